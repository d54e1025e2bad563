import pytest
from conftest import rows
from pyspark.sql import functions as F

from panelwright.operators import batches


@pytest.fixture()
def facts(spark, tmp_path):
    df = spark.range(90).select(F.expr("date '2020-01-01' + cast(id % 3 * 31 AS int)").alias("m"), (F.col("id") % 7).alias("x"))
    batches.lay_out(df.withColumn("m", F.trunc("m", "MM")), "m", str(tmp_path / "facts"))
    return str(tmp_path / "facts")


MONTHS = ["2020-01-01", "2020-02-01", "2020-03-01"]


def test_a_failed_month_is_run_again_and_finished_ones_are_not(spark, tmp_path, facts):
    ledger, out, seen = batches.Ledger(spark, str(tmp_path / "ledger")), str(tmp_path / "out"), []

    def compute(df):
        month = df.first()["m"].isoformat()
        seen.append(month)
        if month == MONTHS[1] and seen.count(month) == 1:
            raise ValueError("no")
        return df.groupBy("x").agg(F.count(F.lit(1)).alias("n"))

    with pytest.raises(batches.MonthFailed) as failure:
        batches.run_months(spark, facts, "m", MONTHS, compute, out, ledger)
    assert list(failure.value.months) == [MONTHS[1]] and ledger.finished() == {MONTHS[0]: 7, MONTHS[2]: 7}
    assert batches.run_months(spark, facts, "m", MONTHS, compute, out, ledger) == [MONTHS[1]]
    assert batches.run_months(spark, facts, "m", MONTHS, compute, out, ledger) == []
    assert seen == [*MONTHS, MONTHS[1]] and spark.read.parquet(out).agg(F.sum("n")).first()[0] == 90


def test_a_month_cut_off_before_its_entry_leaves_nothing_twice(spark, tmp_path, facts):
    class Cut(batches.Ledger):
        def enter(self, month, n):
            raise OSError("cut off")

    out, book = str(tmp_path / "out"), str(tmp_path / "ledger")
    with pytest.raises(batches.MonthFailed):
        batches.run_months(spark, facts, "m", MONTHS[:1], lambda d: d.select("x"), out, Cut(spark, book))
    batches.run_months(spark, facts, "m", MONTHS[:1], lambda d: d.select("x"), out, batches.Ledger(spark, book))
    assert spark.read.parquet(out).count() == 30


def test_a_month_reads_its_own_directory_only(spark, facts, capsys):
    month = batches.month_of(spark, facts, "m", MONTHS[1])
    month.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(m" in plan
    assert all(f"m={MONTHS[1]}" in r[0] for r in month.select("_metadata.file_path").distinct().collect())
    assert rows(month.select("m").distinct().select(F.col("m").cast("string"))) == [(MONTHS[1],)]
