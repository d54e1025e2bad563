import zipfile

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelwright.functions.dates import in_years
from panelwright.operators import describe, reshape
from panelwright.session import shared_folder, ship_package
from panelwright.sources import readers, writers


def test_names_are_normalised_and_clashes_fail(spark):
    df = spark.createDataFrame([(1, 2)], "`ZIP3` int, `Race.Code` int")
    assert readers.lower_snake(df).columns == ["zip3", "race_code"]
    with pytest.raises(ValueError, match="collide"):
        readers.lower_snake(spark.createDataFrame([(1, 2)], "`Race.Code` int, race_code int"))


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, 1.5)], "Id int, name string, v double")
    writers.write_csv(df, str(tmp_path / "c"))
    back = readers.scan_csv(spark, str(tmp_path / "c"), StructType.fromDDL("id int, name string, v double"))
    assert rows(back) == [(1, "a", None), (2, None, 1.5)]


def test_one_copy_is_a_pruned_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "copies")
    writers.write_by_copy(reshape.stack_copies(spark.range(10), 4), path)
    one = readers.scan_copy(spark, path, 3)
    assert one.count() == 10
    one.explain("formatted")
    assert "PartitionFilters: [isnotnull(imp" in capsys.readouterr().out


def test_repeated_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "append")
    for batch in ("a", "b", "a"):
        writers.append_batch(spark.range(3), path, batch)
    assert spark.read.parquet(path).count() == 6


def test_shared_table_append_is_idempotent(spark):
    rows_in = spark.createDataFrame([("F32", 1), ("F33", 2), ("F32", 1)], "code string, n int")
    spark.sql("DROP TABLE IF EXISTS shared_codes")
    for _ in range(2):
        writers.append_table(rows_in, "shared_codes", ["code"])
    assert rows(readers.scan_table(spark, "shared_codes", ["code"])) == [("F32",), ("F33",)]
    spark.sql("DROP TABLE shared_codes")


def test_settled_tables_read_back(spark):
    assert rows(writers.settle(spark.range(5).where("id > 7"), "none")) == []
    assert rows(writers.settle(spark.range(2), "two")) == [(0,), (1,)]


def test_delimited_lists_and_sentinels(spark):
    df = spark.createDataFrame([("a, b",), ("b",), (None,), (" ",)], "code string")
    assert rows(readers.list_to_codes(df, "code", "c").distinct()) == [("a",), ("b",)]
    out = df.select(readers.blank_to_null(F.col("code"), "b").alias("v"))
    assert rows(out) == [("a, b",), (None,), (None,), (None,)]


def test_parameters_are_bound_not_spliced(spark):
    df = spark.createDataFrame([("it's",), ("b",)], "code string")
    out = readers.run_sql(spark, "SELECT code FROM {t} WHERE array_contains(:codes, code)", {"t": df}, codes=["it's"])
    assert rows(out) == [("it's",)]


def test_stratified_table_has_an_overall_column(spark):
    df = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 3.0), ("h", "a", 5.0)], "grp string, c string, v double")
    out = describe.render_table(describe.stratified_table(df, "grp", ["c"], ["v"]))
    assert rows(out, "grp", "variable", "level", "cell") == [
        ("Overall", "c", "a", "67%"), ("Overall", "c", "b", "33%"), ("Overall", "v", None, "3.0 (2.0)"),
        ("g", "c", "a", "50%"), ("g", "c", "b", "50%"), ("g", "v", None, "2.0 (1.4)"), ("h", "c", "a", "100%"),
        ("h", "v", None, None)]


def test_percent_interval_ignores_weights_of_missing_rates(spark):
    df = spark.createDataFrame([("m", 0.5, 0.2), ("m", None, 0.8)], "m string, x double, w double")
    out = describe.weighted_percent_ci(df, ["m"], "x", "w", lenient=True).first()
    assert out["percent"] == 50.0 and out["uci"] == pytest.approx(50 + 1.96 * (0.2 ** 2 * 50 * 50) ** 0.5)
    assert describe.weighted_percent_ci(df, ["m"], "x", "w").first()["percent"] is None


class _Cluster:
    """As much of a session as ``shared_folder`` looks at."""

    def __init__(self, master, folder=None):
        self.sparkContext = self
        self.master, self.folder, self.conf = master, folder, {}

    def getCheckpointDir(self):
        return self.folder


def test_shared_folder_is_named_or_local():
    assert shared_folder(_Cluster("spark://host:7077", "hdfs://x/shared")) == "hdfs://x/shared"
    assert shared_folder(_Cluster("local[4]")) == shared_folder(_Cluster("local"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(_Cluster(master))


def test_archive_for_the_workers_holds_the_package(spark):
    names = zipfile.ZipFile(ship_package(spark)).namelist()
    assert "panelwright/__init__.py" in names and "panelwright/operators/skew.py" in names


def test_year_prefixes_reach_the_scan(spark, tmp_path, capsys):
    spark.createDataFrame([("20190102",), ("2021-03-04",), (None,), ("2020",)], "date string").write.parquet(str(tmp_path / "p"))
    found = spark.read.parquet(str(tmp_path / "p")).where(in_years(F.col("date"), (2019, 2020)))
    found.explain("formatted")
    assert "PushedFilters: [Or(StringStartsWith(date,2019),StringStartsWith(date,2020))]" in capsys.readouterr().out
    assert sorted(r["date"] for r in found.collect()) == ["2019" "0102", "2020"]
