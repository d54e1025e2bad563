"""Month-by-month runs that can be stopped and taken up again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.sources.writers import append_batch


def lay_out(facts: DataFrame, month: str, path: str) -> None:
    """Write facts with one directory a month; a month's rows are split over as many files as there are tasks that meet it, so a
    large month is not funnelled through one writer."""
    facts.write.mode("overwrite").partitionBy(month).parquet(path)


def month_of(spark: SparkSession, path: str, column: str, month: str) -> DataFrame:
    """The facts of one month; only its directory is read."""
    return spark.read.parquet(path).where(F.col(column) == F.lit(month).cast("date"))


class Ledger:
    """Finished months of a run, one small directory each; a month is entered after its result is in place."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def finished(self) -> dict[str, int]:
        """Months with the number of rows that they gave."""
        try:
            entries = self.spark.read.schema("n bigint, batch string").parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return {}
            raise
        return {r["batch"]: r["n"] for r in entries.collect()}

    def enter(self, month: str, n: int) -> None:
        append_batch(self.spark.createDataFrame([(n,)], "n bigint"), self.path, month)


class MonthFailed(RuntimeError):
    """Some months of a run did not finish; ``months`` maps them to their errors. The others are in place."""

    def __init__(self, months: dict[str, Exception]):
        super().__init__(", ".join(f"{m}: {type(e).__name__}: {e}" for m, e in months.items()))
        self.months = months


def run_months(spark: SparkSession, facts: str, column: str, months: Sequence[str], compute: Callable[[DataFrame], DataFrame], out: str,
               ledger: Ledger) -> list[str]:
    """Run ``compute`` on the facts of each month that the ledger lacks, and write the result as the month's partition of ``out``.

    A month replaces its own partition only, and is entered in the ledger afterwards; so one that was cut off half-way is
    run again and leaves nothing twice, and one that has finished is not read again. A failing month does not
    stop the others; they are reported together at the end. Returns the months that were run.
    """
    done, failed, run = ledger.finished(), {}, []
    for month in months:
        if month in done:
            continue
        run.append(month)
        try:
            append_batch(compute(month_of(spark, facts, column, month)), out, month)
            ledger.enter(month, month_of_result(spark, out, month).count())
        except Exception as error:  # noqa: BLE001  (any failure of a month is reported, none is dropped)
            failed[month] = error
    if failed:
        raise MonthFailed(failed)
    return run


def month_of_result(spark: SparkSession, out: str, month: str) -> DataFrame:
    return spark.read.parquet(out).where(F.col("batch").cast("string") == month)
