"""Table sinks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.session import shared_folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/panelwright-{label}-{uuid.uuid4().hex}"


#: Paths written by ``settle`` in this process, oldest first; their owner may remove them when no result is read any more.
SETTLED: list[str] = []


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder once and go on from the files.

    Used where a derived table feeds several branches: the facts behind it are read once, lost executors lose nothing,
    and later joins see the true file sizes.
    """
    path = fresh_path(df.sparkSession, label)
    SETTLED.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Headered CSV without a row-name column."""
    df.write.mode(mode).option("header", True).csv(path)


def write_by_copy(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """All imputed copies in one job, one directory per copy.

    A copy is split over as many tasks as hold its rows, so no copy is funnelled through a single writer.
    """
    df.write.mode(mode).partitionBy("imp").parquet(path)


def append_batch(df: DataFrame, path: str, batch: str) -> None:
    """Append that can be repeated: a batch overwrites its own partition only.

    Replaces read-modify-write of a result file; re-running a batch leaves the dataset unchanged.
    """
    (
        df.withColumn("batch", F.lit(batch))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch")
        .parquet(path)
    )


def append_table(df: DataFrame, table: str, keys: Sequence[str]) -> None:
    """Append to a shared table only rows whose key is not in it yet."""
    spark = df.sparkSession
    fresh = df.dropDuplicates(list(keys))
    if spark.catalog.tableExists(table):
        fresh = fresh.join(spark.table(table).select(*keys), list(keys), "left_anti")
    fresh.write.mode("append").saveAsTable(table)
