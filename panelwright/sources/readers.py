"""Table scans. Schemas are declared by the caller; names come out lower_snake."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def lower_snake(df: DataFrame) -> DataFrame:
    """Lower-case snake names; fails on two columns that would collide."""
    names = [re.sub(r"[^0-9a-z]+", "_", c.lower()).strip("_") for c in df.columns]
    clashes = {n for n in names if names.count(n) > 1}
    if clashes:
        raise ValueError(f"column names collide after normalisation: {sorted(clashes)}")
    return df.toDF(*names)


def scan_table(spark: SparkSession, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = lower_snake(spark.table(name))
    return df.select(*columns) if columns else df


def scan_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = lower_snake(spark.read.parquet(path))
    return df.select(*columns) if columns else df


def scan_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Headered CSV with a declared schema: no inference pass over the files."""
    return lower_snake(spark.read.schema(schema).option("header", True).csv(path))


def scan_jdbc(spark: SparkSession, url: str, query_or_table: str, *, partition_column: str, lower: int, upper: int,
              partitions: int, options: Mapping[str, str] | None = None) -> DataFrame:
    """Partitioned warehouse scan. Credentials come from the caller's ``options``."""
    reader = (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", query_or_table)
        .option("partitionColumn", partition_column)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", partitions)
        .options(**(options or {}))
    )
    return lower_snake(reader.load())


def scan_copy(spark: SparkSession, path: str, imp: int) -> DataFrame:
    """One imputed copy of a dataset written by ``write_by_copy``: a partition-pruned scan."""
    return spark.read.parquet(path).where(F.col("imp") == imp)


def inline_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Reference rows stated in code."""
    return spark.createDataFrame(list(rows), schema)


def code_set(spark: SparkSession, codes: Sequence[str], name: str = "code") -> DataFrame:
    return inline_rows(spark, [(c,) for c in codes], f"{name} string")


def run_sql(spark: SparkSession, text: str, views: Mapping[str, DataFrame], **args) -> DataFrame:
    """Parameterised SQL: values and lists are bound as arguments, never spliced into the text."""
    return spark.sql(text, args=args or None, **views)


def list_to_codes(df: DataFrame, column: str, output: str, separator: str = r"\s*,\s*") -> DataFrame:
    """Codes, one per row, from a column that may hold delimited lists."""
    code = F.explode(F.split(F.col(column), separator)).alias(output)
    return df.select(code).where(F.trim(F.col(output)) != "")


def blank_to_null(value: Column, *sentinels: str) -> Column:
    """Missing-value sentinels to NULL."""
    return F.when(~F.trim(value).isin("", *sentinels), value)
