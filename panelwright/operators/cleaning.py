"""De-duplication, filling, completeness and attrition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _nulls_last(column: Column) -> Column:
    return F.struct(column.isNull(), column)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: smallest by ``order`` with missing values last, ties broken by all other columns.

    Written as an aggregate rather than ``row_number``: each task keeps one candidate per key before the shuffle,
    so a key with many copies costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    ranking = list(order) + [c for c in rest if c not in order]
    best = F.min_by(F.struct(*rest), F.struct(*[_nulls_last(F.col(c)) for c in ranking]))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column, long form (column_name, n_missing), in one pass."""
    columns = list(columns or df.columns)
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], columns, "column_name", "n_missing")


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(reduce(and_, [F.col(c).isNotNull() for c in columns]))


def attrition(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """Rows entering and leaving each filter of a chain, counted in one pass: (step_no, step, rows_in, rows_out)."""
    passed = F.lit(True)
    counts = [F.count(F.lit(1)).alias("_0")]
    for i, condition in enumerate(steps.values(), 1):
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(passed).alias(f"_{i}"))
    rows = [F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"), F.col(f"_{i - 1}").alias("rows_in"),
                     F.col(f"_{i}").alias("rows_out")) for i, name in enumerate(steps, 1)]
    return df.agg(*counts).select(F.inline(F.array(*rows))).withColumn("dropped", F.col("rows_in") - F.col("rows_out"))


def fill_in_order(df: DataFrame, column: str, sources: Sequence[tuple[DataFrame, Sequence[str], str]],
                  drop_missing: bool = True) -> DataFrame:
    """Fill ``column`` from each source in turn: (table with unique keys, key columns, value column)."""
    candidates = [F.col(column)]
    for i, (table, keys, value) in enumerate(sources):
        name = f"_fill_{i}"
        df = df.join(table.select(*keys, F.col(value).alias(name)), list(keys), "left")
        candidates.append(F.col(name))
    filled = df.withColumn(column, F.coalesce(*candidates)).drop(*[f"_fill_{i}" for i in range(len(sources))])
    return complete_cases(filled, [column]) if drop_missing else filled


def group_mode(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most common non-missing value per key; the smallest value wins a tie."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))
