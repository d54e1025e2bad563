"""Shares of group and grand totals, group counts and group means carried on rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.skew import attach_group_stats


def share_of_group(df: DataFrame, keys: Sequence[str], value: str, output: str, *, bounded: bool = False) -> DataFrame:
    """value / group total."""
    total = attach_group_stats(df, keys, {"_total": F.sum(value)}, bounded=bounded)
    return total.withColumn(output, F.try_divide(F.col(value), F.col("_total"))).drop("_total")


def share_of_all(df: DataFrame, value: str, output: str) -> DataFrame:
    """value / grand total. The total is a scalar subquery: a window without keys would run in one task."""
    return df.withColumn(output, F.try_divide(F.col(value), df.agg(F.sum(value)).scalar()))


def group_size(df: DataFrame, keys: Sequence[str], output: str, *, bounded: bool = False) -> DataFrame:
    return attach_group_stats(df, keys, {output: F.count(F.lit(1))}, bounded=bounded)


def group_mean(df: DataFrame, keys: Sequence[str], value: Column, output: str, *, bounded: bool = False) -> DataFrame:
    """Mean over the group on every row, NULL if any value of the group is missing."""
    stats = {"_mean": F.avg(value), "_missing": F.count_if(value.isNull())}
    out = attach_group_stats(df, keys, stats, bounded=bounded)
    return out.withColumn(output, F.when(F.col("_missing") == 0, F.col("_mean"))).drop("_mean", "_missing")


def rank_by_mean(df: DataFrame, category: str, value: str) -> DataFrame:
    """Category order by descending mean: rows keep their grain, with ``avg`` and ``ord``.

    The ranking runs on the aggregated category table, one row per category.
    """
    means = df.groupBy(category).agg(F.avg(value).alias("avg"))
    ranked = means.withColumn("ord", F.dense_rank().over(Window.orderBy(F.col("avg").desc())))
    return df.join(ranked, df[category].eqNullSafe(ranked[category]), "left").drop(ranked[category])
