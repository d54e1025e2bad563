"""Equi-joins with their keys stated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.skew import broadcast_if_small


def natural_left_join(left: DataFrame, right: DataFrame, expect: Sequence[str]) -> DataFrame:
    """Left join on all shared column names, which must be exactly ``expect``: a stray shared name fails loudly."""
    shared = [c for c in left.columns if c in right.columns]
    if set(shared) != set(expect):
        raise ValueError(f"shared columns are {shared}, expected {list(expect)}")
    return left.join(right, shared, "left")


def renamed_left_join(left: DataFrame, right: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Left join where the right key columns carry other names; the right keys are dropped."""
    right = right.withColumnsRenamed({r: f"_r_{r}" for r in keys.values()})
    on = reduce(and_, [left[k] == F.col(f"_r_{r}") for k, r in keys.items()])
    return left.join(right, on, "left").drop(*[f"_r_{r}" for r in keys.values()])


def coalesce_join(left: DataFrame, right: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Left join on ``keys`` when both sides own ``column``: the left value wins, the right one fills."""
    other = right.select(*keys, F.col(column).alias("_other"))
    joined = left.join(other, list(keys), "left")
    return joined.withColumn(column, F.coalesce(column, "_other")).drop("_other")


def suffixed_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join where other columns share names: the left's get the suffix ``_x``, the right's ``_y``."""
    shared = (set(left.columns) & set(right.columns)) - set(keys)
    renamed = lambda df, end: df.withColumnsRenamed({c: f"{c}{end}" for c in shared})
    return renamed(left, "_x").join(renamed(right, "_y"), list(keys), "left")


def require_unique(dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail when a lookup key occurs twice: a left join on it would multiply fact rows and their weights."""
    twice = dimension.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"lookup keys are not unique, e.g. {[tuple(r)[:-1] for r in twice]}")
    return dimension


def lookup(facts: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join to a dimension with unique keys; broadcast when its counted size allows."""
    return facts.join(broadcast_if_small(dimension), list(keys), "left")


def keep_listed(facts: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is listed."""
    return facts.join(broadcast_if_small(listed.select(*keys)), list(keys), "left_semi")


def drop_listed(facts: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """SQL NOT IN: rows whose key is known and not listed."""
    codes = broadcast_if_small(listed.select(key).where(F.col(key).isNotNull()))
    return facts.where(F.col(key).isNotNull()).join(codes, key, "left_anti")
