"""Joins and group statistics that hold when one key carries a large part of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.sources.writers import settle

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES,
                       reject: Column | None = None) -> DataFrame:
    """Broadcast hint only after counting rows and text bytes; otherwise Catalyst/AQE picks a shuffle join.

    The count is one map-side-combined pass over the lookup side, which saves a shuffle of the fact side when it is
    small. ``reject`` fails the call if any row meets the condition, in the same pass.
    """
    width = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8
                                        for c in df.columns])
    bad = F.lit(0) if reject is None else F.count_if(reject)
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b"), bad.alias("bad")).first()
    if size["bad"]:
        raise ValueError(f"{size['bad']} lookup rows are not unique: a join would multiply fact rows")
    return F.broadcast(df) if size["n"] <= max_rows and (size["b"] or 0) <= max_bytes else df


def attach_group_stats(df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column], *,
                       bounded: bool = False) -> DataFrame:
    """Add per-group aggregates to every row.

    ``bounded``: the caller's grain limits the rows per key (a panel unit has at most one row per period), so a
    plain window does. Otherwise no task ever holds a key's rows: the rows are written once, aggregated with map-side
    partial results, and joined to their group's row; of a hot key, AQE splits the join.
    """
    keys = list(keys)
    if bounded:
        return _window_stats(df, keys, stats)
    rows = settle(df, "rows")
    return _join_stats(rows, _group_stats(rows, keys, stats), keys, stats)


def _group_stats(df: DataFrame, keys: list[str], stats: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(name) for name, c in stats.items()])


def _window_stats(df: DataFrame, keys: list[str], stats: Mapping[str, Column]) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumns({name: c.over(w) for name, c in stats.items()})


def _join_stats(df: DataFrame, grouped: DataFrame, keys: list[str], stats: Mapping[str, Column]) -> DataFrame:
    renamed = grouped.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])
    return df.join(renamed, on, "left").select(*df.columns, *stats)
