"""Rows to the interval of their key that holds them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.skew import broadcast_if_small


def overlapping(intervals: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """(keys, start, end) of the intervals that begin before an earlier one of their key has ended; both ends count as inside,
    NULL is open. Intervals without a known key overlap nothing."""
    known = intervals.where(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    earlier = Window.partitionBy(*keys).orderBy(F.col(start).asc_nulls_first(), F.col(end).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    # An earlier interval with an open end reaches everything behind it.
    reach = F.when(F.count_if(F.col(end).isNull()).over(earlier) > 0, F.lit(True)).otherwise(F.max(end).over(earlier) >= F.col(start))
    again = (F.count(F.lit(1)).over(earlier) > 0) & (F.col(start).isNull() | reach)
    return known.withColumn("_hit", again).where("_hit").select(*keys, start, end)


def interval_join(rows: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: int = 12) -> DataFrame:
    """``rows``, each with the other columns of the interval of its key that holds ``at`` (ends included), or NULLs.

    Periods are cut into bins of ``width``; an interval is filed under every bin it touches, so the join is an equi-join on
    key and bin, whatever the number of intervals a key has. Open ends reach to the first and last period of the rows.
    Overlapping intervals are an error, as a row would come out twice. Rows with a NULL key or period keep NULLs.
    """
    bad = overlapping(intervals, keys, start, end).take(3)
    if bad:
        raise ValueError(f"overlapping intervals, such as {[tuple(r) for r in bad]}")
    span = rows.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    if span["lo"] is None:
        span = {"lo": 0, "hi": 0}
    first, last = (F.coalesce(F.col(c), F.lit(v)) for c, v in ((start, span["lo"]), (end, span["hi"])))
    first, last = F.greatest(first, F.lit(span["lo"])), F.least(last, F.lit(span["hi"]))
    bin_of = lambda c: F.floor(c / F.lit(width)).cast("long")
    filed = intervals.where(first <= last).withColumn("_bin", F.explode(F.sequence(bin_of(first), bin_of(last))))
    filed = filed.withColumnsRenamed({c: f"_i_{c}" for c in intervals.columns})
    inside: list[Column] = [F.col(k) == F.col(f"_i_{k}") for k in keys]
    inside += [bin_of(F.col(at)) == F.col("_bin"), F.coalesce(F.col(at) >= F.col(f"_i_{start}"), F.lit(True)), F.coalesce(F.col(at) <= F.col(f"_i_{end}"), F.lit(True))]
    joined = rows.join(broadcast_if_small(filed), reduce(and_, inside), "left")
    return joined.select(*rows.columns, *[F.col(f"_i_{c}").alias(c) for c in intervals.columns if c not in keys])
