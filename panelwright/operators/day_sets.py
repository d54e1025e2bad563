"""Distinct days as sets that can be merged: one 32-bit number for each key and month, a bit for each day.

Batches (months, care types, late deliveries) are turned into sets once; distinct days over any union of batches come from
the sets, without the facts. A fixed-size bitmap per key would take kilobytes for each; a month has at most 31 days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.dates import month_start


def day_sets(facts: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """(keys, month, days): bit d - 1 of ``days`` stands for day d of the month. Rows without a date are in no set; tasks add up
    their own bits before the shuffle, so a key's rows never meet as rows."""
    bit = F.call_function("shiftleft", F.lit(1), F.dayofmonth(day) - 1)
    return facts.where(F.col(day).isNotNull()).groupBy(*keys, month_start(F.col(day)).alias("month")).agg(F.bit_or(bit).alias("days"))


def merge_sets(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The union of sets of several batches, one row for each key and month; merging twice changes nothing."""
    return sets.groupBy(*keys, "month").agg(F.bit_or("days").alias("days"))


def n_days(days: Column) -> Column:
    """Number of days in a set."""
    return F.bit_count(days).cast("bigint")


def count_days(sets: DataFrame, keys: Sequence[str], output: str = "n_days") -> DataFrame:
    """(keys, n_days): distinct days over all months and batches."""
    merged = merge_sets(sets, [k for k in keys])
    return merged.groupBy(*keys).agg(F.sum(n_days(F.col("days"))).alias(output))
