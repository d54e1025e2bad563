"""Column helpers for expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, also where ``use`` reads it inside a loop over an array."""
    return F.transform(F.array(value), use)[0]


def double_array(values: Sequence[float]) -> Column:
    """A constant array, sent with the plan; for bounded tables only."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
