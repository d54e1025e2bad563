"""Recodes, flags and bins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def recode(value: Column, mapping: Mapping, default: Column | None = None) -> Column:
    """Literal recode; values outside the mapping become ``default`` (NULL if not given)."""
    out = None
    for key, label in mapping.items():
        out = (F if out is None else out).when(value == key, F.lit(label))
    return out if default is None else out.otherwise(default)


def flag(condition: Column) -> Column:
    """1/0 flag that stays NULL where the condition is NULL."""
    return F.when(condition.isNull(), F.lit(None)).when(condition, 1).otherwise(0).cast("int")


def bin_right_closed(value: Column, breaks: Sequence[Column]) -> Column:
    """1-based bin of ``(b[k-1], b[k]]``; the lowest break belongs to bin 1, values outside are NULL."""
    index = F.lit(1)
    for cut in breaks[1:-1]:
        index = index + F.when(value > cut, 1).otherwise(0)
    return F.when((value >= breaks[0]) & (value <= breaks[-1]), index).cast("int")


def band(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Half-open bands ``[edge, next)``; one label more than edges."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        out = out.when(value < edge, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def ratio_to_baseline(value: Column, baseline: Column, before: Column) -> Column:
    """1 before the cut-off, then value over baseline; NULL for a zero or missing baseline."""
    return F.when(before, F.lit(1.0)).otherwise(F.try_divide(value, baseline))
