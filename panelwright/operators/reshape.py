"""Long/wide reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def widen(df: DataFrame, keys: Sequence[str], names_from: str, values: Sequence, value: str,
          fill: float | None = None) -> DataFrame:
    """One column per listed value. The list is given, so no extra job runs and the schema is stable."""
    wide = df.groupBy(*keys).pivot(names_from, list(values)).agg(F.max(value))
    return wide if fill is None else wide.fillna(fill, [str(v) for v in values])


def widen_pairs(df: DataFrame, keys: Sequence[str], names_from: str, values: Sequence,
                columns: Sequence[str]) -> DataFrame:
    """Several value columns at once, named ``<column>_<value>``."""
    wide = df.groupBy(*keys).pivot(names_from, list(values)).agg(*[F.max(c).alias(c) for c in columns])
    return wide.withColumnsRenamed({f"{v}_{c}": f"{c}_{v}" for v in values for c in columns})


def lengthen(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def split_term(df: DataFrame, term: str, into: Sequence[str], separator: str = ":") -> DataFrame:
    """Split ``a:b`` into columns; absent parts are NULL."""
    parts = F.split(F.col(term), separator)
    return df.withColumns({name: F.try_element_at(parts, F.lit(i + 1)) for i, name in enumerate(into)})


def stack_copies(df: DataFrame, m: int, output: str = "imp") -> DataFrame:
    """m copies of every row, keyed 1..m; a narrow map, no join."""
    return df.withColumn(output, F.explode(F.sequence(F.lit(1), F.lit(m))))


def treatment_matrix(df: DataFrame, unit: str, period: str, periods: Sequence[int], treat: str) -> DataFrame:
    """Unit x period 0/1 matrix, columns ``t<period>``; NULL where the unit has no row."""
    wide = df.groupBy(unit).pivot(period, list(periods)).agg(F.max(treat))
    return wide.withColumnsRenamed({str(p): f"t{p}" for p in periods})
