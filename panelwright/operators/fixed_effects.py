"""Two-way fixed-effects event studies.

Unit effects are removed by subtracting unit means; period effects stay as dummies. Tasks reduce their rows to one small
cross-product matrix per fit, these are added up by fit, and each fit is solved from its p x p matrix. All fits (copies,
moderators, outcomes) are keys of one job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType, StructField, StructType)

from panelwright.operators.cleaning import complete_cases
from panelwright.operators.skew import attach_group_stats

ALIAS_TOLERANCE = 1e-9


@dataclass(frozen=True)
class EventStudy:
    """Outcome on treatment groups x periods, covariates and unit effects; the first period is the base."""

    outcome: str
    unit: str
    period: str
    periods: Sequence[int]
    treatments: Sequence[tuple[str, Column]]
    covariates: Sequence[str] = ()
    moderator: str | None = None
    columns: list[tuple[str, str, int, int, Column]] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "columns", list(self._columns()))

    def _columns(self) -> Iterator[tuple[str, str, int, int, Column]]:
        """(kind, group, period, moderated, value) in the order in which redundant columns give way."""
        dummies = [(p, F.when(F.col(self.period) == p, 1.0).otherwise(0.0)) for p in self.periods[1:]]
        treat = [(name, t.cast("double")) for name, t in self.treatments]
        mod = None if self.moderator is None else F.col(self.moderator).cast("double")
        yield from (("treatment", name, 0, 0, t) for name, t in treat)
        yield from (("period", "", p, 0, d) for p, d in dummies)
        if mod is not None:
            yield "moderator", "", 0, 1, mod
        yield from (("covariate", c, 0, 0, F.col(c).cast("double")) for c in self.covariates)
        yield from (("effect", name, p, 0, t * d) for name, t in treat for p, d in dummies)
        if mod is not None:
            yield from (("treatment", name, 0, 1, t * mod) for name, t in treat)
            yield from (("period", "", p, 1, d * mod) for p, d in dummies)
            yield from (("effect", name, p, 1, t * d * mod) for name, t in treat for p, d in dummies)


def demean(df: DataFrame, keys: Sequence[str], columns: Sequence[str], *, bounded: bool = True) -> DataFrame:
    """Subtract group means; deviations at rounding level become exact zeros. Adds ``_n``, the group size."""
    stats = {"_n": F.count(F.lit(1)), **{f"_m_{c}": F.avg(c) for c in columns}}
    out = attach_group_stats(df, keys, stats, bounded=bounded)

    def centred(c: str) -> Column:
        d = F.col(c) - F.col(f"_m_{c}")
        return F.when(F.abs(d) <= 1e-11 * F.abs(F.col(f"_m_{c}")), 0.0).otherwise(d)

    return out.withColumns({c: centred(c) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def cross_products(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """(keys, i, j, v): sums of products of the elements of an array column, i <= j, added up by key."""
    keys = list(keys)
    fields = [df.schema[k] for k in keys]
    schema = StructType([*fields, StructField("i", IntegerType()), StructField("j", IntegerType()),
                         StructField("v", DoubleType())])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False):
                x = np.stack(part[vector].to_numpy())
                sums[key] = sums.get(key, 0) + x.T @ x
        for key, s in sums.items():
            i, j = np.triu_indices(len(s))
            yield pd.DataFrame({**dict(zip(keys, key)), "i": i.astype("int32"), "j": j.astype("int32"), "v": s[i, j]})

    return df.select(*keys, vector).mapInPandas(partial, schema).groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def independent_columns(gram: np.ndarray) -> list[int]:
    """Columns kept when each one that depends linearly on those before it is left out."""
    kept: list[int] = []
    for j in range(len(gram)):
        left = gram[j, j]
        if kept:
            sub = gram[np.ix_(kept, kept)]
            left = left - gram[j, kept] @ np.linalg.solve(sub, gram[kept, j])
        if gram[j, j] > 0 and left > ALIAS_TOLERANCE * gram[j, j]:
            kept.append(j)
    return kept


def solve_fit(matrix: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray, int, int]:
    """Least squares from the cross-products of [x..., y, 1, 1/sqrt(unit size)]."""
    p = len(matrix) - 3
    n, units = int(round(matrix[p + 1, p + 1])), int(round(matrix[p + 2, p + 2]))
    scale = np.sqrt(np.maximum(np.diag(matrix)[:p], 1e-300))
    gram, xy = matrix[:p, :p] / np.outer(scale, scale), matrix[:p, p] / scale
    kept = independent_columns(gram)
    inverse = np.linalg.inv(gram[np.ix_(kept, kept)])
    beta = inverse @ xy[kept]
    freedom = n - units - len(kept)
    rss = max(matrix[p, p] - beta @ xy[kept], 0.0)
    sigma2 = rss / freedom if freedom > 0 else np.nan
    s = scale[kept]
    return kept, beta / s, sigma2 * inverse / np.outer(s, s), n, units


def fit_event_study(panel: DataFrame, spec: EventStudy, keys: Sequence[str] = ("imp",)) -> DataFrame:
    """Tidy effects: (keys, parity_group, quarter, kind, coef, se, n_rows, n_units, n_dropped).

    ``kind`` is ``effect`` for treatment x period; with a moderator ``effect`` is the base level's, ``difference`` the
    interaction with the moderator, and ``total`` their sum with its own standard error. Incomplete rows are left out
    before unit means are taken.
    """
    keys = list(keys)
    needed = [spec.outcome, spec.unit, spec.period, *spec.covariates, *([spec.moderator] if spec.moderator else [])]
    names = [f"_x{i}" for i in range(len(spec.columns))]
    design = complete_cases(panel, needed).select(
        *keys, spec.unit, *[c[-1].alias(n) for c, n in zip(spec.columns, names)],
        F.col(spec.outcome).cast("double").alias("_y"))
    design = complete_cases(design, names)
    centred = demean(design, [*keys, spec.unit], [*names, "_y"])
    vector = F.array(*names, "_y", F.lit(1.0), 1 / F.sqrt(F.col("_n")))
    sums = cross_products(centred.select(*keys, vector.alias("v_")), keys, "v_")

    labels = [(kind, group, period, moderated) for kind, group, period, moderated, _ in spec.columns]
    fields = [panel.schema[k] for k in keys]
    schema = StructType([*fields, StructField("parity_group", StringType()), StructField("quarter", IntegerType()),
                         StructField("kind", StringType()), StructField("coef", DoubleType()),
                         StructField("se", DoubleType()), StructField("n_rows", LongType()),
                         StructField("n_units", LongType()), StructField("n_dropped", IntegerType())])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        size = len(labels) + 3
        matrix = np.zeros((size, size))
        matrix[pdf["i"], pdf["j"]] = pdf["v"]
        matrix[pdf["j"], pdf["i"]] = pdf["v"]
        kept, beta, cov, n, units = solve_fit(matrix)
        at = {labels[c]: k for k, c in enumerate(kept)}
        rows = []
        for (kind, group, period, moderated), k in at.items():
            if kind != "effect":
                continue
            rows.append((group, period, "difference" if moderated else "effect", beta[k], np.sqrt(cov[k, k])))
            base = at.get((kind, group, period, 0))
            if moderated and base is not None:
                variance = cov[k, k] + cov[base, base] + 2 * cov[k, base]
                rows.append((group, period, "total", beta[k] + beta[base], np.sqrt(variance)))
        out = pd.DataFrame(rows, columns=["parity_group", "quarter", "kind", "coef", "se"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        out["n_rows"], out["n_units"], out["n_dropped"] = n, units, len(labels) - len(kept)
        return out[[f.name for f in schema.fields]]

    return sums.groupBy(*keys).applyInPandas(solve, schema)
