"""Many fixed-effects models from one pass over a panel.

Models that use the same rows share one wide cross-product per key (imputed copy): all their columns side by side, unit means
taken out. Tasks add up their units' cross-products, so what is shuffled is one matrix per task, row set and key. A model is then
solved from the wide matrix alone, by sweeping its own columns in the order in which redundant ones give way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from panelwright.operators.fixed_effects import ALIAS_TOLERANCE


class Term(NamedTuple):
    """A column of a model: treatment, period, moderator or covariate, or a product of the first three."""

    kind: str
    group: str
    period: int
    moderator: str


@dataclass(frozen=True)
class Model:
    """Outcome on treatments x periods, covariates and unit effects over one row set; the first period is the base."""

    name: str
    rows: str
    outcome: str
    periods: tuple[int, ...]
    treatments: tuple[str, ...] = ()
    covariates: tuple[str, ...] = ()
    moderator: str = ""

    @property
    def needed(self) -> frozenset[str]:
        """Columns that must be known for a row to count."""
        return frozenset({self.outcome, *self.treatments, *self.covariates, *([self.moderator] if self.moderator else [])})

    def terms(self) -> list[Term]:
        """Columns in the order in which redundant ones give way."""
        later, m = self.periods[1:], self.moderator
        out = [Term("treatment", t, 0, "") for t in self.treatments] + [Term("period", "", p, "") for p in later]
        out += [Term("moderator", "", 0, m)] if m else []
        out += [Term("covariate", c, 0, "") for c in self.covariates]
        out += [Term("effect", t, p, "") for t in self.treatments for p in later]
        if m:
            out += [Term("treatment", t, 0, m) for t in self.treatments] + [Term("period", "", p, m) for p in later]
            out += [Term("effect", t, p, m) for t in self.treatments for p in later]
        return out


@dataclass(frozen=True)
class Wide:
    """One cross-product for all models with the same rows and the same needed columns."""

    rows: str
    needed: frozenset[str]
    terms: tuple[Term, ...]
    outcomes: tuple[str, ...]
    models: tuple[Model, ...]


def plan(models: Sequence[Model]) -> list[Wide]:
    """Group models by what rows they use; treatments that come from each other's rows never add to what is needed."""
    out: dict[tuple, list[Model]] = {}
    for m in models:
        out.setdefault((m.rows, m.needed - set(m.treatments)), []).append(m)
    wide = []
    for (rows, needed), members in out.items():
        terms = tuple(dict.fromkeys(t for m in members for t in m.terms()))
        wide.append(Wide(rows, needed, terms, tuple(dict.fromkeys(m.outcome for m in members)), tuple(members)))
    return wide


def sweep(a: np.ndarray, k: int) -> None:
    """Sweep a symmetric matrix in place on pivot k: regress every other column on column k."""
    d = a[k, k]
    row, column = a[k] / d, a[:, k].copy()
    a -= np.outer(column, row)
    a[k], a[:, k] = row, -column / d
    a[k, k] = 1 / d


def solve(gram: np.ndarray, xy: np.ndarray, yy: float, n: int, units: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(kept columns, coefficients, covariance) of a least-squares fit with ``units`` unit effects already taken out.

    A column is left out if what the columns before it leave of it is below ``ALIAS_TOLERANCE`` of its own sum of squares.
    """
    p = len(gram)
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    a = np.empty((p + 1, p + 1))
    a[:p, :p], a[p, p] = gram / np.outer(scale, scale), yy
    a[p, :p] = a[:p, p] = xy / scale
    kept = []
    for k in range(p):
        if gram[k, k] > 0 and a[k, k] > ALIAS_TOLERANCE:
            sweep(a, k)
            kept.append(k)
    freedom = n - units - len(kept)
    sigma2 = max(a[p, p], 0.0) / freedom if freedom > 0 else np.nan
    s = scale[kept]
    return kept, a[kept, p] / s, sigma2 * a[np.ix_(kept, kept)] / np.outer(s, s)


def _columns(terms: Sequence[Term], at: dict[str, np.ndarray], period: np.ndarray) -> np.ndarray:
    out = np.ones((len(period), len(terms)))
    for j, t in enumerate(terms):
        if t.group:
            out[:, j] *= at[t.group]
        if t.period:
            out[:, j] *= period == t.period
        if t.moderator:
            out[:, j] *= at[t.moderator]
    return out


def _centre(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Without the mean of each unit (a run of rows); deviations at rounding level become exact zeros."""
    mean = np.repeat(np.add.reduceat(x, start, axis=0) / size[:, None], size, axis=0)
    d = x - mean
    d[np.abs(d) <= 1e-11 * np.abs(mean)] = 0.0
    return d


def gram_matrices(panel: DataFrame, wides: Sequence[Wide], rows: str, unit: str, period: str, keys: Sequence[str]) -> DataFrame:
    """(wide, keys, matrix): cross-products of [terms..., outcomes..., 1, 1/sqrt(unit size)] as flat arrays, one row for each
    task, wide matrix and key.

    ``rows`` is the column that names a row's set. A unit's rows in a set are one per period, so they fit into a list; units
    are dealt to tasks, and a task holds one batch of them at a time besides its sums.
    """
    names = sorted({c for w in wides for m in w.models for c in m.needed})
    values = F.array(*[F.col(c).cast("double") for c in names])
    known = panel.where(F.col(unit).isNotNull() & F.col(period).isNotNull())
    units = known.groupBy(rows, *keys, unit).agg(F.collect_list(F.struct(F.col(period).cast("int").alias("p"), values.alias("v"))).alias("r"))
    units = units.select(rows, *keys, F.col("r.p").alias("p"), F.flatten(F.col("r.v")).alias("v"))
    fields = [panel.schema[k] for k in keys]
    schema = StructType([StructField("wide", IntegerType()), *fields, StructField("matrix", ArrayType(DoubleType()))])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, part in pdf.groupby([rows, *keys], sort=False, dropna=False):
                size = part["p"].map(len).to_numpy()
                times = np.concatenate(part["p"].to_numpy())
                data = np.concatenate(part["v"].to_numpy()).astype(float).reshape(len(times), len(names))
                owner = np.repeat(np.arange(len(size)), size)
                for i, w in enumerate(wides):
                    if w.rows == key[0]:
                        sums[(i, *key[1:])] = sums.get((i, *key[1:]), 0) + _one(w, names, times, data, owner)
        if sums:
            yield pd.DataFrame([(*k, m.ravel()) for k, m in sums.items()], columns=["wide", *keys, "matrix"])

    return units.mapInPandas(partial, schema)


def _one(w: Wide, names: list[str], times: np.ndarray, data: np.ndarray, owner: np.ndarray) -> np.ndarray:
    place = {c: i for i, c in enumerate(names)}
    needed = sorted({c for m in w.models for c in m.needed})
    ok = ~np.isnan(data[:, [place[c] for c in needed]]).any(axis=1)
    size = len(w.terms) + len(w.outcomes) + 2
    if not ok.any():
        return np.zeros((size, size))
    at = {c: data[ok, place[c]] for c in needed}
    x = np.column_stack([_columns(w.terms, at, times[ok]), *[at[c] for c in w.outcomes]])
    start = np.flatnonzero(np.diff(owner[ok], prepend=-1))
    n = np.diff(np.append(start, len(x)))
    z = np.column_stack([_centre(x, start, n), np.ones(len(x)), 1 / np.sqrt(np.repeat(n, n))])
    return z.T @ z


def fit_models(panel: DataFrame, models: Sequence[Model], *, rows: str = "rows", unit: str = "unit", period: str = "quarter",
               keys: Sequence[str] = ("imp",)) -> DataFrame:
    """Tidy coefficients of all models from one pass over the panel.

    (model, keys, parity_group, quarter, kind, coef, se, n_rows, n_units, n_dropped): ``kind`` is ``effect`` for treatment x
    period and ``covariate`` for a covariate (named in ``parity_group``, quarter 0); with a moderator ``effect`` is the base
    level's, ``difference`` the interaction and ``total`` their sum with its own standard error. A row counts for a model if
    all of the model's columns are known; models of one row set that need the same columns, treatments aside, are solved from one
    matrix, so their treatments must be known on the same rows. An empty panel gives no rows.
    """
    keys, wides = list(keys), plan(models)
    parts = gram_matrices(panel, wides, rows, unit, period, keys)
    fields = [panel.schema[k] for k in keys]
    schema = StructType([StructField("model", StringType()), *fields, StructField("parity_group", StringType()),
                         StructField("quarter", IntegerType()), StructField("kind", StringType()), StructField("coef", DoubleType()),
                         StructField("se", DoubleType()), StructField("n_rows", LongType()), StructField("n_units", LongType()),
                         StructField("n_dropped", IntegerType())])

    def solve_all(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, total = wides[key[0]], 0
        for pdf in batches:
            total = total + sum(np.asarray(m) for m in pdf["matrix"])
        size = len(w.terms) + len(w.outcomes) + 2
        out = [(m.name, *key[1:], *r) for m in w.models for r in _tidy(w, m, total.reshape(size, size))]
        yield pd.DataFrame(out, columns=[f.name for f in schema.fields])

    return parts.groupBy("wide", *keys).applyInPandas(solve_all, schema)


def _tidy(w: Wide, model: Model, matrix: np.ndarray) -> Iterator[tuple]:
    terms = model.terms()
    place = {t: i for i, t in enumerate(w.terms)}
    x, y = [place[t] for t in terms], len(w.terms) + w.outcomes.index(model.outcome)
    n, units = (int(round(matrix[i, i])) for i in (-2, -1))
    if not n:
        return
    kept, beta, cov = solve(matrix[np.ix_(x, x)], matrix[x, y], matrix[y, y], n, units)
    at = {terms[c]: k for k, c in enumerate(kept)}
    counts = (n, units, len(terms) - len(kept))
    for t, k in at.items():
        if t.kind not in ("effect", "covariate"):
            continue
        kind = "difference" if t.moderator else t.kind
        yield t.group, t.period, kind, beta[k], float(np.sqrt(cov[k, k])), *counts
        base = at.get(t._replace(moderator=""))
        if t.moderator and base is not None:
            yield t.group, t.period, "total", beta[k] + beta[base], float(np.sqrt(cov[k, k] + cov[base, base] + 2 * cov[k, base])), *counts
