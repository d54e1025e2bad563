"""Multiple imputation of categorical columns.

Completed data is kept sparse: a row without missing targets appears once with ``imp`` NULL, a row with missing targets
once per copy. ``stack_completed`` gives the dense stack of m copies.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.draws import draw_int, draw_uniform
from panelwright.operators.reshape import stack_copies
from panelwright.operators.skew import broadcast_if_small
from panelwright.operators.softmax import fit_softmax
from panelwright.sources.writers import settle


def open_copies(df: DataFrame, targets: Sequence[str], m: int) -> DataFrame:
    """Sparse stack: only rows with a missing target are copied m times; original missingness is kept as flags."""
    missing = reduce(lambda a, b: a | b, [F.col(t).isNull() for t in targets])
    copies = F.when(missing, F.sequence(F.lit(1), F.lit(m))).otherwise(F.array(F.lit(None).cast("int")))
    return df.withColumn("imp", F.explode(copies))


def stack_completed(sparse: DataFrame, m: int) -> DataFrame:
    """Dense stack keyed by ``imp``."""
    every = F.when(F.col("imp").isNull(), F.sequence(F.lit(1), F.lit(m))).otherwise(F.array("imp"))
    return sparse.withColumn("imp", F.explode(every))


def donor_table(df: DataFrame, strata: Sequence[str], target: str, count: str | None = None) -> DataFrame:
    """(strata, donors): observed classes of a stratum with running counts, in class order.

    Counts per class are taken first, so the list of a stratum is as long as the number of classes. ``count`` names a column
    of rows that are already added up.
    """
    n = F.count(F.lit(1)) if count is None else F.sum(count)
    counts = df.where(F.col(target).isNotNull()).groupBy(*strata, target).agg(n.alias("_n"))
    ordered = Window.partitionBy(*strata).orderBy(target)
    running = counts.withColumn("_upto", F.sum("_n").over(ordered))
    pairs = F.array_sort(F.collect_list(F.struct(F.col("_upto").alias("upto"), F.col(target).alias("class"))))
    return running.groupBy(*strata).agg(pairs.alias("donors"))


def _pick(donors: Column, draw: Column) -> Column:
    """Class whose running count first exceeds draw modulo the number of donors."""
    total = F.element_at(donors, -1)["upto"]
    r = draw % total
    return F.element_at(F.filter(donors, lambda d: d["upto"] > r), 1)["class"]


def hot_deck(sparse: DataFrame, observed: DataFrame, target: str, strata: Sequence[str], key: Column,
             seed: int, count: str | None = None) -> DataFrame:
    """Fill ``target`` by drawing an observed value of the same stratum, or of all rows if the stratum has none.

    ``sparse`` carries ``imp``; draws depend on (key, imp, seed) only, so copies and retries are reproducible.
    """
    by_stratum = broadcast_if_small(donor_table(observed, strata, target, count).withColumnsRenamed(
        {s: f"_s_{s}" for s in strata}))
    anyone = donor_table(observed.withColumn("_all", F.lit(1)), ["_all"], target, count).select("donors").scalar()
    on = reduce(and_, [F.col(s).eqNullSafe(F.col(f"_s_{s}")) for s in strata])
    draw = draw_int(key, F.coalesce("imp", F.lit(0)), seed)
    joined = sparse.join(by_stratum, on, "left").withColumn("donors", F.coalesce("donors", anyone))
    filled = F.coalesce(F.col(target), _pick(F.col("donors"), draw))
    return joined.withColumn(target, filled).select(*sparse.columns)


def _poisson_one(u: Column) -> Column:
    """Poisson(1) count by inverse CDF: the weight of a row in a bootstrap copy."""
    count = F.lit(0)
    for cut in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
                0.9963401531726563, 0.9994058151824183, 0.9999167588507119):
        count = count + F.when(u > cut, 1).otherwise(0)
    return count


def model_based(sparse: DataFrame, observed: DataFrame, target: str, classes: Sequence, features: Sequence[Column],
                key: Column, m: int, seed: int, by_copy: bool = False) -> DataFrame:
    """Fill ``target`` from a multinomial (two classes: logistic) model refitted on a bootstrap copy per imputation.

    ``by_copy``: ``observed`` carries ``imp``, as its other columns differ from copy to copy.

    Donors with equal features are added up before fitting; one lookup carries the m small coefficient vectors to the
    rows, and a replayable uniform picks the class.
    """
    vector = F.array(F.lit(1.0), *[f.cast("double") for f in features])
    code = reduce(lambda acc, kv: acc.when(F.col(target) == kv[1], kv[0]), enumerate(classes), F)
    known = observed.where(F.col(target).isNotNull()).select(*(["imp"] if by_copy else []), vector.alias("x"), code.alias("y"), key.alias("_key"))
    donors = (
        (known if by_copy else stack_copies(known, m))
        .withColumn("w", _poisson_one(draw_uniform(F.col("_key"), F.col("imp"), seed + 1)))
        .where("w > 0").groupBy("imp", "x", "y").agg(F.sum("w").cast("double").alias("w"))
    )
    betas = fit_softmax(donors, ["imp"], "x", "y", "w", len(classes))
    p = len(features) + 1

    def score(k: int) -> Column:
        slope = F.slice("beta", k * p + 1, p)
        return F.aggregate(F.zip_with(slope, "_x", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)

    raw = F.array(F.lit(0.0), *[score(k) for k in range(len(classes) - 1)])
    top = F.array_max("_raw")
    weights = F.transform("_raw", lambda s: F.exp(s - top))
    total = F.aggregate("_w", F.lit(0.0), lambda acc, v: acc + v)
    threshold = draw_uniform(key, F.coalesce("imp", F.lit(0)), seed) * total
    joined = sparse.join(F.broadcast(betas), "imp", "left").withColumn("_x", vector)
    drawn = joined.withColumn("_raw", raw).withColumn("_w", weights).withColumn("_t", threshold)
    running = F.lit(0.0)
    pick = F
    for k, label in enumerate(classes):
        running = running + F.element_at("_w", k + 1)
        pick = pick.when(F.col("_t") <= running, F.lit(label))
    pick = pick.otherwise(F.lit(classes[-1]))
    filled = F.coalesce(F.col(target), F.when(F.col("beta").isNotNull(), pick))
    return drawn.withColumn(target, filled).select(*sparse.columns)


# Chained equations --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Target:
    """A column to impute and what it is imputed from.

    ``sees``: names of features, of plain columns (``deck``) or of other targets. ``kind`` ``model``: (multinomial) logit on
    the features and on indicators of the targets; ``deck``: an observed value of the same stratum.
    """

    name: str
    classes: tuple
    sees: tuple[str, ...] = ()
    kind: str = "model"

    def __post_init__(self):
        if self.kind not in ("model", "deck") or self.name in self.sees:
            raise ValueError(f"{self.name}: kind {self.kind}, sees {self.sees}")


def chained(df: DataFrame, targets: Sequence[Target], features: Mapping[str, Column], key: Column, m: int, passes: int = 1,
            seed: int = 0) -> DataFrame:
    """Multiple imputation by chained equations, sparse (see ``open_copies``).

    All gaps are first filled by draws from the column's observed values. Each pass then visits the targets in turn: a target's
    gaps are opened again and filled from its own equation, fitted per copy to the rows in which it was observed, with the
    other targets as the copy now has them. Only rows with a gap are copied and rewritten; of complete rows a model
    reads m copies while it is fitted, a deck counts them once. Draws depend on (key, copy, seed, pass, target) only.

    A target without any observed value stays NULL. Rows without gaps pass through; an empty table gives no rows.
    """
    names, gap = [t.name for t in targets], lambda n: f"_gap_{n}"
    if len(set(names)) < len(names):
        raise ValueError(f"targets named twice: {names}")
    rows = open_copies(df.withColumns({gap(n): F.col(n).isNull() for n in names}), names, m)
    whole, open_rows = rows.where("imp IS NULL"), rows.where("imp IS NOT NULL")
    for j, t in enumerate(targets):
        anyone = donor_table(df.withColumn("_all", F.lit(1)), ["_all"], t.name).select("donors").scalar()
        drawn = _pick(F.col("_all"), draw_int(key, F.col("imp"), seed + j))
        open_rows = open_rows.withColumn("_all", anyone).withColumn(t.name, F.coalesce(t.name, drawn)).drop("_all")
    open_rows = settle(open_rows, "chain")
    for step in range(passes * len(targets)):
        t = targets[step % len(targets)]
        at = seed + 10 * (step + 1) + len(targets)
        emptied = open_rows.withColumn(t.name, F.when(~F.col(gap(t.name)), F.col(t.name)))
        filled = _deck_step(emptied, whole, t, key, m, at) if t.kind == "deck" else _model_step(emptied, whole, t, targets, features, key, m, at)
        open_rows = settle(filled, "chain")
    return whole.unionByName(open_rows).drop(*[gap(n) for n in names])


def _deck_step(emptied: DataFrame, whole: DataFrame, t: Target, key: Column, m: int, seed: int) -> DataFrame:
    by = [*t.sees, t.name]
    count = lambda df, *more: df.groupBy(*more, *by).agg(F.count(F.lit(1)).alias("_c"))
    donors = stack_copies(count(whole), m).unionByName(count(emptied, "imp"))
    return hot_deck(emptied, donors, t.name, ["imp", *t.sees], key, seed, "_c")


def _model_step(emptied: DataFrame, whole: DataFrame, t: Target, targets: Sequence[Target], features: Mapping[str, Column], key: Column,
                m: int, seed: int) -> DataFrame:
    others = {o.name: o for o in targets}
    vector: list[Column] = []
    for name in t.sees:
        vector += [F.when(F.col(name) == c, 1).otherwise(0) for c in others[name].classes[1:]] if name in others else [features[name]]
    observed = stack_completed(whole, m).unionByName(emptied)
    return model_based(emptied, observed, t.name, t.classes, vector, key, m, seed, by_copy=True)
