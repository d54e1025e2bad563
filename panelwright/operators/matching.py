"""Matched difference-in-differences on panels.

A matched set is identified by (keys, period, history): all units that switch on in that period and all untreated units
with the same treatment history. Sets are kept as a member table, one row per unit, never as treated x control pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.draws import draw_int
from panelwright.operators.cleaning import complete_cases
from panelwright.operators.resampling import redrawn_sums
from panelwright.operators.softmax import fit_softmax

SET = ("period", "history")


def matched_members(panel: DataFrame, *, unit: str, period: str, treat: str, outcome: str, leads: Sequence[int],
                    lag: int = 1, keys: Sequence[str] = ("imp",), carry: Sequence[str] = ()) -> DataFrame:
    """(keys, unit, period, history, treated, dy_<lead>..., carry) for every usable unit-period of a non-empty set.

    Needs the outcome at period - 1 and at all leads and an unbroken treatment history; ranges are on period values, so
    gaps never shift a lead. A unit has few periods, hence the plain window.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys, unit).orderBy(period)

    def at(column: str, offset: int) -> Column:
        return F.max(column).over(w.rangeBetween(offset, offset))

    lags = [at(treat, -k).alias(f"_t{k}") for k in range(1, lag + 1)]
    looked = panel.select(
        *keys, F.col(unit).alias("unit"), F.col(period).alias("period"), F.col(treat).alias("treated"), *carry, *lags,
        at(outcome, -1).alias("_base"), *[at(outcome, h).alias(f"_y{h}") for h in leads])
    usable = complete_cases(looked, ["treated", "_base", *[f"_t{k}" for k in range(1, lag + 1)],
                                     *[f"_y{h}" for h in leads]])
    members = usable.where(F.col("_t1") == 0).select(
        *keys, "unit", "period", F.concat_ws("", *[F.col(f"_t{k}").cast("string") for k in range(lag, 0, -1)])
        .alias("history"), "treated", *[(F.col(f"_y{h}") - F.col("_base")).alias(f"dy_{h}") for h in leads], *carry)
    sets = members.groupBy(*keys, *SET).agg(
        F.count_if(F.col("treated") == 1).alias("n_treated"), F.count_if(F.col("treated") == 0).alias("n_controls"))
    matched = sets.where("n_treated > 0 and n_controls > 0")
    return members.join(matched, [*keys, *SET])


def equal_weights(members: DataFrame) -> DataFrame:
    """Controls of a set share weight one evenly; treated members carry NULL."""
    return members.withColumn("weight", F.when(F.col("treated") == 0, 1.0 / F.col("n_controls")))


def propensity_weights(members: DataFrame, covariates: Sequence[str], keys: Sequence[str] = ("imp",)) -> DataFrame:
    """Control weights p / (1 - p) from one pooled logit per key, normalised inside each set."""
    keys = list(keys)
    complete = complete_cases(members, covariates)
    centre = complete.agg(*[F.avg(c).alias(c) for c in covariates], *[F.stddev_samp(c).alias(f"s_{c}")
                                                                      for c in covariates]).first()
    standard = [(F.col(c) - centre[c]) / (centre[f"s_{c}"] or 1.0) for c in covariates]
    vector = F.array(F.lit(1.0), *[s.cast("double") for s in standard])
    data = complete.withColumn("_x", vector)
    betas = fit_softmax(data.withColumn("_w", F.lit(1.0)), keys, "_x", "treated", "_w", 2)
    linear = F.aggregate(F.zip_with("beta", "_x", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    odds = data.join(F.broadcast(betas), keys).withColumn("_odds", F.when(F.col("treated") == 0, F.exp(linear)))
    sums = odds.groupBy(*keys, *SET).agg(
        F.sum("_odds").alias("_sum"), F.count_if(F.col("treated") == 1).alias("_nt"),
        F.count_if(F.col("treated") == 0).alias("_nc"))
    kept = sums.where("_nt > 0 and _nc > 0")
    return (
        odds.join(kept, [*keys, *SET])
        .withColumn("weight", F.col("_odds") / F.col("_sum"))
        .withColumns({"n_treated": F.col("_nt"), "n_controls": F.col("_nc")})
        .select(*members.columns, "weight")
    )


def unit_contributions(weighted: DataFrame, leads: Sequence[int], keys: Sequence[str] = ("imp",)) -> DataFrame:
    """(keys, unit, s_<lead>..., d): signed sums whose totals give the ATT as sum(s) / sum(d).

    A treated member adds its change; a control takes away its weighted change once per treated member of the set.
    """
    sign = F.when(F.col("treated") == 1, 1.0).otherwise(-F.col("n_treated") * F.col("weight"))
    return weighted.groupBy(*keys, "unit").agg(
        *[F.sum(sign * F.col(f"dy_{h}")).alias(f"s_{h}") for h in leads], F.sum("treated").cast("bigint").alias("d"))


def att(contributions: DataFrame, leads: Sequence[int], keys: Sequence[str] = ("imp",)) -> DataFrame:
    """(keys, lead, estimate)."""
    wide = contributions.groupBy(*keys).agg(
        *[F.try_divide(F.sum(f"s_{h}"), F.sum("d")).alias(str(h)) for h in leads])
    long = wide.unpivot(list(keys), [str(h) for h in leads], "lead", "estimate")
    return long.withColumn("lead", F.col("lead").cast("int"))


def bootstrap_se(contributions: DataFrame, unit_ids: DataFrame, leads: Sequence[int], replicates: int, seed: int,
                 keys: Sequence[str] = ("imp",)) -> DataFrame:
    """(keys, lead, std_error): units are redrawn with replacement, sets and weights held fixed.

    ``unit_ids``: (keys, unit, unit_id) with ids 1..n in every key, all panel units. The k-th draw of a replicate hits
    unit ``draw(k, replicate) % n + 1``; draws are counted per unit before they meet the contribution table.
    """
    keys = list(keys)
    n = unit_ids.agg(F.max("unit_id")).scalar()
    salt = F.col("replicate") * 1000 + reduce(lambda a, b: a * 31 + b, [F.col(k).cast("bigint") for k in keys])
    draws = (
        unit_ids.select(*keys, "unit_id", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
        .select(*keys, "replicate", (draw_int(F.col("unit_id"), salt, seed) % n + 1).alias("unit_id"))
        .groupBy(*keys, "replicate", "unit_id").agg(F.count(F.lit(1)).alias("times"))
    )
    by_id = contributions.join(unit_ids, [*keys, "unit"])
    redrawn = draws.join(by_id, [*keys, "unit_id"]).groupBy(*keys, "replicate").agg(
        *[F.try_divide(F.sum(F.col("times") * F.col(f"s_{h}")), F.sum(F.col("times") * F.col("d"))).alias(str(h))
          for h in leads])
    long = redrawn.unpivot([*keys, "replicate"], [str(h) for h in leads], "lead", "estimate")
    return long.groupBy(*keys, F.col("lead").cast("int").alias("lead")).agg(
        F.stddev_samp("estimate").alias("std_error"))


def redrawn_se(contributions: DataFrame, unit_ids: DataFrame, leads: Sequence[int], replicates: int, seed: int,
               keys: Sequence[str] = ("imp",)) -> DataFrame:
    """(keys, lead, std_error) as ``bootstrap_se``, with counts from recursive splitting in place of a row for each draw."""
    keys = list(keys)
    n = unit_ids.agg(F.max("unit_id")).scalar()
    by_id = contributions.join(unit_ids, [*keys, "unit"]).withColumn("n_units", n)
    sums = redrawn_sums(by_id, [*[f"s_{h}" for h in leads], "d"], "n_units", replicates, seed, keys)
    estimates = sums.select(*keys, "replicate", *[F.try_divide(f"s_{h}", "d").alias(str(h)) for h in leads])
    long = estimates.unpivot([*keys, "replicate"], [str(h) for h in leads], "lead", "estimate")
    return long.groupBy(*keys, F.col("lead").cast("int").alias("lead")).agg(F.stddev_samp("estimate").alias("std_error"))


def linear_se(contributions: DataFrame, leads: Sequence[int], keys: Sequence[str] = ("imp",)) -> DataFrame:
    """(keys, lead, linear_error): the error of a ratio of sums by its first-order expansion, from sums of squares and products."""
    keys = list(keys)
    sums = contributions.groupBy(*keys).agg(
        F.sum("d").cast("double").alias("_d"), F.sum(F.col("d") * F.col("d")).cast("double").alias("_dd"),
        *[F.sum(f"s_{h}").alias(f"_s{h}") for h in leads], *[F.sum(F.col(f"s_{h}") * F.col(f"s_{h}")).alias(f"_ss{h}") for h in leads],
        *[F.sum(F.col(f"s_{h}") * F.col("d")).alias(f"_sd{h}") for h in leads])

    def error(h: int) -> Column:
        ratio = F.try_divide(f"_s{h}", "_d")
        squares = F.col(f"_ss{h}") - 2 * ratio * F.col(f"_sd{h}") + ratio * ratio * F.col("_dd")
        return F.try_divide(F.sqrt(F.greatest(squares, F.lit(0.0))), "_d").alias(str(h))

    long = sums.select(*keys, *[error(h) for h in leads]).unpivot(keys, [str(h) for h in leads], "lead", "linear_error")
    return long.withColumn("lead", F.col("lead").cast("int"))
