"""Descriptive tables and stratified time series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright import constants as C
from panelwright.functions.means import Z_95, weight_se, weighted_mean, weighted_mean_lenient
from panelwright.operators.quantiles import group_quantiles_wide
from panelwright.operators.shares import share_of_all


def weighted_percent_ci(df: DataFrame, keys: Sequence[str], rate: str, weight: str, *,
                        lenient: bool = False, normalise_within: bool = False) -> DataFrame:
    """Weighted percent of a 0-1 rate with a normal interval from the sum of squared weights.

    ``lenient`` skips missing rates together with their weights. By default weights are used as given (normalised over
    the whole panel); ``normalise_within`` makes them sum to one inside each group first.
    """
    x, w = F.col(rate), F.col(weight)
    used = F.when(x.isNotNull(), w) if lenient else w
    mean = weighted_mean_lenient(x, w) if lenient else weighted_mean(x, w)
    sum_sq = F.sum(used * used)
    if normalise_within:
        sum_sq = F.try_divide(sum_sq, F.sum(used) * F.sum(used))
    out = df.groupBy(*keys).agg((100 * mean).alias("percent"), sum_sq.alias("_w2"))
    half = Z_95 * weight_se(F.col("percent"), F.col("_w2"))
    return out.withColumns({"lci": F.col("percent") - half, "uci": F.col("percent") + half}).drop("_w2")


def time_series(panel: DataFrame, stratum: Column | None = None, rate: str = "telehealth", *,
                size: str = "mpatients", month: str = "month", lenient: bool = False) -> DataFrame:
    """Monthly weighted percent, overall or by stratum; weights are shares of the whole panel."""
    weighted = share_of_all(panel, size, "_weight")
    if stratum is None:
        return weighted_percent_ci(weighted, [month], rate, "_weight", lenient=lenient)
    return weighted_percent_ci(weighted.withColumn("stratum", stratum), [month, "stratum"], rate, "_weight",
                               lenient=lenient)


def region_of(state: Column) -> Column:
    out = F
    for region, states in C.REGIONS.items():
        out = out.when(state.isin(*states), region)
    return out


def summary(df: DataFrame, column: str) -> DataFrame:
    """Minimum, quartiles, mean, maximum and number of missing values of one column."""
    named = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    quartiles = group_quantiles_wide(df.withColumn("_all", F.lit(0)), ["_all"], column, named)
    basic = df.agg(F.min(column).alias("min"), F.avg(column).alias("mean"), F.max(column).alias("max"),
                   F.count_if(F.col(column).isNull()).alias("n_missing")).withColumn("_all", F.lit(0))
    return basic.join(quartiles, "_all").select(F.lit(column).alias("variable"), "min", "q1", "median", "mean", "q3",
                                                "max", "n_missing")


def count_buckets(df: DataFrame, key: str, buckets: Sequence[tuple[int, str]], top: str) -> DataFrame:
    """Rows per key as labelled size buckets: (exclusive upper bound, label) in ascending order."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    label = F
    for bound, name in buckets:
        label = label.when(F.col("n") < bound, name)
    return counted.select(key, label.otherwise(top).alias("clients"))


def stratified_table(df: DataFrame, group: str, categorical: Sequence[str], continuous: Sequence[str]) -> DataFrame:
    """Share of every level and mean (SD) of every continuous variable, per group and overall.

    Rows: (group, variable, level, n, percent, mean, sd); the overall column has group "Overall". Counts come from one
    grouping-sets aggregate over the unpivoted levels.
    """
    levels = df.select(group, *[F.col(c).cast("string").alias(c) for c in categorical])
    tall = levels.unpivot([group], list(categorical), "variable", "level").where(F.col("level").isNotNull())
    sets = [[F.col(group), F.col("variable"), F.col("level")], [F.col("variable"), F.col("level")]]
    counts = (
        tall.groupingSets(sets, group, "variable", "level")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping(group).alias("_all"))
        .withColumn(group, F.when(F.col("_all") == 1, "Overall").otherwise(F.col(group)))
    )
    totals = counts.groupBy(group, "variable").agg(F.sum("n").alias("_total"))
    cat = counts.join(totals, [group, "variable"]).select(
        group, "variable", "level", "n", (100 * F.col("n") / F.col("_total")).alias("percent"),
        F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("sd"))

    values = df.select(group, *[F.col(c).cast("double").alias(c) for c in continuous])
    long = values.unpivot([group], list(continuous), "variable", "value").where(F.col("value").isNotNull())
    sets = [[F.col(group), F.col("variable")], [F.col("variable")]]
    cont = (
        long.groupingSets(sets, group, "variable")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
             F.grouping(group).alias("_all"))
        .select(F.when(F.col("_all") == 1, "Overall").otherwise(F.col(group)).alias(group), "variable",
                F.lit(None).cast("string").alias("level"), "n", F.lit(None).cast("double").alias("percent"),
                "mean", "sd")
    )
    return cat.unionByName(cont)


def percent_text(percent: Column) -> Column:
    """``12%``; an exact half goes to the even number."""
    return F.format_string("%.0f%%", F.bround(percent, 0))


def render_table(table: DataFrame) -> DataFrame:
    """Text cells: ``12%`` for levels, ``3.4 (1.2)`` for continuous variables, NULL where the SD is undefined."""
    mean_sd = F.format_string("%.1f (%.1f)", F.bround("mean", 1), F.bround("sd", 1))
    cell = F.when(F.col("percent").isNotNull(), percent_text(F.col("percent"))).when(F.col("sd").isNotNull(), mean_sd)
    return table.withColumn("cell", cell)


def add_zero_states(df: DataFrame, rows: Mapping[str, str]) -> DataFrame:
    """Append those reference states that have no row yet."""
    extra = df.sparkSession.createDataFrame(list(rows.items()), "state string, clients string")
    return df.unionByName(extra.join(df.select("state"), "state", "left_anti"))
