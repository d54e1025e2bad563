"""Time-varying policy status by state, stringency, and model groups."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright import constants as C
from panelwright.functions.recode import recode
from panelwright.operators.intervals import interval_join
from panelwright.operators.skew import broadcast_if_small


def policy_table(spark: SparkSession) -> DataFrame:
    """(state, start_run, end_run, policy_group); open ends are NULL. One row per state with a policy."""
    rows = [(s, None, None, C.GROUP_BEFORE) for s in C.POLICY_ALWAYS]
    for state, (start, end) in C.POLICY_WINDOWS.items():
        rows.append((state, start, end, C.GROUP_WAVE if state in C.POLICY_WAVE else C.GROUP_OTHER))
    return spark.createDataFrame(rows, "state string, start_run int, end_run int, policy_group string")


def attach_policy(panel: DataFrame, policy: DataFrame, run_month: str) -> DataFrame:
    """Add ``parity`` (ever), ``parity_month`` (in force) and ``parity_group``. ``policy``: one row per state; several are an error (``attach_episodes`` takes them)."""
    on_or_after = F.coalesce(F.col(run_month) >= F.col("start_run"), F.lit(True))
    on_or_before = F.coalesce(F.col(run_month) <= F.col("end_run"), F.lit(True))
    ever = F.col("policy_group").isNotNull()
    one = policy.groupBy("state").agg(*[F.any_value(c).alias(c) for c in ("start_run", "end_run", "policy_group")], F.count(F.lit(1)).alias("_n"))
    joined = panel.join(broadcast_if_small(one, reject=F.col("_n") > 1).drop("_n"), "state", "left")
    return joined.withColumns({
        "parity": ever,
        "parity_month": ever & on_or_after & on_or_before,
        "parity_group": F.coalesce("policy_group", F.lit(C.GROUP_NEVER)),
    }).drop("start_run", "end_run", "policy_group")


def attach_episodes(panel: DataFrame, episodes: DataFrame, run_month: str) -> DataFrame:
    """Policies that start, stop and start again: adds ``parity`` (ever), ``parity_month`` (in force), ``episode`` (number in the
    state, from 1), ``months_in`` (since the episode's start; NULL where that is open) and ``parity_group`` (of the first episode).

    ``episodes``: (state, start_run, end_run, policy_group), any number per state, ends included, NULL open. Two that overlap
    are an error. A panel row comes out once.
    """
    order = Window.partitionBy("state").orderBy(F.col("start_run").asc_nulls_first())
    numbered = episodes.select("state", "start_run", "end_run", F.row_number().over(order).alias("episode"))
    first = F.struct(F.coalesce("start_run", F.lit(-(2 ** 31))).alias("s"), "policy_group")
    ever = episodes.groupBy("state").agg(F.min(first)["policy_group"].alias("_group"))
    joined = interval_join(panel, numbered, ["state"], run_month, "start_run", "end_run").join(broadcast_if_small(ever), "state", "left")
    return joined.select(*panel.columns, F.col("_group").isNotNull().alias("parity"), F.col("episode").isNotNull().alias("parity_month"), "episode",
                         (F.col(run_month) - F.col("start_run")).alias("months_in"), F.coalesce("_group", F.lit(C.GROUP_NEVER)).alias("parity_group"))


def policy_start_label(state: Column) -> Column:
    """Display label of the policy start."""
    return (
        F.when(state.isin(*C.POLICY_ALWAYS), "Before 2019")
        .when(state.isin(*C.POLICY_WAVE), "April 2020")
        .otherwise(F.coalesce(recode(state, C.POLICY_START_LABELS), F.lit("Never")))
    )


def stringency_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(C.STRINGENCY.items()), "state string, index double")


def attach_stringency(panel: DataFrame, stringency: DataFrame, month: str, start: dt.date) -> DataFrame:
    """Stringency index, zero before ``start``, NULL for a state not in the table."""
    joined = panel.join(broadcast_if_small(stringency), "state", "left")
    return joined.withColumn("index", F.when(F.col(month) < F.lit(start), 0.0).otherwise(F.col("index")))


def pandemic_period(month: Column, first: dt.date, second: dt.date) -> Column:
    """1 before, 2 between, 3 after the two dates."""
    return F.when(month < F.lit(first), 1).when(month < F.lit(second), 2).when(month >= F.lit(second), 3)


def regroup_states(panel: DataFrame, overrides: Mapping[str, str]) -> DataFrame:
    """Put single states into another policy group before a model."""
    return panel.withColumn("parity_group", recode(F.col("state"), overrides, F.col("parity_group")))


def treatment_indicator(in_force: Column, period: Column, first_untreated: int | None = None) -> Column:
    """0/1 treatment; ``first_untreated`` names a period in which nobody counts as treated."""
    treated = F.when(in_force.isNotNull(), in_force.cast("int"))
    return treated if first_untreated is None else F.when(period == first_untreated, 0).otherwise(treated)
