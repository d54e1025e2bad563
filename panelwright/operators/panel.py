"""From visit rows to unit x month panels.

Visit rows are reduced to (client, patient, month) before any demographic join, so joins see at most one row per
patient and month. Only patients with an imputed attribute are carried through all copies.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright import constants as C
from panelwright.functions.means import percent_se, strict, weighted_mean, weighted_mean_lenient
from panelwright.functions.recode import flag, ratio_to_baseline, recode
from panelwright.operators.reshape import widen
from panelwright.operators.shares import group_mean


def visit_days(rows: DataFrame, keys: Sequence[str], flags: Mapping[str, Column]) -> DataFrame:
    """One row per key with each flag as 0/1: set if any row of the day has it."""
    return rows.groupBy(*keys).agg(*[F.max(F.when(c, 1).otherwise(0)).alias(name) for name, c in flags.items()])


def combine_race(race: Column, hispanic: Column) -> Column:
    """Race/ethnicity group: ethnicity overrides race; unknown race without hispanic ethnicity is NULL."""
    return F.when(hispanic == 1, "hispanic").when(hispanic == 0, recode(race, C.RACE_GROUP_NOT_HISPANIC))


def group_panel(patient_months: DataFrame, completed: DataFrame, m: int) -> DataFrame:
    """(client, month, re, imp): mean flag over visit-days and number of visit-days.

    ``patient_months``: client_id, client_patient_id, month, n_days, n_remote. ``completed``: one row per patient
    with ``imp`` NULL when nothing was imputed, else one row per copy. Complete patients are added up once and the
    small result is copied m times.
    """
    joined = patient_months.join(
        completed.select("client_id", "client_patient_id", "re", "imp"), ["client_id", "client_patient_id"])
    sums = joined.groupBy("client_id", "month", "re", "imp").agg(
        F.sum("n_days").alias("mpatients"), F.sum("n_remote").alias("n_remote"))
    every_copy = F.when(F.col("imp").isNull(), F.sequence(F.lit(1), F.lit(m))).otherwise(F.array("imp"))
    spread = sums.withColumn("imp", F.explode(every_copy))
    total = spread.groupBy("client_id", "month", "re", "imp").agg(
        F.sum("mpatients").alias("mpatients"), F.sum("n_remote").alias("n_remote"))
    return total.select("client_id", "month", "re", "imp",
                        (F.col("n_remote") / F.col("mpatients")).alias("telehealth"), "mpatients")


def group_shares(by_group: DataFrame, groups: Sequence[str] = C.GROUPS) -> DataFrame:
    """Share of each group among visit-days, wide, absent groups 0: (client, month, imp, <groups>).

    A (client, month, imp) holds at most one row per group, so the window stays small.
    """
    keys = ["client_id", "month", "imp"]
    share = F.try_divide(F.col("mpatients"), F.sum("mpatients").over(Window.partitionBy(*keys)))
    return widen(by_group.withColumn("share", share), keys, "re", groups, "share", fill=0.0)


def client_measures(patient_months: DataFrame, patients: DataFrame) -> DataFrame:
    """(client, month): visit-day measures that do not depend on imputed columns.

    ``patient_months`` also carries ``n_mental`` and ``n_mental_remote``; ``patients`` carries birth_year and gender.
    """
    joined = patient_months.join(
        patients.select("client_id", "client_patient_id", "birth_year", "gender"), ["client_id", "client_patient_id"])
    age = F.year("month") - F.col("birth_year")
    n, remote = F.col("n_days"), F.col("n_remote")
    under_65, below_18, female = age <= 64, age < 18, F.col("gender") == "F"

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0))

    out = joined.groupBy("client_id", "month").agg(
        F.sum(n).alias("mpatients"),
        F.sum(remote).alias("_remote"),
        total(F.when(under_65, n)).alias("count_u65"),
        total(F.when(under_65, remote)).alias("_remote_u65"),
        F.sum("n_mental").alias("count_mental"),
        F.sum("n_mental_remote").alias("_remote_mental"),
        total(F.when(female, n)).alias("_female"),
        total(F.when(below_18, n)).alias("_below_18"),
        F.count_if(age.isNull()).alias("_no_age"),
        F.count_if(F.col("gender").isNull()).alias("_no_gender"),
    )

    def rate(count: str, base: str = "mpatients") -> Column:
        return F.try_divide(F.col(count), F.col(base))

    known_age, known_gender = F.col("_no_age") == 0, F.col("_no_gender") == 0
    return out.select(
        "client_id", "month", rate("_remote").alias("telehealth"),
        rate("_remote_u65", "count_u65").alias("u65_telehealth"),
        rate("_remote_mental", "count_mental").alias("mental_telehealth"),
        "mpatients",
        F.when(known_gender, rate("_female")).alias("pct_female"),
        F.when(known_age, rate("_below_18")).alias("pct_below18"),
        F.when(known_age, 1 - rate("count_u65")).alias("pct_65plus"),
        "count_u65", "count_mental",
    )


def unit_flags(panel: DataFrame, small_below: float = C.SMALL_NETWORK_PATIENT_DAYS,
               white_above: float = C.MORE_WHITE_SHARE) -> DataFrame:
    """Area and size flags; a unit's months are few, so its means come from a plain window."""
    keys = ["client_id", "imp"]
    out = group_mean(panel, keys, F.col("mpatients"), "_size", bounded=True)
    out = group_mean(out, keys, F.col("wnh"), "_white", bounded=True)
    return out.withColumns({
        "rural": flag(F.col("pct_rural_2010") > C.RURAL_PERCENT),
        "poverty": flag(F.col("povertyrate") > C.POVERTY_PERCENT),
        "small": flag(F.col("_size") < small_below),
        "more_wnh": flag(F.col("_white") > white_above),
    }).drop("_size", "_white")


def weighted_means(df: DataFrame, keys: Sequence[str], columns: Sequence[str], weight: str, *,
                   lenient: bool = False, firsts: Sequence[str] = (), extra: Sequence[Column] = ()) -> DataFrame:
    """The same weighted mean over many columns, with key-determined attributes carried along."""
    mean = weighted_mean_lenient if lenient else weighted_mean
    return df.groupBy(*keys).agg(
        *[mean(F.col(c), F.col(weight)).alias(c) for c in columns],
        *[F.any_value(c, True).alias(c) for c in firsts],
        *extra,
    )


def plain_means(df: DataFrame, keys: Sequence[str], columns: Sequence[str], *, firsts: Sequence[str] = (),
                extra: Sequence[Column] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        *[strict(F.avg(c), F.col(c)).alias(c) for c in columns],
        *[F.any_value(c, True).alias(c) for c in firsts],
        *extra,
    )


def change_ratios(panel: DataFrame, before: Column) -> DataFrame:
    """Patients relative to the baseline months' mean per month and group shares relative to the baseline share.

    Baseline sums are taken in a window over the unit's few months, beside those of ``unit_flags``: no self-join.
    ``before`` marks the baseline months; a year of them is assumed for the monthly mean.
    """
    w = Window.partitionBy("client_id", "imp")
    size = F.col("mpatients")

    def base_sum(value: Column) -> Column:
        return F.sum(F.when(before, value)).over(w)

    def base_share(name: str) -> Column:
        unknown = F.count_if(before & (F.col(name).isNull() | size.isNull())).over(w)
        return F.when(unknown == 0, F.try_divide(base_sum(F.col(name) * size), base_sum(size)))

    based = panel.withColumns({"_patients": base_sum(size), "_wnh": base_share("wnh"), "_bnh": base_share("bnh")})
    return based.withColumns({
        "change_patients": ratio_to_baseline(size, F.col("_patients") / 12, before),
        "change_wnh": ratio_to_baseline(F.col("wnh"), F.col("_wnh"), before),
        "change_bnh": ratio_to_baseline(F.col("bnh"), F.col("_bnh"), before),
    }).drop("_patients", "_wnh", "_bnh")


def group_rates(by_group: DataFrame, keys: Sequence[str] = ("re", "month", "imp")) -> DataFrame:
    """Percent, size and binomial standard error per key."""
    rates = by_group.groupBy(*keys).agg(
        (100 * weighted_mean(F.col("telehealth"), F.col("mpatients"))).alias("telehealth"),
        F.sum("mpatients").alias("mpatients"),
    )
    return rates.withColumn("se", percent_se(F.col("telehealth"), F.col("mpatients")))
