"""Queries for windows, ordering and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright import constants as C
from panelwright.functions.codes import is_missing_code
from panelwright.functions.dates import run_month
from panelwright.operators import (cleaning, impute, numbering, panel, patient_days, policy, quantiles, reshape,
                                   shares)
from panelwright.operators.fixed_effects import demean
from panelwright.plans.registry import query
from panelwright.plans.role_sql import M, MISSING_DX, quote, r6
from panelwright.plans.roles import STUDY, Roles
from panelwright.plans.study import PATIENT

DAY = ["client_id", "patient_id", "visit_date"]


@query("first_row_preferring_known", "WIN-1", "SRT-1", sql="""
    SELECT client_id, client_patient_id, zip3, race, gender FROM demographic
    QUALIFY row_number() OVER (PARTITION BY client_id, client_patient_id ORDER BY zip3 NULLS LAST) = 1""")
def first_row_preferring_known(t: Roles) -> DataFrame:
    return cleaning.keep_first(t.demographic, PATIENT, ["zip3"]).select(*PATIENT, "zip3", "race", "gender")


@query("any_row_per_key", "WIN-2", sql=f"""
    SELECT client_id, patient_id, visit_date::varchar AS visit_date, cpt4_hcpcs_code, dx1_code FROM
    (SELECT DISTINCT client_id, patient_id, visit_date, cpt4_hcpcs_code, dx1_code FROM outpatient)
    QUALIFY row_number() OVER (PARTITION BY client_id, patient_id, visit_date
                               ORDER BY cpt4_hcpcs_code NULLS LAST, dx1_code NULLS LAST) = 1""")
def any_row_per_key(t: Roles) -> DataFrame:
    return cleaning.keep_first(t.study.outpatient.select(*DAY, "cpt4_hcpcs_code", "dx1_code"), DAY)


@query("share_of_group_total", "WIN-3", "OP-11", sql=f"""
    SELECT state, month::varchar AS month, client_id, {r6('mpatients / sum(mpatients) OVER (PARTITION BY state, month)')}
        AS share FROM network_months""")
def share_of_group_total(t: Roles) -> DataFrame:
    out = shares.share_of_group(t.study.network_months, ["state", "month"], "mpatients", "share", bounded=True)
    return out.select("state", "month", "client_id", "share")


@query("share_of_grand_total", "WIN-4", sql=f"""
    SELECT client_id, month::varchar AS month, {r6('mpatients / sum(mpatients) OVER ()')} AS weight FROM network_months""")
def share_of_grand_total(t: Roles) -> DataFrame:
    return shares.share_of_all(t.study.network_months, "mpatients", "weight").select("client_id", "month", "weight")


@query("group_mean_threshold", "WIN-5", "FN-20", sql="""
    SELECT client_id, month::varchar AS month, CASE WHEN avg(mpatients) OVER (PARTITION BY client_id) < 3 THEN 1 ELSE 0 END
        AS small FROM network_months""")
def group_mean_threshold(t: Roles) -> DataFrame:
    sized = shares.group_mean(t.study.network_months, ["client_id"], F.col("mpatients"), "size", bounded=True)
    return sized.select("client_id", "month", F.when(F.col("size") < 3, 1).otherwise(0).alias("small"))


@query("split_weight_over_rows", "WIN-6", "OP-2", sql=f"""
    SELECT remote, client_id, patient_id, visit_date::varchar AS visit_date, count(*) AS n_rows,
           {r6('min(weight)')} AS weight, {r6('sum(weight)')} AS total FROM weighted_rows
    GROUP BY ALL""")
def split_weight_over_rows(t: Roles) -> DataFrame:
    keys = ["remote", *DAY]
    weighted = patient_days.weight_rows(t.study.care_rows(), keys, is_missing_code(F.col("dx1_code"), C.REDACTED))
    return weighted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.min("weight").alias("weight"),
                                      F.sum("weight").alias("total"))


@query("split_weight_over_codes", "OP-2", sql=f"""
    SELECT remote, client_id, patient_id, visit_date::varchar AS visit_date,
           CASE WHEN NOT {MISSING_DX} THEN dx1_code END AS dx1_code, count(*) AS n_rows, {r6('sum(weight)')} AS weight
    FROM weighted_rows
    GROUP BY ALL""")
def split_weight_over_codes(t: Roles) -> DataFrame:
    return patient_days.weight_codes(t.study.care_rows(), ["remote", *DAY], "dx1_code",
                                     is_missing_code(F.col("dx1_code"), C.REDACTED))


@query("dense_group_id", "WIN-7", sql="""
    SELECT client_id, client_patient_id, dense_rank() OVER (ORDER BY client_patient_id) AS new_id FROM demographic""")
def dense_group_id(t: Roles) -> DataFrame:
    return numbering.with_dense_id(t.demographic, "client_patient_id", "new_id").select(*PATIENT, "new_id")


@query("group_row_count", "WIN-8", sql="""
    SELECT claim_id, line_no, patient_id, count(*) OVER (PARTITION BY client_id, patient_id) AS row_count FROM procedure""")
def group_row_count(t: Roles) -> DataFrame:
    counted = shares.group_size(t.procedure, ["client_id", "patient_id"], "row_count")
    return counted.select("claim_id", "line_no", "patient_id", "row_count")


@query("quantile_bins", "WIN-9", "OP-23", sql=f"""
    SELECT client_id, month, CASE WHEN s <= b[2] THEN 1 WHEN s <= b[3] THEN 2 WHEN s <= b[4] THEN 3 WHEN s <= b[5] THEN 4
                                  ELSE 5 END AS size_det, {r6('s')} AS avg_patients
    FROM (SELECT client_id, month::varchar AS month, avg(mpatients) OVER (PARTITION BY client_id) AS s
          FROM network_months),
         (SELECT quantile_cont(s, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS b FROM
          (SELECT avg(mpatients) OVER (PARTITION BY client_id) AS s FROM network_months))""")
def quantile_bins(t: Roles) -> DataFrame:
    sized = shares.group_mean(t.study.network_months, ["client_id"], F.col("mpatients"), "avg_patients", bounded=True)
    return quantiles.quantile_bins(sized, "avg_patients", 5, "size_det").select("client_id", "month", "size_det",
                                                                               "avg_patients")


@query("category_mean_and_rank", "WIN-10", "SRT-3", sql=f"""
    SELECT family_name, care_type, plot_date::varchar AS plot_date, {r6('weight')} AS weight, {r6('avg')} AS avg,
           cast(dense_rank() OVER (ORDER BY round(avg, 9) DESC) AS int) AS ord
    FROM (SELECT *, avg(weight) OVER (PARTITION BY family_name) AS avg FROM care_comparison)""")
def category_mean_and_rank(t: Roles) -> DataFrame:
    ranked = shares.rank_by_mean(t.study.care_comparison, "family_name", "weight")
    return ranked.select("family_name", "care_type", "plot_date", "weight", "avg", "ord")


@query("treatment_switch_on", "WIN-11", "OP-21", sql="""
    SELECT client_id, cast(run_month AS int) AS run_month FROM
    (SELECT *, lag(on_now) OVER w AS before, lag(run_month) OVER w AS last_month FROM
        (SELECT client_id, (year(month) - 1995) * 12 + month(month) - 12 AS run_month,
                CASE WHEN policy_group IS NOT NULL AND (start_run IS NULL OR run_month >= start_run)
                      AND (end_run IS NULL OR run_month <= end_run) THEN 1 ELSE 0 END AS on_now
         FROM network_months LEFT JOIN policy USING (state)) WINDOW w AS (PARTITION BY client_id ORDER BY run_month))
    WHERE on_now = 1 AND before = 0 AND last_month = run_month - 1""")
def treatment_switch_on(t: Roles) -> DataFrame:
    rows = with_policy(t)
    w = Window.partitionBy("client_id").orderBy("run_month")
    before = F.max("on_now").over(w.rangeBetween(-1, -1))      # by period value: a gap is not an event
    return rows.withColumn("before", before).where("on_now = 1 AND before = 0").select("client_id", "run_month")


def with_policy(t: Roles) -> DataFrame:
    """Network months with run month and treatment indicator."""
    rows = t.study.network_months.withColumn("run_month", run_month(F.col("month"), STUDY.anchor))
    rows = policy.attach_policy(rows, policy.policy_table(t.spark), "run_month")
    return rows.withColumn("on_now", policy.treatment_indicator(F.col("parity_month"), F.col("run_month")))


LEADS = (0, 3, 6, 9, 12)
RUN_MONTHS_SQL = "(SELECT client_id, (year(month) - 1995) * 12 + month(month) - 12 AS r, telehealth FROM network_months)"


@query("leads_against_baseline", "WIN-12", sql=f"""
    SELECT a.client_id, cast(a.r AS int) AS run_month, {', '.join(f"{r6(f'f{h}.telehealth - b.telehealth')} AS dy_{h}" for h in LEADS)}
    FROM {RUN_MONTHS_SQL} a LEFT JOIN {RUN_MONTHS_SQL} b ON a.client_id = b.client_id AND b.r = a.r - 1
    {' '.join(f'LEFT JOIN {RUN_MONTHS_SQL} f{h} ON a.client_id = f{h}.client_id AND f{h}.r = a.r + {h}' for h in LEADS)}""")
def leads_against_baseline(t: Roles) -> DataFrame:
    w = Window.partitionBy("client_id").orderBy("run_month")

    def at(h: int):
        return F.max("telehealth").over(w.rangeBetween(h, h))

    return with_policy(t).select("client_id", "run_month", *[(at(h) - at(-1)).alias(f"dy_{h}") for h in LEADS])


@query("within_unit_demeaning", "WIN-13", sql=f"""
    SELECT client_id, month::varchar AS month, {r6('telehealth - avg(telehealth) OVER w')} AS telehealth,
           {r6('pct_female - avg(pct_female) OVER w')} AS pct_female, count(*) OVER w AS n FROM network_months
    WINDOW w AS (PARTITION BY client_id)""")
def within_unit_demeaning(t: Roles) -> DataFrame:
    out = demean(t.study.network_months, ["client_id"], ["telehealth", "pct_female"])
    return out.select("client_id", "month", "telehealth", "pct_female", F.col("_n").alias("n"))


@query("category_order", "SRT-2", sql="""
    SELECT care_type, plot_date::varchar AS plot_date, CASE WHEN ord IS NOT NULL THEN family_name END AS family_name,
           cast(ord AS int) AS ord, round(prop, 6) + 0.0 AS prop
    FROM care_comparison LEFT JOIN (SELECT unnest([""" + quote(C.FAMILY_ORDER) + """]) AS family_name,
        unnest(range(1, """ + str(len(C.FAMILY_ORDER) + 1) + """)) AS ord) USING (family_name)""")
def category_order(t: Roles) -> DataFrame:
    ordered = patient_days.order_categories(t.study.care_comparison, "family_name", C.FAMILY_ORDER)
    return ordered.select("care_type", "plot_date", "family_name", "ord", "prop")


# --- reshaping ------------------------------------------------------------------------------------------------------


@query("long_to_wide_filled", "RSH-1", "OP-11", sql="SELECT client_id, month::varchar AS month, cast(imp AS int) AS imp, "
       + ", ".join(f"{r6(g)} AS {g}" for g in C.GROUPS) + " FROM shares")
def long_to_wide_filled(t: Roles) -> DataFrame:
    return panel.group_shares(t.study.by_group)


@query("long_to_wide_pairs", "RSH-2", sql="""
    SELECT month::varchar AS month, re, """ + ", ".join(
        f"round(max(telehealth) FILTER (WHERE imp = {i}), 6) + 0.0 AS telehealth_{i}, "
        f"round(max(se) FILTER (WHERE imp = {i}), 6) + 0.0 AS se_{i}" for i in range(1, M + 1)) + f"""
    FROM (SELECT month, re, imp, t AS telehealth, sqrt(t * (100 - t) / n) AS se FROM
          (SELECT month, re, imp, 100 * sum(telehealth * mpatients) / sum(mpatients) AS t, sum(mpatients) AS n
           FROM by_group WHERE month < date '{STUDY.end}' GROUP BY ALL)) GROUP BY ALL""")
def long_to_wide_pairs(t: Roles) -> DataFrame:
    return reshape.widen_pairs(t.study.group_rates, ["month", "re"], "imp", range(1, M + 1), ["telehealth", "se"])


@query("wide_to_long", "RSH-3", sql=f"""
    SELECT client_id, month::varchar AS month, unnest(['u65_telehealth', 'telehealth']) AS age,
           {r6('unnest([u65_telehealth, telehealth])')} AS rate FROM network_months""")
def wide_to_long(t: Roles) -> DataFrame:
    return reshape.lengthen(t.study.network_months, ["client_id", "month"], ["u65_telehealth", "telehealth"], "age", "rate")


@query("split_term_names", "RSH-4", "FN-11", "FN-7", sql="""
    SELECT term, string_split(term, ':')[1] AS treatment, cast(replace(string_split(term, ':')[2], 'quarter', '') AS int)
        AS quarter, n
    FROM (SELECT 'group' || state || CASE WHEN quarter(month) > 1 THEN ':quarter' || quarter(month) ELSE '' END AS term,
                 count(*) AS n FROM network_months GROUP BY ALL)""")
def split_term_names(t: Roles) -> DataFrame:
    quarter = F.quarter("month")
    term = F.concat(F.lit("group"), F.col("state"),
                    F.when(quarter > 1, F.concat(F.lit(":quarter"), quarter.cast("string"))).otherwise(""))
    counted = t.study.network_months.groupBy(term.alias("term")).agg(F.count(F.lit(1)).alias("n"))
    parts = reshape.split_term(counted, "term", ["treatment", "quarter"])
    return parts.withColumn("quarter", F.regexp_replace("quarter", "quarter", "").try_cast("int"))


@query("row_wise_mean_and_squares", "RSH-5", sql=f"""
    SELECT client_id, month::varchar AS month, cast(imp AS int) AS imp, {r6('(aian + aapi + bnh + wnh + hispanic) / 5')} AS mean_share,
           {r6('aian^2 + aapi^2 + bnh^2 + wnh^2 + hispanic^2')} AS concentration FROM shares""")
def row_wise_mean_and_squares(t: Roles) -> DataFrame:
    wide = panel.group_shares(t.study.by_group)
    values = F.array(*C.GROUPS)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    squares = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v * v)
    return wide.select("client_id", "month", "imp", (total / len(C.GROUPS)).alias("mean_share"), squares.alias("concentration"))


@query("stack_of_copies", "RSH-6", sql="""
    SELECT cast(imp AS int) AS imp, race, hispanic, re, count(*) AS n FROM stacked GROUP BY ALL""")
def stack_of_copies(t: Roles) -> DataFrame:
    stacked = impute.stack_completed(t.study.completed, M)
    return stacked.groupBy("imp", "race", "hispanic", "re").agg(F.count(F.lit(1)).alias("n"))


@query("treatment_matrix", "RSH-7", sql="SELECT client_id, " + ", ".join(
    f"cast(max(on_now) FILTER (WHERE run_month = {p}) AS int) AS t{p}" for p in range(1, 52)) + """
    FROM (SELECT client_id, (year(month) - 1995) * 12 + month(month) - 12 AS run_month,
                CASE WHEN policy_group IS NOT NULL AND (start_run IS NULL OR run_month >= start_run)
                      AND (end_run IS NULL OR run_month <= end_run) THEN 1 ELSE 0 END AS on_now
          FROM network_months LEFT JOIN policy USING (state)) GROUP BY ALL""")
def treatment_matrix(t: Roles) -> DataFrame:
    return reshape.treatment_matrix(with_policy(t), "client_id", "run_month", tuple(range(1, 52)), "on_now")
