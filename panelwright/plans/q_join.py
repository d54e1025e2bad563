"""Queries for joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright import constants as C
from panelwright.functions.codes import clean_code, is_missing_code
from panelwright.operators import impute, joins, patient_days, policy
from panelwright.operators.describe import add_zero_states, count_buckets
from panelwright.plans.registry import query
from panelwright.plans.role_sql import M, MISSING_DX, YEARS, quote, r6
from panelwright.plans.roles import Roles
from panelwright.plans.study import PATIENT
from panelwright.sources.bucketed import lay_out_by_key
from panelwright.sources.writers import settle


@query("join_patients_to_visits", "JN-1", "AGG-1", sql=f"""
    SELECT d.client_id, d.client_patient_id, d.gender, count(DISTINCT p.date) AS visit_count
    FROM demographic d JOIN procedure p ON d.client_id = p.client_id AND d.client_patient_id = p.patient_id
    WHERE p.date[1:4] IN ({YEARS}) GROUP BY ALL""")
def join_patients_to_visits(t: Roles) -> DataFrame:
    return t.study.pulled.select(*PATIENT, "gender", "visit_count").distinct()


@query("join_as_existence_test", "JN-2", "JN-10", "AGG-2", "OP-8", sql="""
    SELECT client_id, client_patient_id, visit_date::varchar AS visit_date, telehealth, mentalhealth FROM visit_days
    WHERE (client_id, client_patient_id) IN (SELECT (client_id, client_patient_id) FROM demographic)""")
def join_as_existence_test(t: Roles) -> DataFrame:
    """Rows collapse to visit-days first; the existence test then runs on the smaller table."""
    return joins.keep_listed(t.study.visit_days, t.demographic, PATIENT)


@query("left_join_demographics", "JN-3", sql="""
    SELECT p.claim_id, p.line_no, d.gender, d.birth_year
    FROM procedure p LEFT JOIN patients d ON p.client_id = d.client_id AND p.patient_id = d.client_patient_id""")
def left_join_demographics(t: Roles) -> DataFrame:
    people = t.study.patients.select(*PATIENT, "gender", "birth_year")
    joined = joins.renamed_left_join(t.procedure, people, {"client_id": "client_id", "patient_id": "client_patient_id"})
    return joined.select("claim_id", "line_no", "gender", "birth_year")


@query("joins_without_exchange", "JN-1", "JN-3", "WIN-6", sql=f"""
    SELECT w.client_id, w.patient_id, p.gender, p.birth_year, d.n_listed, count(DISTINCT w.visit_date) AS days, {r6('sum(w.weight)')} AS weight
    FROM weighted_rows w LEFT JOIN patients p ON p.client_id = w.client_id AND p.client_patient_id = w.patient_id
    JOIN (SELECT client_id, client_patient_id, count(*) AS n_listed FROM demographic GROUP BY ALL) d
      ON d.client_id = w.client_id AND d.client_patient_id = w.patient_id WHERE NOT w.remote GROUP BY ALL""")
def joins_without_exchange(t: Roles) -> DataFrame:
    """Weights, demographics and cohort over tables of one layout: split, joined and added up bucket by bucket."""
    key = ["client_id", "patient_id"]
    facts, people, listed = co_located(t)
    weighted = patient_days.weight_codes(facts, [*key, "visit_date"], "dx1_code", is_missing_code(F.col("dx1_code"), C.REDACTED),
                                         times="n_times")
    days = weighted.groupBy(*key, "visit_date").agg(F.sum("weight").alias("weight"))
    patients = days.groupBy(*key).agg(F.count(F.lit(1)).alias("days"), F.sum("weight").alias("weight"))
    joined = patients.join(people.hint("merge"), key, "left").join(listed.hint("merge"), key)
    return joined.select(*key, "gender", "birth_year", "n_listed", "days", "weight")


def co_located(t: Roles) -> tuple[DataFrame, DataFrame, DataFrame]:
    """In-person facts counted by patient, day and code, patients, and the listed cohort, all in the same buckets."""
    key = ["client_id", "patient_id"]
    facts = t.study.care_rows().where("NOT remote").groupBy(*key, "visit_date", "dx1_code").agg(F.count(F.lit(1)).alias("n_times"))
    renamed = t.study.patients.select("client_id", F.col("client_patient_id").alias("patient_id"), "gender", "birth_year")
    listed = t.demographic.groupBy("client_id", F.col("client_patient_id").alias("patient_id")).agg(F.count(F.lit(1)).alias("n_listed"))
    return tuple(lay_out_by_key(df, key, label) for df, label in ((facts, "facts"), (renamed, "people"), (listed, "listed")))


@query("join_dimension_inner", "JN-4", "AGG-21", sql="""
    SELECT m.icd_code, m.code_system, c.cause_name, c.family FROM (SELECT DISTINCT * FROM icd_map) m
    JOIN causelist c USING (acause)""")
def join_dimension_inner(t: Roles) -> DataFrame:
    merged = t.icd_map.distinct().join(F.broadcast(t.causelist), "acause")
    return merged.select("icd_code", "code_system", "cause_name", "family")


@query("map_codes_with_fallback", "JN-5", "OP-4", sql="""
    SELECT remote, dx, acause, family_name, count(*) AS n, round(sum(weight), 6) + 0.0 AS weight
    FROM mapped_rows GROUP BY ALL""")
def map_codes_with_fallback(t: Roles) -> DataFrame:
    rows = patient_days.weight_rows(t.study.care_rows(), ["remote", "client_id", "patient_id", "visit_date"],
                                    is_missing_code(F.col("dx1_code"), C.REDACTED))
    mapped = patient_days.map_codes(rows.withColumn("dx", clean_code(F.col("dx1_code"))), "dx",
                                    t.study.resolved_codes)
    return mapped.groupBy("remote", "dx", "acause", "family_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


@query("left_join_renamed_keys", "JN-6", sql="""
    SELECT s.client_id, s.client_patient_id, cast(s.imp AS int) AS imp, s.re, v.visit_date::varchar AS visit_date, v.telehealth
    FROM stacked s LEFT JOIN visit_days v USING (client_id, client_patient_id)""")
def left_join_renamed_keys(t: Roles) -> DataFrame:
    copies = impute.stack_completed(t.study.completed, M).select(*PATIENT, "imp", "re")
    days = t.study.visit_days.withColumnRenamed("client_patient_id", "patient_id").select(
        "client_id", "patient_id", "visit_date", "telehealth")
    return joins.renamed_left_join(copies, days, {"client_id": "client_id", "client_patient_id": "patient_id"})


@query("natural_left_join", "JN-7", "JN-9", sql=f"""
    SELECT client_id, month::varchar AS month, state, mpatients, {r6('pct_rural_2010')} AS pct_rural_2010
    FROM network_months""")
def natural_left_join(t: Roles) -> DataFrame:
    return t.study.network_months.select("client_id", "month", "state", "mpatients", "pct_rural_2010")


@query("join_suffix_coalesce", "JN-8", sql="""
    SELECT p.client_id, p.client_patient_id, coalesce(p.zip3, z.zip3) AS zip3
    FROM demographic p LEFT JOIN orig_zips z USING (client_id, client_patient_id)""")
def join_suffix_coalesce(t: Roles) -> DataFrame:
    return joins.coalesce_join(t.demographic, t.orig_zips, PATIENT, "zip3").select(*PATIENT, "zip3")


@query("dimension_lookup", "JN-9", sql=f"""
    SELECT c.client_id, c.state, {r6('s.index')} AS index FROM client_dem c LEFT JOIN stringency s USING (state)""")
def dimension_lookup(t: Roles) -> DataFrame:
    return joins.lookup(t.client_dem, policy.stringency_table(t.spark), ["state"]).select("client_id", "state", "index")


@query("semi_and_anti_join", "JN-10", "JN-11", "AGG-22", sql=f"""
    SELECT count(*) FILTER (WHERE bad) AS rows_on_days_with_missing, count(*) FILTER (WHERE NOT bad) AS rows_on_other_days
    FROM (SELECT bool_or({MISSING_DX}) OVER (PARTITION BY client_id, patient_id, visit_date) AS bad FROM outpatient)""")
def semi_and_anti_join(t: Roles) -> DataFrame:
    """The facts are read once, into one row a patient-day and kind of code; the joins start from those."""
    day = ["client_id", "patient_id", "visit_date"]
    bad = is_missing_code(F.col("dx1_code"), C.REDACTED)
    kinds = settle(t.study.outpatient.groupBy(*day, bad.alias("bad")).agg(F.count(F.lit(1)).alias("n")), "day-kinds")
    missing = kinds.where("bad").select(*day)
    total = lambda kind: F.coalesce(F.sum("n"), F.lit(0)).alias(kind)
    on_day = kinds.join(missing, day, "left_semi").agg(total("rows_on_days_with_missing"))
    other = kinds.join(missing, day, "left_anti").agg(total("rows_on_other_days"))
    return on_day.withColumn("rows_on_other_days", other.scalar())


@query("selected_against_other", "JN-12", "AGG-25", "SET-4", "FLT-15", sql=f"""
    SELECT care_type, plot_date::varchar AS plot_date, {r6('total')} AS total, {r6('sub')} AS sub,
           {r6('total - sub')} AS other
    FROM (SELECT care_type, plot_date, sum(units) / any_value(whole) AS total FROM care_comparison GROUP BY ALL)
    JOIN (SELECT care_type, plot_date, sum(units) / any_value(whole) AS sub FROM care_comparison
          WHERE family_name IN ({quote(C.SELECTED_FAMILIES)}) GROUP BY ALL) USING (care_type, plot_date)""")
def selected_against_other(t: Roles) -> DataFrame:
    return patient_days.select_versus_other(t.study.care_weights, ["care_type", "plot_date"], "family_name",
                                            C.SELECTED_FAMILIES, "units")


@query("unit_to_own_baseline", "JN-14", "OP-16", "FN-21", "FN-13", sql=f"""
    SELECT client_id, month::varchar AS month, cast(imp AS int) AS imp, {r6('change_patients')} AS change_patients,
           {r6('change_wnh')} AS change_wnh, {r6('change_bnh')} AS change_bnh FROM panel""")
def unit_to_own_baseline(t: Roles) -> DataFrame:
    return t.study.panel.select("client_id", "month", "imp", "change_patients", "change_wnh", "change_bnh")


# --- set operations -------------------------------------------------------------------------------------------------


@query("append_reference_rows", "SET-1", "OP-24", sql=f"""
    SELECT state, CASE WHEN n < 4 THEN '1-3' WHEN n < 7 THEN '4-6' WHEN n < 15 THEN '7-15' ELSE 'Over 15' END AS clients
    FROM (SELECT state, count(*) AS n FROM client_dem GROUP BY ALL)
    UNION ALL SELECT s, '0' FROM (SELECT unnest([{quote(C.STATES_WITHOUT_NETWORKS)}]) AS s)
    WHERE s NOT IN (SELECT state FROM client_dem WHERE state IS NOT NULL)""")
def append_reference_rows(t: Roles) -> DataFrame:
    buckets = count_buckets(t.client_dem, "state", [(4, "1-3"), (7, "4-6"), (15, "7-15")], "Over 15")
    return add_zero_states(buckets, {s: "0" for s in C.STATES_WITHOUT_NETWORKS})


@query("recombine_slices", "SET-2", "SET-5", sql=f"""
    SELECT CASE WHEN ok = 0 THEN 'all missing' WHEN ok = n THEN 'none missing' ELSE 'some missing' END AS slice,
           count(*) AS n_rows, round(sum(1.0 / CASE WHEN ok > 0 THEN ok ELSE n END), 6) + 0.0 AS weight
    FROM (SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE NOT {MISSING_DX}) OVER w AS ok FROM care_rows
          WINDOW w AS (PARTITION BY remote, client_id, patient_id, visit_date))
    WHERE NOT {MISSING_DX} OR ok = 0 GROUP BY ALL""")
def recombine_slices(t: Roles) -> DataFrame:
    """Weights of both care types by the kind of patient-day, in one grouped pass instead of three slices."""
    day = ["client_id", "patient_id", "visit_date"]
    missing = is_missing_code(F.col("dx1_code"), C.REDACTED)
    days = t.study.care_rows().groupBy("remote", *day).agg(F.count(F.lit(1)).alias("n"), F.count_if(~missing).alias("ok"))
    kind = F.when(F.col("ok") == 0, "all missing").when(F.col("ok") == F.col("n"), "none missing").otherwise(
        "some missing")
    kept = F.when(F.col("ok") == 0, F.col("n")).otherwise(F.col("ok"))
    return days.groupBy(kind.alias("slice")).agg(F.sum(kept).alias("n_rows"),
                                                 F.count(F.lit(1)).cast("double").alias("weight"))


@query("code_list_union", "SET-6", "FN-10", sql="SELECT code FROM excluded_codes")
def code_list_union(t: Roles) -> DataFrame:
    return t.study.excluded_codes.withColumnRenamed("cpt4_hcpcs_code", "code")
