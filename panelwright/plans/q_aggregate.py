"""Queries for aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright import constants as C
from panelwright.functions.codes import is_missing_code
from panelwright.functions.means import (percent_se, safe_log, strict_mean, strict_sum, weighted_mean,
                                         weighted_mean_lenient)
from panelwright.functions.recode import band
from panelwright.operators import cleaning, day_sets, describe, impute, panel, policy, quantiles
from panelwright.operators.joins import suffixed_left_join
from panelwright.operators.reshape import lengthen
from panelwright.plans.registry import query
from panelwright.plans.role_sql import M, MISSING_DX, lenient_wmean, r6, strict_wmean
from panelwright.plans.role_sql import strict_mean as strict_mean_sql
from panelwright.plans.roles import STUDY, Roles

POLICY_GROUP_SQL = """
    SELECT c.*, coalesce(p.policy_group, 'Never') AS parity_group FROM client_dem c LEFT JOIN policy p USING (state)"""
AGE_SQL = (f"CASE WHEN {STUDY.age_year} - birth_year < 15 THEN 'Under 15' "
           f"WHEN {STUDY.age_year} - birth_year < 65 THEN '15-64' ELSE '65 plus' END")


def grouped_clients(t: Roles) -> DataFrame:
    """Networks with their policy group."""
    clients = t.client_dem.withColumn("run_month", F.lit(1))
    return policy.attach_policy(clients, policy.policy_table(t.spark), "run_month").drop("run_month")


@query("distinct_tuple_count", "AGG-1", "AGG-14", sql="""
    SELECT client_id, count(DISTINCT patient_id || '|' || date) AS visits, count(DISTINCT patient_id) AS patients
    FROM procedure GROUP BY client_id""")
def distinct_tuple_count(t: Roles) -> DataFrame:
    """Both distinct counts from one de-duplication: patient-dates first, then patients."""
    pairs = t.procedure.where(F.col("date").isNotNull()).groupBy("client_id", "patient_id").agg(
        F.count_distinct("date").alias("d"))
    return pairs.groupBy("client_id").agg(F.sum("d").alias("visits"), F.count(F.lit(1)).alias("patients"))


@query("visit_day_flags", "AGG-2", "OP-8", "FLT-5", sql="""
    SELECT client_id, client_patient_id, visit_date::varchar AS visit_date, telehealth, mentalhealth FROM visit_days""")
def visit_day_flags(t: Roles) -> DataFrame:
    return t.study.visit_days


@query("group_mean_and_count", "AGG-3", "OP-11", sql=f"""
    SELECT client_id, month::varchar AS month, re, cast(imp AS int) AS imp, {r6('telehealth')} AS telehealth, mpatients
    FROM by_group""")
def group_mean_and_count(t: Roles) -> DataFrame:
    return t.study.by_group


@query("wide_measures", "AGG-4", "AGG-5", "AGG-6", "FN-19", "FN-20", sql=f"""
    SELECT client_id, month::varchar AS month, {r6('telehealth')} AS telehealth,
           {r6('u65_telehealth')} AS u65_telehealth, {r6('mental_telehealth')} AS mental_telehealth, mpatients,
           {r6('pct_female')} AS pct_female, {r6('pct_below18')} AS pct_below18, {r6('pct_65plus')} AS pct_65plus,
           count_u65, count_mental FROM measures""")
def wide_measures(t: Roles) -> DataFrame:
    return t.study.measures


@query("conditional_mean", "AGG-5", sql=f"""
    SELECT c_nationkey, {r6("avg(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING')")} AS building,
           {r6('avg(c_acctbal)')} AS everyone FROM customer GROUP BY ALL""")
def conditional_mean(t: Roles) -> DataFrame:
    building = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal"))
    return t.table("customer").groupBy("c_nationkey").agg(F.avg(building).alias("building"),
                                                          F.avg("c_acctbal").alias("everyone"))


@query("weighted_mean_strict", "AGG-7", "AGG-6", "AGG-9", sql=f"""
    SELECT month, {r6('t')} AS telehealth, n AS mpatients, {r6('sqrt(t * (100 - t) / nullif(n, 0))')} AS se
    FROM (SELECT month::varchar AS month, 100 * ({strict_wmean('mental_telehealth', 'mpatients')}) AS t,
                 cast(sum(mpatients) AS bigint) AS n FROM network_months GROUP BY ALL)""")
def weighted_mean_strict(t: Roles) -> DataFrame:
    out = t.study.network_months.groupBy("month").agg(
        (100 * weighted_mean(F.col("mental_telehealth"), F.col("mpatients"))).alias("telehealth"),
        F.sum("mpatients").alias("mpatients"))
    return out.withColumn("se", percent_se(F.col("telehealth"), F.col("mpatients")))


@query("weighted_mean_lenient", "AGG-8", sql=f"""
    SELECT month::varchar AS month, {r6(lenient_wmean('mental_telehealth', 'mpatients'))} AS mental,
           {r6(lenient_wmean('u65_telehealth', 'mpatients'))} AS under_65 FROM network_months GROUP BY ALL""")
def weighted_mean_lenient_by_month(t: Roles) -> DataFrame:
    w = F.col("mpatients")
    return t.study.network_months.groupBy("month").agg(
        weighted_mean_lenient(F.col("mental_telehealth"), w).alias("mental"),
        weighted_mean_lenient(F.col("u65_telehealth"), w).alias("under_65"))


@query("weighted_percent_interval", "AGG-10", "WIN-4", "OP-22", sql=f"""
    SELECT month, {r6('p')} AS percent, {r6('p - 1.96 * sqrt(w2 * p * (100 - p))')} AS lci,
           {r6('p + 1.96 * sqrt(w2 * p * (100 - p))')} AS uci
    FROM (SELECT month::varchar AS month, 100 * ({strict_wmean('telehealth', 'w')}) AS p, sum(w * w) AS w2
          FROM (SELECT *, mpatients / sum(mpatients) OVER () AS w FROM network_months) GROUP BY ALL)""")
def weighted_percent_interval(t: Roles) -> DataFrame:
    return describe.time_series(t.study.network_months)


@query("weighted_percent_interval_within", "AGG-10", sql=f"""
    SELECT month, {r6('p')} AS percent, {r6('p - 1.96 * sqrt(w2 * p * (100 - p))')} AS lci,
           {r6('p + 1.96 * sqrt(w2 * p * (100 - p))')} AS uci
    FROM (SELECT month::varchar AS month, 100 * ({strict_wmean('telehealth', 'mpatients')}) AS p,
                 sum(mpatients * mpatients) / (sum(mpatients) * sum(mpatients)) AS w2 FROM network_months GROUP BY ALL)""")
def weighted_percent_interval_within(t: Roles) -> DataFrame:
    rows = t.study.network_months.withColumn("w", F.col("mpatients").cast("double"))
    return describe.weighted_percent_ci(rows, ["month"], "telehealth", "w", normalise_within=True)


_across = ["telehealth", "u65_telehealth", "pct_female", "pct_below18", "pct_65plus"]


@query("same_aggregate_many_columns", "AGG-11", "AGG-12", "UDF-2", sql="SELECT client_id, "
       + ", ".join(f"{r6(strict_wmean(c, 'mpatients'))} AS {c}" for c in _across)
       + ", any_value(state) AS state, cast(sum(mpatients) AS bigint) AS mpatients FROM network_months GROUP BY client_id")
def same_aggregate_many_columns(t: Roles) -> DataFrame:
    return panel.weighted_means(t.study.network_months, ["client_id"], _across, "mpatients", firsts=["state"],
                                extra=[F.sum("mpatients").alias("mpatients")])


@query("two_level_aggregation", "AGG-13", "AGG-14", "AGG-15", "AGG-12", "JN-9", sql=f"""
    SELECT parity_group, count(DISTINCT state) AS n_states, {r6('avg(index)')} AS index, {r6('stddev_samp(index)')} AS sd
    FROM (SELECT g.state, parity_group, any_value(s.index) AS index FROM ({POLICY_GROUP_SQL}) g
          JOIN stringency s ON g.state = s.state GROUP BY ALL) GROUP BY ALL""")
def two_level_aggregation(t: Roles) -> DataFrame:
    clients = grouped_clients(t).join(F.broadcast(policy.stringency_table(t.spark)), "state")
    states = clients.groupBy("state", "parity_group").agg(F.any_value("index").alias("index"))
    return states.groupBy("parity_group").agg(F.count_distinct("state").alias("n_states"), F.avg("index").alias("index"),
                                              F.stddev_samp("index").alias("sd"))


@query("medians_by_group", "AGG-16", "AGG-17", "AGG-29", sql=f"""
    SELECT parity_group, variable, {r6('quantile_cont(value, 0.5)')} AS median,
           {r6('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)')} AS iqr
    FROM (SELECT parity_group, unnest(['mpatients', 'pct_rural_2010', 'povertyrate']) AS variable,
                 unnest([mpatients, pct_rural_2010, povertyrate]) AS value
          FROM ({POLICY_GROUP_SQL}) LEFT JOIN
               (SELECT client_id, avg(mpatients) AS mpatients FROM network_months GROUP BY ALL) USING (client_id))
    WHERE value IS NOT NULL GROUP BY ALL""")
def medians_by_group(t: Roles) -> DataFrame:
    """Three variables in long form, so the quantiles of all of them come from one pass."""
    sizes = t.study.network_months.groupBy("client_id").agg(F.avg("mpatients").alias("mpatients"))
    clients = grouped_clients(t).join(sizes, "client_id", "left")
    long = lengthen(clients, ["parity_group"], ["mpatients", "pct_rural_2010", "povertyrate"], "variable", "value")
    q = quantiles.group_quantiles_wide(long, ["parity_group", "variable"], "value",
                                       {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return q.select("parity_group", "variable", "median", (F.col("q3") - F.col("q1")).alias("iqr"))


@query("price_quantiles_by_flag", "AGG-16", "AGG-17", sql=f"""
    SELECT l_returnflag, {r6('quantile_cont(l_extendedprice, 0.25)')} AS q1,
           {r6('quantile_cont(l_extendedprice, 0.5)')} AS median, {r6('quantile_cont(l_extendedprice, 0.9)')} AS p90
    FROM lineitem GROUP BY ALL""")
def price_quantiles_by_flag(t: Roles) -> DataFrame:
    """Exact quantiles of few, very large groups."""
    return quantiles.group_quantiles_wide(t.table("lineitem"), ["l_returnflag"], "l_extendedprice",
                                          {"q1": 0.25, "median": 0.5, "p90": 0.9})


@query("iqr_of_low_cardinality", "AGG-17", sql=f"""
    SELECT state, {r6('quantile_cont(povertyrate, 0.75) - quantile_cont(povertyrate, 0.25)')} AS iqr FROM client_dem
    GROUP BY ALL""")
def iqr_of_low_cardinality(t: Roles) -> DataFrame:
    q = quantiles.group_quantiles_wide(t.client_dem, ["state"], "povertyrate", {"q1": 0.25, "q3": 0.75})
    return t.client_dem.select("state").distinct().join(q, "state", "left").select("state", (F.col("q3") - F.col("q1")).alias("iqr"))


@query("iqr_of_all_rows", "AGG-17", sql=f"""
    SELECT {r6('quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)')} AS iqr FROM lineitem""")
def iqr_of_all_rows(t: Roles) -> DataFrame:
    rows = t.table("lineitem").select(F.lit(0).alias("all"), "l_extendedprice")
    q = quantiles.group_quantiles_wide(rows, ["all"], "l_extendedprice", {"q1": 0.25, "q3": 0.75})
    return q.select((F.col("q3") - F.col("q1")).alias("iqr"))


@query("column_summary", "AGG-18", sql=f"""
    SELECT 'mental_telehealth' AS variable, {r6('min(x)')} AS min, {r6('quantile_cont(x, 0.25)')} AS q1,
           {r6('quantile_cont(x, 0.5)')} AS median, {r6('avg(x)')} AS mean, {r6('quantile_cont(x, 0.75)')} AS q3,
           {r6('max(x)')} AS max, count(*) FILTER (WHERE x IS NULL) AS n_missing
    FROM (SELECT mental_telehealth AS x FROM network_months)""")
def column_summary(t: Roles) -> DataFrame:
    return describe.summary(t.study.network_months, "mental_telehealth")


@query("missing_counts", "AGG-19", "UDF-4", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing FROM demographic"
    for c in ("race", "ethnicity", "zip3", "dob", "gender", "primary_language")))
def missing_counts(t: Roles) -> DataFrame:
    return cleaning.missing_counts(t.demographic, ["race", "ethnicity", "zip3", "dob", "gender", "primary_language"])


@query("distinct_rows", "AGG-21", sql="SELECT DISTINCT acause, code_system, icd_code, icd_name FROM icd_map")
def distinct_rows(t: Roles) -> DataFrame:
    return t.icd_map.distinct()


@query("distinct_under_predicate", "AGG-22", sql=f"""
    SELECT DISTINCT client_id, patient_id, visit_date::varchar AS visit_date FROM outpatient WHERE {MISSING_DX}""")
def distinct_under_predicate(t: Roles) -> DataFrame:
    missing = t.study.outpatient.where(is_missing_code(F.col("dx1_code"), C.REDACTED))
    return missing.select("client_id", "patient_id", "visit_date").distinct()


@query("count_buckets", "AGG-23", "OP-24", sql="""
    SELECT state, CASE WHEN n < 4 THEN '1-3' WHEN n < 7 THEN '4-6' WHEN n < 15 THEN '7-15' ELSE 'Over 15' END AS clients
    FROM (SELECT state, count(*) AS n FROM patients JOIN client_dem USING (client_id) GROUP BY ALL)""")
def count_buckets(t: Roles) -> DataFrame:
    people = t.study.patients.join(t.client_dem.select("client_id", "state"), "client_id")
    return describe.count_buckets(people, "state", [(4, "1-3"), (7, "4-6"), (15, "7-15")], "Over 15")


@query("visit_days_from_sets", "AGG-1", "AGG-14", "OP-1", sql="""
    SELECT client_id, patient_id, count(DISTINCT visit_date) AS n_days, count(DISTINCT date_trunc('month', visit_date)) AS n_months
    FROM outpatient GROUP BY ALL""")
def visit_days_from_sets(t: Roles) -> DataFrame:
    """Distinct visit days of every patient from the monthly sets of two batches, which share days."""
    keys = ["client_id", "patient_id"]
    odd = F.col("line_no") % 2 == 1
    batches = [day_sets.day_sets(t.study.outpatient.where(part), keys, "visit_date") for part in (odd, ~odd)]
    merged = day_sets.merge_sets(batches[0].unionByName(batches[1]), keys)
    return merged.groupBy(*keys).agg(F.sum(day_sets.n_days(F.col("days"))).alias("n_days"), F.count(F.lit(1)).alias("n_months"))


@query("sum_by_cause_and_month", "AGG-24", "FN-4", sql=f"""
    SELECT family_name, plot_date::varchar AS plot_date, {r6('sum(units) / any_value(whole)')} AS weight FROM care_comparison
    GROUP BY ALL""")
def sum_by_cause_and_month(t: Roles) -> DataFrame:
    return t.study.care_weights.groupBy("family_name", "plot_date").agg(F.sum("units").cast("double").alias("weight"))


@query("log_of_group_sum", "AGG-26", "FN-17", sql=f"""
    SELECT state, month::varchar AS month, {r6('CASE WHEN sum(count_mental) > 0 THEN ln(sum(count_mental)) END')} AS lmental
    FROM network_months GROUP BY ALL""")
def log_of_group_sum(t: Roles) -> DataFrame:
    return t.study.network_months.groupBy("state", "month").agg(safe_log(F.sum("count_mental")).alias("lmental"))


_people_sql = f"""
    (SELECT coalesce(policy_group, 'Never') AS parity_group, {AGE_SQL} AS age,
            CASE WHEN gender = 'F' THEN 'true' ELSE 'false' END AS female, re, cast(visit_count AS double) AS visit_count
     FROM (SELECT * FROM stacked WHERE imp = 1) JOIN client_dem USING (client_id) LEFT JOIN policy USING (state))"""


@query("stratified_table", "AGG-27", "OP-25", "FN-12", "UDF-3", sql=f"""
    WITH people AS MATERIALIZED {_people_sql},
    tall AS (SELECT g, unnest(['age', 'female', 're']) AS variable, unnest([age, female, re]) AS level
             FROM (SELECT parity_group AS g, * FROM people UNION ALL SELECT 'Overall', * FROM people)),
    cat AS (SELECT g, variable, level, count(*) AS n FROM tall WHERE level IS NOT NULL GROUP BY ALL)
    SELECT g AS parity_group, variable, level, n, {r6('p')} AS percent, NULL::double AS mean, NULL::double AS sd,
           printf('%.0f%%', p) AS cell
    FROM (SELECT *, 100.0 * n / sum(n) OVER (PARTITION BY g, variable) AS p FROM cat)
    UNION ALL
    SELECT g, 'visit_count', NULL, count(*), NULL, {r6('avg(visit_count)')}, {r6('stddev_samp(visit_count)')},
           CASE WHEN count(*) > 1 THEN printf('%.1f (%.1f)', avg(visit_count), stddev_samp(visit_count)) END
    FROM (SELECT parity_group AS g, visit_count FROM people UNION ALL SELECT 'Overall', visit_count FROM people)
    GROUP BY g""")
def stratified_table(t: Roles) -> DataFrame:
    one = impute.stack_completed(t.study.completed, M).where("imp = 1")
    age = STUDY.age_year - F.col("birth_year")
    people = one.join(grouped_clients(t).select("client_id", "parity_group"), "client_id").withColumns({
        "age": band(age, [15, 65], ["Under 15", "15-64", "65 plus"]), "female": F.col("gender") == "F"})
    return describe.render_table(describe.stratified_table(people, "parity_group", ["age", "female", "re"],
                                                           ["visit_count"]))


@query("weighted_table_over_join", "AGG-28", "JN-8", sql=f"""
    SELECT coalesce(policy_group, 'Never') AS parity_group, cast(sum(mpatients) AS bigint) AS tpatients,
           {r6(strict_wmean('telehealth', 'size'))} AS telehealth
    FROM network_months LEFT JOIN policy USING (state)
    LEFT JOIN (SELECT client_id, avg(mpatients) AS size FROM network_months GROUP BY ALL) USING (client_id) GROUP BY ALL""")
def weighted_table_over_join(t: Roles) -> DataFrame:
    """Panel rows and client sizes share the column mpatients; the weight is the client's, its mean over the months."""
    groups = grouped_clients(t).select("client_id", "parity_group")
    rows = t.study.network_months
    sizes = rows.groupBy("client_id").agg(F.avg("mpatients").alias("mpatients"))
    both = suffixed_left_join(rows, sizes, ["client_id"]).join(groups, "client_id", "left")
    return both.groupBy("parity_group").agg(F.sum("mpatients_x").alias("tpatients"), weighted_mean(F.col("telehealth"), F.col("mpatients_y")).alias("telehealth"))


@query("mean_by_unit", "AGG-29", sql=f"""
    SELECT client_id, {r6('avg(mpatients)')} AS mpatients, {r6(strict_mean_sql('mental_telehealth'))} AS mental_strict,
           CASE WHEN count(count_mental) = count(*) THEN cast(sum(count_mental) AS bigint) END AS mental_days
    FROM network_months GROUP BY ALL""")
def mean_by_unit(t: Roles) -> DataFrame:
    return t.study.network_months.groupBy("client_id").agg(
        F.avg("mpatients").alias("mpatients"), strict_mean(F.col("mental_telehealth")).alias("mental_strict"),
        strict_sum(F.col("count_mental")).alias("mental_days"))
