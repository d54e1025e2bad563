"""Queries for the composed study operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright import constants as C
from panelwright.functions.codes import clean_code
from panelwright.functions.dates import month_start, parse_visit_date, quarter_label, run_month, run_quarter
from panelwright.functions.means import safe_log
from panelwright.functions.recode import band, flag
from panelwright.functions.sql_functions import register_cause_days, register_means
from panelwright.operators import batches, cleaning, describe, panel, patient_days, policy, quantiles, shares
from panelwright.plans.registry import query
from panelwright.plans.role_sql import CLEAN_DX, case, lenient_wmean, quote, r6, strict_mean, strict_wmean
from panelwright.plans.roles import STUDY, Roles
from panelwright.plans.study import PATIENT
from panelwright.sources.writers import fresh_path

# --- cohort ---------------------------------------------------------------------------------------------------------


@query("cohort_selection", "OP-1", "FLT-7", "JN-1", "AGG-1", sql="""
    SELECT client_id, client_patient_id, birth_year, gender, visit_count, race, hispanic, zip3 FROM patients""")
def cohort_selection(t: Roles) -> DataFrame:
    return t.study.patients.select(*PATIENT, "birth_year", "gender", "visit_count", "race", "hispanic", "zip3")


@query("cohort_attrition", "AGG-20", "OP-1", sql="""
    SELECT 1 AS step_no, 'zip3 known' AS step, count(*) AS rows_in, count(*) FILTER (WHERE zip3 IS NOT NULL) AS rows_out,
           count(*) FILTER (WHERE zip3 IS NULL) AS dropped FROM recoded
    UNION ALL SELECT 2, 'gender known', count(*), count(*) FILTER (WHERE gender <> 'U'),
           count(*) FILTER (WHERE gender = 'U') FROM recoded WHERE zip3 IS NOT NULL
    UNION ALL SELECT 3, 'birth year known', count(*), count(birth_year), count(*) - count(birth_year) FROM recoded
           WHERE zip3 IS NOT NULL AND gender <> 'U'""")
def cohort_attrition(t: Roles) -> DataFrame:
    return cleaning.attrition(t.study.recoded, t.study.eligibility)


@query("demographic_recode", "OP-9", "FN-1", "FN-3", "FN-13", sql="""
    SELECT client_id, client_patient_id, race, hispanic, lang_eng, lang_spa, lang_asi, birth_year FROM recoded""")
def demographic_recode(t: Roles) -> DataFrame:
    return t.study.recoded.select(*PATIENT, "race", "hispanic", "lang_eng", "lang_spa", "lang_asi", "birth_year")


@query("race_ethnicity_combined", "OP-9", sql=f"""
    SELECT re, count(*) AS n FROM (SELECT CASE WHEN hispanic = 1 THEN 'hispanic' WHEN hispanic = 0 THEN
        {case('race', C.RACE_GROUP_NOT_HISPANIC)} END AS re FROM recoded) GROUP BY re""")
def race_ethnicity_combined(t: Roles) -> DataFrame:
    re = panel.combine_race(F.col("race"), F.col("hispanic"))
    return t.study.recoded.groupBy(re.alias("re")).agg(F.count(F.lit(1)).alias("n"))


@query("hierarchical_fill", "OP-10", "JN-7", "JN-8", "FN-2", "FN-4", sql="""
    SELECT client_id, client_patient_id, zip3 FROM recoded""")
def hierarchical_fill(t: Roles) -> DataFrame:
    return t.study.recoded.select(*PATIENT, "zip3")


@query("group_modal_value", "OP-10", sql="""
    SELECT client_id, zip3 FROM (SELECT client_id, zip3, count(*) AS n FROM demographic WHERE zip3 IS NOT NULL
    GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY n DESC, zip3) = 1""")
def group_modal_value(t: Roles) -> DataFrame:
    return cleaning.group_mode(t.demographic, ["client_id"], "zip3")


# --- cause shares ---------------------------------------------------------------------------------------------------


@query("cause_share_by_month", "OP-5", "OP-2", "OP-4", "OP-6", "AGG-24", "WIN-3", "FLT-2", "FLT-4", "JN-11", "SET-2",
       "SET-3", sql=f"""
    SELECT cast(plot_date AS varchar) AS plot_date, family_name, {r6('weight')} AS weight, {r6('prop')} AS prop
    FROM cause_share WHERE remote""")
def cause_share_by_month(t: Roles) -> DataFrame:
    return t.study.cause_shares(t.study.care_rows(True)).drop("remote")


@query("cause_share_in_person", "OP-5", "OP-6", "UDF-1", "FLT-6", sql=f"""
    SELECT cast(plot_date AS varchar) AS plot_date, family_name, {r6('weight')} AS weight, {r6('prop')} AS prop
    FROM cause_share WHERE NOT remote""")
def cause_share_in_person(t: Roles) -> DataFrame:
    """All months in one job instead of one call per month."""
    return t.study.cause_shares(t.study.care_rows(False)).drop("remote")


@query("causes_regrouped", "OP-7", "FN-2", sql=f"""
    SELECT care_type, plot_date::varchar AS plot_date, coalesce(g, family_name) AS family_name,
           {r6('sum(units) / any_value(whole)')} AS weight,
           {r6('sum(units) / sum(sum(units)) OVER (PARTITION BY care_type, plot_date)')} AS prop
    FROM (SELECT *, {case('family_name', C.FAMILY_REGROUP)} AS g FROM care_comparison)
    GROUP BY care_type, plot_date, coalesce(g, family_name)""")
def causes_regrouped(t: Roles) -> DataFrame:
    """Weights are added up exactly and divided once, after the merge."""
    keys = ["care_type", "plot_date"]
    merged = patient_days.regroup_causes(t.study.care_weights, keys, "family_name", C.FAMILY_REGROUP, ["units"])
    return patient_days.cause_share(merged, keys, "family_name", "units")


@query("ptdays_by_cause_lateral", "UDF-1", "UDF-2", "OP-6", sql=f"""
    SELECT cast(plot_date AS varchar) AS plot_date, family_name, {r6('weight')} AS weight, {r6('prop')} AS prop
    FROM cause_share WHERE NOT remote""")
def ptdays_by_cause_lateral(t: Roles) -> DataFrame:
    """The table function of the study, called from SQL for every month at once."""
    weights = t.study.care_weights.where("care_type = 'In-Person'")
    register_cause_days(t.spark, "ptdays_by_cause", weights, "panelwright_in_person_weights")
    return t.spark.sql("""
        SELECT m.plot_date, d.family_name, d.weight, d.prop
        FROM (SELECT DISTINCT plot_date FROM panelwright_in_person_weights) m, LATERAL ptdays_by_cause(m.plot_date) d""")


@query("means_from_sql", "UDF-2", "AGG-7", "AGG-8", sql=f"""
    SELECT state, {r6("CASE WHEN count(mental_telehealth) = count(*) THEN avg(mental_telehealth) END")} AS strict, {r6('avg(mental_telehealth)')} AS lenient,
           {r6("CASE WHEN count(*) FILTER (WHERE mental_telehealth IS NULL) = 0 THEN sum(mental_telehealth * mpatients) / sum(mpatients) END")} AS strict_w,
           {r6("sum(mental_telehealth * mpatients) / nullif(sum(mpatients) FILTER (WHERE mental_telehealth IS NOT NULL), 0)")} AS lenient_w
    FROM network_months GROUP BY state""")
def means_from_sql(t: Roles) -> DataFrame:
    register_means(t.spark)
    t.study.network_months.createOrReplaceTempView("panelwright_network_months")
    return t.spark.sql("""
        SELECT state, strict_mean(sum(x), count(x), count(*)) AS strict, lenient_mean(sum(x), count(x)) AS lenient,
               strict_weighted_mean(sum(x * w), sum(w), count_if(x IS NULL)) AS strict_w,
               lenient_weighted_mean(sum(x * w), sum(w) FILTER (WHERE x IS NOT NULL)) AS lenient_w
        FROM (SELECT state, mental_telehealth AS x, CAST(mpatients AS DOUBLE) AS w FROM panelwright_network_months) GROUP BY state""")


RUN_MONTHS = [f"{STUDY.years[0]}-0{m}-01" for m in (1, 2, 3)]


@query("months_taken_up_again", "OP-6", "SET-3", "SNK-5", sql=f"""
    SELECT cast(plot_date AS varchar) AS plot_date, family_name, {r6('weight')} AS weight, {r6('prop')} AS prop,
           CASE WHEN plot_date = date '{RUN_MONTHS[1]}' THEN 2 ELSE 1 END AS attempt
    FROM cause_share WHERE NOT remote AND plot_date IN ({', '.join(f"date '{m}'" for m in RUN_MONTHS)})""")
def months_taken_up_again(t: Roles) -> DataFrame:
    """Three months of in-person care: the second one fails in the first run, the second run does only that one."""
    facts, out, book = (fresh_path(t.spark, label) for label in ("facts", "months", "ledger"))
    batches.lay_out(t.study.care_rows(False).withColumn("plot_date", month_start(F.col("visit_date"))), "plot_date", facts)
    ledger, attempts = batches.Ledger(t.spark, book), {}

    def compute(rows: DataFrame) -> DataFrame:
        month = rows.select("plot_date").first()["plot_date"].isoformat()
        attempts[month] = attempts.get(month, 0) + 1
        if month == RUN_MONTHS[1] and attempts[month] == 1:
            raise RuntimeError("cut off")
        return t.study.cause_shares(rows.drop("plot_date")).drop("remote").withColumn("attempt", F.lit(attempts[month]))

    try:
        batches.run_months(t.spark, facts, "plot_date", RUN_MONTHS, compute, out, ledger)
    except batches.MonthFailed as failure:
        assert list(failure.months) == [RUN_MONTHS[1]]
    batches.run_months(t.spark, facts, "plot_date", RUN_MONTHS, compute, out, ledger)
    return t.spark.read.parquet(out).drop("batch")


#: A stop and a new start for every state with a policy window: in force for six months, off for three, then on for good.
EPISODE_MONTHS, EPISODE_GAP = 6, 3


@query("policy_episodes", "OP-13", "JN-9", sql=f"""
    WITH episodes AS (
      SELECT state, start_run, start_run + {EPISODE_MONTHS - 1} AS end_run, 1 AS episode, policy_group FROM policy WHERE start_run IS NOT NULL
      UNION ALL SELECT state, start_run + {EPISODE_MONTHS + EPISODE_GAP}, NULL, 2, policy_group FROM policy WHERE start_run IS NOT NULL
      UNION ALL SELECT state, NULL, end_run, 1, policy_group FROM policy WHERE start_run IS NULL),
    rows AS (SELECT client_id, month, state, cast((year(month) - {STUDY.anchor.year}) * 12 + month(month) - {STUDY.anchor.month} AS int) AS run_month
             FROM network_months)
    SELECT client_id, month::varchar AS month, p.state IS NOT NULL AS parity, e.state IS NOT NULL AS parity_month, e.episode::int AS episode,
           (run_month - e.start_run)::int AS months_in, coalesce(p.policy_group, '{C.GROUP_NEVER}') AS parity_group
    FROM rows r LEFT JOIN episodes e ON e.state = r.state AND run_month >= coalesce(start_run, run_month) AND run_month <= coalesce(end_run, run_month)
         LEFT JOIN policy p ON p.state = r.state""")
def policy_episodes(t: Roles) -> DataFrame:
    table = policy.policy_table(t.spark)
    first = table.where("start_run IS NOT NULL").withColumn("end_run", F.col("start_run") + EPISODE_MONTHS - 1)
    again = table.where("start_run IS NOT NULL").withColumns({"start_run": F.col("start_run") + EPISODE_MONTHS + EPISODE_GAP, "end_run": F.lit(None).cast("int")})
    episodes = first.unionByName(again).unionByName(table.where("start_run IS NULL"))
    rows = t.study.network_months.withColumn("run_month", run_month(F.col("month"), STUDY.anchor))
    out = policy.attach_episodes(rows, episodes, "run_month")
    return out.select("client_id", "month", "parity", "parity_month", "episode", "months_in", "parity_group")


@query("resolved_code_map", "OP-3", "OP-4", sql="""
    SELECT icd_code AS dx,
           CASE WHEN b THEN n_acause ELSE t_acause END AS acause, CASE WHEN b THEN n_name ELSE t_name END AS icd_name
    FROM (SELECT *, coalesce((t_acause IS NULL AND n_acause IS NOT NULL) OR (t_acause = '_gc' AND n_acause <> '_gc'), false)
                 AS b
          FROM (SELECT icd_code, max(acause) FILTER (WHERE code_system = 'icd10') AS t_acause,
                       max(acause) FILTER (WHERE code_system = 'icd9') AS n_acause,
                       max(icd_name) FILTER (WHERE code_system = 'icd10') AS t_name,
                       max(icd_name) FILTER (WHERE code_system = 'icd9') AS n_name
                FROM code_dimension GROUP BY ALL))""")
def resolved_code_map(t: Roles) -> DataFrame:
    return t.study.resolved_codes.select("dx", "acause", "icd_name")


# --- panel ----------------------------------------------------------------------------------------------------------


@query("panel_assembled", "OP-12", "OP-13", "OP-14", "OP-15", "FN-16", "WIN-5", "JN-7", sql=f"""
    SELECT client_id, month::varchar AS month, cast(imp AS int) AS imp, state, {r6('wnh')} AS wnh, {r6('bnh')} AS bnh,
           {r6('hispanic')} AS hispanic, {r6('telehealth')} AS telehealth, mpatients, run_month, period, parity,
           parity_month, parity_group, rural, poverty, small, more_wnh, {r6('index')} AS index FROM panel""")
def panel_assembled(t: Roles) -> DataFrame:
    return t.study.panel.select(
        "client_id", "month", "imp", "state", "wnh", "bnh", "hispanic", "telehealth", "mpatients", "run_month", "period",
        "parity", "parity_month", "parity_group", "rural", "poverty", "small", "more_wnh", "index")


@query("policy_status", "OP-13", "FN-1", "FN-16", sql="""
    SELECT state, run_month, policy_group IS NOT NULL AS parity,
           policy_group IS NOT NULL AND (start_run IS NULL OR run_month >= start_run)
               AND (end_run IS NULL OR run_month <= end_run) AS parity_month,
           coalesce(policy_group, 'Never') AS parity_group, n
    FROM (SELECT state, cast((year(month) - 1995) * 12 + month(month) - 12 AS int) AS run_month, count(*) AS n
          FROM network_months GROUP BY ALL) LEFT JOIN policy USING (state)""")
def policy_status(t: Roles) -> DataFrame:
    months = t.study.network_months.groupBy("state", run_month(F.col("month"), STUDY.anchor).alias("run_month")).agg(
        F.count(F.lit(1)).alias("n"))
    out = policy.attach_policy(months, policy.policy_table(t.spark), "run_month")
    return out.select("state", "run_month", "parity", "parity_month", "parity_group", "n")


@query("pandemic_period", "OP-14", sql=f"""
    SELECT cast(CASE WHEN month < date '{STUDY.pandemic_start}' THEN 1 WHEN month < date '{STUDY.pandemic_second}' THEN 2
                ELSE 3 END AS int) AS period, cast(sum(mpatients) AS bigint) AS mpatients
    FROM network_months GROUP BY ALL""")
def pandemic_period(t: Roles) -> DataFrame:
    period = policy.pandemic_period(F.col("month"), STUDY.pandemic_start, STUDY.pandemic_second)
    return t.study.network_months.groupBy(period.alias("period")).agg(F.sum("mpatients").alias("mpatients"))


@query("stringency_lookup", "OP-15", sql=f"""
    SELECT client_id, month::varchar AS month,
           {r6(f"CASE WHEN month < date '{STUDY.pandemic_start}' THEN 0.0 ELSE index END")} AS index
    FROM network_months n LEFT JOIN stringency s ON n.state = s.state""")
def stringency_lookup(t: Roles) -> DataFrame:
    out = policy.attach_stringency(t.study.network_months, policy.stringency_table(t.spark), "month",
                                   STUDY.pandemic_start)
    return out.select("client_id", "month", "index")


@query("baseline_year_summary", "OP-16", "AGG-7", "AGG-11", "AGG-12", sql=f"""
    SELECT client_id, cast(imp AS int) AS imp, {r6('telehealth')} AS telehealth, {r6('mental_telehealth')} AS mental_telehealth,
           {r6('pct_65plus')} AS pct_65plus, {r6('wnh')} AS wnh, {r6('hispanic')} AS hispanic, state, zip3, mpatients
    FROM baseline""")
def baseline_year_summary(t: Roles) -> DataFrame:
    return t.study.baseline.select("client_id", "imp", "telehealth", "mental_telehealth", "pct_65plus", "wnh",
                                   "hispanic", "state", "zip3", "mpatients")


@query("state_month_rollup", "OP-17", "AGG-7", "AGG-12", sql="SELECT month::varchar AS month, state, cast(imp AS int) AS imp, "
       + ", ".join(f"{r6(strict_wmean(c, 'mpatients'))} AS {c}" for c in
                   ("telehealth", "pct_65plus", "wnh", "change_patients", "rural", "poverty"))
       + """, any_value(parity_group) AS parity_group, any_value(parity_month) AS parity_month,
       any_value(run_month) AS run_month, cast(sum(mpatients) AS bigint) AS mpatients FROM panel GROUP BY month, state, imp""")
def state_month_rollup(t: Roles) -> DataFrame:
    return t.study.state_months.select(
        "month", "state", "imp", "telehealth", "pct_65plus", "wnh", "change_patients", "rural", "poverty",
        "parity_group", "parity_month", "run_month", "mpatients")


@query("group_month_rates", "OP-18", "AGG-9", "FN-1", sql=f"""
    SELECT re, label, month::varchar AS month, cast(imp AS int) AS imp, {r6('t')} AS telehealth, mpatients,
           {r6('sqrt(t * (100 - t) / mpatients)')} AS se
    FROM (SELECT re, {case('re', C.GROUP_LABELS)} AS label, month, imp,
                 100 * sum(telehealth * mpatients) / sum(mpatients) AS t, cast(sum(mpatients) AS bigint) AS mpatients
          FROM by_group WHERE month < date '{STUDY.end}' GROUP BY ALL)""")
def group_month_rates(t: Roles) -> DataFrame:
    return t.study.group_rates


_quarter = f"cast(quarter(month) + (year(month) - {STUDY.years[0]}) * 4 AS int)"
_client_means = ("u65_telehealth", "mpatients", "pct_65plus", "wnh", "change_patients", "rural", "index")
MAIN_SQL = f"""(SELECT * REPLACE (CASE WHEN state = 'GA' THEN '{C.GROUP_WAVE}' ELSE parity_group END AS parity_group)
                FROM panel)"""


@query("client_quarter_panel", "OP-19", "OP-20", "FN-15", "FN-22", sql=f"""
    SELECT client_id, {_quarter} AS quarter, cast(imp AS int) AS imp, {r6(strict_mean('telehealth') + ' * 100')} AS telehealth,
           {', '.join(f"{r6(strict_mean(c))} AS {c}" for c in _client_means if c != 'u65_telehealth')},
           any_value(parity_group) AS parity_group,
           {r6('ln(avg(mpatients))')} AS lpatients
    FROM {MAIN_SQL} WHERE parity_group <> '{C.GROUP_OTHER}' GROUP BY ALL""")
def client_quarter_panel(t: Roles) -> DataFrame:
    out = t.study.client_quarters(t.study.main_rows)
    return out.select("client_id", "quarter", "imp", "telehealth", "mpatients", "pct_65plus", "wnh", "change_patients",
                      "rural", "index", "parity_group", "lpatients")


@query("state_quarter_panel", "OP-19", "OP-20", "AGG-8", "AGG-26", sql=f"""
    SELECT state, {_quarter} AS quarter, cast(imp AS int) AS imp,
           {r6('100 * (' + lenient_wmean('telehealth', 'mpatients') + ')')} AS telehealth,
           {', '.join(f"{r6(lenient_wmean(c, 'mpatients'))} AS {c}" for c in ('pct_65plus', 'wnh', 'change_patients', 'index'))},
           any_value(parity_group) AS parity_group, {r6('ln(sum(mpatients))')} AS lpatients
    FROM {MAIN_SQL} WHERE parity_group <> '{C.GROUP_OTHER}' GROUP BY ALL""")
def state_quarter_panel(t: Roles) -> DataFrame:
    out = t.study.state_quarters(t.study.main_rows)
    return out.select("state", "quarter", "imp", "telehealth", "pct_65plus", "wnh", "change_patients", "index",
                      "parity_group", "lpatients")


@query("states_regrouped_for_model", "OP-20", "ST-11", sql=f"""
    SELECT state, parity_group, count(*) AS n FROM
    (SELECT state, month, CASE WHEN state = 'GA' THEN '{C.GROUP_WAVE}' WHEN state IN ('NY', 'MD', 'OK', 'OR') THEN 'Never'
                        ELSE coalesce(policy_group, 'Never') END AS parity_group
     FROM network_months LEFT JOIN policy USING (state))
    WHERE parity_group <> '{C.GROUP_OTHER}' AND month < date '{STUDY.alternative_end}' GROUP BY ALL""")
def states_regrouped_for_model(t: Roles) -> DataFrame:
    rows = policy.attach_policy(t.study.network_months.withColumn("run_month", run_month(F.col("month"), STUDY.anchor)),
                                policy.policy_table(t.spark), "run_month")
    late = {s: C.GROUP_NEVER for s in ("NY", "MD", "OK", "OR")}
    moved = policy.regroup_states(rows, {**late, "GA": C.GROUP_WAVE})
    kept = moved.where((F.col("parity_group") != C.GROUP_OTHER) & (F.col("month") < F.lit(STUDY.alternative_end)))
    return kept.groupBy("state", "parity_group").agg(F.count(F.lit(1)).alias("n"))


@query("treatment_indicators", "OP-21", sql="""
    SELECT state, run_month, on_now AS treated, CASE WHEN run_month = 1 THEN 0 ELSE on_now END AS treated_after_first
    FROM (SELECT DISTINCT state, cast((year(month) - 1995) * 12 + month(month) - 12 AS int) AS run_month,
                 CASE WHEN policy_group IS NOT NULL AND (start_run IS NULL OR run_month >= start_run)
                      AND (end_run IS NULL OR run_month <= end_run) THEN 1 ELSE 0 END AS on_now
          FROM network_months LEFT JOIN policy USING (state))""")
def treatment_indicators(t: Roles) -> DataFrame:
    rows = policy.attach_policy(t.study.network_months.withColumn("run_month", run_month(F.col("month"), STUDY.anchor)),
                                policy.policy_table(t.spark), "run_month")
    on, period = F.col("parity_month"), F.col("run_month")
    return rows.select("state", "run_month", policy.treatment_indicator(on, period).alias("treated"),
                       policy.treatment_indicator(on, period, 1).alias("treated_after_first")).distinct()


# --- stratified series ----------------------------------------------------------------------------------------------


def series_sql(stratum: str, rate: str = "telehealth", rows: str = "network_months", lenient: bool = False,
               having: str = "true") -> str:
    """Check text of one stratified series."""
    mean = lenient_wmean(rate, "w") if lenient else strict_wmean(rate, "w")
    used = f"sum(w * w) FILTER (WHERE {rate} IS NOT NULL)" if lenient else "sum(w * w)"
    return f"""
        SELECT month, stratum, {r6('p')} AS percent, {r6('p - 1.96 * sqrt(w2 * p * (100 - p))')} AS lci,
               {r6('p + 1.96 * sqrt(w2 * p * (100 - p))')} AS uci
        FROM (SELECT month::varchar AS month, {stratum} AS stratum, 100 * ({mean}) AS p, {used} AS w2
              FROM (SELECT *, mpatients / sum(mpatients) OVER () AS w FROM {rows}) WHERE {having} GROUP BY ALL)"""


SIZED_SQL = "(SELECT *, avg(mpatients) OVER (PARTITION BY client_id) AS avg_patients FROM network_months)"


@query("series_by_rurality", "OP-22", "OP-23", "FN-20", sql=series_sql(
    f"CASE WHEN pct_rural_2010 < {C.RURAL_PERCENT} THEN 'Urban' ELSE 'Rural' END"))
def series_by_rurality(t: Roles) -> DataFrame:
    return describe.time_series(t.study.network_months, band(F.col("pct_rural_2010"), [C.RURAL_PERCENT],
                                                             ["Urban", "Rural"]))


@query("series_by_rural_band", "OP-22", "OP-23", "FN-1", sql=series_sql(
    "CASE WHEN pct_rural_2010 < 5.3 THEN 'Most urban' WHEN pct_rural_2010 < 27.4 THEN 'Part urban' "
    "WHEN pct_rural_2010 < 39 THEN 'Part rural' ELSE 'Most rural' END"))
def series_by_rural_band(t: Roles) -> DataFrame:
    return describe.time_series(t.study.network_months, band(F.col("pct_rural_2010"), C.RURAL_BAND_EDGES,
                                                             C.RURAL_BAND_LABELS))


@query("series_by_poverty", "OP-22", "OP-23", sql=series_sql(
    f"CASE WHEN povertyrate > {C.POVERTY_PERCENT} THEN 'More poverty' ELSE 'Less poverty' END"))
def series_by_poverty(t: Roles) -> DataFrame:
    poor = flag(F.col("povertyrate") > C.POVERTY_PERCENT)
    return describe.time_series(t.study.network_months, F.when(poor == 1, "More poverty").when(poor == 0, "Less poverty"))


@query("series_by_size", "OP-22", "OP-23", "WIN-5", sql=series_sql(
    "CASE WHEN avg_patients < 3 THEN 'Small' ELSE 'Large' END", rows=SIZED_SQL))
def series_by_size(t: Roles) -> DataFrame:
    sized = shares.group_mean(t.study.network_months, ["client_id"], F.col("mpatients"), "avg_patients", bounded=True)
    return describe.time_series(sized, band(F.col("avg_patients"), [3], ["Small", "Large"]))


@query("series_by_size_quintile", "OP-22", "OP-23", "WIN-9", "FN-18", sql=series_sql(
    "CASE WHEN avg_patients <= b[2] THEN 1 WHEN avg_patients <= b[3] THEN 2 WHEN avg_patients <= b[4] THEN 3 "
    "WHEN avg_patients <= b[5] THEN 4 ELSE 5 END",
    rows=f"{SIZED_SQL}, (SELECT quantile_cont(avg_patients, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS b FROM {SIZED_SQL})"))
def series_by_size_quintile(t: Roles) -> DataFrame:
    sized = shares.group_mean(t.study.network_months, ["client_id"], F.col("mpatients"), "avg_patients", bounded=True)
    binned = quantiles.quantile_bins(sized, "avg_patients", 5, "size_det")
    return describe.time_series(binned, F.col("size_det"))


@query("series_by_region", "OP-22", "OP-23", "FN-3", sql=series_sql(
    "CASE " + " ".join(f"WHEN state IN ({quote(s)}) THEN '{r}'" for r, s in C.REGIONS.items()) + " END"))
def series_by_region(t: Roles) -> DataFrame:
    return describe.time_series(t.study.network_months, describe.region_of(F.col("state")))


def by_measure(rows: DataFrame, measure: str, label: str) -> DataFrame:
    """Long form of one special rate against the overall rate, panel weights kept."""
    weighted = shares.share_of_all(rows, "mpatients", "w")
    return weighted.unpivot(["client_id", "month", "w", "count_mental"], [measure, "telehealth"], "stratum", "rate").withColumn(
        "stratum", F.when(F.col("stratum") == "telehealth", "All").otherwise(label))


_long_sql = """(SELECT client_id, month, w, count_mental, unnest(['{label}', 'All']) AS stratum,
                       unnest([{measure}, telehealth]) AS rate
                FROM (SELECT *, mpatients / sum(mpatients) OVER () AS w FROM network_months))"""


def long_series_sql(measure: str, label: str, having: str) -> str:
    return series_sql("stratum", "rate", _long_sql.format(measure=measure, label=label), True, having).replace(
        "(SELECT *, mpatients / sum(mpatients) OVER () AS w FROM (SELECT client_id",
        "(SELECT * FROM (SELECT client_id")


@query("series_under_65", "OP-22", "RSH-3", "AGG-8", sql=long_series_sql("u65_telehealth", "Under 65", "true"))
def series_under_65(t: Roles) -> DataFrame:
    long = by_measure(t.study.network_months, "u65_telehealth", "Under 65")
    return describe.weighted_percent_ci(long, ["month", "stratum"], "rate", "w", lenient=True)


@query("series_mental_health", "OP-22", "RSH-3", "FLT-12", sql=long_series_sql(
    "mental_telehealth", "Mental health care", "count_mental > 0"))
def series_mental_health(t: Roles) -> DataFrame:
    long = by_measure(t.study.network_months, "mental_telehealth", "Mental health care").where("count_mental > 0")
    return describe.weighted_percent_ci(long, ["month", "stratum"], "rate", "w", lenient=True)


@query("series_by_policy_group", "OP-22", "FLT-10", sql=f"""
    SELECT * FROM ({series_sql(f"CASE WHEN coalesce(policy_group, 'Never') = '{C.GROUP_OTHER}' THEN state "
                               "ELSE coalesce(policy_group, 'Never') END",
                               rows="network_months LEFT JOIN policy USING (state)")}) WHERE stratum <> 'Never'""")
def series_by_policy_group(t: Roles) -> DataFrame:
    rows = policy.attach_policy(t.study.network_months.withColumn("run_month", run_month(F.col("month"), STUDY.anchor)),
                                policy.policy_table(t.spark), "run_month")
    group = F.when(F.col("parity_group") == C.GROUP_OTHER, F.col("state")).otherwise(F.col("parity_group"))
    return describe.time_series(rows, group).where(F.col("stratum") != C.GROUP_NEVER)


@query("map_of_networks", "OP-24", "FN-1", "AGG-23", "SET-1", sql=f"""
    SELECT state, clients, CASE WHEN state IN ({quote(C.POLICY_ALWAYS)}) THEN 'Before 2019'
        WHEN state IN ({quote(C.POLICY_WAVE)}) THEN 'April 2020'
        ELSE coalesce({case('state', C.POLICY_START_LABELS)}, 'Never') END AS parity_date
    FROM (SELECT state, CASE WHEN n < 4 THEN '1-3' WHEN n < 7 THEN '4-6' WHEN n < 15 THEN '7-15' ELSE 'Over 15' END AS clients
          FROM (SELECT state, count(*) AS n FROM client_dem GROUP BY ALL)
          UNION ALL SELECT s, '0' FROM (SELECT unnest([{quote(C.STATES_WITHOUT_NETWORKS)}]) AS s)
          WHERE s NOT IN (SELECT state FROM client_dem WHERE state IS NOT NULL))""")
def map_of_networks(t: Roles) -> DataFrame:
    buckets = describe.count_buckets(t.client_dem, "state", [(4, "1-3"), (7, "4-6"), (15, "7-15")], "Over 15")
    full = describe.add_zero_states(buckets, {s: "0" for s in C.STATES_WITHOUT_NETWORKS})
    return full.withColumn("parity_date", policy.policy_start_label(F.col("state")))


# --- scalar functions -----------------------------------------------------------------------------------------------


@query("date_functions", "FN-5", "FN-6", "FN-14", "FN-15", "FN-16", "FN-18", "FN-7", sql="""
    SELECT date, d::varchar AS visit_date, cast(date_trunc('month', d) AS date)::varchar AS month, year(d)::int AS year,
           cast(quarter(d) + (year(d) - 1996) * 4 AS int) AS run_quarter,
           cast((year(d) - 1995) * 12 + month(d) - 12 AS int) AS run_month,
           'Q' || quarter(d) || ' ' || year(d) AS quarter_label, n
    FROM (SELECT date, CASE WHEN length(date) = 8 THEN cast(try_strptime(date, '%Y%m%d') AS date)
                            WHEN length(date) = 10 THEN cast(try_strptime(date, '%Y-%m-%d') AS date) END AS d, n
          FROM (SELECT date, count(*) AS n FROM procedure GROUP BY ALL))""")
def date_functions(t: Roles) -> DataFrame:
    dates = t.procedure.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    d = F.col("visit_date")
    return dates.withColumn("visit_date", parse_visit_date(F.col("date"))).select(
        "date", "visit_date", month_start(d).alias("month"), F.year(d).alias("year"),
        run_quarter(d, 1996).alias("run_quarter"), run_month(d, STUDY.anchor).alias("run_month"),
        quarter_label(run_quarter(d, 1996), 1996).alias("quarter_label"), "n")


@query("code_clean_up", "FN-8", "FN-9", "FN-13", sql=f"""
    SELECT dx1_code, {CLEAN_DX} AS dx, try_cast(substring(upper(replace(dx1_code, '.', '')), 2) AS int) AS number,
           count(*) AS n FROM procedure GROUP BY ALL""")
def code_clean_up(t: Roles) -> DataFrame:
    number = F.substring(F.upper(F.replace("dx1_code", F.lit("."), F.lit(""))), 2, 20).try_cast("int")
    return t.procedure.groupBy("dx1_code", clean_code(F.col("dx1_code")).alias("dx"), number.alias("number")).agg(
        F.count(F.lit(1)).alias("n"))


@query("age_bands", "FN-19", "FN-1", "FN-12", sql=f"""
    SELECT age, n, printf('%d (%.0f%%)', n, 100.0 * n / sum(n) OVER ()) AS cell
    FROM (SELECT CASE WHEN {STUDY.age_year} - birth_year < 15 THEN 'Under 15' WHEN {STUDY.age_year} - birth_year < 65
                 THEN '15-64' ELSE '65 plus' END AS age, count(*) AS n FROM patients GROUP BY ALL)""")
def age_bands(t: Roles) -> DataFrame:
    age = band(STUDY.age_year - F.col("birth_year"), [15, 65], ["Under 15", "15-64", "65 plus"])
    counted = t.study.patients.groupBy(age.alias("age")).agg(F.count(F.lit(1)).alias("n"))
    shared = shares.share_of_all(counted, "n", "share")
    return shared.select("age", "n", F.concat(F.col("n").cast("string"), F.lit(" ("), describe.percent_text(
        100 * F.col("share")), F.lit(")")).alias("cell"))


@query("flags_and_powers", "FN-17", "FN-20", "FN-22", sql=f"""
    SELECT client_id, CASE WHEN pct_rural_2010 > {C.RURAL_PERCENT} THEN 1 ELSE 0 END AS rural,
           CASE WHEN zip3 > 105 THEN 1 WHEN zip3 <= 105 THEN 0 END AS high_area,
           {r6('sqrt(povertyrate)')} AS root, {r6('povertyrate ^ 2')} AS square,
           {r6('CASE WHEN povertyrate > 0 THEN ln(povertyrate) END')} AS log_rate, {r6('povertyrate / 1000')} AS thousands
    FROM client_dem""")
def flags_and_powers(t: Roles) -> DataFrame:
    rate = F.col("povertyrate")
    return t.client_dem.select(
        "client_id", flag(F.col("pct_rural_2010") > C.RURAL_PERCENT).alias("rural"),
        flag(F.col("zip3") > 105).alias("high_area"), F.sqrt(rate).alias("root"), F.pow(rate, F.lit(2)).alias("square"),
        safe_log(rate).alias("log_rate"), (rate / 1000).alias("thousands"))
