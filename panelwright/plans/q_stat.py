"""Queries for imputation, pooling, fixed effects and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright import constants as C
from panelwright.functions.dates import quarter_label, run_month, run_quarter
from panelwright.functions.draws import draw_sql
from panelwright.operators import fixed_effects, impute, matching, numbering, panel, policy
from panelwright.operators.fixed_effects import EventStudy, fit_event_study
from panelwright.operators.gram import Model, fit_models
from panelwright.operators.pooling import pool
from panelwright.operators.reshape import stack_copies
from panelwright.operators.skew import broadcast_if_small
from panelwright.plans.registry import query
from panelwright.plans.role_sql import M, r6
from panelwright.plans.roles import STUDY, Roles
from panelwright.plans.study import PATIENT
from panelwright.sources.writers import settle

LEADS = (0, 3, 6, 9, 12)
REPLICATES = 100

# --- imputation -----------------------------------------------------------------------------------------------------


@query("impute_by_hot_deck", "ST-1", "RSH-6", "OP-9", sql="""
    SELECT client_id, client_patient_id, cast(imp AS int) AS imp, race, cast(hispanic AS int) AS hispanic, re FROM stacked""")
def impute_by_hot_deck(t: Roles) -> DataFrame:
    return impute.stack_completed(t.study.completed, M).select(*PATIENT, "imp", "race", "hispanic", "re")


@query("impute_by_model", "ST-1")
def impute_by_model(t: Roles) -> DataFrame:
    """One chained pass: race from a multinomial model that sees ethnicity, then ethnicity from a logit that sees race."""
    people = t.study.patients.join(broadcast_if_small(t.client_dem.select("client_id", "pct_rural_2010", "povertyrate")),
                                   "client_id")
    features = {"age": (STUDY.age_year - F.col("birth_year")) / 100, "female": F.when(F.col("gender") == "F", 1).otherwise(0),
                "eng": F.col("lang_eng").cast("int"), "spa": F.col("lang_spa").cast("int"), "rural": F.col("pct_rural_2010") / 100,
                "poor": F.col("povertyrate") / 100}
    targets = [impute.Target("race", tuple(sorted(set(C.RACE_CODES.values()))), (*features, "hispanic")),
               impute.Target("hispanic", (0, 1), (*features, "race"))]
    both = impute.chained(people, targets, features, F.col("client_patient_id"), M, 1, STUDY.seed)
    stacked = impute.stack_completed(both, M)
    return stacked.withColumn("re", panel.combine_race(F.col("race"), F.col("hispanic"))).select(
        *PATIENT, "imp", "race", "hispanic", "re")


#: (target, what it sees) of a chain of three columns, and its passes.
DECK_CHAIN = (("race", ("speaks",)), ("hispanic", ("race",)), ("speaks", ("race", "hispanic")))
DECK_PASSES = 2


def _deck_chain_sql() -> str:
    """The chain step by step: donors of a step are all rows of a copy in which its target was observed."""
    names = [n for n, _ in DECK_CHAIN]
    steps = [f"""
    chain_0 AS MATERIALIZED (
      SELECT client_id, client_patient_id, i.imp, {', '.join(f'{n} IS NULL AS gap_{n}' for n in names)}, {', '.join(
          f"coalesce({n}, (SELECT min(class) FROM first_{n} d WHERE d.upto > {draw_sql('client_patient_id', 'i.imp', STUDY.seed + j)} % d.total)) AS {n}"
          for j, n in enumerate(names))}
      FROM speakers, range(1, {M + 1}) i(imp))"""]
    first = [f"""
    first_{n} AS MATERIALIZED (SELECT {n} AS class, sum(count(*)) OVER (ORDER BY {n}) AS upto, sum(count(*)) OVER () AS total
                               FROM speakers WHERE {n} IS NOT NULL GROUP BY {n})""" for n in names]
    for k in range(DECK_PASSES * len(names)):
        n, sees = DECK_CHAIN[k % len(names)]
        draw = draw_sql("c.client_patient_id", "c.imp", STUDY.seed + 10 * (k + 1) + len(names))
        by = ", ".join(("imp", *sees))
        same = " AND ".join(f"d.{s} = c.{s}" for s in ("imp", *sees))
        keep = ", ".join(x for x in names if x != n)
        steps.append(f"""
    near_{k} AS MATERIALIZED (SELECT {by}, {n} AS class, sum(count(*)) OVER (PARTITION BY {by} ORDER BY {n}) AS upto,
                                     sum(count(*)) OVER (PARTITION BY {by}) AS total FROM chain_{k} WHERE NOT gap_{n} GROUP BY {by}, {n}),
    any_{k} AS MATERIALIZED (SELECT {n} AS class, sum(count(*)) OVER (ORDER BY {n}) AS upto, sum(count(*)) OVER () AS total
                             FROM chain_{k} WHERE NOT gap_{n} GROUP BY {n}),
    chain_{k + 1} AS MATERIALIZED (
      SELECT client_id, client_patient_id, imp, {', '.join(f'gap_{x}' for x in names)}, {keep}, CASE WHEN NOT gap_{n} THEN {n} ELSE coalesce(
        (SELECT min(class) FROM near_{k} d WHERE {same} AND d.upto > {draw} % d.total),
        (SELECT min(class) FROM any_{k} d WHERE d.upto > {draw} % d.total)) END AS {n}
      FROM chain_{k} c)""")
    return f"""WITH speakers AS MATERIALIZED (
      SELECT *, CASE WHEN lang_eng THEN 'eng' WHEN lang_spa THEN 'spa' WHEN lang_asi THEN 'asi' END AS speaks FROM patients),
    {','.join(first)}, {','.join(steps)}
    SELECT client_id, client_patient_id, imp::int AS imp, race, hispanic::int AS hispanic, speaks FROM chain_{DECK_PASSES * len(names)}"""


@query("impute_chained_decks", "ST-1", "RSH-6", sql=_deck_chain_sql())
def impute_chained_decks(t: Roles) -> DataFrame:
    """Three columns with gaps, two passes; each is drawn within strata of the others as they stand."""
    speaks = F.when(F.col("lang_eng"), "eng").when(F.col("lang_spa"), "spa").when(F.col("lang_asi"), "asi")
    classes = {"race": tuple(sorted(set(C.RACE_CODES.values()))), "hispanic": (0, 1), "speaks": ("asi", "eng", "spa")}
    targets = [impute.Target(n, classes[n], sees, "deck") for n, sees in DECK_CHAIN]
    people = t.study.patients.withColumn("speaks", speaks)
    filled = impute.chained(people, targets, {}, F.col("client_patient_id"), M, DECK_PASSES, STUDY.seed)
    return impute.stack_completed(filled, M).select(*PATIENT, "imp", "race", "hispanic", "speaks")


# --- pooling --------------------------------------------------------------------------------------------------------


@query("pooled_group_rates", "ST-5", "ST-10", "RSH-2", "RSH-5", sql=f"""
    SELECT re, month, {r6('est')} AS est_adj, {r6('v_b')} AS v_b, {r6('v_w')} AS v_w, {r6('vt')} AS v_total,
           {r6('sqrt(vt)')} AS se_pooled, {r6('est - 1.96 * sqrt(vt)')} AS lci, {r6('est + 1.96 * sqrt(vt)')} AS uci
    FROM (SELECT *, v_w + v_b + v_b / {M} AS vt FROM
          (SELECT re, month::varchar AS month, CASE WHEN count(t) = {M} AND count(se) = {M} THEN avg(t) END AS est,
                  CASE WHEN count(t) = {M} AND count(se) = {M} THEN var_samp(t) END AS v_b,
                  CASE WHEN count(t) = {M} AND count(se) = {M} THEN avg(se * se) END AS v_w
           FROM (SELECT *, sqrt(t * (100 - t) / n) AS se FROM
                 (SELECT re, month, imp, 100 * sum(telehealth * mpatients) / sum(mpatients) AS t, sum(mpatients) AS n
                  FROM by_group WHERE month < date '{STUDY.end}' GROUP BY ALL)) GROUP BY ALL))""")
def pooled_group_rates(t: Roles) -> DataFrame:
    return pool(t.study.group_rates, ["re", "month"], "telehealth", "se", M)


# --- fixed effects --------------------------------------------------------------------------------------------------


def pooled_effects(fits: DataFrame, *keys: str) -> DataFrame:
    """Pool every effect over the copies and label its quarter; with the rows, units and left-out columns of its fits."""
    by = [*keys, "parity_group", "quarter", "kind"]
    effects = settle(fits.where("quarter > 1"), "fits")
    counts = effects.groupBy(*by).agg(*[F.max(c).alias(c) for c in ("n_rows", "n_units", "n_dropped")])
    out = pool(effects, by, "coef", "se", M).join(counts, by)
    return out.withColumn("label", quarter_label(F.col("quarter"), STUDY.years[0]))


@query("effects_early_policies", "ST-2", "ST-4", "ST-5", "OP-19")
def effects_early_policies(t: Roles) -> DataFrame:
    """Before the wave of policies: early adopters against the rest."""
    return pooled_effects(t.study.fits(["early"]))


@query("effects_state_level", "ST-2", "ST-4", "ST-5", "OP-19")
def effects_state_level(t: Roles) -> DataFrame:
    return pooled_effects(t.study.fits(["state_groups", "state_combined"]))


@query("effects_client_level", "ST-2", "ST-4", "ST-5", "SET-5", "RSH-4")
def effects_client_level(t: Roles) -> DataFrame:
    return pooled_effects(t.study.fits(["client_groups", "client_combined"]))


@query("effects_under_65", "ST-2", "ST-4", "ST-5")
def effects_under_65(t: Roles) -> DataFrame:
    return pooled_effects(t.study.fits(["under_65_groups", "under_65_combined"]))


@query("effects_by_moderator", "ST-3", "ST-4", "ST-5")
def effects_by_moderator(t: Roles) -> DataFrame:
    """Four moderators x all copies in one job."""
    return pooled_effects(t.study.fits(["rural", "small", "poverty", "more_wnh"]).withColumnRenamed("model", "moderator"), "moderator")


@query("effects_alternative_controls", "ST-11", "ST-2", "ST-4", "ST-5", "OP-20")
def effects_alternative_controls(t: Roles) -> DataFrame:
    return pooled_effects(t.study.fits(["alternative_groups", "alternative_combined"]))


@query("effects_all_models", "ST-2", "ST-3", "ST-4", "ST-5", "ST-11", "OP-19", "OP-20")
def effects_all_models(t: Roles) -> DataFrame:
    """Every model of the study from one pass over the panel."""
    return pooled_effects(t.study.fits(list(t.study.models())), "model")


STATE_CELLS = f"""
    (SELECT state, quarter, g, avg(telehealth) AS y FROM
     (SELECT *, cast(quarter(month) + (year(month) - {STUDY.years[0]}) * 4 AS int) AS quarter,
             CASE WHEN policy_group IS NULL THEN 0 ELSE 1 END AS g FROM network_months LEFT JOIN policy USING (state))
     GROUP BY ALL)"""


def state_cells(t: Roles) -> DataFrame:
    states = policy.policy_table(t.spark).select("state", F.lit(1).alias("g"))
    rows = t.study.network_months.join(F.broadcast(states), "state", "left").withColumns({
        "g": F.coalesce("g", F.lit(0)), "quarter": run_quarter(F.col("month"), STUDY.years[0])})
    return rows.groupBy("state", "quarter", "g").agg(F.avg("telehealth").alias("y"))


@query("effects_saturated_balanced", "ST-2", "ST-4", "WIN-13", sql=f"""
    WITH cells AS MATERIALIZED {STATE_CELLS},
    m AS (SELECT g, quarter, avg(y) AS y FROM cells GROUP BY ALL)
    SELECT a.quarter, {r6('(a.y - b.y) - (c.y - d.y)')} AS coef
    FROM m a JOIN m b ON b.g = 1 AND b.quarter = 1 JOIN m c ON c.g = 0 AND c.quarter = a.quarter
         JOIN m d ON d.g = 0 AND d.quarter = 1 WHERE a.g = 1 AND a.quarter > 1""")
def effects_saturated_balanced(t: Roles) -> DataFrame:
    """Every state has every quarter, so the effects are differences of cell means."""
    spec = EventStudy("y", "state", "quarter", t.study.quarters, [("policy", F.col("g"))])
    fits = fit_event_study(state_cells(t).withColumn("imp", F.lit(1)), spec)
    return fits.select("quarter", "coef")


def _two_way(c: str) -> str:
    return f"{c} - avg({c}) OVER (PARTITION BY state) - avg({c}) OVER (PARTITION BY quarter) + avg({c}) OVER ()"


_DID = ("did", "did_m", "x")
_PAIRS = [(a, b) for i, a in enumerate(_DID) for b in _DID[i:]]


@query("effects_with_covariate_and_moderator", "ST-2", "ST-3", "ST-4", sql=f"""
    WITH cells AS MATERIALIZED (
      SELECT state, quarter, y, x, g * CASE WHEN quarter > 6 THEN 1 ELSE 0 END AS did, did * m AS did_m
      FROM (SELECT state, quarter, avg(telehealth) * 100 AS y, avg(pct_female) AS x, max(g) AS g,
                   max(CASE WHEN ascii(substr(state, 2, 1)) % 2 = 0 THEN 1 ELSE 0 END) AS m
            FROM (SELECT *, cast(quarter(month) + (year(month) - {STUDY.years[0]}) * 4 AS int) AS quarter,
                         CASE WHEN policy_group IS NULL THEN 0 ELSE 1 END AS g FROM network_months LEFT JOIN policy USING (state))
            GROUP BY state, quarter)),
    w AS (SELECT {_two_way('y')} AS y, {', '.join(f'{_two_way(c)} AS {c}' for c in _DID)} FROM cells),
    s AS (SELECT sum(y * y) AS yy, {', '.join(f'sum({a} * {b}) AS {a}_{b}' for a, b in _PAIRS)},
                 {', '.join(f'sum({c} * y) AS y_{c}' for c in _DID)} FROM w),
    n AS (SELECT count(*) AS n, count(DISTINCT state) AS units, count(DISTINCT quarter) AS periods FROM cells),
    a AS (SELECT *, did_did AS a, did_did_m AS b, did_x AS c, did_m_did_m AS d, did_m_x AS e, x_x AS f FROM s),
    i AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM a),
    inv AS (SELECT *, (d * f - e * e) / det AS v11, (c * e - b * f) / det AS v12, (b * e - c * d) / det AS v13, (a * f - c * c) / det AS v22,
                   (b * c - a * e) / det AS v23, (a * d - b * b) / det AS v33 FROM i),
    beta AS (SELECT *, v11 * y_did + v12 * y_did_m + v13 * y_x AS b1, v12 * y_did + v22 * y_did_m + v23 * y_x AS b2,
                    v13 * y_did + v23 * y_did_m + v33 * y_x AS b3 FROM inv),
    fit AS (SELECT *, (yy - b1 * y_did - b2 * y_did_m - b3 * y_x) / (n - units - (periods - 1) - 3) AS s2 FROM beta, n)
    SELECT 'did' AS term, {r6('b1')} AS coef, {r6('sqrt(s2 * v11)')} AS se, n AS n_rows, units AS n_units FROM fit
    UNION ALL SELECT 'did_m', {r6('b2')}, {r6('sqrt(s2 * v22)')}, n, units FROM fit
    UNION ALL SELECT 'x', {r6('b3')}, {r6('sqrt(s2 * v33)')}, n, units FROM fit""")
def effects_with_covariate_and_moderator(t: Roles) -> DataFrame:
    """Treated x later, its product with a moderator, and a covariate, with unit and period effects, coefficients and errors.

    Every state has every quarter, so both effects can be taken out by means, and three normal equations are left to check.
    """
    states = policy.policy_table(t.spark).select("state", F.lit(1).alias("g"))
    rows = t.study.network_months.join(F.broadcast(states), "state", "left").withColumn("quarter", run_quarter(F.col("month"), STUDY.years[0]))
    cells = rows.groupBy("state", "quarter").agg(F.avg(100 * F.col("telehealth")).alias("y"), F.avg("pct_female").alias("x"),
                                                 F.coalesce(F.max("g"), F.lit(0)).alias("g"))
    did = F.col("g") * (F.col("quarter") > 6).cast("int")
    flag = (F.ascii(F.substring("state", 2, 1)) % 2 == 0).cast("int")
    cells = cells.withColumns({"did": did, "did_m": did * flag, "imp": F.lit(1), "rows": F.lit("states")})
    model = Model("did", "states", "y", tuple(t.study.quarters), (), _DID)
    fits = fit_models(cells, [model], unit="state")
    return fits.select(F.col("parity_group").alias("term"), "coef", "se", "n_rows", "n_units")


@query("cross_products_by_fit", "ST-2", "WIN-13", sql="""
    WITH d AS MATERIALIZED (SELECT m.imp, telehealth - avg(telehealth) OVER w AS x0, pct_female - avg(pct_female) OVER w AS x1,
                      pct_65plus - avg(pct_65plus) OVER w AS x2 FROM panel m WHERE m.imp <= 2
               WINDOW w AS (PARTITION BY m.imp, client_id))
    SELECT imp, 0 AS i, 0 AS j, round(sum(x0 * x0), 6) + 0.0 AS v FROM d GROUP BY ALL
    UNION ALL SELECT imp, 0, 1, round(sum(x0 * x1), 6) + 0.0 FROM d GROUP BY ALL
    UNION ALL SELECT imp, 0, 2, round(sum(x0 * x2), 6) + 0.0 FROM d GROUP BY ALL
    UNION ALL SELECT imp, 1, 1, round(sum(x1 * x1), 6) + 0.0 FROM d GROUP BY ALL
    UNION ALL SELECT imp, 1, 2, round(sum(x1 * x2), 6) + 0.0 FROM d GROUP BY ALL
    UNION ALL SELECT imp, 2, 2, round(sum(x2 * x2), 6) + 0.0 FROM d GROUP BY ALL""")
def cross_products_by_fit(t: Roles) -> DataFrame:
    rows = t.study.panel.where("imp <= 2")
    columns = ["telehealth", "pct_female", "pct_65plus"]
    centred = fixed_effects.demean(rows, ["imp", "client_id"], columns)
    return fixed_effects.cross_products(centred.withColumn("x", F.array(*columns)), ["imp"], "x")


# --- matching -------------------------------------------------------------------------------------------------------

LONG_SQL = """
    (SELECT client_id AS unit, cast((year(month) - 1995) * 12 + month(month) - 12 AS int) AS period,
            cast(unnest([1, 2, 3]) AS int) AS imp, 100 * unnest([telehealth, u65_telehealth, pct_female]) AS y,
            CASE WHEN policy_group IS NOT NULL AND (start_run IS NULL OR period >= start_run)
                      AND (end_run IS NULL OR period <= end_run) THEN 1 ELSE 0 END AS d
     FROM network_months LEFT JOIN policy USING (state))"""
MEMBERS_SQL = f"""
    long AS MATERIALIZED {LONG_SQL},
    looked AS (SELECT a.imp, a.unit, a.period, cast(p.d AS varchar) AS history, a.d AS treated,
                      {', '.join(f'f{h}.y - p.y AS dy_{h}' for h in LEADS)}
               FROM long a JOIN long p ON p.imp = a.imp AND p.unit = a.unit AND p.period = a.period - 1 AND p.d = 0
               {' '.join(f'JOIN long f{h} ON f{h}.imp = a.imp AND f{h}.unit = a.unit AND f{h}.period = a.period + {h}'
                         for h in LEADS)}
               WHERE p.y IS NOT NULL AND {' AND '.join(f'f{h}.y IS NOT NULL' for h in LEADS)}),
    members AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) FILTER (WHERE treated = 1) OVER w AS n_treated,
                               count(*) FILTER (WHERE treated = 0) OVER w AS n_controls
                        FROM looked WINDOW w AS (PARTITION BY imp, period, history))
                WHERE n_treated > 0 AND n_controls > 0)"""
CONTRIBUTIONS_SQL = f"""{MEMBERS_SQL},
    contrib AS MATERIALIZED (SELECT imp, unit, sum(treated) AS d, {', '.join(
        f'sum(CASE WHEN treated = 1 THEN dy_{h} ELSE -1.0 * n_treated / n_controls * dy_{h} END) AS s_{h}'
        for h in LEADS)} FROM members GROUP BY ALL)"""


def outcome_panel(t: Roles) -> DataFrame:
    """Three outcomes stacked by number; treatment from the policy table."""
    rows = t.study.network_months.withColumn("run_month", run_month(F.col("month"), STUDY.anchor))
    rows = policy.attach_policy(rows, policy.policy_table(t.spark), "run_month")
    treated = policy.treatment_indicator(F.col("parity_month"), F.col("run_month"))
    outcomes = F.array(*[100 * F.col(c) for c in ("telehealth", "u65_telehealth", "pct_female")])
    return rows.select("client_id", "run_month", treated.alias("treatment"), F.posexplode(outcomes).alias("k", "y")).select(
        "client_id", "run_month", "treatment", (F.col("k") + 1).alias("imp"), "y")


def outcome_members(t: Roles) -> DataFrame:
    return matching.matched_members(outcome_panel(t), unit="client_id", period="run_month", treat="treatment",
                                    outcome="y", leads=LEADS)


@query("matched_sets", "ST-6", "JN-13", "WIN-11", "WIN-12", sql=f"""
    WITH {MEMBERS_SQL} SELECT imp, unit, period, history, treated, n_treated, n_controls,
        round(CASE WHEN treated = 0 THEN 1.0 / n_controls END, 6) + 0.0 AS weight FROM members""")
def matched_sets(t: Roles) -> DataFrame:
    """Member table of the matched sets with even control weights."""
    out = matching.equal_weights(outcome_members(t))
    return out.select("imp", "unit", "period", "history", "treated", "n_treated", "n_controls", "weight")


@query("matched_att_even_weights", "ST-8", "SET-5", sql=f"""
    WITH {MEMBERS_SQL},
    sets AS (SELECT imp, period, history, {', '.join(
        f'sum(dy_{h}) FILTER (WHERE treated = 1) AS t_{h}, avg(dy_{h}) FILTER (WHERE treated = 0) AS c_{h}'
        for h in LEADS)}, count(*) FILTER (WHERE treated = 1) AS n FROM members GROUP BY ALL)
    {' UNION ALL '.join(f"SELECT imp, {h} AS lead, round(sum(t_{h} - n * c_{h}) / sum(n), 6) + 0.0 AS estimate FROM sets GROUP BY ALL"
                        for h in LEADS)}""")
def matched_att_even_weights(t: Roles) -> DataFrame:
    sums = matching.unit_contributions(matching.equal_weights(outcome_members(t)), LEADS)
    return matching.att(sums, LEADS)


def unit_ids(t: Roles, imps: int) -> DataFrame:
    """(imp, unit, unit_id) for all panel units."""
    ids = numbering.dense_ids(t.study.network_months, "client_id", "unit_id")
    return stack_copies(ids.withColumnRenamed("client_id", "unit"), imps)


@query("matched_bootstrap_errors", "ST-9", "WIN-7", sql=f"""
    WITH {CONTRIBUTIONS_SQL},
    ids AS MATERIALIZED (SELECT client_id AS unit, row_number() OVER (ORDER BY client_id) AS unit_id
            FROM (SELECT DISTINCT client_id FROM network_months)),
    drawn AS (SELECT imp, r, {draw_sql('unit_id', '(r * 1000 + imp)', STUDY.seed)} % (SELECT max(unit_id) FROM ids) + 1 AS hit
              FROM ids, range(1, {REPLICATES + 1}) a(r), (SELECT unnest([1, 2, 3]) AS imp)),
    reps AS (SELECT d.imp, r, {', '.join(f'sum(s_{h}) / nullif(sum(c.d), 0) AS e_{h}' for h in LEADS)}
             FROM drawn d JOIN ids ON ids.unit_id = hit JOIN contrib c ON c.imp = d.imp AND c.unit = ids.unit GROUP BY ALL)
    {' UNION ALL '.join(f"SELECT cast(imp AS int) AS imp, {h} AS lead, round(stddev_samp(e_{h}), 6) + 0.0 AS std_error FROM reps GROUP BY ALL"
                        for h in LEADS)}""")
def matched_bootstrap_errors(t: Roles) -> DataFrame:
    sums = matching.unit_contributions(matching.equal_weights(outcome_members(t)), LEADS)
    return matching.bootstrap_se(sums, unit_ids(t, 3), LEADS, REPLICATES, STUDY.seed)


@query("matched_errors_two_ways", "ST-9", sql=f"""
    WITH {CONTRIBUTIONS_SQL}
    {' UNION ALL '.join(f"""SELECT cast(imp AS int) AS imp, {h} AS lead, round(sqrt(greatest(sum(s_{h} * s_{h})
        - 2 * sum(s_{h}) / sum(d) * sum(s_{h} * d) + (sum(s_{h}) / sum(d)) ** 2 * sum(d * d), 0)) / sum(d), 6) + 0.0 AS linear_error,
        true AS redrawn_error_agrees FROM contrib GROUP BY imp""" for h in LEADS)}""")
def matched_errors_two_ways(t: Roles) -> DataFrame:
    """Errors by the first-order expansion, and whether those of redrawn units are within half of them."""
    sums = settle(matching.unit_contributions(matching.equal_weights(outcome_members(t)), LEADS), "contributions")
    redrawn = matching.redrawn_se(sums, unit_ids(t, 3), LEADS, REPLICATES, STUDY.seed)
    both = matching.linear_se(sums, LEADS).join(redrawn, ["imp", "lead"])
    close = F.abs(F.col("std_error") - F.col("linear_error")) <= 0.5 * F.col("linear_error")
    return both.select("imp", "lead", "linear_error", close.alias("redrawn_error_agrees"))


def pooled_matching(t: Roles, outcome: str, covariates: list[str], drop_wave: bool, first: int | None) -> DataFrame:
    """Propensity-weighted matched effects over all copies, with bootstrap errors, pooled."""
    rows = t.study.matching_panel(drop_wave, first)
    members = settle(matching.matched_members(rows, unit="client_id", period="run_month", treat="treatment",
                                              outcome=outcome, leads=LEADS, carry=covariates), "members")
    weighted = matching.propensity_weights(members, covariates)
    sums = settle(matching.unit_contributions(weighted, LEADS), "contributions")
    estimates = matching.att(sums, LEADS)
    errors = matching.redrawn_se(sums, unit_ids(t, M), LEADS, REPLICATES, STUDY.seed)
    both = estimates.join(errors, ["imp", "lead"])
    return pool(both, ["lead"], "estimate", "std_error", M)


MATCH_COVARIATES = ["lpatients", "pct_below18", "pct_65plus", "wnh", "bnh", "hispanic", "pct_rural_2010", "povertyrate",
                    "change_patients"]


@query("matched_effects_all_visits", "ST-6", "ST-7", "ST-8", "ST-9", "ST-5")
def matched_effects_all_visits(t: Roles) -> DataFrame:
    return pooled_matching(t, "telehealth", [*MATCH_COVARIATES, "index"], True, 1)


@query("matched_effects_under_65", "ST-7", "ST-8", "ST-9", "ST-5")
def matched_effects_under_65(t: Roles) -> DataFrame:
    return pooled_matching(t, "u65_telehealth", MATCH_COVARIATES, False, None)


@query("matched_effects_mental_health", "ST-7", "ST-8", "ST-9", "ST-5")
def matched_effects_mental_health(t: Roles) -> DataFrame:
    return pooled_matching(t, "mental_telehealth", MATCH_COVARIATES, False, None)
