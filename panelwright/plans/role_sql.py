"""The role tables and study chain as plain SQL common table expressions, for checking query results."""

from __future__ import annotations

from panelwright import constants as C
from panelwright.functions.draws import draw_sql
from panelwright.plans.roles import BRANCHES, CAUSES, CPT, RACES, STATES, STUDY

M = STUDY.m


def quote(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def case(column: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {column} = '{k}' THEN {v if isinstance(v, (int, float)) else repr(v)}"
                     for k, v in mapping.items())
    return f"CASE {whens} ELSE {default} END"


def r6(expression: str) -> str:
    """Six places, without a negative zero."""
    return f"round({expression}, 6) + 0.0"


def strict_wmean(x: str, w: str) -> str:
    return (f"CASE WHEN count(*) FILTER (WHERE {x} IS NULL OR {w} IS NULL) = 0 "
            f"THEN sum({x} * {w}) / nullif(sum({w}), 0) END")


def lenient_wmean(x: str, w: str) -> str:
    return f"sum({x} * {w}) / nullif(sum({w}) FILTER (WHERE {x} IS NOT NULL), 0)"


def strict_mean(x: str) -> str:
    return f"CASE WHEN count({x}) = count(*) THEN avg({x}) END"


CLIENT = f"cast(c_nationkey * {BRANCHES} + c_custkey % {BRANCHES} AS bigint)"
REMOTE = "(" + " OR ".join(f"coalesce(modifier_code{i} IN ({quote(C.REMOTE_MODIFIERS)}), false)"
                           for i in range(1, 5)) + ")"
REMOTE_OR_PLACE = f"({REMOTE} OR coalesce(place_of_service = '{C.REMOTE_PLACE_OF_SERVICE}', false))"
MISSING_DX = f"(dx1_code IS NULL OR dx1_code = '{C.REDACTED}')"
CLEAN_DX = "upper(replace(replace(dx1_code, '.', ''), ' ', ''))"
VISIT_DATE = ("CASE WHEN length(date) = 8 THEN cast(try_strptime(date, '%Y%m%d') AS date) "
              "WHEN length(date) = 10 THEN cast(try_strptime(date, '%Y-%m-%d') AS date) END")
YEARS = quote(STUDY.years)
_policy_rows = [(s, "NULL", "NULL", C.GROUP_BEFORE) for s in C.POLICY_ALWAYS] + [
    (s, a, "NULL" if b is None else b, C.GROUP_WAVE if s in C.POLICY_WAVE else C.GROUP_OTHER)
    for s, (a, b) in C.POLICY_WINDOWS.items()]
_shares = ", ".join(f"coalesce(max(share) FILTER (WHERE re = '{g}'), 0) AS {g}" for g in C.GROUPS)
_base_columns = ["telehealth", "u65_telehealth", "mental_telehealth", "pct_female", "pct_below18", "pct_65plus",
                 *C.GROUPS]


def _donors(name: str, strata: str, target: str) -> dict[str, str]:
    """Running class counts per stratum and overall."""
    part = f"PARTITION BY {strata}" if strata else ""
    cols = f"{strata}, " if strata else ""
    return {
        name: f"""SELECT {cols}{target} AS class, sum(c) OVER ({part} ORDER BY {target}) AS upto,
                  sum(c) OVER ({part}) AS total
                  FROM (SELECT {cols}{target}, count(*) AS c FROM patients WHERE {target} IS NOT NULL
                        GROUP BY {cols}{target})"""}


CTES: dict[str, str] = {
    # --- role tables
    "client_dem": f"""
        SELECT client_id, ([{quote(STATES)}])[n_nationkey + 1] AS state,
               CASE WHEN client_id % 11 <> 0 THEN cast(100 + client_id % 13 AS int) END AS zip3,
               cast(client_id * 37 % 61 AS double) AS pct_rural_2010, cast(client_id * 13 % 31 AS double) AS povertyrate
        FROM (SELECT cast(n_nationkey * {BRANCHES} + k AS bigint) AS client_id, n_nationkey
              FROM nation, range({BRANCHES}) t(k))""",
    "demographic": f"""
        SELECT {CLIENT} AS client_id, c_custkey AS client_patient_id,
               CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 2 = 1 THEN '2076-8'
                    ELSE {case('c_mktsegment', RACES)} END AS race,
               CASE WHEN c_custkey % 6 = 0 THEN 'H' WHEN c_custkey % 6 <> 5 THEN 'N' END AS ethnicity,
               CASE WHEN dup = 0 AND c_custkey % 13 <> 0 THEN cast(100 + c_custkey % 13 AS varchar) END AS zip3,
               CASE WHEN c_custkey % 97 <> 0 THEN cast(1915 + c_custkey * 7 % 80 AS varchar) || '0615' END AS dob,
               CASE WHEN c_custkey % 10 < 5 THEN 'F' WHEN c_custkey % 10 < 9 THEN 'M' ELSE 'U' END AS gender,
               CASE WHEN c_custkey % 8 < 5 THEN 'eng' WHEN c_custkey % 8 = 5 THEN 'spa'
                    WHEN c_custkey % 8 = 6 THEN 'vie' END AS primary_language
        FROM (SELECT *, 0 AS dup FROM customer UNION ALL SELECT *, 1 FROM customer WHERE c_custkey % 9 = 0)""",
    "orig_zips": f"""
        SELECT {CLIENT} AS client_id, c_custkey AS client_patient_id,
               CASE WHEN c_custkey % 5 <> 0 THEN cast(200 + c_custkey % 5 AS varchar) END AS zip3
        FROM customer WHERE c_custkey % 4 <> 1""",
    "procedure": f"""
        SELECT {CLIENT} AS client_id, o_custkey AS patient_id,
               CASE WHEN o_orderkey % 20 = 0 THEN strftime(o_orderdate, '%Y')
                    WHEN o_orderkey % 20 < 10 THEN strftime(o_orderdate, '%Y-%m-%d')
                    ELSE strftime(o_orderdate, '%Y%m%d') END AS date,
               {case('p_type', CPT, "CASE WHEN p_size % 2 = 1 THEN '99281' END")} AS cpt4_hcpcs_code,
               CASE WHEN b <= 4 THEN NULL WHEN b <= 8 THEN '{C.REDACTED}'
                    WHEN b % 2 = 0 THEN ' b.' || b ELSE 'B' || b END AS dx1_code,
               CASE WHEN l_returnflag = 'R' THEN 'GT' WHEN l_returnflag = 'A' THEN '25' END AS modifier_code1,
               CASE WHEN l_linestatus = 'O' THEN '59' END AS modifier_code2,
               CASE WHEN o_orderstatus = 'P' THEN '76' END AS modifier_code3,
               CASE WHEN o_orderpriority[1:1] = '1' THEN '93' END AS modifier_code4,
               CASE WHEN l_linenumber % 7 = 2 THEN '2' ELSE '11' END AS place_of_service,
               l_orderkey AS claim_id, l_linenumber AS line_no
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN (SELECT *, cast(p_brand[7:8] AS int) AS b FROM part) ON l_partkey = p_partkey""",
    "inpatient_codes": "SELECT '99477,X' || p_brand[7:8] AS hcpcs_code FROM part WHERE p_type = 'LARGE'",
    "icd_map": f"""
        SELECT ([{quote(c[0] for c in CAUSES)}])[k % 8 + 1] AS acause, 'icd10' AS code_system, 'B' || k AS icd_code,
               CASE WHEN k = 13 THEN 'Coronavirus infection' ELSE 'name ' || k END AS icd_name
        FROM (SELECT cast(p_brand[7:8] AS int) AS k FROM part) WHERE k BETWEEN 9 AND 21
        UNION ALL
        SELECT ([{quote(c[0] for c in CAUSES)}])[k * 3 % 8 + 1], 'icd9', 'B' || k, 'old name ' || k
        FROM (SELECT cast(p_brand[7:8] AS int) AS k FROM part) WHERE k % 2 = 0 OR k IN (21, 23)""",
    "causelist": "SELECT * FROM (VALUES " + ", ".join(f"({quote(c)})" for c in CAUSES)
                 + ") t(acause, cause_name, family, family_name)",
    "policy": "SELECT * FROM (VALUES " + ", ".join(f"('{s}', {a}, {b}, '{g}')" for s, a, b, g in _policy_rows)
              + ") t(state, start_run, end_run, policy_group)",
    "stringency": "SELECT state, cast(index AS double) AS index FROM (VALUES "
                  + ", ".join(f"('{s}', {v})" for s, v in C.STRINGENCY.items()) + ") t(state, index)",
    # --- cohort
    "pulled": f"""
        SELECT d.*, v.visit_count
        FROM (SELECT DISTINCT * FROM demographic WHERE client_id IN (SELECT client_id FROM client_dem)) d
        JOIN (SELECT client_id, patient_id, count(DISTINCT date) AS visit_count FROM procedure
              WHERE date[1:4] IN ({YEARS}) GROUP BY ALL) v
          ON d.client_id = v.client_id AND d.client_patient_id = v.patient_id""",
    "recoded": f"""
        SELECT p.client_id, p.client_patient_id, try_cast(dob[1:4] AS int) AS birth_year, gender, visit_count,
               {case('race', C.RACE_CODES)} AS race, {case('ethnicity', C.ETHNICITY_CODES)} AS hispanic,
               coalesce(primary_language IN ('eng'), false) AS lang_eng,
               coalesce(primary_language IN ('spa'), false) AS lang_spa,
               coalesce(primary_language IN ({quote(C.ASIAN_LANGUAGES)}), false) AS lang_asi,
               coalesce(try_cast(p.zip3 AS int), try_cast(z.zip3 AS int), a.zip3) AS zip3
        FROM (SELECT * FROM pulled
              QUALIFY row_number() OVER (PARTITION BY client_id, client_patient_id ORDER BY zip3 NULLS LAST) = 1) p
        LEFT JOIN orig_zips z ON p.client_id = z.client_id AND p.client_patient_id = z.client_patient_id
        LEFT JOIN client_dem a ON p.client_id = a.client_id""",
    "patients": "SELECT * FROM recoded WHERE zip3 IS NOT NULL AND gender <> 'U' AND birth_year IS NOT NULL",
    # --- hot-deck imputation
    **_donors("race_by_client", "client_id", "race"),
    **_donors("race_any", "", "race"),
    **_donors("hispanic_by_stratum", "client_id, race", "hispanic"),
    **_donors("hispanic_any", "", "hispanic"),
    "sparse": f"""
        SELECT p.*, i.imp FROM patients p JOIN range(1, {M + 1}) i(imp) ON p.race IS NULL OR p.hispanic IS NULL
        UNION ALL SELECT p.*, NULL FROM patients p WHERE p.race IS NOT NULL AND p.hispanic IS NOT NULL""",
    "race_filled": f"""
        SELECT s.* EXCLUDE (race), coalesce(race,
            (SELECT min(class) FROM race_by_client d WHERE d.client_id = s.client_id AND d.upto > s.draw % d.total),
            (SELECT min(class) FROM race_any d WHERE d.upto > s.draw % d.total)) AS race
        FROM (SELECT *, {draw_sql('client_patient_id', 'coalesce(imp, 0)', STUDY.seed)} AS draw FROM sparse) s""",
    "completed": f"""
        SELECT *, CASE WHEN hispanic = 1 THEN 'hispanic'
                       WHEN hispanic = 0 THEN {case('race', C.RACE_GROUP_NOT_HISPANIC)} END AS re
        FROM (SELECT s.* EXCLUDE (hispanic, draw2), coalesce(hispanic,
                (SELECT min(class) FROM hispanic_by_stratum d WHERE d.client_id = s.client_id AND d.race = s.race
                   AND d.upto > s.draw2 % d.total),
                (SELECT min(class) FROM hispanic_any d WHERE d.upto > s.draw2 % d.total)) AS hispanic
              FROM (SELECT *, {draw_sql('client_patient_id', 'coalesce(imp, 0)', STUDY.seed + 100)} AS draw2
                    FROM race_filled) s)""",
    "stacked": f"""
        SELECT * EXCLUDE (imp, draw), imp FROM completed WHERE imp IS NOT NULL
        UNION ALL SELECT c.* EXCLUDE (imp, draw), i.imp FROM completed c, range(1, {M + 1}) i(imp)
        WHERE c.imp IS NULL""",
    # --- visits
    "excluded_codes": "SELECT DISTINCT unnest(string_split(hcpcs_code, ',')) AS code FROM inpatient_codes UNION "
                      f"SELECT unnest([{quote(C.HOSPITAL_AND_EMERGENCY_CODES)}])",
    "outpatient": f"""
        SELECT * FROM (SELECT *, {VISIT_DATE} AS visit_date FROM procedure) WHERE visit_date IS NOT NULL
        AND client_id IN (SELECT client_id FROM client_dem)
        AND cpt4_hcpcs_code NOT IN (SELECT code FROM excluded_codes)""",
    "code_dimension": f"""
        SELECT CASE WHEN covid THEN '{C.COVID_CAUSE}' ELSE acause END AS acause,
               CASE WHEN covid THEN '{C.COVID_NAME}' ELSE cause_name END AS cause_name, family,
               CASE WHEN covid THEN '{C.COVID_NAME}' WHEN family_name LIKE '%Risk factors%' THEN cause_name
                    ELSE family_name END AS family_name, icd_name, code_system, icd_code
        FROM (SELECT *, regexp_matches(icd_name, '{C.COVID_NAME_PATTERN}') AS covid
              FROM causelist JOIN (SELECT DISTINCT * FROM icd_map) USING (acause))
        UNION ALL SELECT '{C.COVID_CAUSE}', '{C.COVID_NAME}', 'fam_ri', '{C.COVID_NAME}', 'found in data', 'icd10',
                         unnest([{quote(C.COVID_EMPIRICAL_CODES)}])""",
    "visit_days": f"""
        SELECT client_id, patient_id AS client_patient_id, visit_date,
               max(CASE WHEN {REMOTE} THEN 1 ELSE 0 END) AS telehealth,
               max(CASE WHEN {CLEAN_DX} IN (SELECT icd_code FROM code_dimension
                    WHERE family = '{C.MENTAL_FAMILY}') THEN 1 ELSE 0 END) AS mentalhealth
        FROM outpatient WHERE cast(year(visit_date) AS varchar) IN ({YEARS}) GROUP BY ALL""",
    # --- cause shares
    "care_rows": f"""
        SELECT *, {REMOTE_OR_PLACE} AS remote FROM outpatient
        WHERE visit_date >= date '{STUDY.start}' AND visit_date < date '{STUDY.end}'""",
    "weighted_rows": f"""
        SELECT * EXCLUDE (n, ok), CASE WHEN ok > 0 THEN ok ELSE n END AS n_parts, 1.0 / n_parts AS weight
        FROM (SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE NOT {MISSING_DX}) OVER w AS ok FROM care_rows
              WINDOW w AS (PARTITION BY remote, client_id, patient_id, visit_date))
        WHERE NOT {MISSING_DX} OR ok = 0""",
    "mapped_rows": f"""
        SELECT w.*, CASE WHEN b THEN n.acause ELSE t.acause END AS acause,
               CASE WHEN b THEN n.family_name ELSE t.family_name END AS family_name
        FROM (SELECT *, {CLEAN_DX} AS dx FROM weighted_rows) w
        LEFT JOIN (SELECT * FROM code_dimension WHERE code_system = 'icd10') t ON w.dx = t.icd_code
        LEFT JOIN (SELECT * FROM code_dimension WHERE code_system = 'icd9') n ON w.dx = n.icd_code,
        LATERAL (SELECT coalesce((t.acause IS NULL AND n.acause IS NOT NULL)
                 OR (t.acause = '{C.GARBAGE_CAUSE}' AND n.acause <> '{C.GARBAGE_CAUSE}'), false) AS b)""",
    "cause_share": """
        SELECT *, units / whole AS weight, units / sum(units) OVER (PARTITION BY remote, plot_date) AS prop
        FROM (SELECT remote, cast(date_trunc('month', visit_date) AS date) AS plot_date,
                     coalesce(family_name, 'Unmapped') AS family_name, sum(whole // n_parts)::HUGEINT AS units,
                     any_value(whole) AS whole
              FROM mapped_rows, (SELECT list_reduce(list(DISTINCT n_parts), lambda a, b: lcm(a, b)) AS whole FROM mapped_rows)
              GROUP BY ALL)""",
    "care_comparison": "SELECT plot_date, family_name, units, whole, weight, prop, "
                       "CASE WHEN remote THEN 'Telemedicine' ELSE 'In-Person' END AS care_type FROM cause_share",
    # --- panels
    "by_group": """
        SELECT v.client_id, cast(date_trunc('month', visit_date) AS date) AS month, s.re, s.imp,
               avg(telehealth) AS telehealth, count(*) AS mpatients
        FROM visit_days v JOIN stacked s USING (client_id, client_patient_id) GROUP BY ALL""",
    "shares": f"""
        SELECT client_id, month, imp, {_shares}
        FROM (SELECT *, mpatients / sum(mpatients) OVER (PARTITION BY client_id, month, imp) AS share FROM by_group)
        GROUP BY ALL""",
    "measures": """
        SELECT client_id, month, avg(telehealth) AS telehealth,
               avg(telehealth) FILTER (WHERE above_65 = 0) AS u65_telehealth,
               avg(telehealth) FILTER (WHERE mentalhealth = 1) AS mental_telehealth, count(*) AS mpatients,
               avg(CASE WHEN gender = 'F' THEN 1 ELSE 0 END) AS pct_female, avg(below_18) AS pct_below18,
               avg(above_65) AS pct_65plus, count(*) - cast(sum(above_65) AS bigint) AS count_u65,
               cast(sum(mentalhealth) AS bigint) AS count_mental
        FROM (SELECT v.*, cast(date_trunc('month', visit_date) AS date) AS month, gender,
                     CASE WHEN year(visit_date) - birth_year < 18 THEN 1 ELSE 0 END AS below_18,
                     CASE WHEN year(visit_date) - birth_year > 64 THEN 1 ELSE 0 END AS above_65
              FROM visit_days v JOIN patients p USING (client_id, client_patient_id)) GROUP BY ALL""",
    "network_months": f"""
        SELECT m.*, c.* EXCLUDE (client_id) FROM measures m LEFT JOIN client_dem c USING (client_id)
        WHERE month < date '{STUDY.end}'""",
    "assembled": f"""
        SELECT a.* EXCLUDE (mean_size, mean_white),
               CASE WHEN month < date '{STUDY.pandemic_start}' THEN 1 WHEN month < date '{STUDY.pandemic_second}' THEN 2
                    ELSE 3 END AS period,
               p.policy_group IS NOT NULL AS parity,
               p.policy_group IS NOT NULL AND run_month >= coalesce(start_run, run_month)
                   AND run_month <= coalesce(end_run, run_month) AS parity_month,
               coalesce(p.policy_group, '{C.GROUP_NEVER}') AS parity_group,
               CASE WHEN pct_rural_2010 > {C.RURAL_PERCENT} THEN 1 ELSE 0 END AS rural,
               CASE WHEN povertyrate > {C.POVERTY_PERCENT} THEN 1 ELSE 0 END AS poverty,
               CASE WHEN mean_size < {STUDY.small_below} THEN 1 ELSE 0 END AS small,
               CASE WHEN mean_white > {STUDY.white_above} THEN 1 ELSE 0 END AS more_wnh
        FROM (SELECT s.*, c.state, c.zip3, c.pct_rural_2010, c.povertyrate, m.* EXCLUDE (client_id, month),
                     cast((year(month) - {STUDY.anchor.year}) * 12 + month(month) - {STUDY.anchor.month} AS int)
                         AS run_month,
                     avg(mpatients) OVER w AS mean_size, avg(wnh) OVER w AS mean_white
              FROM shares s LEFT JOIN client_dem c USING (client_id) LEFT JOIN measures m USING (client_id, month)
              WHERE month < date '{STUDY.end}' WINDOW w AS (PARTITION BY client_id, imp)) a
        LEFT JOIN policy p USING (state)""",
    "baseline": "SELECT client_id, imp, "
                + ", ".join(f"{strict_wmean(c, 'mpatients')} AS {c}" for c in _base_columns)
                + ", any_value(state) AS state, any_value(zip3) AS zip3, cast(sum(mpatients) AS bigint) AS mpatients "
                f"FROM assembled WHERE month < date '{STUDY.baseline_end}' GROUP BY client_id, imp",
    "panel": f"""
        SELECT a.*,
               CASE WHEN b4 THEN 1.0 ELSE a.mpatients / nullif(b.mpatients / 12, 0) END AS change_patients,
               CASE WHEN b4 THEN 1.0 ELSE a.wnh / nullif(b.wnh, 0) END AS change_wnh,
               CASE WHEN b4 THEN 1.0 ELSE a.bnh / nullif(b.bnh, 0) END AS change_bnh,
               CASE WHEN month < date '{STUDY.pandemic_start}' THEN 0.0 ELSE s.index END AS index
        FROM (SELECT *, month < date '{STUDY.baseline_end}' AS b4 FROM assembled) a
        LEFT JOIN baseline b USING (client_id, imp) LEFT JOIN stringency s ON a.state = s.state""",
}


def _mentions(text: str) -> list[str]:
    import re
    words = set(re.findall(r"[a-z_0-9]+", text))
    return [name for name in CTES if name in words]


def with_roles(body: str) -> str:
    """Prefix ``body`` with every role or chain table it mentions, directly or through another."""
    needed: set[str] = set()
    queue = _mentions(body)
    while queue:
        name = queue.pop()
        if name not in needed:
            needed.add(name)
            queue += [n for n in _mentions(CTES[name]) if n != name]
    if not needed:
        return body
    # An expression may only look back; the dictionary is in dependency order.
    chain = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name].strip()})" for name in CTES if name in needed)
    own = body.strip()
    return f"WITH {chain},\n{own[5:]}" if own.startswith("WITH ") else f"WITH {chain}\n{own}"
