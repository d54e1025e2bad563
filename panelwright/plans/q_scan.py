"""Queries for scans, sinks, projections and filters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelwright import constants as C
from panelwright.functions.codes import any_code, clean_code, is_member, is_missing_code, is_remote
from panelwright.functions.dates import in_years, month_start, parse_visit_date
from panelwright.functions.recode import flag
from panelwright.operators import code_map, impute, joins
from panelwright.plans.registry import query
from panelwright.plans.role_sql import M, MISSING_DX, REMOTE, REMOTE_OR_PLACE, VISIT_DATE, YEARS, quote, r6
from panelwright.plans.roles import STUDY, Roles
from panelwright.plans.study import MODIFIERS, PATIENT
from panelwright.sources import readers, writers
from panelwright.sources.commits import SharedTable


# --- sources and sinks ----------------------------------------------------------------------------------------------


@query("scan_whole_table", "SRC-1", "SRC-5", sql="SELECT * FROM client_dem")
def scan_whole_table(t: Roles) -> DataFrame:
    return readers.lower_snake(t.client_dem)


@query("scan_with_bound_lists", "SRC-2", "FLT-3", "AGG-2", sql=f"""
    SELECT client_id, patient_id, date, cast(max(CASE WHEN {REMOTE} THEN 1 ELSE 0 END) AS int) AS telehealth
    FROM procedure WHERE date[1:4] IN ({YEARS}) AND cpt4_hcpcs_code NOT IN ({quote(C.HOSPITAL_AND_EMERGENCY_CODES)})
    GROUP BY ALL""")
def scan_with_bound_lists(t: Roles) -> DataFrame:
    has = " OR ".join(f"array_contains(:remote, {c})" for c in MODIFIERS)
    text = f"""
        SELECT client_id, patient_id, date, max(CASE WHEN {has} THEN 1 ELSE 0 END) AS telehealth
        FROM {{procedure}}
        WHERE array_contains(:years, substring(date, 1, 4)) AND NOT array_contains(:excluded, cpt4_hcpcs_code)
        GROUP BY client_id, patient_id, date"""
    return readers.run_sql(t.spark, text, {"procedure": t.procedure},
                           remote=list(C.REMOTE_MODIFIERS), years=[str(y) for y in STUDY.years],
                           excluded=list(C.HOSPITAL_AND_EMERGENCY_CODES))


@query("scan_single_column", "SRC-3", "PRJ-1", sql="SELECT c_custkey FROM customer")
def scan_single_column(t: Roles) -> DataFrame:
    return t.table("customer").select("c_custkey")


@query("csv_write_and_read", "SRC-4", "SNK-1", sql=f"""
    SELECT client_id, cast(month AS varchar) AS month, mpatients, {r6('telehealth')} AS telehealth FROM measures""")
def csv_write_and_read(t: Roles) -> DataFrame:
    path = writers.fresh_path(t.spark, "csv")
    writers.write_csv(t.study.measures.select("client_id", "month", "mpatients", "telehealth"), path)
    schema = StructType.fromDDL("client_id bigint, month date, mpatients bigint, telehealth double")
    return readers.scan_csv(t.spark, path, schema)


@query("parquet_write_and_read", "SRC-5", "SNK-2", sql="""
    SELECT client_id, client_patient_id, visit_count FROM pulled""")
def parquet_write_and_read(t: Roles) -> DataFrame:
    path = writers.fresh_path(t.spark, "parquet")
    writers.write_parquet(t.study.pulled, path)
    return readers.scan_parquet(t.spark, path, [*PATIENT, "visit_count"])


@query("copies_write_and_read_one", "SNK-3", "SRC-6", "FLT-13", "RSH-6", sql="""
    SELECT client_id, client_patient_id, race, hispanic, re, cast(imp AS int) AS imp FROM stacked WHERE imp = 3""")
def copies_write_and_read_one(t: Roles) -> DataFrame:
    path = writers.fresh_path(t.spark, "copies")
    stacked = impute.stack_completed(t.study.completed, M)
    writers.write_by_copy(stacked.select(*PATIENT, "race", "hispanic", "re", "imp"), path)
    return readers.scan_copy(t.spark, path, 3)


@query("append_batches_repeatably", "SNK-5", sql="""
    SELECT client_id % 3 AS third, count(*) AS n FROM patients GROUP BY ALL""")
def append_batches_repeatably(t: Roles) -> DataFrame:
    path = writers.fresh_path(t.spark, "append")
    rows = t.study.patients.select("client_id", "client_patient_id", (F.col("client_id") % 3).alias("third"))
    for third in (0, 1, 2, 1):            # the repeated batch replaces itself
        writers.append_batch(rows.where(F.col("third") == third), path, f"third-{third}")
    return t.spark.read.parquet(path).groupBy("third").agg(F.count(F.lit(1)).alias("n"))


@query("append_to_shared_table", "SNK-4", sql="""
    SELECT client_id % 3 AS third, count(*) AS n FROM patients GROUP BY ALL""")
def append_to_shared_table(t: Roles) -> DataFrame:
    table = f"shared_{uuid.uuid4().hex}"
    rows = t.study.patients.select(*PATIENT, (F.col("client_id") % 3).alias("third"))
    for third in (0, 1, 2, 1):            # rows that the table has already are not appended again
        writers.append_table(rows.where(F.col("third") == third), table, PATIENT)
    return t.spark.table(table).groupBy("third").agg(F.count(F.lit(1)).alias("n"))


@query("append_in_commits", "SNK-4", sql="""
    SELECT client_id % 3 AS third, count(*) AS n FROM patients GROUP BY ALL""")
def append_in_commits(t: Roles) -> DataFrame:
    """Two writers start from the same table, their rows overlap, and one sends its batch twice."""
    rows = t.study.patients.select(*PATIENT, (F.col("client_id") % 3).alias("third"))
    table = SharedTable(t.spark, writers.fresh_path(t.spark, "shared"), rows.schema, PATIENT)
    one, other = table.stage(rows.where("third < 2"), "one"), table.stage(rows.where("third > 0"), "other")
    table.commit(one)
    table.commit(other)
    table.append(rows.where("third < 2"), "one")
    return table.read().groupBy("third").agg(F.count(F.lit(1)).alias("n"))


@query("inline_reference_rows", "SRC-7", "SET-1", sql="""
    SELECT icd_code, code_system, acause, family_name FROM code_dimension WHERE family_name = 'COVID-19'""")
def inline_reference_rows(t: Roles) -> DataFrame:
    covid = t.study.code_dimension.where(F.col("family_name") == C.COVID_NAME)
    return covid.select("icd_code", "code_system", "acause", "family_name")


@query("inline_code_set", "SRC-8", "FLT-15", sql=f"""
    SELECT client_id, state FROM client_dem WHERE state IN ({quote(C.POLICY_ALWAYS)})""")
def inline_code_set(t: Roles) -> DataFrame:
    return t.client_dem.where(is_member(F.col("state"), C.POLICY_ALWAYS)).select("client_id", "state")


# --- projections ----------------------------------------------------------------------------------------------------


@query("rename_compute_reorder", "PRJ-2", "PRJ-3", "PRJ-7", "FN-22", sql=f"""
    SELECT client_id AS network, state, pct_rural_2010 / 100 AS rural_share,
           CASE WHEN povertyrate > {C.POVERTY_PERCENT} THEN 1 ELSE 0 END AS poverty FROM client_dem""")
def rename_compute_reorder(t: Roles) -> DataFrame:
    renamed = t.client_dem.withColumnsRenamed({"client_id": "network", "pct_rural_2010": "rural_share"})
    out = renamed.withColumns({"rural_share": F.col("rural_share") / 100,
                               "poverty": flag(F.col("povertyrate") > C.POVERTY_PERCENT)})
    return out.select("poverty", "network", "state", "rural_share")


@query("tag_before_union", "PRJ-4", "SET-4", sql="""
    SELECT care_type, count(*) AS n, round(sum(units) / any_value(whole), 6) + 0.0 AS weight FROM care_comparison GROUP BY ALL""")
def tag_before_union(t: Roles) -> DataFrame:
    return t.study.care_weights.groupBy("care_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("units").cast("double").alias("weight"))


@query("conditional_updates", "PRJ-5", "PRJ-6", "FLT-11", "OP-3", "JN-4", "AGG-21", sql="""
    SELECT acause, cause_name, family, family_name, icd_name, code_system, icd_code FROM code_dimension""")
def conditional_updates(t: Roles) -> DataFrame:
    return t.study.code_dimension


# --- filters --------------------------------------------------------------------------------------------------------


@query("keep_listed_ids", "FLT-1", "JN-10", sql="""
    SELECT client_id, count(*) AS n FROM procedure
    WHERE client_id IN (SELECT client_id FROM client_dem WHERE povertyrate > 15) GROUP BY ALL""")
def keep_listed_ids(t: Roles) -> DataFrame:
    listed = t.client_dem.where("povertyrate > 15")
    return joins.keep_listed(t.procedure, listed, ["client_id"]).groupBy("client_id").agg(
        F.count(F.lit(1)).alias("n"))


@query("drop_listed_codes", "FLT-2", "SET-6", "FN-10", sql="""
    SELECT cpt4_hcpcs_code, count(*) AS n FROM procedure
    WHERE cpt4_hcpcs_code NOT IN (SELECT code FROM excluded_codes) GROUP BY ALL""")
def drop_listed_codes(t: Roles) -> DataFrame:
    kept = joins.drop_listed(t.procedure, t.study.excluded_codes, "cpt4_hcpcs_code")
    return kept.groupBy("cpt4_hcpcs_code").agg(F.count(F.lit(1)).alias("n"))


@query("year_prefix_filter", "FLT-3", "FN-5", sql=f"""
    SELECT date[1:4] AS year_text, count(*) AS n FROM procedure WHERE date[1:4] IN ({YEARS}) GROUP BY ALL""")
def year_prefix_filter(t: Roles) -> DataFrame:
    kept = t.procedure.where(in_years(F.col("date"), STUDY.years))
    return kept.groupBy(F.substring("date", 1, 4).alias("year_text")).agg(F.count(F.lit(1)).alias("n"))


@query("parsed_date_range", "FLT-4", "FLT-9", "FN-14", sql=f"""
    SELECT cast(date_trunc('month', d) AS date)::varchar AS month, count(*) AS n
    FROM (SELECT {VISIT_DATE} AS d FROM procedure)
    WHERE d >= date '{STUDY.start}' AND d < date '{STUDY.end}' GROUP BY ALL""")
def parsed_date_range(t: Roles) -> DataFrame:
    d = parse_visit_date(F.col("date"))
    dated = t.procedure.select(d.alias("d")).where((F.col("d") >= F.lit(STUDY.start)) & (F.col("d") < F.lit(STUDY.end)))
    return dated.groupBy(month_start(F.col("d")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("any_of_columns_in_codes", "FLT-5", sql=f"""
    SELECT {REMOTE} AS by_modifier, {REMOTE_OR_PLACE} AS by_modifier_or_place, count(*) AS n
    FROM procedure GROUP BY ALL""")
def any_of_columns_in_codes(t: Roles) -> DataFrame:
    mods = [F.col(c) for c in MODIFIERS]
    return t.procedure.groupBy(
        any_code(mods, C.REMOTE_MODIFIERS).alias("by_modifier"),
        is_remote(mods, C.REMOTE_MODIFIERS, F.col("place_of_service")).alias("by_modifier_or_place"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("in_person_complement", "FLT-6", sql=f"""
    SELECT place_of_service, count(*) AS n FROM procedure WHERE NOT {REMOTE_OR_PLACE} GROUP BY ALL""")
def in_person_complement(t: Roles) -> DataFrame:
    remote = is_remote([F.col(c) for c in MODIFIERS], C.REMOTE_MODIFIERS, F.col("place_of_service"))
    return t.procedure.where(~remote).groupBy("place_of_service").agg(F.count(F.lit(1)).alias("n"))


@query("drop_year_only_dates", "FLT-8", "FN-6", sql=f"""
    SELECT count(*) AS n_rows, count(*) FILTER (WHERE length(date) = 4) AS n_year_only,
           round(avg(CASE WHEN length(date) = 4 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS share_year_only,
           count({VISIT_DATE}) AS n_kept FROM procedure""")
def drop_year_only_dates(t: Roles) -> DataFrame:
    year_only = F.length("date") == 4
    return t.procedure.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(year_only).alias("n_year_only"),
        F.avg(F.when(year_only, 1.0).otherwise(0.0)).alias("share_year_only"),
        F.count(parse_visit_date(F.col("date"))).alias("n_kept"))


@query("month_cut_off", "FLT-9", "FLT-12", sql=f"""
    SELECT client_id, month::varchar AS month, count_mental FROM measures
    WHERE month < date '{STUDY.baseline_end}' AND count_mental > 0""")
def month_cut_off(t: Roles) -> DataFrame:
    kept = t.study.measures.where((F.col("month") < F.lit(STUDY.baseline_end)) & (F.col("count_mental") > 0))
    return kept.select("client_id", "month", "count_mental")


@query("published_code_subset", "FLT-10", "FLT-14", sql=f"""
    SELECT DISTINCT acause, cause_name, family_name, icd_code FROM code_dimension WHERE family = '{C.MENTAL_FAMILY}'""")
def published_code_subset(t: Roles) -> DataFrame:
    mental = code_map.family_codes(t.study.code_dimension, C.MENTAL_FAMILY)
    columns = ["acause", "cause_name", "family_name", "icd_code"]
    header = t.spark.createDataFrame([tuple(c.upper() for c in columns)], mental.select(*columns).schema)
    shared = mental.select(*columns).unionByName(header)
    return code_map.drop_header_rows(shared, "acause", "ACAUSE")


@query("missing_code_filter", "FLT-7", "FN-8", "FN-9", sql=f"""
    SELECT upper(replace(replace(dx1_code, '.', ''), ' ', '')) AS dx, count(*) AS n FROM procedure
    WHERE NOT {MISSING_DX} GROUP BY ALL""")
def missing_code_filter(t: Roles) -> DataFrame:
    kept = t.procedure.where(~is_missing_code(F.col("dx1_code")))
    return kept.groupBy(clean_code(F.col("dx1_code")).alias("dx")).agg(F.count(F.lit(1)).alias("n"))
