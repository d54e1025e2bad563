"""Study source tables derived from the star-schema test tables.

A network is one of four branches of a nation; a patient is a customer; a procedure row is a line item with its order
and part. Missing values, mixed date formats, redacted codes and duplicate patients are put in by fixed rules on the
keys. ``role_sql`` states the same tables for the check engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright import constants as C
from panelwright.functions.recode import recode
from panelwright.plans.study import Study, StudyTables
from panelwright.sources.readers import inline_rows

#: The test tables have few patients a network, so the size and share that split networks are theirs.
STUDY = Study(small_below=1.905, white_above=0.2003).shifted(-23)
BRANCHES = 4
STATES = ("AZ", "AR", "CA", "CO", "GA", "MT", "TN", "OR", "MD", "NV", "OK", "NY", "WA",
          "KY", "VT", "AL", "FL", "ID", "TX", "PA", "OH", "MI", "UT", "NC", "IN")
CAUSES = (
    ("mental_a", "Depressive disorders", "fam_mental", "Mental disorders"),
    ("sud_a", "Alcohol use", "fam_sud", "Substance use disorders"),
    ("mental_b", "Anxiety disorders", "fam_mental", "Mental disorders"),
    ("mental_c", "Bipolar disorder", "fam_mental", "Mental disorders"),
    ("rf_b", "Well causes", "fam_rf", "Risk factors"),
    ("lri_a", "Pneumonia", "fam_ri", "Respiratory infections and tuberculosis"),
    ("ntd_a", "Malaria", "fam_ntd", "Neglected tropical diseases and malaria"),
    (C.GARBAGE_CAUSE, "Garbage code", "fam_gc", "Garbage code"),
)
RACES = {"AUTOMOBILE": "1002-5", "BUILDING": "2028-9", "FURNITURE": "2054-5", "HOUSEHOLD": "2106-3"}
CPT = {"SMALL": "99213", "MEDIUM": "99214", "PROMO": "90834", "LARGE": "99477", "STANDARD": "99215"}
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
}


class Roles:
    """Role tables over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        self._scans: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """Scan with a declared schema: no job to read footers."""
        if name not in self._scans:
            self._scans[name] = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.dir}/{name}.parquet")
        return self._scans[name]

    @cached_property
    def client_dem(self) -> DataFrame:
        nation = self.table("nation")
        branch = F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1)))
        client = nation.select("n_nationkey", branch.alias("k")).select(
            (F.col("n_nationkey") * BRANCHES + F.col("k")).cast("bigint").alias("client_id"), "n_nationkey")
        c = F.col("client_id")
        return client.select(
            "client_id",
            F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("n_nationkey") + 1).alias("state"),
            F.when(c % 11 != 0, 100 + c % 13).cast("int").alias("zip3"),
            (c * 37 % 61).cast("double").alias("pct_rural_2010"),
            (c * 13 % 31).cast("double").alias("povertyrate"))

    @cached_property
    def demographic(self) -> DataFrame:
        p = F.col("c_custkey")
        copies = F.when(p % 9 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        return self.table("customer").withColumn("dup", F.explode(copies)).select(
            (F.col("c_nationkey") * BRANCHES + p % BRANCHES).cast("bigint").alias("client_id"),
            p.alias("client_patient_id"),
            F.when((F.col("c_mktsegment") == "BUILDING") & (p % 2 == 1), "2076-8")
            .otherwise(recode(F.col("c_mktsegment"), RACES)).alias("race"),
            F.when(p % 6 == 0, "H").when(p % 6 != 5, "N").alias("ethnicity"),
            F.when((F.col("dup") == 0) & (p % 13 != 0), (100 + p % 13).cast("string")).alias("zip3"),
            F.when(p % 97 != 0, F.concat((1915 + p * 7 % 80).cast("string"), F.lit("0615"))).alias("dob"),
            F.when(p % 10 < 5, "F").when(p % 10 < 9, "M").otherwise("U").alias("gender"),
            F.when(p % 8 < 5, "eng").when(p % 8 == 5, "spa").when(p % 8 == 6, "vie").alias("primary_language"))

    @cached_property
    def orig_zips(self) -> DataFrame:
        p = F.col("c_custkey")
        return self.table("customer").where(p % 4 != 1).select(
            (F.col("c_nationkey") * BRANCHES + p % BRANCHES).cast("bigint").alias("client_id"),
            p.alias("client_patient_id"),
            F.when(p % 5 != 0, (200 + p % 5).cast("string")).alias("zip3"))

    @cached_property
    def procedure(self) -> DataFrame:
        """Line item with its order, patient and part.

        Role columns are made on the side they depend on, before the joins. All joins are plain equi-joins left to
        Catalyst and AQE (skew join on).
        """
        fmt = F.col("o_orderkey") % 20
        dashed = F.col("o_orderdate").cast("date").cast("string")
        visits = self.table("orders").select(
            "o_orderkey", F.col("o_custkey").alias("patient_id"),
            F.when(fmt == 0, F.substring(dashed, 1, 4)).when(fmt < 10, dashed)
            .otherwise(F.translate(dashed, "-", "")).alias("date"),
            F.when(F.col("o_orderstatus") == "P", "76").alias("modifier_code3"),
            F.when(F.substring("o_orderpriority", 1, 1) == "1", "93").alias("modifier_code4"))
        patients = self.table("customer").select(
            F.col("c_custkey").alias("patient_id"),
            (F.col("c_nationkey") * BRANCHES + F.col("c_custkey") % BRANCHES).cast("bigint").alias("client_id"))
        brand = F.substring("p_brand", 7, 2).cast("int")
        codes = self.table("part").select(
            "p_partkey",
            recode(F.col("p_type"), CPT, F.when(F.col("p_size") % 2 == 1, "99281")).alias("cpt4_hcpcs_code"),
            F.when(brand <= 4, F.lit(None)).when(brand <= 8, C.REDACTED)
            .when(brand % 2 == 0, F.concat(F.lit(" b."), brand.cast("string")))
            .otherwise(F.concat(F.lit("B"), brand.cast("string"))).alias("dx1_code"))
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("line_no"), "l_partkey",
            F.when(F.col("l_returnflag") == "R", "GT").when(F.col("l_returnflag") == "A", "25")
            .alias("modifier_code1"),
            F.when(F.col("l_linestatus") == "O", "59").alias("modifier_code2"),
            F.when(F.col("l_linenumber") % 7 == 2, "2").otherwise("11").alias("place_of_service"))
        rows = lines.join(visits.join(patients, "patient_id"), F.col("claim_id") == F.col("o_orderkey")).join(
            codes, F.col("l_partkey") == F.col("p_partkey"))
        return rows.select("client_id", "patient_id", "date", "cpt4_hcpcs_code", "dx1_code", "modifier_code1",
                           "modifier_code2", "modifier_code3", "modifier_code4", "place_of_service", "claim_id", "line_no")

    @cached_property
    def inpatient_codes(self) -> DataFrame:
        large = self.table("part").where(F.col("p_type") == "LARGE")
        return large.select(F.concat(F.lit("99477,X"), F.substring("p_brand", 7, 2)).alias("hcpcs_code"))

    @cached_property
    def icd_map(self) -> DataFrame:
        """Two code systems over the brand numbers, with the whole-row duplicates of the part table."""
        k = F.substring("p_brand", 7, 2).cast("int")
        names = F.array(*[F.lit(c[0]) for c in CAUSES])
        first = F.when((k >= 9) & (k <= 21), F.struct(
            F.element_at(names, k % 8 + 1).alias("acause"), F.lit("icd10").alias("code_system"),
            F.when(k == 13, "Coronavirus infection").otherwise(F.concat(F.lit("name "), k)).alias("icd_name")))
        second = F.when((k % 2 == 0) | (k.isin(21, 23)), F.struct(
            F.element_at(names, k * 3 % 8 + 1).alias("acause"), F.lit("icd9").alias("code_system"),
            F.concat(F.lit("old name "), k).alias("icd_name")))
        both = self.table("part").select(F.concat(F.lit("B"), k).alias("icd_code"),
                                         F.explode(F.array(first, second)).alias("s"))
        return both.where(F.col("s").isNotNull()).select("s.acause", "s.code_system", "icd_code", "s.icd_name")

    @cached_property
    def causelist(self) -> DataFrame:
        return inline_rows(self.spark, CAUSES, "acause string, cause_name string, family string, family_name string")

    @cached_property
    def study(self) -> StudyTables:
        return StudyTables(self.spark, self, STUDY)
