"""op12: personal data of all documents."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.pii import KINDS, find_pii, fit_pii


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["base"])
    counts = [_count(base, k).alias(f"n_{k}") for k in KINDS]
    return find_pii(docs, fit_pii(docs)).select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))


#: The spans of the trees are no SQL; ``tests/llm`` compares the patterns with a plain search.
QUERIES, SQL = {"op12_personal_data": op12_personal_data}, {}
