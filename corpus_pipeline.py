"""The corpus pipeline: stages over ``documents``, each on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm.decontaminate import drop_contaminated, read_benchmark
from panelwright.llm.mixing import fit_domains, mix
from panelwright.llm.near_dup import keep_one_per_group
from panelwright.llm.q_mixing import WEIGHTS, domain_labels
from panelwright.llm.q_quality import trusted_ids
from panelwright.llm.q_sharding import SHARDS
from panelwright.llm.quality import fit_quality, keep_good
from panelwright.llm.sharding import place
from panelwright.sources.writers import settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the counts, or whose n-grams are unlike those of trusted documents, go."""
    return keep_good(docs, fit_quality(docs, trusted_ids(spark, sf_dir)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays (five-word shingles, similarity 0.8), also where rows are repeated."""
    return keep_one_per_group(docs, one_row=True)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text go."""
    return drop_contaminated(docs, read_benchmark(spark, sf_dir))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers that give the labelled domains their wanted shares of the tokens."""
    return mix(docs, fit_domains(docs, domain_labels(spark, sf_dir)), WEIGHTS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their slot and shard."""
    return place(docs, ["doc_id"], SHARDS)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixing), ("sharding", sharding)]

#: Set similarity by signatures, tiling and iterated fits are not stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
