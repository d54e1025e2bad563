"""op5: rates that mix all documents to wanted shares of the labelled domains."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.mixing import fit_domains, mix_rates

#: Wanted shares of tokens: domains are quality and toxicity as labelled.
WEIGHTS = {"q1t0": 0.90, "q1t1": 0.04, "q0t0": 0.05, "q0t1": 0.01}


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select("doc_id", F.concat(F.lit("q"), "quality", F.lit("t"), "toxic").alias("domain"))


def op5_mix_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_domains(docs, domain_labels(spark, sf_dir))
    out = mix_rates(docs, model, WEIGHTS)
    named = [F.round(F.col("posteriors")[i], 6).alias(f"p_{d}") for i, d in enumerate(model.domains)]
    return out.select("doc_id", "n_tokens", *named, F.round("rate", 6).alias("rate"), "copies")


QUERIES = {"op5_mix_rates": op5_mix_rates}
SQL: dict[str, str] = {}
