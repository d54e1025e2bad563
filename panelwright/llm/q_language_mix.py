"""op7: language of all documents, learned from those whose id is not held out."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.language_mix import fit_languages, predict_languages
from panelwright.llm.text import crc_bucket


def op7_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_languages(docs, where=crc_bucket(F.col("doc_id"), 5) != 0)
    out = predict_languages(docs, model)
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "languages", "proportions")


QUERIES = {"op7_languages": op7_languages}
SQL: dict[str, str] = {}
