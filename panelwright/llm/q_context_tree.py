"""op3: log-probabilities of all documents, learned from those that are not held out."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.context_tree import score_texts
from panelwright.llm.text import crc_bucket


def op3_text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, crc_bucket(F.col("doc_id"), 10) != 0)


QUERIES = {"op3_text_scores": op3_text_scores}
SQL: dict[str, str] = {}
