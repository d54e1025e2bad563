"""op9: benchmark texts held by any document."""

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm.decontaminate import benchmark_matches, read_benchmark


def op9_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return benchmark_matches(docs, read_benchmark(spark, sf_dir)).drop("text_key")


QUERIES = {"op9_benchmark_matches": op9_benchmark_matches}
SQL: dict[str, str] = {}
