"""op10: main text of all pages."""

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm.html_text import extract_text


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op10_main_text": op10_main_text}

SQL: dict[str, str] = {}
