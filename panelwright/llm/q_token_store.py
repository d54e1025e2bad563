"""op4: all documents as token ids, written to files and read back."""

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.token_store import read_tokens, write_tokens
from panelwright.sources.writers import fresh_path

END_ID = 2


def op4_token_store(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = fresh_path(spark, "token-files")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, Path(tokenizer).read_text(), END_ID)
    ids = F.col("ids")
    return read_tokens(spark, path).select(F.col("id").alias("doc_id"), "start", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
                                           F.crc32(ids).alias("ids_crc32"))


QUERIES = {"op4_token_store": op4_token_store}
SQL: dict[str, str] = {}
