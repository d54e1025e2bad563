"""op1: shard of every document."""

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm.sharding import TABLE_SIZE, place
from panelwright.llm.text import sql_murmur_long

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op1_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), ["doc_id"], SHARDS)


QUERIES = {"op1_shard_placement": op1_shard_placement}

_NUMBER = "('0x' || substr(md5('{0}:' || name), 1, 8))::BIGINT"

SQL = {"op1_shard_placement": f"""
WITH RECURSIVE shards AS (SELECT i, 'shard-' || lpad(i::VARCHAR, 3, '0') AS name FROM range({len(SHARDS)}) t(i)),
orders AS MATERIALIZED (
  SELECT i, list_transform(range({TABLE_SIZE}),
    lambda j: (({_NUMBER.format("offset")} + j * ({_NUMBER.format("skip")} % {TABLE_SIZE - 1} + 1)) % {TABLE_SIZE})::INTEGER) AS prefers
  FROM shards),
fill AS (
  SELECT -1 AS turn, -1::INTEGER AS slot, bitstring('0', {TABLE_SIZE}) AS taken
  UNION ALL
  SELECT turn + 1, s, set_bit(taken, s, 1)
  FROM (SELECT turn, taken, list_filter(prefers, lambda x: get_bit(taken, x) = 0)[1] AS s
        FROM fill JOIN orders ON i = (turn + 1) % {len(SHARDS)} WHERE turn + 1 < {TABLE_SIZE})),
slots AS (SELECT slot, name FROM fill JOIN shards ON i = turn % {len(SHARDS)} WHERE turn >= 0),
placed AS (SELECT doc_id, {sql_murmur_long("doc_id")} AS h FROM documents)
SELECT doc_id, (((h % {TABLE_SIZE}) + {TABLE_SIZE}) % {TABLE_SIZE}) AS slot, name AS shard
FROM placed JOIN slots ON slot = ((h % {TABLE_SIZE}) + {TABLE_SIZE}) % {TABLE_SIZE}"""}
