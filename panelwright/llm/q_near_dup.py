"""op2: near-copy groups of all documents, on two-word shingles."""

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm.near_dup import near_copies
from panelwright.llm.text import sql_lower_ascii, sql_words


def op2_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_copies(docs, shingle=2, percent=80).drop("text_key")


QUERIES = {"op2_near_copies": op2_near_copies}

SQL = {"op2_near_copies": f"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, {sql_words(sql_lower_ascii("text"))} AS w FROM documents),
runs AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)),
    lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w WHERE len(w) > 0),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM runs),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.m, d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(l.m, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id"""}
