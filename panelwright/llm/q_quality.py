"""op8: quality counts and verdict of all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.quality import BUCKETS, MIN_RATIO, fit_quality, judge
from panelwright.llm.text import SQL_BLANK, sql_murmur, sql_words


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good and not toxic."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND toxic = 0").select("doc_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_quality(docs, trusted_ids(spark, sf_dir))
    return judge(docs, model).withColumn("ratio", F.round("ratio", 4) + F.lit(0.0))


QUERIES = {"op8_quality_rules": op8_quality_rules}

SQL = {"op8_quality_rules": f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS text, {sql_words("text")} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
windows AS MATERIALIZED (SELECT doc_id, i, w[i:i + 2] AS v FROM places WHERE i + 2 <= len(w)),
twice AS (SELECT doc_id, v FROM windows GROUP BY ALL HAVING count(*) > 1),
inside AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM windows JOIN twice USING (doc_id, v)),
repeated AS (SELECT doc_id, count(DISTINCT i) AS n FROM inside GROUP BY doc_id),
vocabulary AS (SELECT DISTINCT w[i] AS x FROM places),
hashed AS MATERIALIZED (SELECT x, {sql_murmur("x")} AS h FROM vocabulary),
seq AS MATERIALIZED (SELECT p.doc_id, p.i, h FROM places p JOIN hashed ON x = p.w[p.i]),
hashes AS (
  SELECT doc_id, h AS v FROM seq UNION ALL
  SELECT a.doc_id, a.h * 31 + b.h FROM seq a JOIN seq b ON a.doc_id = b.doc_id AND b.i = a.i + 1),
grams AS MATERIALIZED (SELECT doc_id, ((v % {BUCKETS}) + {BUCKETS}) % {BUCKETS} AS b FROM hashes),
trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
counts AS (
  SELECT b, count(*) AS n, count(t.doc_id) AS t FROM grams g LEFT JOIN trusted t ON g.doc_id = t.doc_id GROUP BY b),
totals AS (SELECT sum(n) AS n, sum(t) AS t FROM counts),
weights AS (
  SELECT b, CASE WHEN z.t = 0 THEN 0 ELSE ln((c.t + 1) / (z.t + {BUCKETS})) - ln((c.n + 1) / (z.n + {BUCKETS})) END AS x
  FROM counts c, totals z),
ratios AS (SELECT doc_id, avg(x) AS r FROM grams JOIN weights USING (b) GROUP BY doc_id),
out AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(text, '{SQL_BLANK}', '', 'g')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(p.n, 0) AS n_repeat_words, coalesce(r, 0) AS r
  FROM d LEFT JOIN repeated p ON p.doc_id = d.doc_id LEFT JOIN ratios q ON q.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, round(r, 4) AS ratio,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND r >= {MIN_RATIO} AS kept
FROM out"""}
