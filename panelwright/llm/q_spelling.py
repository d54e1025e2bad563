"""op11: spelling variants of the words of all documents."""

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm.spelling import FORM_RATIO, MIN_COUNT, MIN_LENGTH, count_words, group_spellings
from panelwright.llm.text import sql_crc32, sql_lower_ascii


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(count_words(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}

#: Words of equal length that are equal without the code point at one place, and words that are another word without one.
SQL = {"op11_spelling_variants": f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all({sql_lower_ascii("coalesce(text, '')")}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL),
hashed AS MATERIALIZED (SELECT run, n, {sql_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM counted),
damaged AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM damaged GROUP BY word HAVING length(word) >= {MIN_LENGTH} AND sum(n) >= {MIN_COUNT}),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
less AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
near AS MATERIALIZED (
  SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, l.word FROM less l JOIN words w ON l.rest = w.word),
ranked AS (
  SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r
  FROM near JOIN words ON b = word),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= {FORM_RATIO} * w.n THEN r.b END AS form,
         CASE WHEN r.n >= {FORM_RATIO} * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.a = w.word AND r.r = 1),
chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n
FROM formed f JOIN (SELECT word, root FROM chain c WHERE NOT EXISTS (FROM formed f WHERE f.word = c.root AND f.form IS NOT NULL)) USING (word)"""}
