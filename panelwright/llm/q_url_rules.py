"""op6: verdict on every page's URL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.url_rules import BOUND, MIN_CONFIDENCE, MIN_COUNT, judge_urls, mine_rules

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose id is labelled; bad is low quality or toxic under any label of the id."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy(F.col("doc_id").alias("page_id"))
    bad = labels.agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").distinct().join(bad, "page_id")


def op6_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined = mine_rules(labelled_urls(spark, sf_dir), bound=BOUND)
    out = judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), mined, RULES)
    return out.withColumn("confidence", F.round("confidence", 6))


QUERIES = {"op6_url_verdicts": op6_url_verdicts}

_FITS = "(host = split_part('{0}', '/', 1) OR ends_with(host, '.' || split_part('{0}', '/', 1))) AND starts_with(path, '{0}'[strpos('{0}', '/'):])"
_CASE = "CASE " + " ".join(f"WHEN {_FITS.format(r)} THEN '{{{i}}}'" for i, (_, r) in
                           sorted(enumerate(RULES), key=lambda x: -len(x[1][1]))) + " END"
_TAGGED = "list_transform(list_filter({1}, lambda x: x <> ''), lambda x: '{0}' || regexp_replace(x, '[0-9]+', '#', 'g'))"

SQL = {"op6_url_verdicts": f"""
WITH parts AS MATERIALIZED (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(.*)$', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(.*)$', 2), '') AS path,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(.*)$', 3), '') AS tail FROM pages),
tokens AS MATERIALIZED (
  SELECT DISTINCT url, CASE WHEN host = '' THEN [] ELSE list_sort(list_distinct(
      {_TAGGED.format("host:", "string_split(host, '.')")} || {_TAGGED.format("path:", "string_split(path, '/')")} ||
      list_transform({_TAGGED.format("query:", "string_split(regexp_extract(tail, '(?s)^[?]([^#]*)', 1), '&')")},
                     lambda x: split_part(x, '=', 1)) || CASE WHEN contains(tail, '#') THEN ['fragment'] ELSE [] END)) END AS t
  FROM parts),
bad AS (SELECT doc_id AS page_id, max(quality = 0 OR toxic = 1) AS bad FROM labels GROUP BY 1),
baskets AS MATERIALIZED (
  SELECT DISTINCT p.page_id, p.url, t, coalesce(bad, false) AS bad FROM parts p JOIN bad USING (page_id) JOIN tokens k ON k.url IS NOT DISTINCT FROM p.url),
subsets AS (
  SELECT bad, list_filter(t, lambda x, i: (m >> (i - 1)) & 1 = 1) AS s
  FROM (SELECT bad, t, unnest(range(1, (1 << len(t))::BIGINT)) AS m FROM baskets)),
counted AS (SELECT s, count(*) AS m, count(*) FILTER (bad) AS n, count(*) FILTER (bad) / count(*) AS confidence FROM subsets GROUP BY s),
rules AS MATERIALIZED (
  SELECT s, confidence FROM counted WHERE n >= {MIN_COUNT} AND confidence >= {MIN_CONFIDENCE}
     AND (confidence + {BOUND} ** 2 / (2 * m) - {BOUND} * sqrt(confidence * (1 - confidence) / m + {BOUND} ** 2 / (4 * m * m)))
         / (1 + {BOUND} ** 2 / m) >= (SELECT avg(bad::INT) FROM baskets)),
found AS (SELECT url, count(*) AS n, max(confidence) AS c FROM tokens JOIN rules ON list_has_all(t, s) WHERE url IS NOT NULL GROUP BY url),
fixed AS (
  SELECT page_id, url, host, path, {_CASE.format(*[r for _, r in RULES])} AS rule, {_CASE.format(*[v for v, _ in RULES])} AS v FROM parts)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN n > 0 THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(n, 0) AS n_rules, round(c, 6) AS confidence
FROM fixed LEFT JOIN found USING (url)"""}
