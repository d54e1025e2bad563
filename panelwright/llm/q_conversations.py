"""op13: damage, faults and cheapest repair of all conversations."""

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm.conversations import DELETE, INSERT, KEEP, REROLE, TRUNCATED, damage, mark_repeats, repair_conversations, with_lost
from panelwright.llm.text import sql_crc32


def op13_repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return with_lost(rows, repair_conversations(mark_repeats(damage(rows))))


QUERIES = {"op13_repaired_conversations": op13_repaired_conversations}

#: Every row's options are tried from every state, and of equal states the least (cost, audit) goes on.
SQL = {"op13_repaired_conversations": f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {sql_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM keyed WHERE kind <> 0),
ordered AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
faults AS MATERIALIZED (
  SELECT *, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault
  FROM ordered),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank,
         count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
         count_if(before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM faults GROUP BY conv_id),
inserts AS (
  FROM (VALUES ('', '', '', ''), ('s', 's', '', ''), ('u', 'u', '', ''), ('a', 'a', '', ''), ('', 'u', 'I', chr(10) || 'user:'), ('s', 'u', 'I', chr(10) || 'user:'),
               ('a', 'u', 'I', chr(10) || 'user:'), ('u', 'a', 'I', chr(10) || 'assistant:'), ('', 'a', 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
               ('s', 'a', 'II', chr(10) || 'user:' || chr(10) || 'assistant:')) AS t(here, there, edits, added)),
next(here, there) AS (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
moves AS (
  SELECT i.here, n.there, i.edits, i.added, k.edit FROM inserts i JOIN next n ON n.here = i.there, (VALUES ('K'), ('R')) AS k(edit)
  UNION ALL SELECT here, there, edits, added, 'D' FROM inserts),
search AS (
  SELECT conv_id, 0::BIGINT AS i, '' AS state, {{'cost': 0::BIGINT, 'audit': '', 'out': ''}} AS best FROM counts
  UNION ALL
  SELECT s.conv_id, s.i + 1, m.there, min({{
    'cost': (s.best.cost + {INSERT} * length(m.edits) + CASE m.edit WHEN 'D' THEN {DELETE} WHEN 'K' THEN {KEEP} ELSE {REROLE} END
             + CASE WHEN f.fault = 'truncated' AND m.edit <> 'D' THEN {TRUNCATED} ELSE 0 END)::BIGINT,
    'audit': s.best.audit || m.edits || m.edit,
    'out': s.best.out || m.added || CASE m.edit WHEN 'K' THEN chr(10) || f.role || ':' || f.text
             WHEN 'R' THEN chr(10) || CASE m.there WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text ELSE '' END}})
  FROM search s JOIN faults f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1 JOIN moves m ON m.here = s.state
  WHERE m.edit = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (m.edit = 'K' AND m.there = f.x OR m.edit = 'R' AND m.there IN ('u', 'a')))
  GROUP BY s.conv_id, s.i, m.there),
ended AS (
  SELECT s.conv_id, min({{'cost': (s.best.cost + {INSERT} * length(e.edits))::BIGINT, 'audit': s.best.audit || e.edits,
                         'out': s.best.out || e.added}}) AS best
  FROM search s JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.i JOIN inserts e ON e.here = s.state
  WHERE e.there IN ('', 'a') GROUP BY s.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.out, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
     LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""}
