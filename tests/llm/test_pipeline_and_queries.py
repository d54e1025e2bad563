import sys
from itertools import combinations
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT / "tools"))
DATA = "/root/testdata/sf0.001"

import check_oracle  # noqa: E402
import corpus_pipeline  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from panelwright.llm import queries  # noqa: E402


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in check_oracle.TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_check_text(spark, con, name):
    status, _, _, note = check_oracle.compare(spark, con, name, DATA, entry.oracle_sql()[name])
    assert status == "ok", note


def test_one_query_for_each_operator():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13)}
    assert "pipeline" in entry.queries() and set(queries.QUERIES) <= set(entry.queries())


def test_stages_on_their_own_input(spark, con, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    inputs, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs.collect()
        out = stage(spark, docs, DATA)
        assert out.columns[:len(columns)] == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    inputs["end"] = docs.collect()
    ids = {k: [r["doc_id"] for r in v] for k, v in inputs.items()}

    verdicts = dict(con.execute(f"SELECT doc_id, kept FROM ({queries.SQL['op8_quality_rules']})").fetchall())
    assert sorted(ids["near_dedup"]) == sorted(d for d in ids["quality"] if verdicts[d])

    sets = {}
    for r in inputs["near_dedup"]:
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}
    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {d: new if x == old else x for d, x in root.items()}
    assert sorted(ids["decontaminate"]) == sorted(d for d, x in root.items() if d == x)

    norm = lambda t: " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split())
    items = [f" {norm(t)} " for (t,) in con.execute("SELECT text FROM benchmark").fetchall()]
    held = {r["doc_id"] for r in inputs["decontaminate"] if any(i in f" {norm(r['text'])} " for i in items)}
    assert not held & set(ids["mixing"]) and set(ids["decontaminate"]) - held == set(ids["mixing"])

    assert set(ids["sharding"]) <= set(ids["mixing"]) and len(set(ids["sharding"])) >= 0.8 * len(ids["mixing"])
    assert sorted(ids["end"]) == sorted(ids["sharding"])
    assert docs.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
