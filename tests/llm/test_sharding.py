from collections import Counter

import pytest

from panelwright.llm.sharding import lookup_table, place, write_shards


def test_table_is_even_and_stable():
    names = [f"s{i}" for i in range(40)]
    before, after = lookup_table(names, 4099), lookup_table(names[:-1], 4099)
    counts = Counter(before)
    assert len(counts) == 40 and max(counts.values()) - min(counts.values()) <= 1
    moved = sum(a != b for a, b in zip(before, after) if a != 39)
    assert moved < 0.12 * 4099
    assert lookup_table(names, 4099) == before


@pytest.mark.parametrize("shards, size", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_bad_parameters_are_refused(shards, size):
    with pytest.raises(ValueError):
        lookup_table(shards, size)


def test_rows_keep_their_columns_and_keys_their_shard(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "old"), (1, "b", "old"), (None, None, None), (None, "x", "old"), (2, "", None)], "doc_id long, text string, shard string")
    out = place(df, ["doc_id"], ["p", "q", "r"], 101)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "shard", "slot"] and len(rows) == 5
    by_key = {}
    for r in rows:
        by_key.setdefault(r["doc_id"], set()).add((r["shard"], r["slot"]))
    assert all(len(v) == 1 for v in by_key.values()) and {r["shard"] for r in rows} <= {"p", "q", "r"}
    assert place(df.where("false"), ["doc_id"], ["p"], 101).count() == 0
    write_shards(out, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_no_row_moves(spark):
    plan = place(spark.range(100), ["id"], ["a", "b"], 101)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Python" not in plan
