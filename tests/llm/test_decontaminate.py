import random

import numpy as np

from panelwright.llm import decontaminate
from panelwright.llm.decontaminate import ItemIndex, _windows, benchmark_matches, drop_contaminated, tiles


def naive_tiles(doc, item, k):
    """Greedy string tiling as published: in each round, mark the longest common unmarked runs."""
    doc_free, item_free, out = [True] * len(doc), [True] * len(item), []
    while True:
        best, found = k, []
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and item_free[i + n] and doc_free[d + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, d)]
                elif n == best:
                    found.append((i, d))
        marked = False
        for i, d in found:
            if all(item_free[i:i + best]) and all(doc_free[d:d + best]):
                item_free[i:i + best] = [False] * best
                doc_free[d:d + best] = [False] * best
                out.append((d, i, best))
                marked = True
        if not marked:
            return out


def test_tiles_equal_the_published_rounds():
    draw, k = random.Random(3), 3
    for _ in range(150):
        doc = np.array([draw.randrange(4) for _ in range(draw.randrange(3, 40))], dtype=np.uint64)
        item = np.array([draw.randrange(4) for _ in range(draw.randrange(3, 20))], dtype=np.uint64)
        seeds = [(d, i) for d in range(len(doc) - k + 1) for i in range(len(item) - k + 1) if (doc[d:d + k] == item[i:i + k]).all()]
        at = np.array(seeds, dtype=np.int64).reshape(-1, 2)
        assert sorted(tiles(doc, item, at[:, 0], at[:, 1], k)) == sorted(naive_tiles(doc.tolist(), item.tolist(), k))


ITEM = "What is the capital of the old northern kingdom, and who built its first stone bridge?"


def test_exact_reordered_partial_and_clean(spark):
    filler = " ".join(f"f{i}" for i in range(50))
    halves = ITEM.split(", ")
    docs = [(1, f"{filler} {ITEM} {filler}"), (2, f"{halves[1].upper()} {filler} ({halves[0]})"), (3, filler), (4, f"{filler} the capital of the old northern"),
            (5, None), (6, ""), (7, "two short"), (None, ITEM), (1, f"{filler} {ITEM} {filler}"), (9, ("the capital of the old northern kingdom " * 3000))]
    bench = [(10, ITEM), (10, ITEM), (11, None), (12, ""), (13, "Two, short!"), (None, "five words are enough here")]
    d = spark.createDataFrame([(*x, "c", 1) for x in docs], "doc_id long, text string, item string, coverage int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    found = benchmark_matches(d, b)
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in found.collect()) == [(0, 10), (1, 10), (1, 10), (2, 10), (7, 13)]
    assert {r["n_tiles"] for r in found.where("doc_id = 2").collect()} == {2}
    kept = drop_contaminated(d, b)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 9]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    b = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert benchmark_matches(d.where("false"), b).count() == 0 and benchmark_matches(d, b.where("false")).count() == 0
    assert drop_contaminated(d, b.where("false")).count() == 1


def test_matches_by_their_ends_equal_all_seeds():
    """Beginnings and ends of matches over several items at once, against tiles of every seed."""
    draw, k = random.Random(8), 3
    for n in range(150):
        letters = 1 + n % 4
        doc, *items = (np.array([draw.randrange(letters) for _ in range(draw.randrange(1, 40))], dtype=np.uint64) for _ in range(4))
        index = ItemIndex([0, 1, 2], items, k)
        found = dict(index.matches(doc, {s: _windows(doc, np.arange(max(0, len(doc) - s + 1)), s) for s in index.sizes}))
        for i, item in enumerate(items):
            size = min(k, len(item))
            seeds = [(d, j) for d in range(len(doc) - size + 1) for j in range(len(item) - size + 1) if (doc[d:d + size] == item[j:j + size]).all()]
            at = np.array(seeds, dtype=np.int64).reshape(-1, 2)
            assert sorted(found.get(i, [])) == sorted(tiles(doc, item, at[:, 0], at[:, 1], size))


def test_repeats_on_both_sides_cost_by_their_length(spark):
    for unit in ("ha ", "one two three "):
        d = spark.createDataFrame([(1, unit * 200_000), (2, unit * 30)], "doc_id long, text string")
        b = spark.createDataFrame([(1, unit * 3_000)], "item_id long, text string")
        assert [(r["doc_id"], r["n_tiles"], r["coverage"]) for r in benchmark_matches(d, b).collect()] == [(1, 1, 1.0)]


def test_large_benchmark_is_joined_and_gives_the_same(spark, monkeypatch):
    draw = random.Random(4)
    texts = [" ".join(draw.choice("abcdefgh") for _ in range(draw.choice([0, 2, 4, 9, 30]))) for _ in range(60)]
    bench = spark.createDataFrame([*enumerate(texts[:30]), (3, texts[3]), (None, texts[4]), (99, None)], "item_id long, text string")
    docs = [(i, f"{t} {draw.choice(texts)} {draw.choice(texts)}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*docs, docs[0], (None, texts[7]), (70, None), (71, "")], "doc_id long, text string")
    small = sorted(map(str, benchmark_matches(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BENCHMARK_BYTES", 60)
    assert sorted(map(str, benchmark_matches(docs, bench).collect())) == small and len(small) > 60
    kept = drop_contaminated(docs, bench)
    assert 0 < kept.count() < docs.count() and benchmark_matches(docs.where("false"), bench).count() == 0


def test_large_benchmark_is_not_collected(spark, monkeypatch):
    """The driver gets seed sizes and rows of the bit table only."""
    monkeypatch.setattr(decontaminate, "BENCHMARK_BYTES", 60)
    seen, collect = [], type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda df: (seen.append(df.columns), collect(df))[1])
    bench = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x y a{i} b{i} c{i} d{i} e{i} f{i} z") for i in range(9)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in benchmark_matches(docs, bench).toLocalIterator()) == [(i, i) for i in range(9)]
    assert ["size"] in seen and ["row", "bits"] in seen and not any("t" in c for c in seen)
