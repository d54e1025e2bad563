import random
from itertools import combinations

import numpy as np
import pytest

from panelwright.llm import near_dup
from panelwright.llm.components import connected_components, join_components
from panelwright.llm.near_dup import keep_one_per_group, near_copies, super_minhash


def brute_force(docs, k, percent):
    """{row number: (set size, smallest linked id)} by comparing all pairs of texts."""
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)]


def family(n, seed):
    """Copies of one text, each changed a little more than the one before, and unrelated texts."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [draw.choice(vocabulary) for _ in range(150)]
    docs = []
    for i in range(n):
        words = [draw.choice(vocabulary) if draw.random() < 0.12 * i / n else w for w in base]
        docs.append((3 * i % 101, " ".join(words)))
    return docs + [(500 + i, " ".join(draw.choice(vocabulary) for _ in range(80))) for i in range(20)]


@pytest.mark.parametrize("paired", [2, 1000])
def test_groups_equal_brute_force(spark, monkeypatch, paired):
    monkeypatch.setattr(near_dup, "PAIRED_MEMBERS", paired)
    monkeypatch.setattr(near_dup, "BLOCK_MEMBERS", 16)
    docs = family(70, 1)
    found = near_copies(spark.createDataFrame(docs, "doc_id long, text string"), shingle=2)
    assert sorted(tuple(r)[:1] + tuple(r)[2:4] for r in found.collect()) == sorted(brute_force(docs, 2, 80))


def test_nulls_blanks_ties_and_clashing_names(spark):
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "WORD"), (6, "a b c"), (6, "a b c"), (None, "a b c"), (7, "x y z"),
            (None, "alone here"), (8, "a  b\tc")]
    df = spark.createDataFrame([(*d, "x", 1, b"y") for d in docs], "doc_id long, text string, cls string, n int, bands binary")
    out = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_copies(df, shingle=2).collect()}
    assert out == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 2, 6, True),
                   (None, 2, 6, False), (7, 1, 7, True), (None, 1, None, True), (8, 2, 6, False)}
    kept = keep_one_per_group(df, shingle=2)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted(
        [(1, ""), (2, ""), (3, " \n\t"), (4, "word"), (6, "a b c"), (6, "a b c"), (7, "x y z"), (0, "alone here")])


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_copies(empty).count() == 0 and keep_one_per_group(empty).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    shared, a, b = (rng.integers(0, 2 ** 63, n, dtype=np.uint64) for n in (400, 100, 100))
    sets = [np.concatenate([shared, a]), np.concatenate([shared, b]), np.concatenate([b, shared]), shared[:3], shared[:0]]
    m = 1000
    sig = super_minhash(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), m)
    assert abs((sig[0] == sig[1]).mean() - 400 / 600) < 0.05
    assert (sig[1] == sig[2]).all() and np.isfinite(sig[3]).all() and np.isinf(sig[4]).all()


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (None, 7)], "x long, y long").repartition(5)
    found = connected_components(edges, "x", "y")
    groups = {}
    for r in found.collect():
        groups.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(len, groups.values())) == [200, 301]
    more = spark.createDataFrame([(300, 1150), (9000, 9001), (1, 2)], "x long, y long")
    joined = {}
    for r in join_components(found, more, "x", "y").collect():
        joined.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(len, joined.values())) == [2, 501]
    assert connected_components(edges.where("false"), "x", "y").count() == 0


def test_one_row_of_each_group_stays_however_often_it_is_repeated(spark):
    import corpus_pipeline
    hot, other, near = "one two three four five six seven", "a b c d e f g h", " ".join(f"w{i}" for i in range(60))
    docs = [(1, hot)] * 300 + [(2, hot)] * 20 + [(None, other)] * 200 + [(None, "x y z x y z")] * 2 + [(5, near)] * 3 + [(6, near + " w60")]
    docs += [(5, "nothing like the text of the same id above")] * 2 + [(7, near + " w61")] + [(9, "")] * 2 + [(10, "just one of these here")]
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(docs)], "doc_id long, text string, line long").repartition(5)
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert kept.columns == df.columns
    wanted = [(1, hot), (None, other), (None, "x y z x y z"), (5, near), (5, "nothing like the text of the same id above"), (9, ""), (10, "just one of these here")]
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted((str(d), t) for d, t in wanted)
    both = keep_one_per_group(spark.createDataFrame([(3, near), (3, near + " w60"), (4, "p q r s t")], "doc_id long, text string"), one_row=True)
    assert sorted(r["doc_id"] for r in both.collect()) == [3, 4]
