from collections import Counter, defaultdict
from math import exp, lgamma, log, log10

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.llm import context_tree
from panelwright.llm.context_tree import DEPTH, byte_runs, run_scores, score_texts
from panelwright.llm.text import crc_bucket


def log_kt(a, b):
    return lgamma(a + 0.5) + lgamma(b + 0.5) - 2 * lgamma(0.5) - lgamma(a + b + 1)


class Tree:
    """The same model as a recursion over nested contexts."""

    def __init__(self, texts):
        self.counts = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for text in texts:
            for context, byte in self.steps(text):
                for node, bit in self.decisions(byte):
                    for d in range(DEPTH + 1):
                        self.counts[context[DEPTH - d:], node][bit] += 1
                        if d:
                            self.children[context[DEPTH - d + 1:], node].add(context[DEPTH - d:])
        self.memo = {}

    @staticmethod
    def steps(text):
        data = bytes(DEPTH) + text.encode().lower() + b"\0"
        return [(data[i - DEPTH:i], data[i]) for i in range(DEPTH, len(data))]

    @staticmethod
    def decisions(byte):
        return [((1 << i) | (byte >> (8 - i)), (byte >> (7 - i)) & 1) for i in range(8)]

    def weighted(self, context, node):
        if (context, node) not in self.memo:
            own = log_kt(*self.counts.get((context, node), (0, 0)))
            if len(context) < DEPTH:
                below = sum(self.weighted(c, node) for c in self.children[context, node])
                own = log(0.5) + max(own, below) + log(1 + exp(-abs(own - below)))
            self.memo[context, node] = own
        return self.memo[context, node]

    def chance_of_one(self, context, node):
        p = None
        for d in range(DEPTH, -1, -1):
            c = context[DEPTH - d:]
            a, b = self.counts.get((c, node), (0, 0))
            kt = (b + 0.5) / (a + b + 1)
            beta = 1.0 if d == DEPTH else exp(log_kt(a, b) + log(0.5) - self.weighted(c, node))
            p = kt if p is None else beta * kt + (1 - beta) * p
        return p

    def score(self, text):
        total = 0.0
        for context, byte in self.steps(text):
            for node, bit in self.decisions(byte):
                p = self.chance_of_one(context, node)
                total += log10(p if bit else 1 - p)
        return total


TRAIN = ["the cat sat on the mat. The cat sat.", "a cat and a hat", "", "über den Wolken", "the cat sat on the mat. The cat sat."]
OTHER = ["the dog sat on the log", "ZZZ 漢", "", "x"]


def table(spark):
    rows = [(i, t, True) for i, t in enumerate(TRAIN)] + [(100 + i, t, False) for i, t in enumerate(OTHER)] + [(None, None, None), (0, TRAIN[0], True)]
    return spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, held_out boolean, score double")


def test_scores_equal_the_recursion(spark):
    df = table(spark)
    out = score_texts(df, F.col("held_out")).collect()
    train = [*TRAIN, TRAIN[0]]
    tree = Tree(train)
    words = Counter(w for t in train for w in [*t.encode().lower().split(), None])
    n, v = sum(words.values()), len(words)
    texts = {**dict(enumerate(TRAIN)), **{100 + i: t for i, t in enumerate(OTHER)}, None: ""}
    assert sorted(str(r["doc_id"]) for r in out) == sorted([*map(str, texts), "0"])
    for r in out:
        text = texts[r["doc_id"]]
        tokens = [*text.encode().lower().split(), None]
        assert r["held_out"] == (r["doc_id"] is None or r["doc_id"] >= 100) and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"]) == (len(tokens), sum(words[t] > 0 for t in tokens))
        assert r["base_score"] == pytest.approx(sum(log10((words[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens), rel=1e-9)
        assert r["score"] == pytest.approx(tree.score(text), rel=1e-6)
        assert r["bits_per_byte"] == pytest.approx(-r["score"] / log10(2) / (len(text.encode()) + 1), rel=1e-9)


def test_probabilities_of_all_bytes_add_up(spark):
    context = int.from_bytes(b"the ", "big") << 8
    counts = Counter(byte_runs(pa.array(TRAIN))[0].tolist())
    runs = [(k, counts[k]) for k in {*counts, *(context + b for b in range(256))}]
    found = {r["key"]: 10 ** r["value"] for r in run_scores(spark.createDataFrame(runs, "key long, n long")).collect()}
    assert sum(found[context + b] for b in range(256)) == pytest.approx(1, abs=1e-9)


def test_nothing_to_learn_from_and_no_rows(spark):
    out = score_texts(table(spark), F.lit(False)).where("doc_id = 103").first()
    assert out["train_tokens"] == 0 and out["n_known"] == 0 and out["score"] == pytest.approx(16 * log10(0.5))
    assert score_texts(table(spark).where("false"), F.lit(True)).count() == 0


def test_held_out_bits_a_byte_are_below_those_of_the_word_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = docs.select("doc_id", (F.octet_length("text") + 1).alias("bytes"))
    out = score_texts(docs, crc_bucket(F.col("doc_id"), 10) != 0).where("held_out").join(sizes, "doc_id").collect()
    total = sum(r["bytes"] for r in out)
    bits, base = (-sum(r[c] for r in out) / log10(2) / total for c in ("score", "base_score"))
    better = sum(r["score"] > r["base_score"] for r in out)
    print(f"held-out bits a byte {bits:.3f}, base {base:.3f}, better on {better} of {len(out)}")
    assert bits < base - 0.03 and better > 0.7 * len(out)


@pytest.mark.parametrize("ids", ["outlier", "text", "repeated"])
def test_no_task_holds_a_hot_text_or_the_rows_beside_an_outlier_id(spark, monkeypatch, ids):
    monkeypatch.setattr(context_tree, "DEPTH", 2)
    monkeypatch.setattr(context_tree, "_RUN", 3)
    rows = [(9 * 10 ** 18 if i == 0 else i, "the hot text of them all" if i % 3 else f"text {i} of many", i % 5 > 0) for i in range(600)]
    if ids == "repeated":
        rows = [(7, t, True) if i % 3 else (i, t, h) for i, t, h in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3)
    if ids == "text":
        df = df.withColumn("doc_id", F.col("doc_id").cast("string"))
    wanted = sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 6)) for r in score_texts(df, F.col("train")).collect())
    monkeypatch.setattr(context_tree, "BLOCK_BYTES", 6000)
    docs = df.select(F.col("doc_id").alias("id"), "text", "train")
    docs = docs.withColumn("block", context_tree._blocks(docs))
    parts = context_tree._parts(docs)
    docs = docs.withColumn("part", F.lit(0) if parts is None else F.pmod(F.monotonically_increasing_id(), parts))
    assert (parts is not None) == (ids == "repeated")
    held = [r["bytes"] for r in docs.groupBy("block", "part").agg(F.sum(context_tree._size()).alias("bytes")).collect()]
    assert max(held) < 3 * 6000
    found = sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 6)) for r in score_texts(df, F.col("train")).collect())
    assert found == wanted
