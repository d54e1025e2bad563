from collections import Counter
from math import log

from pyspark.sql import functions as F

from panelwright.llm.quality import QualityModel, fit_quality, judge, keep_good, ngram_buckets, text_counts

TEXTS = [None, "", " \n ", "one", "a b c a b c", "a a a a", "x y z\nx y z\n\nx  y z\n", "#1 *two* $5 50% a&b <c> |", "über 你好 \U0001f600 a b",
         "p q r s p q t p q r", "w " * 60, "\n".join(["same line here"] * 30), "a b a b a b", " ".join(f"w{i}" for i in range(3000)) + " w1 w2 w3"]


def expected(text):
    text = text or ""
    words = [w for w in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    found = df.select("doc_id", *[c.alias(k) for k, c in text_counts(F.col("text")).items()]).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in found] == [expected(t) for t in TEXTS]


def corpus(spark):
    good = [(i, "the cat sat on the mat " * 10 + f"tail{i}") for i in range(8)]
    bad = [(100 + i, " ".join(f"###x{j * 7 + i} %%%" for j in range(40))) for i in range(8)]
    return spark.createDataFrame([(*d, "clash", 0.5) for d in [*good, *bad, (None, None), (3, "the cat sat on the mat " * 10 + "tail3")]],
                                 "doc_id long, text string, kept string, ratio double")


def test_ratio_equals_brute_force(spark):
    docs, size = corpus(spark), 1 << 10
    trusted = spark.createDataFrame([(1,), (2,), (2,), (None,), (77,)], "doc_id long")
    model = fit_quality(docs, trusted, buckets=size)
    grams = [(r["doc_id"], r["g"]) for r in docs.select("doc_id", ngram_buckets(F.col("text"), size).alias("g")).collect()]
    every, good = Counter(), Counter()
    for d, g in grams:
        every.update(g)
        if d in (1, 2):
            good.update(g)
    weight = [log((good[b] + 1) / (sum(good.values()) + size)) - log((every[b] + 1) / (sum(every.values()) + size)) for b in range(size)]
    assert max(abs(a - b) for a, b in zip(model.weights, weight)) < 1e-12
    found = judge(docs, model).collect()
    assert len(found) == 18
    for r, (d, g) in zip(found, grams):
        assert r["doc_id"] == d and abs(r["ratio"] - (sum(weight[b] for b in g) / len(g) if g else 0)) < 1e-9
        assert r["kept"] == (not r["base_failed"] and r["ratio"] >= model.min_ratio)


def test_nothing_trusted_and_no_rows(spark):
    docs = corpus(spark)
    assert set(fit_quality(docs, docs.where("false")).weights) == {0.0}
    model = fit_quality(docs.where("false"), docs.select("doc_id"))
    assert judge(docs.where("false"), model).count() == 0


def test_kept_rows_keep_their_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (2, "few words", "b"), (None, text, None), (3, None, "c")], "doc_id long, text string, kept string")
    kept = keep_good(docs, QualityModel([0.0] * 16))
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 1]
    assert keep_good(docs, QualityModel([-1.0] * 16)).count() == 0
