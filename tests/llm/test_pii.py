import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array

from panelwright.llm.pii import (FEATURES, KINDS, PiiModel, base_spans, candidates, features, find_pii, fit_pii, labelled, luhn, read_tree, redact_pii,
                                 threshold, thresholds)
from panelwright.llm.q_pii import op12_personal_data

DATA = "/root/testdata/sf0.001"
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, s):
    digits = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits),
            "phone": 8 <= len(digits) <= 15}[kind]


def plain(text):
    return {k: [m.span() for m in re.finditer(PLAIN[k], text) if valid(k, m.group())] for k in KINDS}


def test_patterns_equal_a_plain_search():
    rng = random.Random(3)
    parts = ["a.b", "@", "x-1.com", "é", " ", "-", "..", "+", "12", "4111 1111 1111 1111", "4111111111111111", "255.1.1.0", ".", "300", "(0)", "+49 (30) 123-4567",
             "\n", "٣", "%+", "0000255", "a@b.c", "@b.c"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert base_spans(text)[0] == plain(text), repr(text)
        assert all(text[a:b] for _, a, b in candidates(text, *base_spans(text)))


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112") and luhn("0")


def test_long_runs_take_seconds():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "1 " * 150_000, "+1" + "(" * 200_000, "@a." * 60_000, "+1-" * 60_000, "a@b.c" * 30_000,
                 "12-" * 80_000, "(at)[" * 40_000):
        found = candidates(text, *base_spans(text))
        assert len(found) <= 4 * len(text) and sum(1 for _ in labelled(text[:60_000])) <= 4 * len(text)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    words = "the of mail house green call number server card other and with".split()
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = number(15)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def piece():
        return rng.choice([lambda: f"{rng.choice(words)}.{number(2)}@mail{number(1)}.example.com", lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
                           card, lambda: f"+1 ({number(3)}) 555-{number(4)}", lambda: number(16), lambda: number(4), lambda: f"{number(3)}-{number(3)}-{number(4)}"])()

    rows = [(i, " ".join(rng.choice(words) if rng.random() < 0.9 else piece() for _ in range(60)), 0) for i in range(1200)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans int"), card


def test_trees_recover_what_the_patterns_drop(spark, corpus):
    docs, card = corpus
    model = fit_pii(docs)
    assert set(model.thresholds) == set(KINDS) and all(0.5 <= t <= 1 for t in model.thresholds.values())
    right = wrong = 0
    for _ in range(60):
        one, two = card(), card()
        text = f"pay {one} {two} now"
        assert not base_spans(text)[0]["card"]
        found = {text[a:b] for k, a, b, base, _ in model.find(text) if k == "card" and not base}
        right, wrong = right + len(found & {one, two}), wrong + len(found - {one, two})
    assert right >= 110 and wrong <= 4
    text = "call +1 (511) 555-6887 170.106.47.218 now"
    assert [text[a:b] for k, a, b, _, _ in model.find(text) if k == "phone"] == ["+1 (511) 555-6887"]
    for clean in ("version 3.0 of 1999 and 12 34", "the 9807915762804490 number", "a plain text", "5555 of 20-12-2024"):
        assert not [s for s in model.find(clean) if not s[3]], clean
    texts = [r["text"] for r in docs.limit(150).collect()]
    for t in texts:
        found, base = model.find(t), plain(t)
        assert {(k, a, b) for k, a, b, is_base, _ in found if is_base} == {(k, *s) for k in KINDS for s in base[k]}
        bare = model.redact(t)
        assert not any(t[a:b] in bare for k, a, b, _, _ in found if k != "ip")


def test_trees_read_from_print_score_as_spark_does(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] * x[:, 1] > 0)).astype(float)
    df = spark.createDataFrame([(float(b), a.tolist()) for a, b in zip(x, y)], "label double, x array<double>").withColumn("features", array_to_vector("x"))
    fitted = GBTClassifier(maxIter=6, maxDepth=3, seed=1).fit(df)
    model = PiiModel([(w, read_tree(t.toDebugString)) for w, t in zip(fitted.treeWeights, fitted.trees)])
    out = fitted.transform(df).select("x", vector_to_array("probability")[1].alias("p")).collect()
    assert np.allclose(model.probability(np.array([r["x"] for r in out])), [r["p"] for r in out])


def test_threshold_and_features():
    assert threshold(np.array([.9, .8, .7, .2]), np.array([1, 1, 1, 0])) == pytest.approx(0.5)
    assert threshold(np.array([.9, .8, .7, .6]), np.array([1, 1, 0, 0])) == pytest.approx(0.75)
    assert threshold(np.array([.9]), np.array([0])) is None
    assert len(features("x 1 y", "card", 2, 3)) == len(FEATURES)


def test_nulls_repeats_empty_tables_and_nothing_learned(spark):
    rows = [(1, "a@b.cd", "k"), (1, "a@b.cd", "k"), (None, None, None), (2, "", "z"), (None, "é 1.2.3.4", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    model = fit_pii(docs)
    assert model.trees == [] and fit_pii(docs.where("false")) == PiiModel()
    out = sorted((str(r["doc_id"]), [tuple(s)[:4] for s in r["spans"]]) for r in find_pii(docs, model).collect())
    assert out == [("1", [("email", 0, 6, True)])] * 2 + [("2", []), ("None", []), ("None", [("ip", 2, 9, True)])]
    red = redact_pii(docs, model)
    assert red.columns == docs.columns and sorted(str(r["text"]) for r in red.collect()) == ["", "None", "[EMAIL]", "[EMAIL]", "é [IP]"]
    assert find_pii(docs.where("false"), model).count() == 0


def test_query_digests(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    out = op12_personal_data(spark, DATA).collect()
    assert len(out) == len(texts)
    for r in out:
        base = plain(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in base[k])
        assert [r[f"n_{k}"] for k in KINDS] == [len(base[k]) for k in KINDS]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))
    assert sum(r[f"n_{k}"] for r in out for k in KINDS) > 0


@pytest.mark.parametrize("flood", ["see a.b@c.de now. ", "see 10.20.30.40 now. "])
def test_frequent_candidates_crowd_out_no_other_kind(spark, flood):
    other = ["a.b@c.de", "10.20.30.40", "call 030 555 1234 now", "id 9807915762804490 now"]
    rows = [(i, flood * 1000) for i in range(230)] + [(1000 + i, f"see {x} now. ") for i, x in enumerate(other * 30)]
    model = fit_pii(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {"email", "ip"} <= set(model.thresholds)
    assert [s[:3] for s in model.find("id 9807915762804490 now") if not s[3]] == []


def test_thresholds_equal_those_of_single_candidates(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (300, len(FEATURES))).astype(float)
    rows = [(KINDS[i % 3], float(rng.random() < 0.97 if v[1] > 2 else rng.random() < 0.1), v.tolist(), float(rng.integers(1, 9))) for i, v in enumerate(x)]
    train = spark.createDataFrame([r[1:3] for r in rows], "label double, x array<double>").withColumn("features", array_to_vector("x"))
    fitted = GBTClassifier(maxIter=3, maxDepth=3, seed=1).fit(train)
    model = PiiModel([(w, read_tree(t.toDebugString)) for w, t in zip(fitted.treeWeights, fitted.trees)])
    held = spark.createDataFrame(rows, "kind string, label double, x array<double>, n double")
    for precision in (0.5, 0.9, 0.99):
        wanted = {}
        for k in KINDS:
            each = [r for r in rows if r[0] == k for _ in range(int(r[3]))]
            t = threshold(model.probability(np.array([r[2] for r in each]).reshape(-1, len(FEATURES))), np.array([r[1] for r in each]), precision) if each else None
            wanted |= {} if t is None else {k: t}
        assert thresholds(held, model, precision) == pytest.approx(wanted)
    assert wanted != {k: 0.5 for k in KINDS}
