import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm.mixing import fit_domains, fit_rates, mix, mix_rates


def corpus(spark):
    a = [(i, "apple pear plum cherry fig " * (3 + i % 4), "fruit") for i in range(40)]
    b = [(100 + i, "iron zinc tin lead gold " * (2 + i % 3), "metal") for i in range(60)]
    rows = [*a, *b, (200, "apple pear iron zinc", None), (201, None, None), (202, "", None), (None, "plum fig", None), (5, a[5][1], "fruit")]
    docs = spark.createDataFrame([(d, t, "x", 1.5) for d, t, _ in rows], "doc_id long, text string, rate string, copies double")
    labels = spark.createDataFrame([(d, x) for d, _, x in rows if x] + [(None, "fruit"), (999, "metal"), (3, None)], "doc_id long, domain string")
    return docs, labels


def test_totals_meet_targets(spark):
    docs, labels = corpus(spark)
    model = fit_domains(docs, labels)
    assert list(model.domains) == ["fruit", "metal"]
    rates = mix_rates(docs, model, {"fruit": 3, "metal": 1}, budget=900)
    total = np.zeros(2)
    for r in rates.collect():
        assert r["rate"] >= 0 and abs(sum(r["posteriors"]) - 1) < 1e-9 and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1)
        total += r["rate"] * r["n_tokens"] * np.array(r["posteriors"])
    assert np.allclose(total, [675, 225], rtol=1e-4)
    names = {r["doc_id"]: r["posteriors"] for r in rates.collect()}
    assert names[1][0] > 0.95 and names[101][1] > 0.95 and 0.1 < names[200][0] < 0.9


def test_rates_equal_projected_gradient_by_hand(spark):
    rng = np.random.default_rng(2)
    n, p = rng.integers(1, 50, 30), rng.dirichlet([0.3] * 3, 30)
    soft = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, posteriors array<double>")
    target = np.array([10.0, 500.0, 3.0])
    rows = fit_rates(soft, list(target)).collect()
    n, p, rate = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r["rate"] for r in rows])
    r, h = np.ones(30), np.linalg.inv((p * n[:, None]).T @ p)
    for _ in range(20000):
        r = np.maximum(0, r + p @ h @ (target - (r * n) @ p))
    gap = lambda x: (lambda g: g @ h @ g)(target - (x * n) @ p)
    assert (rate >= 0).all() and gap(rate) <= gap(r) * 1.05 + 1e-6


def test_default_budget_repeats_nothing_and_mix_takes_effect(spark):
    docs, labels = corpus(spark)
    model = fit_domains(docs, labels)
    rates = mix_rates(docs, model, {"fruit": 0.5, "metal": 0.5})
    assert max(r["rate"] for r in rates.collect()) < 1.2
    scarce = mix_rates(docs, model, {"fruit": 0.01, "metal": 0.99}).agg(F.min(F.when(F.col("doc_id").between(100, 160), F.col("rate")))).first()[0]
    assert scarce > 0.95
    rare = mix_rates(docs, model, {"fruit": 0.7, "metal": 0.3}).agg(F.min(F.when(F.col("doc_id") < 50, F.col("rate"))), F.max("rate")).first()
    assert rare[0] > 0.95 and rare[1] < 1.2
    out = mix(docs, model, {"fruit": 2, "metal": 1}, budget=3000)
    assert out.columns == docs.columns
    wanted = {(r["doc_id"], r["text_key"]): r["copies"] for r in mix_rates(docs, model, {"fruit": 2, "metal": 1}, budget=3000).collect()}
    found = {}
    for r in out.select("doc_id", F.xxhash64("text").alias("k")).collect():
        found[(r["doc_id"], r["k"])] = found.get((r["doc_id"], r["k"]), 0) + 1
    twice = {k: v * (2 if k[0] == 5 else 1) for k, v in wanted.items() if v}
    assert found == twice


def test_no_labels_no_rows_and_absent_domains(spark):
    docs, labels = corpus(spark)
    model = fit_domains(docs, labels.where("false"))
    assert list(model.domains) == ["all"] and mix(docs, model, {"all": 1}).count() == docs.count()
    known = fit_domains(docs, labels)
    assert mix_rates(docs.where("false"), known, {"fruit": 1}).count() == 0
    only = mix_rates(docs, known, {"fruit": 1, "glass": 5}).where("doc_id BETWEEN 100 AND 160").agg(F.max("rate")).first()[0]
    assert only < 0.2


def test_scarce_domain_reaches_its_share_under_the_default_budget(spark):
    rows = [(i, "apple pear plum cherry fig " * (3 + i % 4), "fruit") for i in range(196)]
    rows += [(500 + i, "iron zinc tin lead gold " * 4, "metal") for i in range(4)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = fit_domains(docs, spark.createDataFrame([(d, x) for d, _, x in rows], "doc_id long, domain string"))
    with pytest.warns(UserWarning, match="glass"):
        out = mix_rates(docs, model, {"fruit": 0.9, "metal": 0.1, "glass": 0.2}).collect()
    total = sum(r["rate"] * r["n_tokens"] * np.array(r["posteriors"]) for r in out)
    assert np.allclose(total / total.sum(), [0.9, 0.1], atol=1e-4)
    assert np.allclose(out[0]["reached"], total) and np.allclose(out[0]["wanted"], total, rtol=1e-3)
    metal = [r for r in out if r["doc_id"] >= 500]
    assert min(r["rate"] for r in metal) > 2 and all(r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in metal)
