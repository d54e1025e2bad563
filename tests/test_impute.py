import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from panelwright.functions import draws
from panelwright.functions.draws import draw_int
from panelwright.operators import impute


@pytest.fixture(scope="module")
def people(spark):
    i = F.col("id")
    return spark.range(1200).select(
        i.alias("id"), (i % 4).cast("int").alias("area"),
        F.when(i % 3 == 0, None).when(i % 4 == 3, None).when(i % 5 < 3, "x").when(i % 5 == 3, "y").otherwise("z")
        .alias("race"))


def check_copies(people, sparse, m):
    stacked = impute.stack_completed(sparse, m)
    counts = {r["imp"]: r["n"] for r in stacked.groupBy("imp").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {k: 1200 for k in range(1, m + 1)}
    both = stacked.join(people.withColumnRenamed("race", "seen"), ["id", "area"])
    assert both.where("race IS NULL").count() == 0
    assert both.where("seen IS NOT NULL AND seen <> race").count() == 0
    return stacked


def test_hot_deck(spark, people):
    sparse = impute.open_copies(people, ["race"], 5)
    assert sparse.where("imp IS NULL").count() + sparse.where("imp IS NOT NULL").select("id").distinct().count() == 1200
    filled = impute.hot_deck(sparse, people, "race", ["area"], F.col("id"), 3)
    stacked = check_copies(people, filled, 5)
    # a stratum with donors only gives its own classes; area 3 has none and falls back on everybody
    seen = rows(people.where("race IS NOT NULL").groupBy("area").agg(F.array_sort(F.collect_set("race"))))
    assert rows(stacked.where("area < 3").groupBy("area").agg(F.array_sort(F.collect_set("race")))) == seen
    donors = {r["race"]: r["count"] for r in people.where("race IS NOT NULL").groupBy("race").count().collect()}
    ladder = [c for c in sorted(donors) for _ in range(donors[c])]
    drawn = filled.where("area = 3 AND imp = 2").withColumn("d", draw_int(F.col("id"), F.lit(2), 3)).collect()
    assert drawn and all(r["race"] == ladder[r["d"] % len(ladder)] for r in drawn)


def test_model_based_follows_the_predictor(spark):
    i = F.col("id")
    people = spark.range(4000).select(
        i.alias("id"), (i % 2).cast("int").alias("area"),
        F.when(i % 5 == 0, None).when((i % 2 == 1) == (i % 10 < 8), "b").otherwise("a").alias("race"))
    sparse = impute.open_copies(people, ["race"], 3)
    filled = impute.model_based(sparse, people, "race", ["a", "b"], [F.col("area")], i, 3, 5)
    assert filled.where("race IS NULL").count() == 0
    observed = {r["area"]: r["s"] for r in people.where("race IS NOT NULL").groupBy("area").agg(
        F.avg((F.col("race") == "b").cast("int")).alias("s")).collect()}
    drawn = filled.where("imp IS NOT NULL").groupBy("imp", "area").agg(F.avg((F.col("race") == "b").cast("int")).alias("s"))
    for r in drawn.collect():
        assert abs(r["s"] - observed[r["area"]]) < 0.12
    again = impute.model_based(sparse, people, "race", ["a", "b"], [F.col("area")], i, 3, 5)
    assert rows(again) == rows(filled)


def test_donor_table_is_bounded_by_classes(people):
    out = impute.donor_table(people, ["area"], "race")
    assert {r["area"] for r in out.collect()} == {0, 1, 2}
    assert out.agg(F.max(F.size("donors"))).first()[0] <= 3


def softmax_fit(x, y, w, k):
    """Newton steps for class 0 as base, with the small ridge of the operator's fit."""
    beta = np.zeros((k - 1, x.shape[1]))
    for _ in range(60):
        s = np.hstack([np.zeros((len(x), 1)), x @ beta.T])
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (((y[:, None] == np.arange(1, k)) - p[:, 1:]) * w[:, None]).T @ x
        h = np.zeros((beta.size, beta.size))
        q = x.shape[1]
        for a in range(k - 1):
            for b in range(k - 1):
                h[a * q:(a + 1) * q, b * q:(b + 1) * q] = (x * (w * p[:, a + 1] * ((a == b) - p[:, b + 1]))[:, None]).T @ x
        beta = beta + np.linalg.solve(h + 1e-10 * np.eye(len(h)), g.ravel()).reshape(beta.shape)
    return beta


def mix(key, salt, seed):
    p = draws.PRIME
    h0 = key % p
    h1 = (h0 * draws.STEP_KEY + salt * draws.STEP_SALT + seed * draws.STEP_SEED + 1) % p
    h2 = (h1 * h1 + h0 + salt) % p
    h3 = (h2 * draws.STEP_LAST + 7) % p
    return (h3 * h3 + h1) % p


def uniform(key, salt, seed):
    return (mix(key, salt, seed) + 0.5) / draws.PRIME


def poisson(u):
    cuts = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(8)])
    return int((u > cuts[:7]).sum())


def replay(rows, targets, m, passes, seed):
    """The chain on plain Python rows: {(id, imp): (values)}."""
    names, out = [t.name for t in targets], {}
    deck = lambda values, draw: sorted(values)[draw % len(values)]
    for imp in range(1, m + 1):
        data = {r["id"]: dict(r) for r in rows}
        for j, t in enumerate(targets):
            seen = [r[t.name] for r in rows if r[t.name] is not None]
            for r in data.values():
                r[t.name] = deck(seen, mix(r["id"], imp, seed + j)) if r[t.name] is None else r[t.name]
        for step in range(passes * len(targets)):
            t, at = targets[step % len(targets)], seed + 10 * (step + 1) + len(targets)
            known = [r for r in rows if r[t.name] is not None]
            gaps = [r for r in rows if r[t.name] is None]
            if t.kind == "deck":
                new = {}
                for g in gaps:
                    same = [data[r["id"]][t.name] for r in known if all(data[r["id"]][s] == data[g["id"]][s] for s in t.sees)]
                    new[g["id"]] = deck(same, mix(g["id"], imp, at))
            else:
                def vector(r):
                    v = [1.0]
                    for s in t.sees:
                        o = next((o for o in targets if o.name == s), None)
                        v += [float(r[s] == c) for c in o.classes[1:]] if o else [float(r[s])]
                    return v
                x = np.array([vector(data[r["id"]]) for r in known])
                y = np.array([t.classes.index(r[t.name]) for r in known])
                w = np.array([poisson(uniform(r["id"], imp, at + 1)) for r in known], dtype=float)
                beta = softmax_fit(x, y, w, len(t.classes))
                new = {}
                for g in gaps:
                    s = np.concatenate([[0.0], beta @ np.array(vector(data[g["id"]]))])
                    e = np.exp(s - s.max())
                    new[g["id"]] = t.classes[min(int((np.cumsum(e) < uniform(g["id"], imp, at) * e.sum()).sum()), len(e) - 1)]
            for i, v in new.items():
                data[i][t.name] = v
        out |= {(i, imp): tuple(r[n] for n in names) for i, r in data.items()}
    return out


@pytest.mark.parametrize("kinds", [("model", "model", "model"), ("deck", "model", "deck")])
def test_chain_of_three_equals_a_replay(spark, kinds):
    rng = np.random.default_rng(9)
    data = []
    for i in range(500):
        a = int(rng.integers(3))
        b, c = int(rng.random() < 0.3 + 0.2 * a), "pq"[int(rng.random() < 0.25 + 0.4 * (a == 2))]
        data.append({"id": i, "age": round(float(rng.random()), 3), "a": "xyz"[a], "b": b, "c": c})
        for n in "abc":
            if rng.random() < 0.15:
                data[-1][n] = None
    df = spark.createDataFrame([tuple(r.values()) for r in data], "id long, age double, a string, b int, c string")
    sees = {"a": ("b", "c"), "b": ("a",), "c": ("a", "b")}
    extra = lambda k: ("age",) if k == "model" else ()
    targets = [impute.Target(n, classes, (*extra(k), *sees[n]), k) for n, classes, k in zip("abc", (("x", "y", "z"), (0, 1), ("p", "q")), kinds)]
    filled = impute.chained(df, targets, {"age": F.col("age")}, F.col("id"), 2, 2, 40)
    assert filled.columns == [*df.columns, "imp"]
    got = {(r["id"], r["imp"]): (r["a"], r["b"], r["c"]) for r in impute.stack_completed(filled, 2).collect()}
    wanted = replay(data, targets, 2, 2, 40)
    assert got == wanted
    assert impute.chained(df.where("false"), targets, {"age": F.col("age")}, F.col("id"), 2).count() == 0


def test_chain_without_gaps_or_without_observed_values(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "y", None)], "id long, a string, b string")
    targets = [impute.Target("a", ("x", "y"), ("b",), "deck"), impute.Target("b", ("p",), ("a",), "deck")]
    out = impute.chained(df, targets, {}, F.col("id"), 2)
    assert rows(impute.stack_completed(out, 2), "id", "a", "b", "imp") == [(1, "x", None, 1), (1, "x", None, 2), (2, "y", None, 1), (2, "y", None, 2)]
    assert rows(impute.chained(df, targets[:1], {}, F.col("id"), 2), "id", "a", "imp") == [(1, "x", None), (2, "y", None)]
    with pytest.raises(ValueError):
        impute.Target("a", ("x",), ("a",))
