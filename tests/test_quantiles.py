import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from panelwright.operators import numbering, quantiles


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    data = [(g, float(v)) for g, n in (("a", 1500), ("b", 37), ("c", 1), (None, 11))
            for v in np.round(rng.normal(size=n), 1 if g == "a" else 6)]
    return data, spark.createDataFrame(data + [("a", None)] * 5, "g string, x double").repartition(5)


def test_exact_quantiles_with_ties_nulls_and_null_keys(sample):
    data, df = sample
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["prob"]): r["q"] for r in quantiles.group_quantiles(df, ["g"], "x", probs, slice_rows=10).collect()}
    for g in ("a", "b", "c", None):
        values = [v for k, v in data if k == g]
        for p in probs:
            assert got[(g, p)] == pytest.approx(np.quantile(values, p), abs=1e-9)
    assert len(got) == 20


def test_wide_form(sample):
    data, df = sample
    out = quantiles.group_quantiles_wide(df.where("g = 'b'"), ["g"], "x", {"q1": 0.25, "q3": 0.75}).first()
    values = [v for k, v in data if k == "b"]
    assert out["q3"] - out["q1"] == pytest.approx(np.quantile(values, 0.75) - np.quantile(values, 0.25))


def test_quantile_bins_cover_all_rows(sample):
    data, df = sample
    known = df.where("x IS NOT NULL")
    edges = np.quantile([v for _, v in data], [0, .2, .4, .6, .8, 1])
    out = quantiles.quantile_bins(known, "x", 5, "bin").select("x", "bin").collect()
    assert len(out) == len(data)
    for r in out:
        assert r["bin"] == max(1, int(np.searchsorted(edges, r["x"], side="left")))


def test_one_constant_value(spark):
    df = spark.range(10).select(F.lit(1).alias("g"), F.lit(2.5).alias("x"))
    assert quantiles.group_quantiles(df, ["g"], "x", [0.5]).first()["q"] == 2.5


def test_dense_ids_follow_key_order(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), (F.col("id") * 7 % 500 + 1000).cast("string")).alias("k"))
    got = rows(numbering.dense_ids(df, "k", "i"))
    assert got == [(f"k{1000 + i}", i + 1) for i in range(500)]
