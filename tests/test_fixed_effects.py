import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators.fixed_effects import EventStudy, fit_event_study, independent_columns
from panelwright.operators.pooling import pool


def make_panel(seed, units=24, periods=5, moderator=False):
    """Unbalanced panel with unit-constant treatment and moderator and one missing covariate."""
    rng = np.random.default_rng(seed)
    out = []
    for u in range(units):
        effect = rng.normal()
        for p in range(1, periods + 1):
            if rng.random() < 0.15:
                continue
            treat, mod = u % 3 == 0, u % 2
            x = rng.normal()
            y = effect + 0.3 * p + 0.5 * x + treat * p * (0.4 + 0.7 * mod) + rng.normal(scale=0.2)
            out.append((f"u{u}", p, int(treat), mod, None if rng.random() < 0.05 else x, 2.0 * (u % 5), float(y)))
    return pd.DataFrame(out, columns=["unit", "period", "treat", "mod", "x", "constant", "y"])


def full_dummy_fit(df, columns):
    """Least squares with one dummy per unit; columns that depend on earlier ones are left out."""
    units = pd.get_dummies(df["unit"]).to_numpy(float)
    design, names = units, []
    for name, values in columns:
        wider = np.column_stack([design, values])
        if np.linalg.matrix_rank(wider, tol=1e-8) > design.shape[1]:
            design, names = wider, [*names, name]
    y = df["y"].to_numpy()
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    rss = ((y - design @ beta) ** 2).sum()
    cov = rss / (len(y) - design.shape[1]) * np.linalg.inv(design.T @ design)
    start = units.shape[1]
    return {n: (beta[start + i], np.sqrt(cov[start + i, start + i])) for i, n in enumerate(names)}, names, cov[start:, start:]


def columns_of(df, periods, moderator):
    t, m = df["treat"].to_numpy(float), df["mod"].to_numpy(float)
    dummies = [(p, (df["period"] == p).to_numpy(float)) for p in range(2, periods + 1)]
    cols = [("t", t), *[(("p", p), d) for p, d in dummies]]
    if moderator:
        cols.append(("m", m))
    cols += [("x", df["x"].to_numpy(float)), ("constant", df["constant"].to_numpy())]
    cols += [(("effect", p), t * d) for p, d in dummies]
    if moderator:
        cols += [("tm", t * m), *[(("pm", p), d * m) for p, d in dummies],
                 *[(("difference", p), t * d * m) for p, d in dummies]]
    return cols


@pytest.mark.parametrize("moderator", [False, True])
def test_equals_full_dummy_fit(spark, moderator):
    frames = [make_panel(s).assign(imp=s) for s in (1, 2)]
    panel = spark.createDataFrame(pd.concat(frames).astype(object).where(lambda d: d.notna(), None).values.tolist(),
                                  "unit string, period int, treat int, mod int, x double, constant double, y double, imp int")
    spec = EventStudy("y", "unit", "period", [1, 2, 3, 4, 5], [("g", F.col("treat"))], ["x", "constant"],
                      "mod" if moderator else None)
    got = {(r["imp"], r["kind"], r["quarter"]): r for r in fit_event_study(panel.repartition(5), spec).collect()}
    for frame in frames:
        used = frame.dropna().reset_index(drop=True)
        expected, names, cov = full_dummy_fit(used, columns_of(used, 5, moderator))
        imp = frame["imp"].iloc[0]
        for name, (coef, se) in expected.items():
            if name[0] in ("effect", "difference"):
                r = got[(imp, name[0], name[1])]
                assert r["coef"] == pytest.approx(coef, abs=1e-8) and r["se"] == pytest.approx(se, rel=1e-6)
                assert r["n_rows"] == len(used) and r["n_units"] == used["unit"].nunique()
        if moderator:
            for p in range(2, 6):
                a, b = names.index(("effect", p)), names.index(("difference", p))
                r = got[(imp, "total", p)]
                assert r["coef"] == pytest.approx(expected[("effect", p)][0] + expected[("difference", p)][0], abs=1e-8)
                assert r["se"] == pytest.approx(np.sqrt(cov[a, a] + cov[b, b] + 2 * cov[a, b]), rel=1e-6)


def test_redundant_columns_give_way_in_order():
    x = np.random.default_rng(0).normal(size=(50, 3))
    full = np.column_stack([x, x[:, 0] + x[:, 1], np.zeros(50)])
    assert independent_columns(full.T @ full) == [0, 1, 2]


def test_pooling_formula_and_missing_copy(spark):
    rng = np.random.default_rng(5)
    est, se = rng.normal(size=10), rng.uniform(1, 2, size=10)
    data = [("a", i, float(est[i]), float(se[i])) for i in range(10)] + [("b", i, 1.0, 1.0) for i in range(9)]
    out = {r["k"]: r for r in pool(spark.createDataFrame(data, "k string, imp int, e double, s double"), ["k"], "e", "s",
                                   10).collect()}
    b, w = est.var(ddof=1), (se ** 2).mean()
    r = out["a"]
    assert r["est_adj"] == pytest.approx(est.mean()) and r["v_b"] == pytest.approx(b) and r["v_w"] == pytest.approx(w)
    assert r["se_pooled"] == pytest.approx(np.sqrt(w + b + b / 10)) and r["v_total"] >= r["v_w"]
    assert r["uci"] == pytest.approx(est.mean() + 1.96 * r["se_pooled"])
    assert out["b"]["est_adj"] is None and out["b"]["uci"] is None
