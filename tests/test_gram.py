import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators.fixed_effects import EventStudy, fit_event_study, solve_fit
from panelwright.operators.gram import Model, fit_models, plan, solve

KEYS = ["imp", "parity_group", "quarter", "kind"]


def make_panel(seed, units=40, periods=5):
    rng = np.random.default_rng(seed)
    out = []
    for u in range(units):
        level, a, b, m = rng.normal(), int(u % 4 == 0), int(u % 4 == 1), int(rng.random() < 0.5)
        for p in range(1, periods + 1):
            if rng.random() < 0.1:
                continue
            x = rng.normal()
            y = level + 0.3 * p + 0.5 * x + (a + 2 * b) * p * (0.4 + 0.7 * m) + rng.normal(scale=0.3)
            out.append((f"u{u}", p, a, b, a + b, m, None if rng.random() < 0.06 else x, 3.0 * (u % 5), y, None if rng.random() < 0.1 else y * y, seed))
    return pd.DataFrame(out, columns=["unit", "quarter", "a", "b", "any", "m", "x", "constant", "y", "z", "imp"])


@pytest.fixture(scope="module")
def panel(spark):
    data = pd.concat([make_panel(s) for s in (1, 2)]).astype(object)
    data = data.where(data.notna(), None)
    kinds = "unit string, quarter int, a int, b int, any int, m int, x double, constant double, y double, z double, imp int"
    df = spark.createDataFrame(data.values.tolist(), kinds)
    return df.withColumn("rows", F.lit("all")).unionByName(df.where("unit <> 'u0'").withColumn("rows", F.lit("less")))


MODELS = [Model("groups", "all", "y", (1, 2, 3, 4, 5), ("a", "b"), ("x", "constant")), Model("any", "all", "y", (1, 2, 3, 4, 5), ("any",), ("x", "constant")),
          Model("mod", "all", "y", (1, 2, 3, 4, 5), ("any",), ("x", "constant"), "m"), Model("less", "less", "z", (1, 2, 3, 4, 5), ("any",), ())]


def test_equals_single_fits(panel):
    assert [len(w.models) for w in plan(MODELS)] == [2, 1, 1]
    found = fit_models(panel, MODELS).toPandas()
    for m in MODELS:
        spec = EventStudy(m.outcome, "unit", "quarter", m.periods, [(t, F.col(t)) for t in m.treatments], m.covariates, m.moderator or None)
        wanted = fit_event_study(panel.where(F.col("rows") == m.rows), spec).toPandas().set_index(KEYS).sort_index()
        got = found[(found["model"] == m.name) & (found["kind"] != "covariate")].set_index(KEYS).sort_index()
        assert list(wanted.index) == list(got.index)
        assert np.allclose(wanted[["coef", "se"]], got[["coef", "se"]], rtol=1e-9, atol=1e-9)
        assert (wanted[["n_rows", "n_units", "n_dropped"]] == got[["n_rows", "n_units", "n_dropped"]]).all(axis=None)


def test_covariates_equal_a_dummy_regression(panel):
    found = fit_models(panel, MODELS[1:2]).where("kind = 'covariate' AND imp = 1").toPandas().set_index("parity_group")
    df = make_panel(1).dropna(subset=["x", "y"])
    cols = [pd.get_dummies(df["unit"]).to_numpy(float)] + [((df["quarter"] == p)).to_numpy(float)[:, None] for p in range(2, 6)]
    cols += [df[["x"]].to_numpy()] + [((df["quarter"] == p) * df["any"]).to_numpy(float)[:, None] for p in range(2, 6)]
    x = np.hstack(cols)
    beta = np.linalg.lstsq(x, df["y"].to_numpy(), rcond=None)[0]
    rss = ((df["y"] - x @ beta) ** 2).sum()
    at = cols[0].shape[1] + 4
    se = np.sqrt(rss / (len(df) - x.shape[1]) * np.linalg.inv(x.T @ x)[at, at])
    assert list(found.index) == ["x"] and np.isclose(found.loc["x", "coef"], beta[at]) and np.isclose(found.loc["x", "se"], se)


def test_sweep_equals_inversion_and_leaves_out_redundant_columns():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 6))
    x[:, 3] = x[:, 0] - 2 * x[:, 1]
    y = x @ np.arange(6) + rng.normal(size=60)
    z = np.column_stack([x, y, np.ones(60), np.full(60, np.sqrt(1 / 6))])
    m = z.T @ z
    kept, beta, cov = solve(m[:6, :6], m[:6, 6], m[6, 6], 60, 10)
    wanted, b, c, n, units = solve_fit(m)
    assert kept == wanted == [0, 1, 2, 4, 5] and (n, units) == (60, 10)
    assert np.allclose(beta, b, rtol=1e-9) and np.allclose(cov, c, rtol=1e-9)


def test_empty_and_unknown_rows(panel):
    assert fit_models(panel.where("false"), MODELS).count() == 0
    assert fit_models(panel.withColumn("y", F.lit(None).cast("double")), MODELS[:1]).count() == 0
    assert fit_models(panel, [Model("n", "none", "y", (1, 2), ("any",))]).count() == 0


def test_panel_is_shuffled_once_by_unit_and_only_matrices_after(panel, capsys):
    fit_models(panel, MODELS).explain("simple")
    plan_text = capsys.readouterr().out
    assert plan_text.count("Exchange") == 2 and "Join" not in plan_text
