import numpy as np
import pandas as pd
import pytest
from conftest import rows

from panelwright.functions.draws import PRIME
from panelwright.operators import matching
from panelwright.operators.softmax import fit_softmax

LEADS = (0, 2)
COLUMNS = "imp int, unit int, period int, treat int, y double, a double"


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(11)
    out = []
    for imp in (1, 2):
        for u in range(40):
            start = int(rng.integers(2, 8)) if u % 4 == 0 else 99
            a = rng.normal()
            for p in range(1, 11):
                if rng.random() < 0.05:
                    continue
                treat = int(start <= p)
                y = None if rng.random() < 0.03 else float(a + 0.1 * p + treat + rng.normal(scale=0.3))
                out.append((imp, u, p, treat, y, float(a + rng.normal(scale=0.1))))
    return pd.DataFrame(out, columns=["imp", "unit", "period", "treat", "y", "a"])


@pytest.fixture(scope="module")
def members(spark, frame):
    data = [tuple(None if v != v else v for v in r) for r in frame.itertuples(index=False, name=None)]
    df = spark.createDataFrame([(int(i), int(u), int(p), int(t), y, a) for i, u, p, t, y, a in data], COLUMNS)
    return matching.matched_members(df.repartition(4), unit="unit", period="period", treat="treat", outcome="y",
                                    leads=LEADS, carry=["a"])


def naive_sets(frame):
    """Matched sets by explicit search."""
    at = {(r.imp, r.unit, r.period): r for r in frame.itertuples()}

    def usable(i, u, p):
        need = [(i, u, p + k) for k in (-1, *LEADS)]
        return all(k in at and at[k].y == at[k].y for k in need) and at[(i, u, p - 1)].treat == 0

    sets = {}
    for (i, u, p), r in at.items():
        if usable(i, u, p):
            sets.setdefault((i, p), {0: [], 1: []})[r.treat].append(u)
    return at, {k: s for k, s in sets.items() if s[0] and s[1]}


def test_sets_equal_explicit_search(frame, members):
    _, sets = naive_sets(frame)
    expected = sorted((i, p, u, t) for (i, p), s in sets.items() for t in (0, 1) for u in s[t])
    assert rows(members, "imp", "period", "unit", "treated") == expected


def test_even_weighted_effect_equals_set_loop(frame, members):
    at, sets = naive_sets(frame)
    contributions = matching.unit_contributions(matching.equal_weights(members), LEADS)
    got = {(r["imp"], r["lead"]): r["estimate"] for r in matching.att(contributions, LEADS).collect()}
    for imp in (1, 2):
        for h in LEADS:
            effects = []
            for (i, p), s in sets.items():
                if i == imp:
                    change = {u: at[(i, u, p + h)].y - at[(i, u, p - 1)].y for u in s[0] + s[1]}
                    effects += [change[u] - np.mean([change[c] for c in s[0]]) for u in s[1]]
            assert got[(imp, h)] == pytest.approx(np.mean(effects), abs=1e-9)


def test_propensity_weights(members):
    weighted = matching.propensity_weights(members, ["a"]).toPandas()
    for imp, part in weighted.groupby("imp"):
        x = np.column_stack([np.ones(len(part)), (part["a"] - part["a"].mean())])
        y, beta = part["treated"].to_numpy(), np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ beta))
            beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
        odds = np.exp(x @ beta)
        for _, s in part.assign(odds=odds).groupby("period"):
            controls = s[s["treated"] == 0]
            assert controls["weight"].sum() == pytest.approx(1)
            assert np.allclose(controls["weight"], controls["odds"] / controls["odds"].sum(), atol=1e-5)
    assert weighted.loc[weighted["treated"] == 1, "weight"].isna().all()


def draw(key, salt, seed):
    h0 = key % PRIME
    h1 = (h0 * 48271 + salt * 40692 + seed * 16807 + 1) % PRIME
    h2 = (h1 * h1 + h0 + salt) % PRIME
    h3 = (h2 * 69621 + 7) % PRIME
    return (h3 * h3 + h1) % PRIME


def test_bootstrap_equals_direct_replay(spark, members):
    contributions = matching.unit_contributions(matching.equal_weights(members), LEADS)
    ids = spark.createDataFrame([(i, u, u + 1) for i in (1, 2) for u in range(40)], "imp int, unit int, unit_id bigint")
    got = {(r["imp"], r["lead"]): r["std_error"] for r in matching.bootstrap_se(contributions, ids, LEADS, 20, 9).collect()}
    table = {(r["imp"], r["unit"]): r for r in contributions.collect()}
    for imp in (1, 2):
        for h in LEADS:
            estimates = []
            for rep in range(1, 21):
                hits = [draw(k, rep * 1000 + imp, 9) % 40 for k in range(1, 41)]
                chosen = [table[(imp, u)] for u in hits if (imp, u) in table]
                d = sum(r["d"] for r in chosen)
                if d:
                    estimates.append(sum(r[f"s_{h}"] for r in chosen) / d)
            assert got[(imp, h)] == pytest.approx(np.std(estimates, ddof=1), abs=1e-9)


def test_events_need_an_unbroken_untreated_history(spark):
    data = [(1, 1, p, 1, 0.0, 0.0) for p in range(1, 5)]                          # on from the first period: no event
    data += [(1, 2, p, int(p == 2), 0.0, 0.0) for p in range(1, 5)]               # on, then off: one event
    data += [(1, 3, p, int(p >= 3), 0.0, 0.0) for p in (1, 3, 4)]                 # gap before the switch: no event
    data += [(1, 4, p, 0, 0.0, 0.0) for p in range(1, 5)]
    df = spark.createDataFrame(data, COLUMNS)
    out = matching.matched_members(df, unit="unit", period="period", treat="treat", outcome="y", leads=(0,))
    assert rows(out.where("treated = 1"), "unit", "period") == [(2, 2)]
    assert (4, 2) in rows(out.where("treated = 0"), "unit", "period")


def test_longer_history_is_part_of_the_set(spark):
    data = [(1, u, p, int((u == 1 and p == 4) or (u == 2 and p == 2)), 0.0, 0.0) for u in (1, 2, 3) for p in range(1, 6)]
    df = spark.createDataFrame(data, COLUMNS)
    out = matching.matched_members(df, unit="unit", period="period", treat="treat", outcome="y", leads=(0,), lag=2)
    assert rows(out.where("period = 4"), "unit", "history", "treated") == [(1, "00", 1), (3, "00", 0)]


def test_multinomial_fit_recovers_cell_shares(spark):
    data = [(1, [1.0, float(x)], y, float(n)) for x, counts in ((0, (10, 20, 30)), (1, (25, 5, 10)))
            for y, n in enumerate(counts)]
    df = spark.createDataFrame(data, "imp int, x array<double>, y int, w double")
    beta = np.array(fit_softmax(df, ["imp"], "x", "y", "w", 3).first()["beta"]).reshape(2, 2)
    assert np.allclose(beta[:, 0], np.log([2, 3]), atol=1e-5)
    assert np.allclose(beta.sum(axis=1), np.log([5 / 25, 10 / 25]), atol=1e-5)


def test_separable_data_is_reported(spark):
    df = spark.createDataFrame([(1, [1.0, float(i)], int(i > 5), 1.0) for i in range(10)]
                               + [(2, [1.0, float(i)], int(i in (2, 7, 8)), 1.0) for i in range(10)],
                               "imp int, x array<double>, y int, w double")
    found = {r["imp"]: r for r in fit_softmax(df, ["imp"], "x", "y", "w", 2).collect()}
    assert np.isfinite(found[1]["beta"]).all() and found[1]["separable"] and not found[2]["separable"]
    assert 1 < found[2]["passes"] < 20
    with pytest.raises(RuntimeError, match="not converged"):
        fit_softmax(df, ["imp"], "x", "y", "w", 2, max_passes=3)
