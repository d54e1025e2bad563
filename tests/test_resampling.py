import numpy as np
import pytest
from conftest import rows

from panelwright.operators import matching, resampling
from panelwright.operators.resampling import BLOCK, block_counts, redrawn_sums

SEED, REPLICATES = 9, 50


def all_counts(n, key):
    return np.hstack([block_counts(n, REPLICATES, SEED, key, b) for b in range(-(-n // BLOCK))])


@pytest.mark.parametrize("n", [1, 7, BLOCK, BLOCK + 1, 5 * BLOCK - 3])
def test_every_replicate_draws_each_unit_once_on_average(n):
    counts = all_counts(n, ("1",))
    assert counts.shape == (REPLICATES, n) and (counts.sum(axis=1) == n).all()
    if n > BLOCK:
        assert counts.var() == pytest.approx(1 - 1 / n, abs=0.02)
        spread = counts[:, :BLOCK].sum(axis=1)                       # draws in the first block: binomial
        assert spread.std(ddof=1) == pytest.approx(np.sqrt(BLOCK * (1 - BLOCK / n)), rel=0.35)
    assert n == 1 or (all_counts(n, ("2",)) != counts).any()


def test_unknown_block():
    with pytest.raises(ValueError, match="block 1 of 1"):
        block_counts(5, 2, SEED, (1,), 1)


@pytest.fixture(scope="module")
def units(spark):
    rng = np.random.default_rng(3)
    n = 2 * BLOCK + 100
    data = [(imp, u, u + 1, float(rng.normal()), int(rng.random() < 0.3)) for imp in (1, 2) for u in range(n) if u % 3]
    contributions = spark.createDataFrame([(i, u, s, d) for i, u, _, s, d in data], "imp int, unit int, s_0 double, d bigint")
    ids = spark.createDataFrame([(i, u, u + 1) for i in (1, 2) for u in range(n)], "imp int, unit int, unit_id bigint")
    return n, data, contributions, ids


def replay(n, data, imp):
    values = np.zeros((n, 2))
    for i, u, _, s, d in data:
        if i == imp:
            values[u] = s, d
    return all_counts(n, (imp,)) @ values


def test_errors_equal_a_replay(units):
    n, data, contributions, ids = units
    got = {r["imp"]: r["std_error"] for r in matching.redrawn_se(contributions, ids, (0,), REPLICATES, SEED).collect()}
    for imp in (1, 2):
        sums = replay(n, data, imp)
        assert got[imp] == pytest.approx(np.std(sums[:, 0] / sums[:, 1], ddof=1), abs=1e-9)


def test_sums_do_not_depend_on_partitions(spark, units):
    n, data, contributions, ids = units
    values = contributions.join(ids, ["imp", "unit"]).selectExpr("imp", "unit_id", f"{n} AS n", "s_0", "d")
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for parts, batch in (("1", "10000"), ("7", "100")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            found.append(np.array(rows(redrawn_sums(values, ["s_0", "d"], "n", REPLICATES, SEED, ["imp"]))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before[1])
    assert np.allclose(*found) and np.allclose(found[0][:REPLICATES, 2:], replay(n, data, 1))


def test_no_row_for_a_draw(units, capsys):
    _, _, contributions, ids = units
    matching.redrawn_se(contributions, ids, (0,), REPLICATES, SEED).explain("formatted")
    plan = capsys.readouterr().out
    assert "Generate" not in plan and "MapInPandas" in plan


def test_empty_and_null(spark):
    schema = "imp int, unit_id bigint, n bigint, v double"
    empty = spark.createDataFrame([], schema)
    assert rows(redrawn_sums(empty, ["v"], "n", 3, SEED, ["imp"])) == []
    sparse = spark.createDataFrame([(1, 1, 2, None), (1, 2, 2, 2.0)], schema)
    counts = resampling.block_counts(2, 3, SEED, (1,), 0)
    assert rows(redrawn_sums(sparse, ["v"], "n", 3, SEED, ["imp"])) == [(1, r + 1, 2.0 * counts[r, 1]) for r in range(3)]


def test_linear_error_by_hand(spark):
    data = spark.createDataFrame([(1, 1, 2.0, 1), (1, 2, 1.0, 1), (1, 3, -0.5, 0)], "imp int, unit int, s_0 double, d bigint")
    ratio = 2.5 / 2
    expected = np.sqrt((2 - ratio) ** 2 + (1 - ratio) ** 2 + 0.25) / 2
    assert matching.linear_se(data, (0,)).first()["linear_error"] == pytest.approx(expected)
