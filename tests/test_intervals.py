import numpy as np
import pytest
from conftest import rows

from panelwright.operators import policy
from panelwright.operators.intervals import interval_join, overlapping

KINDS = "k string, s int, e int, name string"


def test_equals_a_range_join(spark):
    rng = np.random.default_rng(6)
    intervals = []
    for k in "abcd":
        at = int(rng.integers(-20, 0))
        for i in range(int(rng.integers(1, 9))):
            start, end = at, at + int(rng.integers(0, 30))
            intervals.append((k, None if i == 0 and k in "ab" else start, end, f"{k}{i}"))
            at = end + int(rng.integers(1, 6))
    intervals.append(("e", None, None, "always"))
    intervals.append(("a", 500, None, "later"))
    points = [(k, t) for k in ["a", "b", "c", "d", "e", "f", None] for t in [*range(-30, 120, 3), None, 600]] * 2
    out = interval_join(spark.createDataFrame(points, "k string, t int"), spark.createDataFrame(intervals, KINDS), ["k"], "t", "s", "e", 7)
    hit = lambda k, t: next((n for a, s, e, n in intervals if a == k and t is not None and (s is None or t >= s) and (e is None or t <= e)), None)
    assert rows(out, "k", "t", "name") == sorted([(k, t, hit(k, t)) for k, t in points], key=lambda r: tuple((v is None, v) for v in r))
    assert interval_join(spark.createDataFrame([], "k string, t int"), spark.createDataFrame(intervals, KINDS), ["k"], "t", "s", "e").count() == 0


@pytest.mark.parametrize("extra,clash", [(("a", 5, 6, "x"), False), (("a", 4, 6, "x"), True), (("a", None, None, "x"), True), (("b", 2, 3, "x"), False),
                                         (("a", None, 1, "x"), True), (("a", 9, None, "x"), False), ((None, 1, 1, "x"), False)])
def test_overlaps_are_found(spark, extra, clash):
    df = spark.createDataFrame([("a", 1, 4, "p"), ("a", 7, 8, "q"), extra], KINDS)
    assert (overlapping(df, ["k"], "s", "e").count() > 0) == clash
    if clash:
        with pytest.raises(ValueError):
            interval_join(spark.createDataFrame([("a", 1)], "k string, t int"), df, ["k"], "t", "s", "e")


def test_policies_with_several_episodes(spark):
    panel = spark.createDataFrame([(s, m) for s in ("CA", "TX", None) for m in (1, 3, 5, 8)], "state string, run_month int")
    episodes = spark.createDataFrame([("CA", 2, 3, "late"), ("CA", 8, None, "later")], "state string, start_run int, end_run int, policy_group string")
    out = policy.attach_episodes(panel, episodes, "run_month")
    assert rows(out.where("state = 'CA'").drop("state")) == [
        (1, True, False, None, None, "late"), (3, True, True, 1, 1, "late"), (5, True, False, None, None, "late"), (8, True, True, 2, 0, "late")]
    assert out.count() == 12 and out.where("parity").count() == 4
    with pytest.raises(ValueError):
        policy.attach_policy(panel, episodes, "run_month").count()
