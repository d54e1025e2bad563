import datetime as dt
import random

from conftest import rows

from panelwright.operators.day_sets import count_days, day_sets, merge_sets

KINDS = "k string, d date, batch int"


def test_merged_sets_count_as_the_facts_do(spark):
    rng = random.Random(4)
    start = dt.date(2019, 12, 25)
    data = [(rng.choice("abc"), start + dt.timedelta(days=rng.randrange(80)), rng.randrange(3)) for _ in range(400)]
    data += [("hot", dt.date(2020, 1, 31), i % 3) for i in range(500)] + [(None, dt.date(2020, 2, 29), 0), ("none", None, 1)]
    df = spark.createDataFrame(data, KINDS)
    wanted = sorted({(k, len({d for kk, d, _ in data if kk == k and d})) for k, d, _ in data if d}, key=lambda r: (r[0] is None, r[0]))
    batches = [day_sets(df.where(f"batch = {b}"), ["k"], "d") for b in range(3)]
    together = batches[0].unionByName(batches[1]).unionByName(batches[2])
    assert rows(count_days(together, ["k"])) == wanted == rows(count_days(day_sets(df, ["k"], "d"), ["k"]))
    once = merge_sets(together, ["k"])
    assert rows(merge_sets(once.unionByName(once), ["k"])) == rows(once)
    assert count_days(day_sets(df.where("false"), ["k"], "d"), ["k"]).count() == 0


def test_all_days_of_a_month_fit(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, i), 0) for i in range(1, 32)], KINDS)
    assert rows(count_days(day_sets(df, ["k"], "d"), ["k"])) == [("a", 31)]
