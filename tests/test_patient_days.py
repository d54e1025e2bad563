import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from panelwright.functions.codes import is_missing_code
from panelwright.operators import patient_days, shares

DAY = ["client", "patient", "day"]


def missing():
    return is_missing_code(F.col("dx"))


@pytest.fixture()
def visits(spark):
    return spark.createDataFrame([
        ("c1", "p1", "d1", "A"), ("c1", "p1", "d1", "B"),
        ("c1", "p2", "d1", "A"), ("c1", "p2", "d1", None), ("c1", "p2", "d1", "[REDACTED]"),
        ("c1", "p3", "d1", None), ("c1", "p3", "d1", "[REDACTED]"),
        ("c2", "p1", "d1", "B")], "client string, patient string, day string, dx string")


def test_row_weights(visits):
    out = patient_days.weight_rows(visits, DAY, missing())
    assert rows(out, "client", "patient", "dx", "weight") == [
        ("c1", "p1", "A", 0.5), ("c1", "p1", "B", 0.5), ("c1", "p2", "A", 1.0), ("c1", "p3", "[REDACTED]", 0.5),
        ("c1", "p3", None, 0.5), ("c2", "p1", "B", 1.0)]


def test_code_weights(visits):
    out = patient_days.weight_codes(visits, DAY, "dx", missing())
    assert rows(out, "client", "patient", "dx", "weight") == [
        ("c1", "p1", "A", 0.5), ("c1", "p1", "B", 0.5), ("c1", "p2", "A", 1.0), ("c1", "p3", None, 1.0),
        ("c2", "p1", "B", 1.0)]


@pytest.fixture()
def skewed(spark):
    """A third of all rows on one patient-day, many of them full copies."""
    i = F.col("id")
    hot = i < 3000
    return spark.range(9000).select(
        F.when(hot, "c0").otherwise(F.concat(F.lit("c"), i % 7)).alias("client"),
        F.when(hot, "p0").otherwise(F.concat(F.lit("p"), i % 900)).alias("patient"),
        F.when(hot, "d0").otherwise(F.concat(F.lit("d"), i % 5)).alias("day"),
        F.when(i % 4 == 0, None).when(i % 4 == 1, "[REDACTED]").otherwise(F.concat(F.lit("x"), i % 3)).alias("dx"))


def test_weights_sum_to_one_and_agree_between_grains(skewed):
    by_row = patient_days.weight_rows(skewed, DAY, missing())
    coded = F.when(~missing(), F.col("dx")).alias("dx")
    from_rows = by_row.groupBy(*DAY, coded).agg(F.round(F.sum("weight"), 9).alias("w"))
    from_codes = patient_days.weight_codes(skewed, DAY, "dx", missing()).select(*DAY, "dx", F.round("weight", 9))
    assert rows(from_rows) == rows(from_codes)
    totals = by_row.groupBy(*DAY).agg(F.sum("weight").alias("w")).where("abs(w - 1) > 1e-9")
    assert totals.count() == 0


@pytest.mark.parametrize("keys", [["client", "patient"], ["client"], ["patient", "day", "dx"]])
def test_group_stats_equal_on_every_path(skewed, keys):
    with_null = skewed.withColumn("patient", F.when(F.col("patient") != "p3", F.col("patient")))
    expected = rows(shares.group_size(with_null, keys, "n", bounded=True))
    assert rows(shares.group_size(with_null, keys, "n")) == expected


def test_no_window_on_an_unbounded_key(skewed, capsys):
    shares.group_size(skewed, DAY, "n").explain("simple")
    plan = capsys.readouterr().out
    assert "Window" not in plan and "Range" not in plan


def test_cause_share_counts_missing_as_a_category(spark):
    df = spark.createDataFrame([("m", "a", 1.0), ("m", None, 3.0), ("n", None, 2.0)], "m string, cause string, weight double")
    assert rows(patient_days.cause_share(df, ["m"], "cause")) == [
        ("m", "Unmapped", 3.0, 0.75), ("m", "a", 1.0, 0.25), ("n", "Unmapped", 2.0, 1.0)]


def test_categories_outside_the_list_become_missing(spark):
    df = spark.createDataFrame([("b",), ("z",)], "cause string")
    assert rows(patient_days.order_categories(df, "cause", ["a", "b"]), "cause", "ord") == [("b", 2), (None, None)]


def test_selected_against_other_drops_keys_without_selection(spark):
    df = spark.createDataFrame([("m", "a", 1.0), ("m", "b", 3.0), ("n", "b", 2.0)], "m string, cause string, weight double")
    assert rows(patient_days.select_versus_other(df, ["m"], "cause", ["a"])) == [("m", 4.0, 1.0, 3.0)]


@pytest.mark.parametrize("partitions", [1, 7, 211])
def test_exact_sums_do_not_depend_on_the_order_of_rows(spark, partitions):
    """39 of 128 lies on a rounding edge of six places; sums of floating shares fell to either side of it."""
    rng = random.Random(partitions)
    parts = [("a", 1, 3)] * 60 + [("a", 1, 7)] * 70 + [("a", 2, 11)] * 11 + [("a", 1, 6)] * 42 + [("b", 1, 9)] * 801
    rng.shuffle(parts)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([("m", *p) for p in parts], "m string, cause string, n int, whole int").repartition(partitions)
        units = patient_days.exact_weights(df, ["m", "cause"], "n", "whole")
        merged = patient_days.regroup_causes(units, ["m"], "cause", {"z": "a"}, ["units"])
        out = rows(patient_days.cause_share(merged, ["m"], "cause", "units"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert out == [("m", "a", 39.0, 0.3046875), ("m", "b", 89.0, 0.6953125)]
