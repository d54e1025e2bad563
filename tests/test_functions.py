import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from panelwright import constants as C
from panelwright.functions import codes, dates, draws, means, recode


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def test_strict_and_lenient_means(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", None, 3.0), ("b", 2.0, 1.0), ("b", 4.0, 3.0)],
                               "g string, x double, w double")
    x, w = F.col("x"), F.col("w")
    out = df.groupBy("g").agg(means.strict_mean(x).alias("m"), means.strict_sum(x).alias("s"),
                              means.weighted_mean(x, w).alias("wm"), means.weighted_mean_lenient(x, w).alias("wl"))
    assert rows(out) == [("a", None, None, None, 1.0), ("b", 3.0, 6.0, 3.5, 3.5)]


def test_lenient_weights_of_missing_values_do_not_count(spark):
    df = spark.createDataFrame([(10.0, 1.0), (None, 3.0)], "x double, w double")
    assert df.agg(means.weighted_mean_lenient(F.col("x"), F.col("w"))).first()[0] == 10.0


@pytest.mark.parametrize("text, expected", [
    ("20190315", dt.date(2019, 3, 15)), ("2019-03-15", dt.date(2019, 3, 15)), ("2019", None), (None, None),
    ("20191399", None)])
def test_visit_dates(spark, text, expected):
    assert one(spark, dates.parse_visit_date(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize("day, expected", [("2019-01-01", 1), ("2023-03-01", 51), ("2018-12-01", 0), ("2018-11-30", -1)])
def test_run_month(spark, day, expected):
    assert one(spark, dates.run_month(F.lit(day).cast("date"), dt.date(2018, 12, 1))) == expected


def test_run_month_counts_whole_months(spark):
    got = one(spark, dates.run_month(F.lit("2019-02-14").cast("date"), dt.date(2019, 1, 15)))
    assert got == 0


def test_quarters(spark):
    assert one(spark, dates.run_quarter(F.lit("2023-02-01").cast("date"), 2019)) == 17
    assert one(spark, dates.quarter_label(F.lit(17), 2019)) == "Q1 2023"
    assert one(spark, dates.quarter_label(F.lit(-2), 1996)) == "Q2 1995"


def test_clean_code(spark):
    assert one(spark, codes.clean_code(F.lit(" f32.9"))) == "F329"


@pytest.mark.parametrize("a, b, expected", [
    (None, "x", True), ("_gc", "x", True), ("_gc", "_gc", False), ("_gc", None, False), ("y", "x", False),
    (None, None, False)])
def test_fallback_between_systems(spark, a, b, expected):
    lit = [F.lit(v).cast("string") for v in (a, b)]
    assert one(spark, codes.use_fallback(*lit, C.GARBAGE_CAUSE)) is expected


@pytest.mark.parametrize("mods, place, by_modifier, by_both", [
    ((None,) * 4, None, False, False), ((None, None, "GT", None), "11", True, True),
    ((None,) * 4, "2", False, True), (("25", "59", None, None), None, False, False)])
def test_remote_flag(spark, mods, place, by_modifier, by_both):
    lits = [F.lit(m).cast("string") for m in mods]
    assert one(spark, codes.is_remote(lits, C.REMOTE_MODIFIERS)) is by_modifier
    assert one(spark, codes.is_remote(lits, C.REMOTE_MODIFIERS, F.lit(place).cast("string"))) is by_both


def test_membership_is_never_null(spark):
    assert one(spark, codes.is_member(F.lit(None).cast("string"), ["a"])) is False


def test_bins_are_right_closed_and_include_the_minimum(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.0, 3.0, 9.0)], "x double")
    out = df.select("x", recode.bin_right_closed(F.col("x"), [F.lit(v) for v in (0.0, 1.0, 2.0, 3.0)]).alias("b"))
    assert rows(out) == [(0.0, 1), (1.0, 1), (1.5, 2), (2.0, 2), (3.0, 3), (9.0, None)]


def test_bands_and_flags_keep_missing(spark):
    missing = F.lit(None).cast("double")
    assert one(spark, recode.band(missing, [5.3], ["a", "b"])) is None
    assert one(spark, recode.band(F.lit(5.3), [5.3], ["a", "b"])) == "b"
    assert one(spark, recode.flag(missing > 1)) is None


def test_ratio_to_baseline(spark):
    ratio = recode.ratio_to_baseline
    assert one(spark, ratio(F.lit(3.0), F.lit(0.0), F.lit(False))) is None
    assert one(spark, ratio(F.lit(3.0), F.lit(2.0), F.lit(False))) == 1.5
    assert one(spark, ratio(F.lit(3.0), F.lit(0.0), F.lit(True))) == 1.0


def test_draws_are_even_and_independent_over_salts(spark):
    df = spark.range(20000).select(draws.draw_uniform(F.col("id"), F.lit(1), 7).alias("a"),
                                   draws.draw_uniform(F.col("id"), F.lit(2), 7).alias("b"))
    mean_a, sd_a, corr = df.agg(F.avg("a"), F.stddev("a"), F.corr("a", "b")).first()
    assert abs(mean_a - 0.5) < 0.01 and abs(sd_a - 12 ** -0.5) < 0.01 and abs(corr) < 0.03


def test_draws_match_their_sql_text(spark):
    df = spark.range(500).select("id", draws.draw_int(F.col("id"), F.lit(3), 11).alias("v"),
                                 F.expr(draws.draw_sql("id", "3", 11)).alias("s"))
    assert df.where("v <> s").count() == 0


def test_string_keys_are_not_negative(spark):
    low = spark.range(1000).select(draws.string_key(F.col("id").cast("string")).alias("k")).agg(F.min("k")).first()[0]
    assert low >= 0
