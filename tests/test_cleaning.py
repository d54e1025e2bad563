import pytest
from conftest import rows
from pyspark.sql import functions as F

from panelwright import constants as C
from panelwright.operators import cleaning, code_map, joins, policy
from panelwright.operators.skew import broadcast_if_small


def test_keep_first_prefers_known_values(spark):
    df = spark.createDataFrame([("c", "p", None, "x"), ("c", "p", "981", "y"), ("c", "q", None, "z")],
                               "client string, patient string, zip3 string, other string")
    assert rows(cleaning.keep_first(df, ["client", "patient"], ["zip3"])) == [
        ("c", "p", "981", "y"), ("c", "q", None, "z")]


def test_keep_first_breaks_ties_by_the_other_columns(spark):
    df = spark.createDataFrame([(1, None, 3), (1, None, 2), (1, None, 2)], "k int, a int, b int")
    assert rows(cleaning.keep_first(df.repartition(3), ["k"], ["a"])) == [(1, None, 2)]


def test_fill_order(spark):
    df = spark.createDataFrame([(1, None), (2, 50), (3, None), (4, None)], "id int, zip int")
    other = spark.createDataFrame([(1, 100), (3, None)], "id int, z int")
    area = spark.createDataFrame([(1, 200), (3, 200)], "id int, z int")
    out = cleaning.fill_in_order(df, "zip", [(other, ["id"], "z"), (area, ["id"], "z")])
    assert rows(out) == [(1, 100), (2, 50), (3, 200)]


def test_attrition_reconciles(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (3, 4), (5, None)], "a int, b int")
    out = rows(cleaning.attrition(df, {"a": F.col("a").isNotNull(), "b": F.col("b") > 0}))
    assert out == [(1, "a", 4, 3, 1), (2, "b", 3, 1, 2)]


def test_group_mode_and_missing_counts(spark):
    df = spark.createDataFrame([("g", 2), ("g", 2), ("g", 1), ("g", 1), ("g", None), ("h", None)], "g string, v int")
    assert rows(cleaning.group_mode(df, ["g"], "v")) == [("g", 1)]
    assert rows(cleaning.missing_counts(df)) == [("g", 0), ("v", 2)]


def test_natural_join_fails_on_a_stray_shared_column(spark):
    a = spark.createDataFrame([(1, 2)], "id int, n int")
    with pytest.raises(ValueError, match="shared columns"):
        joins.natural_left_join(a, a, ["id"])


def test_drop_listed_also_drops_unknown_codes(spark):
    facts = spark.createDataFrame([("a",), ("b",), (None,)], "code string")
    listed = spark.createDataFrame([("a",), (None,)], "code string")
    assert rows(joins.drop_listed(facts, listed, "code")) == [("b",)]


def test_require_unique(spark):
    with pytest.raises(ValueError, match="not unique"):
        joins.require_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])


def test_broadcast_only_below_the_counted_size(spark, capsys):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for limit, broadcast in ((100, True), (10, False)):
            spark.range(100).join(broadcast_if_small(spark.range(50), max_rows=limit), "id").explain()
            assert ("BroadcastHashJoin" in capsys.readouterr().out) is broadcast
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


DIMENSION = "acause string, code_system string, icd_code string, icd_name string"
CAUSELIST = "acause string, cause_name string, family string, family_name string"


@pytest.fixture()
def code_tables(spark):
    icd = spark.createDataFrame([
        ("dep", "icd10", "F32", "Depression"), ("dep", "icd10", "F32", "Depression"),
        ("rf", "icd10", "Z72", "Tobacco"), ("lri", "icd10", "U99", "coronavirus illness"),
        ("_gc", "icd10", "R99", "ill defined"), ("dep", "icd9", "R99", "Depression old"),
        ("dep", "icd9", "311", "Depression older")], DIMENSION)
    causes = spark.createDataFrame([
        ("dep", "Depression", "fam_mental", "Mental disorders"), ("rf", "Tobacco intervention", "fam_rf", "Risk factors"),
        ("lri", "Pneumonia", "fam_ri", "Respiratory infections"), ("_gc", "Garbage code", "fam_gc", "Garbage code")],
        CAUSELIST)
    return icd, causes


def test_code_dimension_and_resolution(spark, code_tables):
    dimension = code_map.build_code_dimension(*code_tables)
    family = {r["icd_code"]: r["family_name"] for r in dimension.where("code_system = 'icd10'").collect()}
    assert family["Z72"] == "Tobacco intervention" and family["U99"] == C.COVID_NAME and family["F32"] == "Mental disorders"
    assert set(C.COVID_EMPIRICAL_CODES) <= set(family)
    resolved = {r["dx"]: (r["acause"], r["icd_name"]) for r in code_map.resolve_systems(dimension, "dx").collect()}
    assert resolved["R99"] == ("dep", "Depression old")          # garbage gives way, row taken whole
    assert resolved["311"] == ("dep", "Depression older")
    assert resolved["F32"] == ("dep", "Depression")


def test_a_code_listed_twice_fails(spark, code_tables):
    from panelwright.operators.patient_days import map_codes
    icd, causes = code_tables
    twice = icd.union(spark.createDataFrame([("rf", "icd10", "F32", "again")], DIMENSION))
    resolved = code_map.resolve_systems(code_map.build_code_dimension(twice, causes), "dx")
    with pytest.raises(ValueError, match="not unique"):
        map_codes(spark.createDataFrame([("F32",)], "dx string"), "dx", resolved)


def test_policy_windows(spark):
    months = spark.range(1, 52).select(F.col("id").cast("int").alias("run"))
    states = spark.createDataFrame([(s,) for s in ("AR", "GA", "CA", "MT", "TN", "NY", "FL")], "state string")
    on = policy.attach_policy(states.crossJoin(months), policy.policy_table(spark), "run")
    span = {r["state"]: (r["a"], r["b"], r["g"]) for r in on.groupBy("state").agg(
        F.min(F.when(F.col("parity_month"), F.col("run"))).alias("a"),
        F.max(F.when(F.col("parity_month"), F.col("run"))).alias("b"), F.any_value("parity_group").alias("g")).collect()}
    assert span == {"AR": (1, 51, C.GROUP_BEFORE), "GA": (13, 51, C.GROUP_OTHER), "CA": (16, 51, C.GROUP_WAVE),
                    "MT": (16, 25, C.GROUP_WAVE), "TN": (20, 39, C.GROUP_OTHER), "NY": (40, 51, C.GROUP_OTHER),
                    "FL": (None, None, C.GROUP_NEVER)}
    assert on.where("parity_month IS NULL OR parity IS NULL").count() == 0


def test_treatment_indicator_first_period(spark):
    df = spark.createDataFrame([(True, 1), (True, 2), (False, 3), (None, 4)], "on boolean, p int")
    out = df.select("p", policy.treatment_indicator(F.col("on"), F.col("p")).alias("a"),
                    policy.treatment_indicator(F.col("on"), F.col("p"), 1).alias("b"))
    assert rows(out) == [(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, None, None)]
