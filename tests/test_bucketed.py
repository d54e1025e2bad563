import glob

from conftest import rows
from pyspark.sql import functions as F

from panelwright.plans.q_join import co_located, joins_without_exchange
from panelwright.plans.roles import Roles
from panelwright.sources.bucketed import lay_out_by_key


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_and_sums_need_no_exchange(spark):
    df = joins_without_exchange(Roles(spark, "/root/testdata/sf0.001"))
    plan = plan_of(df)
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2 and plan.count("Bucketed: true") == 3
    assert df.count() > 0


def test_layout_keeps_the_rows_and_leaves_no_table(spark):
    before = len(spark.catalog.listTables())
    facts = spark.createDataFrame([(i % 7 if i % 5 else None, "x", i) for i in range(100)], "a bigint, b string, v int")
    back = lay_out_by_key(facts.repartition(5), ["a", "b"], "facts", buckets=3)
    assert rows(back) == rows(facts) and len(spark.catalog.listTables()) == before
    folder = back.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert len(glob.glob(f"{folder}/*.parquet")) <= 3                                    # one file a bucket
    assert rows(lay_out_by_key(facts.where("v < 0"), ["a"], "none", buckets=2)) == []


def test_counted_facts_are_those_of_the_rows(spark):
    t = Roles(spark, "/root/testdata/sf0.001")
    facts, people, listed = co_located(t)
    assert facts.select(F.sum("n_times")).first()[0] == t.study.care_rows().where("NOT remote").count()
    assert people.count() == t.study.patients.count() and listed.count() == t.demographic.select("client_id", "client_patient_id").distinct().count()
