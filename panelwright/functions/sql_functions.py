"""The study's functions for use from SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Means with a stated rule for missing values, from sums that the caller's aggregate gives. ``strict_mean``: NULL if any value
#: is missing; ``lenient_mean``: over the known ones; the weighted forms take the weights of all and of the known values.
MEANS = {
    "strict_mean(total DOUBLE, n_known BIGINT, n BIGINT)": "CASE WHEN n_known = n THEN try_divide(total, CAST(n AS DOUBLE)) END",
    "lenient_mean(total DOUBLE, n_known BIGINT)": "try_divide(total, CAST(n_known AS DOUBLE))",
    "strict_weighted_mean(total DOUBLE, weight DOUBLE, n_missing BIGINT)": "CASE WHEN n_missing = 0 THEN try_divide(total, weight) END",
    "lenient_weighted_mean(total DOUBLE, known_weight DOUBLE)": "try_divide(total, known_weight)",
}


def register_means(spark: SparkSession) -> None:
    for signature, body in MEANS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS DOUBLE RETURN {body}")


def register_cause_days(spark: SparkSession, name: str, weights: DataFrame, view: str) -> None:
    """Table function ``name(day DATE)``: patient-days and share of every cause family in one month.

    ``weights``: (plot_date, family_name, units), exact; it is put under the view name ``view``, on which the function depends.
    With a column as its argument (LATERAL) all months are one job, joined on the month.
    """
    weights.select("plot_date", "family_name", "units").createOrReplaceTempView(view)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(day DATE) RETURNS TABLE (family_name STRING, weight DOUBLE, prop DOUBLE) RETURN
        SELECT w.family_name, CAST(w.units AS DOUBLE), try_divide(CAST(w.units AS DOUBLE), CAST(t.units AS DOUBLE))
        FROM {view} w JOIN (SELECT plot_date, sum(units) AS units FROM {view} GROUP BY plot_date) t ON t.plot_date = w.plot_date
        WHERE w.plot_date = trunc({name}.day, 'MM')""")
