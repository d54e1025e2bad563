"""Pooling of estimates over imputed copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.means import Z_95


def pool(df: DataFrame, keys: Sequence[str], estimate: str, se: str, m: int) -> DataFrame:
    """Mean estimate with within- and between-copy variance and a 95 % interval.

    NULL unless all ``m`` copies contribute. Long form replaces one column per copy.
    """
    complete = (F.count(estimate) == m) & (F.count(se) == m)
    out = df.groupBy(*keys).agg(
        F.when(complete, F.avg(estimate)).alias("est_adj"),
        F.when(complete, F.var_samp(estimate)).alias("v_b"),
        F.when(complete, F.avg(F.col(se) * F.col(se))).alias("v_w"),
    )
    total = F.col("v_w") + F.col("v_b") + F.col("v_b") / m
    half = Z_95 * F.col("se_pooled")
    return (
        out.withColumn("v_total", total)
        .withColumn("se_pooled", F.sqrt("v_total"))
        .withColumns({"lci": F.col("est_adj") - half, "uci": F.col("est_adj") + half})
    )
