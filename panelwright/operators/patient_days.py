"""Patient-day weighting and cause shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright import constants as C
from panelwright.functions.codes import is_member
from panelwright.functions.recode import recode
from panelwright.operators.skew import attach_group_stats, broadcast_if_small


def weight_rows(df: DataFrame, keys: Sequence[str], missing: Column, output: str = "weight") -> DataFrame:
    """Split weight 1 of each patient-day over its rows.

    Rows without a diagnosis are dropped when the day has any diagnosis, and share the weight when it has none.
    """
    stats = {"_n": F.count(F.lit(1)), "_ok": F.count_if(~missing)}
    counted = attach_group_stats(df, keys, stats)
    kept = counted.where(~missing | (F.col("_ok") == 0))
    weight = F.lit(1.0) / F.when(F.col("_ok") > 0, F.col("_ok")).otherwise(F.col("_n"))
    return kept.withColumn(output, weight).drop("_n", "_ok")


def weight_codes(df: DataFrame, keys: Sequence[str], code: str, missing: Column,
                 output: str = "weight", whole: str | None = None, times: str | None = None) -> DataFrame:
    """The same weights at (patient-day, code) grain.

    Rows are counted per code first, with map-side partial counts, so the window below sees at most one row per
    distinct code of a patient-day however many rows that day holds. ``whole`` names a column for the denominator: the
    weight is n_rows / whole. ``times`` names the number of rows that a row of ``df`` stands for, if it was counted before.
    """
    counted = (
        df.select(*keys, F.when(~missing, F.col(code)).alias(code), F.col(times) if times else F.lit(1).alias("_times"))
        .groupBy(*keys, code)
        .agg((F.sum(times) if times else F.count(F.lit(1))).alias("n_rows"))
    )
    known = F.sum(F.when(F.col(code).isNotNull(), F.col("n_rows"))).over(Window.partitionBy(*keys))
    total = counted.withColumn("_ok", known)
    kept = total.where(F.col(code).isNotNull() | F.col("_ok").isNull())
    parts = F.coalesce("_ok", "n_rows")
    kept = kept.withColumn(output, F.col("n_rows") / parts)
    return (kept.withColumn(whole, parts) if whole else kept).drop("_ok")


def exact_weights(df: DataFrame, keys: Sequence[str], parts: str, whole: str, output: str = "units") -> DataFrame:
    """Sum of parts / whole per key, the same in whatever order rows arrive.

    Numerators are whole numbers and are added up by denominator; each denominator is divided once, to 18 places, and the
    quotients are added as decimals. So a sum that is a short decimal number comes out as just that number.
    """
    by_whole = df.groupBy(*keys, whole).agg(F.sum(parts).alias("_n"))
    quotient = F.col("_n").cast("decimal(20,0)") / F.col(whole).cast("decimal(20,0)")
    return by_whole.groupBy(*keys).agg(F.sum(quotient.cast("decimal(38,18)")).alias(output))


def cause_share(df: DataFrame, keys: Sequence[str], cause: str, weight: str = "weight",
                unmapped: str = C.UNMAPPED) -> DataFrame:
    """Weight by cause within keys (period, care type) and its share there; a missing cause is a category of its own.

    Decimal weights are added up exactly, and divided once.
    """
    total = df.groupBy(*keys, F.coalesce(F.col(cause), F.lit(unmapped)).alias(cause)).agg(F.sum(weight).alias("_w"))
    within = F.sum("_w").over(Window.partitionBy(*keys)).cast("double")
    return total.withColumns({"weight": F.col("_w").cast("double"), "prop": F.try_divide(F.col("_w").cast("double"), within)}).drop("_w")


def order_categories(df: DataFrame, category: str, ordered: Sequence[str], output: str = "ord") -> DataFrame:
    """Position of a category in a fixed list; a category outside the list becomes NULL."""
    spark = df.sparkSession
    levels = spark.createDataFrame([(v, i) for i, v in enumerate(ordered, 1)], f"{category} string, {output} int")
    joined = df.join(F.broadcast(levels), category, "left")
    return joined.withColumn(category, F.when(F.col(output).isNotNull(), F.col(category)))


def regroup_causes(df: DataFrame, keys: Sequence[str], cause: str, mapping: Mapping[str, str],
                   measures: Sequence[str]) -> DataFrame:
    """Merge categories and add their measures up again."""
    merged = df.withColumn(cause, recode(F.col(cause), mapping, F.col(cause)))
    return merged.groupBy(*keys, cause).agg(*[F.sum(m).alias(m) for m in measures])


def select_versus_other(df: DataFrame, keys: Sequence[str], cause: str, selected: Sequence[str],
                        weight: str = "weight") -> DataFrame:
    """Total, selected part and remainder per key in one aggregate; keys without a selected row drop out."""
    chosen = is_member(F.col(cause), selected)
    out = df.groupBy(*keys).agg(
        F.sum(weight).alias("total"), F.sum(F.when(chosen, F.col(weight))).alias("sub"),
        F.count_if(chosen).alias("_n"),
    )
    parts = {"total": F.col("total"), "sub": F.col("sub"), "other": F.col("total") - F.col("sub")}
    return out.where("_n > 0").select(*keys, *[c.cast("double").alias(name) for name, c in parts.items()])


def map_codes(df: DataFrame, code: str, resolved: DataFrame) -> DataFrame:
    """Attach the resolved cause of each code; unknown codes keep NULL causes. Fails on a code listed twice."""
    checked = broadcast_if_small(resolved, reject=F.col("n_repeats") > 0)
    return df.join(checked, code, "left").drop("n_repeats")
