"""Exact quantiles by group, without gathering a group in one task.

``percentile`` keeps every distinct value of a group in one buffer. Here equal values are counted first, values
are cut into slices at approximate quantiles of the whole column, running slice counts tell which slice holds each
wanted rank, and only those slices are ordered. There are as many slices as keep each at about ``slice_rows`` distinct values,
whatever the size of the column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.recode import bin_right_closed
from panelwright.sources.writers import settle

SLICE_ROWS = 100_000


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Quantiles with linear interpolation between order statistics: rows (keys, prob, q)."""
    keys = list(keys)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("x"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    counted = settle(counted, "counts")
    slices = -(-counted.count() // slice_rows)
    cuts = counted.approxQuantile("x", [i / slices for i in range(1, slices)], 1 / (4 * slices)) if slices > 1 else []
    splits = [float("-inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    sliced = Bucketizer(splits=splits, inputCol="x", outputCol="slice").transform(counted)

    by_key = Window.partitionBy(*keys)
    sizes = (
        sliced.groupBy(*keys, "slice").agg(F.sum("c").alias("m"))
        .withColumn("upto", F.sum("m").over(by_key.orderBy("slice")))
        .withColumn("before", F.col("upto") - F.col("m"))
        .withColumn("n", F.sum("m").over(by_key))
    )
    position = (F.col("n") - 1) * F.col("prob")
    low = F.floor(position + F.lit(1e-9))
    wanted = (
        sizes.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("rank", F.least(low + F.col("part"), F.col("n") - 1))
        .withColumn("fraction", F.greatest(position - low, F.lit(0.0)))
        .where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto")))
        .select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("slice").alias("_slice"), "before", "prob", "part",
                "rank", "fraction")
    )
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("slice") == F.col("_slice")])
    needed = wanted.select(*[f"_{k}" for k in keys], "_slice").distinct()
    in_slice = Window.partitionBy(*keys, "slice").orderBy("x")
    ordered = sliced.join(needed, on, "left_semi").withColumn("seen", F.sum("c").over(in_slice))
    upper = F.col("before") + F.col("seen")
    picked = ordered.join(wanted, on & (F.col("rank") >= upper - F.col("c")) & (F.col("rank") < upper))
    ends = picked.groupBy(*keys, "prob").agg(
        F.max(F.when(F.col("part") == 0, F.col("x"))).alias("lo"),
        F.max(F.when(F.col("part") == 1, F.col("x"))).alias("hi"),
        F.max("fraction").alias("fraction"),
    )
    return ends.select(*keys, "prob", (F.col("lo") + F.col("fraction") * (F.col("hi") - F.col("lo"))).alias("q"))


def group_quantiles_wide(df: DataFrame, keys: Sequence[str], value: str, named: dict[str, float]) -> DataFrame:
    """The same, one column per named probability."""
    long = group_quantiles(df, keys, value, sorted(set(named.values())))
    at = [F.max(F.when(F.abs(F.col("prob") - p) < 1e-12, F.col("q"))).alias(name) for name, p in named.items()]
    return long.groupBy(*keys).agg(*at)


def quantile_bins(df: DataFrame, value: str, bins: int, output: str) -> DataFrame:
    """Right-closed bins between sample quantiles of all rows, the minimum in bin 1.

    The ``bins`` + 1 break points travel as one scalar subquery, so binning needs no join and no global window.
    """
    breaks = group_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, [i / bins for i in range(bins + 1)])
    ordered = breaks.agg(F.array_sort(F.collect_list(F.struct("prob", "q"))).alias("b"))
    edges = ordered.select(F.col("b.q")).scalar()
    at = [F.element_at("_edges", i + 1) for i in range(bins + 1)]
    return df.withColumn("_edges", edges).withColumn(output, bin_right_closed(F.col(value), at)).drop("_edges")
