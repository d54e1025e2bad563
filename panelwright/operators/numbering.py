"""Dense integer ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.skew import broadcast_if_small
from panelwright.sources.writers import settle


def dense_ids(df: DataFrame, key: str, output: str) -> DataFrame:
    """(key, id) with ids 1..n in key order.

    Ids are range-partitioned and written out, so that the partition an id sits in is settled; each partition is
    numbered on its own and shifted by the sizes of the partitions before it (one small row per partition).
    """
    ids = df.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(key)
    ranged = settle(ids.withColumn("_part", F.spark_partition_id()), "ids")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_m"))
    shifts = sizes.select("_part", (F.sum("_m").over(Window.orderBy("_part")) - F.col("_m")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return (
        ranged.withColumn("_local", local)
        .join(F.broadcast(shifts), "_part")
        .select(key, (F.col("_before") + F.col("_local")).cast("bigint").alias(output))
    )


def with_dense_id(df: DataFrame, key: str, output: str) -> DataFrame:
    return df.join(broadcast_if_small(dense_ids(df, key, output)), key, "left")
