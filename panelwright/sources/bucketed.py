"""Tables laid out by key, so that later joins and groupings on it need no exchange."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from panelwright.sources.writers import fresh_path


def lay_out_by_key(df: DataFrame, keys: Sequence[str], label: str, buckets: int | None = None) -> DataFrame:
    """Write ``df`` in sorted buckets of ``keys`` to the shared folder and read it back as a bucketed scan.

    Rows are dealt to the buckets before they are written, so a bucket is one file and not one for every task. Tables of one
    layout (same keys in the same order, same types and number of buckets) join bucket by bucket. All rows of a key share a
    bucket, so facts should be reduced to the grain of later steps first, as a hot key then counts by its groups and not by its rows.
    ``buckets`` should keep a bucket within a task's memory; unset, it is the session's number of shuffle partitions.
    The catalogue entry is dropped at once: the returned frame holds the layout, and the files stay with the folder's owner.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{label}_{uuid.uuid4().hex}"
    dealt = df.repartition(n, *keys)
    dealt.write.bucketBy(n, *keys).sortBy(*keys).option("path", fresh_path(spark, label)).format("parquet").saveAsTable(table)
    laid_out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return laid_out
