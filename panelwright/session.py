"""Session settings for tests, the bench and stand-alone use."""

from __future__ import annotations

import tempfile
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "panelwright", cores: int | str = "*", **conf: str) -> SparkSession:
    """Local session with the settings the operators are written for.

    On a cluster the caller passes its own session; nothing here is required by the operators.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    settings.update(conf)
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="panelwright-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; on a cluster that would be another disk for every executor,
    so it is an error. The caller's context is left as it is.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if context.master == "local" or context.master.startswith("local["):
        return _own_folder()
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def ship_package(spark: SparkSession) -> str:
    """Give this package to the Python workers of a cluster that has it only on the driver; returns the archive's path."""
    root = Path(__file__).resolve().parent
    archive = Path(_own_folder()) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    return str(archive)
