"""Registered queries: a Spark function and, where SQL can state it, the check text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType

from panelwright.plans.role_sql import with_roles
from panelwright.plans.roles import Roles


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Roles], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(self.build(Roles(spark, sf_dir)))


QUERIES: dict[str, Query] = {}


def query(name: str, *covers: str, sql: str | None = None):
    """Register a function of ``Roles``; ``covers`` lists the inventory rows it shows."""
    def register(build: Callable[[Roles], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, covers, build, with_roles(sql) if sql else None)
        return build
    return register


def present(df: DataFrame) -> DataFrame:
    """Output form shared with the check text: six places, no negative zero, dates as text."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DoubleType | FloatType):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, DateType):
            c = c.cast("string")
        columns.append(c.alias(f.name))
    return df.select(*columns)
