"""Code dimension: diagnosis codes of two systems to causes and families."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright import constants as C
from panelwright.functions.codes import use_fallback

ATTRIBUTES = ("acause", "cause_name", "family", "family_name", "icd_name")


def build_code_dimension(icd_map: DataFrame, causelist: DataFrame) -> DataFrame:
    """De-duplicated map joined to the cause list, with risk factors under their own name and COVID-19 split out."""
    merged = causelist.join(icd_map.distinct(), "acause")
    risk_factor = F.col("family_name").contains("Risk factors")
    covid = F.col("icd_name").rlike(C.COVID_NAME_PATTERN)
    named = merged.withColumn("family_name", F.when(risk_factor, F.col("cause_name")).otherwise(F.col("family_name")))
    override = {"acause": C.COVID_CAUSE, "cause_name": C.COVID_NAME, "family_name": C.COVID_NAME}
    split_out = named.withColumns({c: F.when(covid, F.lit(v)).otherwise(F.col(c)) for c, v in override.items()})
    columns = [*ATTRIBUTES, "code_system", "icd_code"]
    return split_out.select(*columns).unionByName(empirical_covid_codes(icd_map).select(*columns))


def empirical_covid_codes(like: DataFrame) -> DataFrame:
    """Codes met in the data that the map lacks."""
    rows = [(C.COVID_CAUSE, C.COVID_NAME, "fam_ri", C.COVID_NAME, "found in data", "icd10", code)
            for code in C.COVID_EMPIRICAL_CODES]
    schema = ", ".join(f"{c} string" for c in (*ATTRIBUTES, "code_system", "icd_code"))
    return like.sparkSession.createDataFrame(rows, schema)


def resolve_systems(dimension: DataFrame, code: str, first: str = "icd10", second: str = "icd9",
                    garbage: str = C.GARBAGE_CAUSE, attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """One row per code with the winning system's attributes, and ``n_repeats``, the rows beyond one per system.

    The choice between the systems depends on the code alone, so it is made once in the dimension, by one aggregate,
    and facts need a single lookup. The winning row is taken whole.
    """
    row = F.struct(*attributes)

    def side(system: str):
        chosen = F.col("code_system") == system
        return F.min(F.when(chosen, row)), F.count_if(chosen)

    (a, n_a), (b, n_b) = side(first), side(second)
    both = dimension.groupBy(F.col("icd_code").alias(code)).agg(
        a.alias("a"), b.alias("b"), (F.greatest(n_a, F.lit(1)) + F.greatest(n_b, F.lit(1)) - 2).alias("n_repeats"))
    fallback = use_fallback(F.col("a")[attributes[0]], F.col("b")[attributes[0]], garbage)
    return both.select(code, "n_repeats", F.when(fallback, F.col("b")).otherwise(F.col("a")).alias("row")).select(
        code, "row.*", "n_repeats")


def family_codes(dimension: DataFrame, family: str) -> DataFrame:
    """Code subset of one family, as published for other users."""
    return dimension.where(F.col("family") == family)


def drop_header_rows(df: DataFrame, column: str, header: str) -> DataFrame:
    """Whole-row distinct without header lines that were loaded as data."""
    return df.distinct().where(F.col(column) != header)
