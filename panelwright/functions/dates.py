"""Visit dates arrive as text: ``yyyyMMdd``, ``yyyy-MM-dd`` or a bare year."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_visit_date(text: Column) -> Column:
    """Date from compact or dashed text; anything else, including a bare year, is NULL.

    Compact text is put into dashed form and cast: a cast is much cheaper than a formatter.
    """
    dashed = F.concat(F.substring(text, 1, 4), F.lit("-"), F.substring(text, 5, 2), F.lit("-"), F.substring(text, 7, 2))
    return F.when(F.length(text) == 8, dashed).when(F.length(text) == 10, text).try_cast("date")


def month_start(date: Column) -> Column:
    return F.trunc(date, "month")


def in_years(text: Column, years: Iterable[int]) -> Column:
    """Year prefix test on date text; true for bare years as well. Prefix tests reach the Parquet scan, a substring does not."""
    return reduce(or_, [text.startswith(str(y)) for y in years], F.lit(False))


def run_month(date: Column, anchor: dt.date) -> Column:
    """Whole months elapsed since ``anchor``."""
    months = (F.year(date) - anchor.year) * 12 + F.month(date) - anchor.month
    return (months - F.when(F.dayofmonth(date) < anchor.day, 1).otherwise(0)).cast("int")


def run_quarter(date: Column, first_year: int) -> Column:
    """Quarter counted from the first quarter of ``first_year``."""
    return (F.quarter(date) + (F.year(date) - first_year) * 4).cast("int")


def quarter_label(run_quarter_index: Column, first_year: int) -> Column:
    """``Q2 2019`` style label of a running quarter."""
    zero_based = run_quarter_index - 1
    return F.concat(
        F.lit("Q"), (F.pmod(zero_based, F.lit(4)) + 1).cast("string"), F.lit(" "),
        (F.floor(zero_based / 4) + first_year).cast("string"),
    )
