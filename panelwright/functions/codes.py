"""Diagnosis and modifier codes."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_code(code: Column) -> Column:
    """Upper case, without dots and blanks."""
    return F.upper(F.translate(code, ". ", ""))


def is_missing_code(code: Column, redacted: str = "[REDACTED]") -> Column:
    return code.isNull() | (code == redacted)


def is_member(value: Column, members: Iterable) -> Column:
    """Set membership that is false, never NULL, for a missing value."""
    return F.coalesce(value.isin(list(members)), F.lit(False))


def any_code(columns: Iterable[Column], codes: Iterable[str]) -> Column:
    """True when any of the columns holds any of the codes."""
    codes = list(codes)
    return reduce(or_, [is_member(c, codes) for c in columns])


def is_remote(modifiers: Iterable[Column], codes: Iterable[str],
              place: Column | None = None, place_code: str = "2") -> Column:
    """Remote-visit flag: by modifier, and by place of service too when ``place`` is given."""
    flag = any_code(modifiers, codes)
    return flag if place is None else flag | is_member(place, [place_code])


def use_fallback(first: Column, second: Column, garbage: str) -> Column:
    """Whether the second code system wins: first missing, or first garbage while second is informative."""
    return F.coalesce(
        (first.isNull() & second.isNotNull()) | ((first == garbage) & (second != garbage)), F.lit(False)
    )
