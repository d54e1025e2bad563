"""Replayable pseudo-random integers from row keys.

A short integer mixing rule modulo the prime 2^31 - 1. It needs only BIGINT arithmetic, gives the same
draw on every retry of a task, and can be written in any SQL dialect (``draw_sql``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647
STEP_KEY, STEP_SALT, STEP_SEED, STEP_LAST = 48271, 40692, 16807, 69621


def _mix(key, salt, seed: int, mod):
    h0 = mod(key)
    h1 = mod(h0 * STEP_KEY + salt * STEP_SALT + (seed * STEP_SEED + 1))
    h2 = mod(h1 * h1 + h0 + salt)
    h3 = mod(h2 * STEP_LAST + 7)
    return mod(h3 * h3 + h1)


def draw_int(key: Column, salt: Column, seed: int) -> Column:
    """Integer in [0, PRIME) for a non-negative integer key and a salt (copy, replicate, ...)."""
    return _mix(key.cast("bigint"), salt.cast("bigint"), seed, lambda c: c % F.lit(PRIME).cast("bigint"))


def draw_uniform(key: Column, salt: Column, seed: int) -> Column:
    """Uniform in (0, 1)."""
    return (draw_int(key, salt, seed) + F.lit(0.5)) / F.lit(float(PRIME))


def string_key(*columns: Column) -> Column:
    """Non-negative integer key for text or composite identifiers."""
    return F.pmod(F.xxhash64(*columns), F.lit(PRIME).cast("bigint"))


class _Sql(str):
    def __mul__(self, other):
        return _Sql(f"({self} * {other})")

    def __add__(self, other):
        return _Sql(f"({self} + {other})")


def draw_sql(key: str, salt: str, seed: int) -> str:
    """The same draw as SQL text."""
    return str(_mix(_Sql(f"cast({key} as bigint)"), _Sql(f"cast({salt} as bigint)"), seed,
                    lambda c: _Sql(f"({c} % {PRIME})")))
