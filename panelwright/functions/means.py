"""Means, sums and spreads with an explicit rule for missing values.

``strict`` forms are NULL as soon as one input is missing; ``lenient`` forms skip missing inputs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_95 = 1.96


def strict(aggregate: Column, *inputs: Column) -> Column:
    """Keep ``aggregate`` only when none of ``inputs`` is missing in the group."""
    any_missing = inputs[0].isNull()
    for extra in inputs[1:]:
        any_missing = any_missing | extra.isNull()
    return F.when(F.count_if(any_missing) == 0, aggregate)


def strict_mean(x: Column) -> Column:
    return strict(F.avg(x), x)


def strict_sum(x: Column) -> Column:
    return strict(F.sum(x), x)


def weighted_mean(x: Column, weight: Column) -> Column:
    """Weighted mean, NULL if any value or weight in the group is missing."""
    return strict(F.try_divide(F.sum(x * weight), F.sum(weight)), x, weight)


def weighted_mean_lenient(x: Column, weight: Column) -> Column:
    """Weighted mean over rows with a value; only their weights enter the denominator."""
    return F.try_divide(F.sum(x * weight), F.sum(F.when(x.isNotNull(), weight)))


def percent_se(percent: Column, n: Column) -> Column:
    """Binomial standard error of a 0-100 percent; NULL outside that range or for n = 0."""
    variance = F.try_divide(percent * (100 - percent), n)
    return F.when(variance >= 0, F.sqrt(variance))


def weight_se(percent: Column, sum_sq_weight: Column) -> Column:
    """Standard error of a weighted percent from the sum of squared weights."""
    variance = sum_sq_weight * percent * (100 - percent)
    return F.when(variance >= 0, F.sqrt(variance))


def safe_log(x: Column) -> Column:
    return F.when(x > 0, F.log(x))
