"""Order statistics and losses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_rank(values: Column, q: Column | float) -> Column:
    """The ceil(q*n)-th smallest of an array, first or last where that runs over; null for an empty one."""
    q = F.lit(float(q)) if isinstance(q, int | float) else q
    n = F.size(values)
    at = F.least(F.greatest(F.ceil(q * n).cast("int"), F.lit(1)), n)
    return F.when(n > 0, F.element_at(F.array_sort(values), F.greatest(at, F.lit(1))))


def low_rank(values: Column, share: float) -> Column:
    """The element at floor((n-1)*share) from 0 of the sorted array: the rule for peaks."""
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), (F.floor((F.size(values) - 1) * F.lit(share)) + 1).cast("int")))


def pinball(actual: Column, upper: Column, q: Column | float) -> Column:
    """Quantile loss."""
    q = F.lit(float(q)) if isinstance(q, int | float) else q
    return F.greatest(q * (actual - upper), (q - 1) * (actual - upper))


def ratio_or_zero(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or the quotient is not finite."""
    quotient = F.try_divide(a, b)
    return F.when(quotient.isNull() | F.isnan(quotient) | (F.abs(quotient) == float("inf")), F.lit(0.0)).otherwise(quotient)
