"""Column expressions for ratios and repairs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double; 0 where it is undefined or not finite."""
    return repair(F.try_divide(numerator.cast("double"), denominator.cast("double")))


def repair(value: Column) -> Column:
    """Null, NaN and infinite values become 0."""
    value = value.cast("double")
    finite = ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.when(finite, value).otherwise(F.lit(0.0))


def log_ratio(a: Column, b: Column) -> Column:
    """``log(1 + a) / log(1 + b)``; 0 where undefined."""
    return safe_ratio(F.log1p(a), F.log1p(b))
