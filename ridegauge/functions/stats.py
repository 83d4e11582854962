"""Small guarded statistics used across operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def safe_ratio(num: Column, den: Column, minimum: float = 0.0) -> Column:
    """Null when either side is null or the denominator is not above ``minimum`` in size."""
    return F.when(F.abs(den) > minimum, num.cast("double") / den.cast("double"))


def clip0(c: Column) -> Column:
    """Floor at zero; null stays null."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def robust_cv(mean: Column, std: Column, minimum: float = 1.0, cap: float = 10.0) -> Column:
    return F.when(mean >= minimum, F.least(std / mean, F.lit(cap)))


def unbiased_skew(population_skew: Column, n: Column) -> Column:
    """Sample-size corrected skewness from the population one."""
    n = n.cast("double")
    return F.when(n > 2, population_skew * F.sqrt(n * (n - 1)) / (n - 2))


def unbiased_kurtosis(population_excess: Column, n: Column) -> Column:
    n = n.cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * population_excess + 6))


def winkler(actual: Column, lower: Column, upper: Column, alpha: float) -> Column:
    width = upper - lower
    return (
        F.when(actual < lower, width + (lower - actual) * (2.0 / alpha))
        .when(actual > upper, width + (actual - upper) * (2.0 / alpha))
        .otherwise(width)
    )


def order_bounds(lower: Column, point: Column, upper: Column) -> tuple[Column, Column]:
    """Lower bound at least zero; upper bound at least the point and the lower bound."""
    low = clip0(lower)
    return low, F.when(upper.isNotNull(), F.greatest(point, upper, low))


# Standard normal quantiles of the central 80% and 95% intervals.
Z_VALUE = {0.80: 1.2815515655446004, 0.95: 1.959963984540054}


def gaussian_bounds(mean: Column, scale: Column, level: float = 0.80) -> tuple[Column, Column]:
    z = Z_VALUE[level]
    return clip0(mean - scale * z), mean + scale * z
