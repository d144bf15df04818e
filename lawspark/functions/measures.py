"""The statistics of a law: violations, Wilson's interval, description length."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a unit of complexity costs in bits, and the slack of comparisons with a tolerance.
FORM_COST, SLACK, SMALLEST, EXACT = 0.15, 1e-15, 1e-9, 1e-12
# End of fixed values.


def z_for_alpha(alpha: float) -> float:
    return NormalDist().inv_cdf(1 - min(max(alpha, 1e-12), 1 - 1e-12) / 2)


def wilson(k: int, n: int, z: float | None = None) -> tuple[float, float, float]:
    """(low, high, rate) of Wilson's score interval; zeros without points."""
    if not n:
        return 0.0, 0.0, 0.0
    z2 = (z_for_alpha(0.05) if z is None else z) ** 2
    rate = k / n
    middle = rate + z2 / (2 * n)
    half = math.sqrt(z2) * math.sqrt(rate * (1 - rate) / n + z2 / (4 * n * n))
    return max(0.0, (middle - half) / (1 + z2 / n)), min(1.0, (middle + half) / (1 + z2 / n)), rate


def wilson_columns(k: Column, n: Column, z: float) -> tuple[Column, Column]:
    """Low and high end of Wilson's interval as Columns; zero without points."""
    n_, z2 = F.nullif(n, F.lit(0)).cast("double"), z * z
    rate = k / n_
    middle, half = rate + z2 / (2 * n_), z * F.sqrt(rate * (1 - rate) / n_ + z2 / (4 * n_ * n_))
    low, high = (middle - half) / (1 + z2 / n_), (middle + half) / (1 + z2 / n_)
    return F.coalesce(F.greatest(F.lit(0.0), low), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), high), F.lit(0.0))


def description_gain(complexity: int, eps: float, median: float | None) -> float:
    """Half the bits that the band and the typical residual save, less the cost of the form. median None: no residuals."""
    bits = [-math.log2(min(1.0, max(SMALLEST, x))) for x in (eps, eps if median is None else median)]
    return sum(bits) / 2 - FORM_COST * complexity


def gain_column(complexity: Column, eps: float, median: Column) -> Column:
    def bits(x):
        return -F.log2(F.least(F.lit(1.0), F.greatest(F.lit(SMALLEST), x)))

    return (bits(F.lit(eps)) + bits(median)) / 2 - complexity * FORM_COST


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def violation(op: str, rho: Column, scale: Column) -> Column:
    """How far a point is on the wrong side, relative to its scale; both sides count for what isn't a bound."""
    r = F.when(scale == 0, F.lit(0.0)).otherwise(F.try_divide(rho, scale))
    return F.greatest(F.lit(0.0), r) if op == "<=" else F.greatest(F.lit(0.0), -r) if op == ">=" else F.abs(r)
