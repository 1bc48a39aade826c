"""The normal distribution as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published rational approximation of the normal quantile.
CENTRAL_TOP = (2.50662823884, -18.61500062529, 41.39119773534, -25.44106049637)
CENTRAL_BOTTOM = (-8.47351093090, 23.08336743743, -21.06224101826, 3.13082909833)
TAIL_TOP = (2.515517, 0.802853, 0.010328)
TAIL_BOTTOM = (1.432788, 0.189269, 0.001308)
# The published approximation of erf with an error below 1.5e-7.
ERF_P, ERF = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def quantile(p: Column) -> Column:
    """Inverse normal distribution function, p kept within 1e-8 of 0 and 1."""
    p = F.least(F.greatest(p, F.lit(1e-8)), F.lit(1 - 1e-8))
    y = p - 0.5
    r = y * y
    central = y * horner(r, CENTRAL_TOP) / (horner(r, CENTRAL_BOTTOM) * r + 1.0)
    t = F.sqrt(-2.0 * F.log(F.when(y > 0, 1.0 - p).otherwise(p)))
    tail = t - horner(t, TAIL_TOP) / (horner(t, TAIL_BOTTOM) * t + 1.0)
    return F.when(F.abs(y) < 0.42, central).otherwise(F.when(y < 0, -tail).otherwise(tail))


def cdf(x: Column) -> Column:
    """Normal distribution function by the polynomial approximation of erf."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + ERF_P * z)
    erf = 1.0 - horner(t, ERF) * t * F.exp(-z * z)
    return F.when(x < 0, 0.5 * (1.0 - erf)).otherwise(0.5 * (1.0 + erf))
