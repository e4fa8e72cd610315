"""Numeric column expressions that stay inside generated JVM code."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation of the normal distribution in the
# published double-precision form (West, 2005).
_HART_NUMERATOR = (
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
_HART_DENOMINATOR = (
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
_HART_SWITCH = 7.07106781186547
_SQRT_TWO_PI = 2.506628274631
_INV_SQRT_TWO_PI = 1.0 / math.sqrt(2.0 * math.pi)


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_finite(value: Column | str) -> Column:
    """True for numbers that are neither NaN nor infinite; NULL stays NULL."""
    x = col(value)
    return (~F.isnan(x)) & (F.abs(x) < F.lit(float("inf")))


def not_finite(value: Column | str) -> Column:
    """True for NULL, NaN and the infinities; never NULL itself."""
    return ~F.coalesce(is_finite(value), F.lit(False))


def safe_ln(value: Column | str) -> Column:
    """Logarithm with IEEE edges: ln(0) = -inf, ln(negative) = NaN, NULL stays NULL."""
    x = col(value)
    return (
        F.when(x > 0.0, F.ln(x))
        .when(x == 0.0, F.lit(float("-inf")))
        .when(x.isNotNull(), F.lit(float("nan")))
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL instead of an ANSI error when the divisor is zero."""
    return F.try_divide(numerator, denominator)


def _horner(x: Column, coefficients: Sequence[float]) -> Column:
    value = F.lit(coefficients[0])
    for coefficient in coefficients[1:]:
        value = value * x + F.lit(coefficient)
    return value


def normal_tail(value: Column | str) -> Column:
    """P(Z > |x|) for a standard normal Z, accurate to about 1e-15."""
    a = F.abs(col(value))
    bell = F.exp(-a * a / 2.0)
    middle = bell * _horner(a, _HART_NUMERATOR) / _horner(a, _HART_DENOMINATOR)
    fraction = a + 0.65
    for step in (4.0, 3.0, 2.0, 1.0):
        fraction = a + F.lit(step) / fraction
    return (
        F.when(a > 37.0, F.lit(0.0))
        .when(a < _HART_SWITCH, middle)
        .otherwise(bell / fraction / _SQRT_TWO_PI)
    )


def cdf_from_tail(value: Column | str, tail: Column | str) -> Column:
    """Distribution function of x given normal_tail(x), kept in a column of its own so that
    cdf(x) and cdf(-x) share it."""
    x, t = col(value), col(tail)
    return F.when(x > 0.0, 1.0 - t).otherwise(t)


def norm_cdf(value: Column | str) -> Column:
    """Standard normal distribution function; NaN stays NaN."""
    x = col(value)
    return F.when(F.isnan(x), x).otherwise(cdf_from_tail(x, normal_tail(x)))


def norm_pdf(value: Column | str) -> Column:
    x = col(value)
    return F.exp(-x * x / 2.0) * _INV_SQRT_TWO_PI


def qlike(actual: Column, predicted: Column, floor: float) -> Column:
    """Per-cell quasi-likelihood loss r - ln r - 1 on floored variances."""
    r = F.greatest(actual, F.lit(floor)) / F.greatest(predicted, F.lit(floor))
    return r - F.ln(r) - 1.0


def total_variance_to_iv(variance: Column, tau_years: Column, floor: float = 0.0) -> Column:
    """Implied volatility of a total variance; bad variances raise at run time."""
    checked = F.when(
        not_finite(variance) | (variance < 0.0),
        F.raise_error("total variance must be finite and non-negative").cast("double"),
    ).otherwise(variance)
    return F.sqrt(
        F.greatest(checked, F.lit(float(floor))) / F.greatest(tau_years, F.lit(1.0e-12))
    )


def log_positive(values: Column) -> Column:
    """Element-wise log of an array of strictly positive numbers."""
    return F.transform(
        values,
        lambda v: F.when(
            not_finite(v) | (v <= 0.0),
            F.raise_error("log target must be finite and positive").cast("double"),
        ).otherwise(F.ln(v)),
    )


def exp_back(values: Column) -> Column:
    return F.transform(values, F.exp)


def doubles(values: Sequence[float]) -> Column:
    """Literal array of doubles."""
    return F.array(*[F.lit(float(v)) for v in values])


def count_at_or_below(value: Column, edges: Sequence[float]) -> Column:
    """How many of a few fixed edges are <= value, as an unrolled sum."""
    total = F.lit(0)
    for edge in edges:
        total = total + F.when(value >= F.lit(float(edge)), 1).otherwise(0)
    return total


def nearest_rank(n: Column, q: float) -> Column:
    """1-based rank of the nearest-rank quantile among n ascending values."""
    return F.floor(F.lit(q) * (n - 1) + 0.5).cast("long") + 1
