"""Tail probabilities as column expressions, by the regularised incomplete gamma function."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL_975 = 1.959963984540054
# Terms of the series and of the continued fraction: enough for shapes of some hundreds.
TERMS = 400
# Coefficients of Stirling's series for the logarithm of the gamma function.
STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188]
SHIFT = 10
TINY = 1e-300


def log_gamma(a: Column) -> Column:
    """Logarithm of the gamma function of a positive number, by Stirling's series ten further on."""
    shifted = a + SHIFT
    series = F.lit(0.0)
    for k, c in enumerate(STIRLING):
        series = series + F.lit(c) * F.pow(shifted, F.lit(-(2.0 * k + 1)))
    below = F.lit(1.0)
    for k in range(SHIFT):
        below = below * (a + k)
    half_log_two_pi = 0.5 * math.log(2 * math.pi)
    return (shifted - 0.5) * F.log(shifted) - shifted + half_log_two_pi + series - F.log(below)


def gamma_upper(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, x) for positive ``a``; 1 for x <= 0.

    Below ``a + 1`` it is one less the power series of the lower function, beyond it Lentz's form
    of the continued fraction, whose value keeps its relative accuracy far out in the tail.
    """
    steps = F.sequence(F.lit(1), F.lit(TERMS))
    front = F.exp(a * F.log(x) - x - log_gamma(a))

    def next_term(acc: Column, n: Column) -> Column:
        term = acc["term"] * x / (a + n)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    first = F.struct((1 / a).alias("term"), (1 / a).alias("total"))
    lower = F.aggregate(steps, first, next_term)["total"] * front

    def apart_from_zero(v: Column) -> Column:
        return F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)

    def next_fraction(acc: Column, n: Column) -> Column:
        an = n * (a - n)
        b = acc["b"] + 2
        d = 1 / apart_from_zero(an * acc["d"] + b)
        c = apart_from_zero(b + an / acc["c"])
        return F.struct(
            b.alias("b"), c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h")
        )

    b0 = x + 1 - a
    start = F.struct(
        b0.alias("b"), F.lit(1 / TINY).alias("c"), (1 / b0).alias("d"), (1 / b0).alias("h")
    )
    upper = F.aggregate(steps, start, next_fraction)["h"] * front
    return F.when(x <= 0, F.lit(1.0)).when(x < a + 1, 1 - lower).otherwise(upper)


def normal_two_sided_p(z: Column | str) -> Column:
    """Two-sided normal p-value of a z statistic; NULL of NULL."""
    z = F.col(z) if isinstance(z, str) else z
    return gamma_upper(F.lit(0.5), z * z / 2)


def chi_square_upper_p(x: Column, df: Column) -> Column:
    """P(X > x) of a chi-square variable."""
    return gamma_upper(df / F.lit(2.0), x / 2)
