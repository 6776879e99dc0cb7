"""Tail probabilities: Column forms where a short series does, and exact ones for aggregated rows.

The pandas functions run on results of aggregations (one row per test), never on data rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Coefficients of the error-function approximation 7.1.26 of Abramowitz and Stegun.
_P = 0.3275911
_A = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, absolute error below 1e-7."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + F.lit(_P) * x)
    poly = F.lit(0.0)
    for a in reversed(_A):
        poly = (poly + a) * t
    tail = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)


def kolmogorov_sf(x: Column) -> Column:
    """Limit distribution of the scaled two-sided distance; below 0.2 it is 1 in double precision."""
    terms = F.sequence(F.lit(1), F.lit(100))
    s = F.aggregate(terms, F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(2.0 * s, F.lit(0.0)), F.lit(1.0)))


def ks_p_value(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic p-value of the two-sample distance."""
    size = n1.cast("double") * n2.cast("double") / (n1 + n2)
    return kolmogorov_sf(F.sqrt(size) * d)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 2000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_sf(x: float, a: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * front)
    b, c = x + 1.0 - a, 1e300
    d = 1.0 / b
    h = d
    for i in range(1, 5000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(x / 2.0, df / 2.0)


def f_sf(x: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / (d2 + d1 * x), d2 / 2.0, d1 / 2.0) if x > 0 else 1.0


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2.0, 0.5)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def beta_quantile(p: float, a: float, b: float) -> float:
    """Inverse of beta_cdf by bisection."""
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if beta_cdf(mid, a, b) < p else (lo, mid)
    return (lo + hi) / 2.0


def _rowwise(fn, *cols: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(v) for v in row) else fn(*row) for row in zip(*cols)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(chi2_sf, x, df)


@F.pandas_udf(T.DoubleType())
def f_p(x: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _rowwise(f_sf, x, d1, d2)


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return _rowwise(normal_two_sided, z)


@F.pandas_udf(T.DoubleType())
def binomial_low(k: pd.Series, n: pd.Series, level: pd.Series) -> pd.Series:
    """Lower exact confidence bound of a proportion."""
    return _rowwise(lambda a, b, c: 0.0 if a == 0 else beta_quantile((1 - c) / 2, a, b - a + 1), k, n, level)


@F.pandas_udf(T.DoubleType())
def binomial_high(k: pd.Series, n: pd.Series, level: pd.Series) -> pd.Series:
    """Upper exact confidence bound of a proportion."""
    return _rowwise(lambda a, b, c: 1.0 if a == b else beta_quantile((1 + c) / 2, a + 1, b - a), k, n, level)
