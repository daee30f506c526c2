"""Upper tails of the normal, chi-square, Student t and F distributions: numpy on whole columns, as pandas functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_EPS, _TINY, _ROUNDS = 1e-16, 1e-300, 500
_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def normal_sf(z):
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2))


def _gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: the series below a + 1, the continued fraction above."""
    if not (x == x and a == a):
        return math.nan
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a)) if x < 1e6 else 0.0
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, _ROUNDS * 4):
            term *= x / (a + n)
            total += term
            if term < total * _EPS:
                break
        return 1 - front * total
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for n in range(1, _ROUNDS * 4):
        an = -n * (n - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        step = c * d
        h *= step
        if abs(step - 1) < _EPS * 10:
            break
    return front * h


def _beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if not (x == x):
        return math.nan
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or _TINY)
    h = d
    for m in range(1, _ROUNDS * 4):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or _TINY)
            c = 1 + num / c or _TINY
            h *= c * d
        if abs(c * d - 1) < _EPS * 10:
            break
    return front * h


def chi2_sf(x: float, k: float) -> float:
    return _gamma_q(k / 2, x / 2)


def t_two_sided(t: float, df: float) -> float:
    return math.nan if t != t else _beta_i(df / 2, 0.5, df / (df + t * t))


def f_sf(x: float, d1: float, d2: float) -> float:
    return math.nan if x != x else 1.0 if x <= 0 else _beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def _each(f, *cols: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in zip(*cols, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, k: pd.Series) -> pd.Series:
    return _each(chi2_sf, x, k)


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def f_p(x: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _each(f_sf, x, d1, d2)


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided."""
    return pd.Series(2 * normal_sf(np.abs(z.to_numpy(float))))
