"""Tail probabilities for one-row test results.

Spark has no incomplete gamma or beta function, so these are pandas UDFs. They
are applied to the finished statistics only, never to data rows.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Ship these helpers inside the UDF, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_EPS = 1e-15


def _lentz(b0: float, terms) -> float:
    """Continued fraction b0 + a1/(b1 + a2/(b2 + ...)) by the modified Lentz rule.

    NaN if the terms end before it settles.
    """
    tiny = 1e-300
    f = b0 or tiny
    c, d = f, 0.0
    for a, b in terms:
        d = b + a * d
        d = 1.0 / (d or tiny)
        c = b + a / c
        c = c or tiny
        step = c * d
        f *= step
        if abs(step - 1.0) < _EPS:
            return f
    return math.nan


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * _EPS:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    fraction = _lentz(x + 1 - a, ((-i * (i - a), x + 2 * i + 1 - a) for i in range(1, 10_000)))
    return front / fraction


def beta_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_reg(b, a, 1.0 - x)

    def terms():
        for m in range(10_000):
            if m:
                yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    return front / a / _lentz(1.0, terms())


def chi_square_tail(stat: float, df: float) -> float:
    return gamma_upper(df / 2.0, stat / 2.0)


def f_tail(stat: float, df1: float, df2: float) -> float:
    if stat <= 0:
        return 1.0
    return beta_reg(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * stat))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _rowwise(fn):
    def apply(*cols: pd.Series) -> pd.Series:
        def one(row):
            p = math.nan if any(pd.isna(v) for v in row) else fn(*(float(v) for v in row))
            return None if math.isnan(p) else p

        return pd.Series([one(r) for r in zip(*cols)], dtype="float64")

    return apply


@F.pandas_udf(DoubleType())
def p_chi_square(stat: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(chi_square_tail)(stat, df)


@F.pandas_udf(DoubleType())
def p_f(stat: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _rowwise(f_tail)(stat, df1, df2)


@F.pandas_udf(DoubleType())
def p_normal(z: pd.Series) -> pd.Series:
    return _rowwise(normal_two_sided)(z)
