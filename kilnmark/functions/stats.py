"""Statistics that neither engine has built in: Student's t distribution, grouped quantile tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz), to about 1e-12."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    f = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def t_p_value(t: float, df: float) -> float:
    """Two-sided p of Student's t; NaN without degrees of freedom."""
    if not df > 0 or t != t:
        return math.nan
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_of_r(r: Column, n: Column) -> Column:
    """t statistic of a correlation; null for fewer than 3 pairs or a perfect one."""
    return F.when((n > 2) & (F.abs(r) < 1), r * F.sqrt((n - 2) / (1 - r * r)))


@F.pandas_udf(T.DoubleType())
def p_values(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_p_value(a, b) for a, b in zip(t.astype(float), df.astype(float), strict=True)])
