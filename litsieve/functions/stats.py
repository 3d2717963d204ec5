"""Distribution functions for a few rows (after aggregation)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_sf2(z: float) -> float:
    """Two-sided tail of the normal distribution."""
    return math.erfc(abs(z) / math.sqrt(2))


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function: series below a + 1, continued fraction (Lentz) above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - scale * total)
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def chi2_sf(q: float, df: float) -> float:
    return gamma_q(df / 2, q / 2) if df > 0 else 1.0


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 10_000):
        for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + an * d) or tiny)
            c = (1 + an / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's distribution."""
    return beta_i(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def _udf(f):
    def column(*cols: Column) -> Column:
        @F.pandas_udf(T.DoubleType())
        def run(*xs: pd.Series) -> pd.Series:
            return pd.Series([f(*v) if all(x is not None and not math.isnan(x) for x in v) else None for v in zip(*xs)], dtype="float64")

        return run(*cols)

    return column


normal_p, chi2_p, t_p = _udf(normal_sf2), _udf(chi2_sf), _udf(t_sf2)
