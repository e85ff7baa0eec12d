"""p-values of aggregated test statistics. They run on one row per group, after all data was aggregated."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    total = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 / (1.0 + term * d or tiny)
            c = 1.0 + term / c or tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return total


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    log_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def student_t_two_sided(t: float, df: float) -> float:
    if t is None or df is None or math.isnan(t) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def signed_rank_exact(w_plus: float, n: int) -> float:
    """Two-sided p of the signed-rank statistic when there are no ties and no zeros."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for rank in range(1, n + 1):
        ways[rank:] = ways[rank:] + ways[:-rank]
    share = ways / ways.sum()
    k = int(round(w_plus))
    return float(min(1.0, 2.0 * min(share[: k + 1].sum(), share[k:].sum())))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


@F.pandas_udf(DoubleType())
def student_t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_t_two_sided(a, b) for a, b in zip(t, df, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def signed_rank_p(w_plus: pd.Series, z: pd.Series, n: pd.Series, exact: pd.Series) -> pd.Series:
    return pd.Series([
        math.nan if pd.isna(n_) or not n_ else signed_rank_exact(w, int(n_)) if e else normal_two_sided(z_)
        for w, z_, n_, e in zip(w_plus, z, n, exact, strict=True)
    ], dtype=float)
