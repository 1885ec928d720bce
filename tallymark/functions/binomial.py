"""Exact binomial bounds and sample sizes."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    out = d
    for m in range(1, 20_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def upper_bound(errors: float, n: float, delta: float) -> float:
    """One-sided Clopper-Pearson bound; 1 without data or if all are errors."""
    if n <= 0 or errors >= n:
        return 1.0
    low, high = errors / n, 1.0
    for _ in range(100):
        mid = (low + high) / 2
        if beta_cdf(mid, errors + 1, n - errors) < 1 - delta:
            low = mid
        else:
            high = mid
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def clopper_pearson_upper(errors: pd.Series, n: pd.Series, delta: pd.Series) -> pd.Series:
    """Meant for aggregated rows, of which there are few."""
    return pd.Series([upper_bound(e, m, d) for e, m, d in zip(errors, n, delta, strict=True)])


def required_sample_size(alpha: Column, delta: Column) -> Column:
    """Error-free points needed to certify alpha; both must lie between 0 and 1."""
    valid = (alpha > 0) & (alpha < 1) & (delta > 0) & (delta < 1)
    return F.when(valid, F.ceil(F.log(delta) / F.log(1 - alpha))).otherwise(F.raise_error(F.lit("alpha and delta must lie strictly between 0 and 1")).cast("bigint"))


def needed(alpha: float, delta: float) -> int:
    if not 0 < alpha < 1 or not 0 < delta < 1:
        raise ValueError("alpha and delta must lie strictly between 0 and 1")
    return math.ceil(math.log(delta) / math.log(1 - alpha))
