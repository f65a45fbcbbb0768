"""Statistics without a built-in (F20-F22, W8): binomial tail, Jeffreys interval, Benjamini-Hochberg."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return front * f


def beta_quantile(q: float, a: float, b: float) -> float:
    """By bisection."""
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if incomplete_beta(a, b, mid) < q else (lo, mid)
    return (lo + hi) / 2


def tail(k: float, n: float, p: float) -> float:
    """P(B(n, p) >= k) with p at least 1/n and at most 1."""
    if n <= 0 or np.isnan(n) or np.isnan(p) or np.isnan(k):
        return float("nan")
    p = min(max(p, 1.0 / n), 1.0)
    if k <= 0:
        return 1.0
    return 0.0 if k > n else 1.0 if p >= 1 else incomplete_beta(k, n - k + 1, p)


@F.pandas_udf(DoubleType())
def binomial_tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([tail(*x) for x in zip(k, n, p)], dtype="float64")


@F.pandas_udf(StructType([StructField("bas", DoubleType()), StructField("haut", DoubleType())]))
def jeffreys(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    """The 90 % Jeffreys interval of k out of n; null where n is 0 or null."""
    seen: dict[tuple[float, float], tuple] = {}

    def one(x: float, m: float) -> tuple:
        if np.isnan(x) or np.isnan(m) or m <= 0:
            return (None, None)
        if (x, m) not in seen:
            seen[x, m] = (beta_quantile(0.05, x + 0.5, m - x + 0.5), beta_quantile(0.95, x + 0.5, m - x + 0.5))
        return seen[x, m]

    return pd.DataFrame([one(float("nan") if a is None else a, float("nan") if b is None else b) for a, b in zip(k, n)], columns=["bas", "haut"])


def q_values(df: DataFrame, p: str, tests: str, rank: str, by: list[str]) -> DataFrame:
    """Add ``q``: the running minimum from the largest p of p * tests / rank, at most 1. ``rank``: 1 for the smallest p; ``by``: families of tests."""
    w = W.partitionBy(*by).orderBy(F.col(rank).desc()).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("q", F.least(F.min(F.col(p) * F.col(tests) / F.col(rank)).over(w), F.lit(1.0)))


def average_rank(order: Column, by: list[Column]) -> Column:
    """Rank with ties at their mean."""
    w = W.partitionBy(*by).orderBy(order)
    return F.rank().over(w) + (F.count(F.lit(1)).over(w.rangeBetween(W.currentRow, W.currentRow)) - 1) / 2
