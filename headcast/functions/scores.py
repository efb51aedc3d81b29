"""Column forms of forecast scores and of the log-normal that two quantiles fix."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NORMAL = NormalDist()
#: The normal quantile at 0.8 to the digits that the log-normal fit is defined with.
Z80 = 0.8416212335729143


@F.pandas_udf(T.DoubleType())
def libm_log(values: pd.Series) -> pd.Series:
    """Logarithm as the C library rounds it (the JVM's differs in last bits), for comparisons that have ties; null at 0 and below."""
    return pd.Series([math.log(v) if v > 0 else None for v in values], dtype="float64")


def lognormal_mu(p50: Column) -> Column:
    """Logarithm of the median; null where no log-normal fits."""
    return F.when(p50 > 0, F.log(p50))


def lognormal_sigma(p50: Column, p80: Column) -> Column:
    return F.when((p50 > 0) & (p80 > p50), (F.log(p80) - F.log(p50)) / Z80)


def lognormal_quantile(p50: Column, p80: Column, q: float) -> Column:
    return F.exp(lognormal_mu(p50) + lognormal_sigma(p50, p80) * NORMAL.inv_cdf(q))


def normal_cdf(z: Column) -> Column:
    """Normal distribution function to about 1e-7 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + F.lit(0.2316419) * F.abs(z))
    tail = F.lit(0.3989422804014327) * F.exp(-z * z / 2) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def pinball(q: float, actual: Column, predicted: Column) -> Column:
    error = actual - predicted
    return F.greatest(q * error, (q - 1) * error)


def crps(actual: Column, p50: Column, p80: Column, p90: Column) -> Column:
    """Twice the trapezoid of pinball losses over the levels, with constant tails."""
    a, b, c = pinball(0.5, actual, p50), pinball(0.8, actual, p80), pinball(0.9, actual, p90)
    return 2 * (0.5 * 0.3 * (a + b) + 0.5 * 0.1 * (b + c) + 0.5 * a + 0.1 * c)


def interval_score(actual: Column, low: Column, high: Column, penalty: float = 4.0) -> Column:
    zero = F.lit(0.0)
    return (high - low) + penalty * (F.greatest(zero, low - actual) + F.greatest(zero, actual - high))


def rounded(c: Column, digits: int = 6) -> Column:
    """To a fixed number of digits: sums of doubles depend on their order."""
    return F.round(c, digits)
