"""Arithmetic and normal-distribution expressions."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

_SETTLE = 1e10


def number(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def safe_div(top, bottom) -> Column:
    """``top / bottom``, and 0 where the divisor is 0."""
    top, bottom = number(top), number(bottom)
    return F.when(bottom == 0, F.lit(0.0)).otherwise(F.try_divide(top, bottom))


def shape_ratio(top, bottom) -> Column:
    """A candle-shape ratio; the divisor never falls under one cent."""
    return safe_div(top, F.greatest(number(bottom), F.lit(0.01)))


def add(*parts) -> Column:
    return reduce(lambda a, b: a + b, [number(p) for p in parts])


def mul(*parts) -> Column:
    return reduce(lambda a, b: a * b, [number(p) for p in parts])


def settle(value: Column) -> Column:
    """Round to ten decimals so that ties do not hang on summation order.

    Plain double arithmetic: ``round`` would go through BigDecimal per row.
    """
    return F.rint(value * F.lit(_SETTLE)) / F.lit(_SETTLE)


def finite(value: Column) -> Column:
    """NaN and infinities become NULL; everything downstream relies on it."""
    value = value.cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)


def z_critical(level: float) -> float:
    if not 0.0 < level < 1.0:
        raise ValueError("confidence level must lie between 0 and 1")
    return NormalDist().inv_cdf((1.0 + level) / 2.0)


def erf(x: Column) -> Column:
    """erf for x >= 0 from its all-positive series (Spark has no erf).

    erf(x) = 2/sqrt(pi) * exp(-x^2) * sum_n 2^n x^(2n+1) / (2n+1)!!, where each
    term is the one before times 2 x^2 / (2n+1).
    """
    start = F.struct(x.alias("term"), x.alias("total"))

    def step(acc: Column, n: Column) -> Column:
        term = acc["term"] * 2.0 * x * x / (2 * n + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(160)), start, step, lambda acc: acc["total"])
    return F.when(x > 6.0, F.lit(1.0)).otherwise(series * F.exp(-x * x) * (2.0 / math.sqrt(math.pi)))


def two_sided_p(t: Column) -> Column:
    """2 * (1 - Phi(|t|)); NULL stays NULL."""
    return F.when(t.isNull(), None).otherwise(1.0 - erf(F.abs(t) / F.lit(math.sqrt(2.0))))
