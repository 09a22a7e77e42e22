"""Medians, quantiles and outlier bounds. They differ on purpose; none stands for another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Null for null, NaN and infinite values."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def session_stats(x: Column) -> Column:
    """Aggregate: struct(mean, sd) of the finite values; sd is the population's and null below two values."""
    x = finite(x)
    return F.struct(F.avg(x).alias("mean"), F.when(F.count(x) >= 2, F.stddev_pop(x)).alias("sd"))


def circular_mean(deg: Column, weight: Column, period: float = 360.0) -> Column:
    """Aggregate: the weighted circular mean of angles of a period, in degrees."""
    turn = F.radians(deg * (360.0 / period))
    return F.degrees(F.atan2(F.sum(F.sin(turn) * weight), F.sum(F.cos(turn) * weight))) * (period / 360.0)


def circular_distance(a: Column, b: Column, period: float = 180.0) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(period))
    return F.least(d, F.lit(period) - d)


def circular_medoid(values: Column, period: float = 180.0) -> Column:
    """Of an array of angles the one with the least sum of circular distances, the first of equals."""
    cost = lambda v: F.aggregate(values, F.lit(0.0), lambda a, x: a + circular_distance(v, x, period))
    scored = F.transform(values, lambda v, i: F.struct(cost(v).alias("cost"), i.alias("i"), v.alias("v")))
    return F.array_min(scored)["v"]
