"""Numeric columns in which missing means NULL and nothing else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(column: Column) -> Column:
    """NaN and infinities become NULL: Spark would order NaN above all numbers and call it equal to itself."""
    return F.when(~F.isnan(column) & (column != INF) & (column != -INF), column)


def as_number(column: Column) -> Column:
    """A double, or NULL for what isn't a finite number."""
    return finite(column.try_cast("double"))


def divide(a: Column, b: Column) -> Column:
    """a / b; NULL for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def half_even(column: Column, digits: int = 0) -> Column:
    return F.bround(column, digits)


def sortino_of_negatives(values: Column) -> Column:
    """Mean over the deviation of the negative values, times the root of the count; the mean if none is negative. An aggregate."""
    downside = F.stddev_pop(F.when(values < 0, values))
    scaled = F.avg(values) / F.nullif(downside, F.lit(0.0)) * F.sqrt(F.count(values))
    return F.round(F.when(F.count_if(values < 0) == 0, F.avg(values)).otherwise(scaled), 6)


def sortino_of_shortfall(values: Column) -> Column:
    """Mean over the root mean square of min(0, value); NULL where that is nil. An aggregate."""
    shortfall = F.avg(F.pow(F.least(values, F.lit(0.0)), F.lit(2.0)))
    return F.when(shortfall > 1e-18, F.avg(values) / F.sqrt(F.when(shortfall > 1e-18, shortfall)))


def steady_round(column: Column, digits: int = 6) -> Column:
    """Rounded half up by plain double arithmetic, so that any engine gets the same number from the same double."""
    scale = float(10**digits)
    return F.floor(column * scale + 0.5).cast("double") / scale
