"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def long(x: Column) -> Column:
    return x.cast("long")


def rounded(x: Column, digits: int = 6) -> Column:
    """A double rounded for stable comparison; NaN becomes null."""
    return F.round(F.when(~F.isnan(x), x), digits)


def finite(x: Column) -> Column:
    """The value as double, or null where it is no finite number."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two columns over a group; null where one of them doesn't vary."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
