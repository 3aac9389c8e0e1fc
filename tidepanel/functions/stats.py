"""Aggregates that skip NULL in pairs and never divide by zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def skewness(c: Column) -> Column:
    """Adjusted Fisher-Pearson skewness; NULL below three values or without spread."""
    n, spread = F.count(c), F.var_pop(c)
    adjusted = F.skewness(c) * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0))
    return F.when((n > 2) & (spread > 0), adjusted)


def pair_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over the rows that have both; NULL for a constant side."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))


def null_share(c: Column) -> Column:
    return F.avg(c.isNull().cast("double"))
