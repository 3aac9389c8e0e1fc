"""Filters, order and top rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields that the long table keeps.
RELEVANT_FIELDS = ("Last Price", "Bid Price", "High Price", "Low Price", "Volume", "Current Market Cap", "BEst EBITDA", "BEst EPS", "BEst P/E Ratio", "Dividend 12 Month Yld - Gross")


def with_fields(df: DataFrame, fields: Sequence[str] = RELEVANT_FIELDS, column: str = "Field") -> DataFrame:
    return df.where(F.col(column).isin(*fields))


def priced(df: DataFrame, price: str = "Price") -> DataFrame:
    """Rows with a price above 0."""
    return df.where(F.col(price) > 0)


def between(df: DataFrame, start: object, end: object, date: str = "Date") -> DataFrame:
    """Rows of [start, end)."""
    return df.where((F.col(date) >= F.lit(start)) & (F.col(date) < F.lit(end)))


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that have a value in each of the columns that there are."""
    return df.dropna(subset=[c for c in columns if c in df.columns])


def without_sparse_columns(df: DataFrame, most: float = 0.2, keep: Sequence[str] = ()) -> DataFrame:
    """Columns with a share of NULL above ``most`` go; one aggregate decides. An empty table keeps all."""
    columns = [c for c in df.columns if c not in keep]
    shares = df.agg(*(F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"c{i}") for i, c in enumerate(columns))).first()
    return df.drop(*(c for i, c in enumerate(columns) if (shares[i] or 0) > most))


def not_matching(columns: Sequence[str], patterns: Sequence[str]) -> list[str]:
    """Names in which none of the regular expressions is found."""
    return [c for c in columns if not any(p and re.search(p, c) for p in patterns)]


def top(df: DataFrame, n: int, *by: Column | str) -> DataFrame:
    return df.orderBy(*by).limit(n)


def sorted_panel(df: DataFrame, first: str = "Ticker", then: str = "Date") -> DataFrame:
    return df.orderBy(F.col(first).asc_nulls_last(), F.col(then).asc_nulls_last())
