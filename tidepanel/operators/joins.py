"""Joins of panels with series by date, and rows with date ranges.

Which side is sent whole is left to adaptive execution, by measured size. Ranges are few and known to the
driver, so a row finds its ranges in an array and needs no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def on_date(left: DataFrame, right: DataFrame, how: str = "left", date: str = "Date") -> DataFrame:
    """Columns of ``right`` beside those of ``left`` with the same date."""
    return left.join(right, date, how)


def with_aggregates(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """A single row's columns beside every row."""
    return df.crossJoin(F.broadcast(one_row.limit(1)))


def members(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")
