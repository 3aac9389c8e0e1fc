"""Between long and wide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_first(df: DataFrame, index: Sequence[str], name: str, value: str, order: str, names: Sequence[str] | None = None) -> DataFrame:
    """A column per name: the first value that is not NULL by ``order``, which must tell rows apart.

    Without ``names`` they are looked up, by one aggregate, sorted. A name without a value has no column.
    """
    held = df.where(F.col(value).isNotNull() & F.col(name).isNotNull())
    if names is None:
        names = sorted(r[0] for r in held.select(name).distinct().collect())  # the columns of the result
    if not names:
        return held.select(*index).distinct()
    return held.groupBy(*index).pivot(name, list(names)).agg(F.min_by(value, order))


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    """A row per column and row, NULLs kept."""
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in columns]
    return df.unpivot(list(ids), quoted, name, value)


def panel_of_fields(wide: DataFrame, date: str, fields: dict[str, Sequence[str]], ticker: Column) -> DataFrame:
    """(Date, Ticker, one column per field) from ``<ticker> | <field>`` columns: one unpivot and one grouping.

    The first field's columns say which (Date, Ticker) there are; ``ticker`` makes the ticker from the
    column ``instrument``.
    """
    columns = [c for cs in fields.values() for c in cs]
    named = F.create_map(*(F.lit(x) for f, cs in fields.items() for c in cs for x in (c, f)))
    tall = melt(wide, [date], columns, "instrument", "v").withColumns({"field": named[F.col("instrument")], "Ticker": ticker})
    first = next(iter(fields))
    values = [F.max(F.when(F.col("field") == f, F.col("v"))).alias(f) for f in fields]
    out = tall.groupBy(F.col(date).alias("Date"), "Ticker").agg(*values, F.max((F.col("field") == first).cast("int")).alias("_there"))
    return out.where("_there = 1").drop("_there")


def stack_stats(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(ids, feature, mean, std) from columns ``mean__f`` and ``std__f``."""
    one = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"`mean__{f}`").alias("mean"), F.col(f"`std__{f}`").alias("std")) for f in features)))
    return df.select(*ids, one.alias("s")).select(*ids, "s.*")


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]
