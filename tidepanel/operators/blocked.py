"""Windows over long series: blocks of rows with a halo, so that one series is spread over many tasks.

Rows are numbered in the order of key and date (:func:`order.positions`) and cut into blocks of ``size`` rows. A block also gets the
``back`` rows before it and the ``ahead`` rows after it; windows run within a block and key, and only the block's own rows
stay. Frames that reach at most so far give what they give over the whole series. What reaches back without a limit, the
last value that is not NULL, is carried from block to block (:func:`filled`).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidepanel.operators import order

AT, BLOCK, OWN = "_at", "_block", "_own"


def spec(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(BLOCK, *keys).orderBy(AT)


def cut(df: DataFrame, keys: Sequence[str], by: Sequence[str], size: int, back: int, ahead: int = 0, ranges: int = 64) -> DataFrame:
    """Rows with their place, a row for each block that sees them, and whether the block owns them."""
    if max(back, ahead) > size or size < 1:
        raise ValueError(f"blocks of {size} rows are shorter than what is to be seen beside them ({back} before, {ahead} after)")
    placed = order.positions(df, [*keys, *by], AT, ranges)
    block, within = F.floor(F.col(AT) / size), F.pmod(F.col(AT), F.lit(size))
    seen = F.array(F.struct(block.alias(BLOCK), F.lit(True).alias(OWN)), F.when(within >= size - back, F.struct((block + 1).alias(BLOCK), F.lit(False).alias(OWN))), F.when((within < ahead) & (block > 0), F.struct((block - 1).alias(BLOCK), F.lit(False).alias(OWN))))
    return placed.withColumn("_s", F.explode(F.filter(seen, lambda s: s.isNotNull()))).select(*(F.col(f"`{c}`") for c in df.columns), AT, "_s.*")


def windowed(df: DataFrame, make: Callable[[WindowSpec], Mapping[str, Column]], keys: Sequence[str] = ("Ticker",), by: Sequence[str] = ("Date",), size: int = 100_000, back: int = 0, ahead: int = 0, ranges: int = 64) -> DataFrame:
    """``df`` with the columns that ``make`` gives for a window over each key's rows in the order of ``by``.

    No frame of theirs may reach further than ``back`` rows back and ``ahead`` rows on. Without keys the whole table is one series.
    Rows of equal key and order are placed by a hash of all their columns.
    """
    made = make(spec(keys))
    rows = cut(df, keys, by, size, back, ahead, ranges).withColumns(dict(made))
    return rows.where(OWN).select(*(F.col(f"`{c}`") for c in dict.fromkeys([*df.columns, *made])))


def filled(df: DataFrame, columns: Mapping[str, str], keys: Sequence[str] = ("Ticker",), by: Sequence[str] = ("Date",), size: int = 100_000, ranges: int = 64) -> DataFrame:
    """``df`` with each of ``columns`` (new name to old) filled forward: the last value of its key that is not NULL up to the row.

    Each block's last values are one row for each key in it; those rows, one in about ``size``, are sorted by key.
    """
    rows = cut(df, keys, by, size, 0, 0, ranges)
    ends = rows.groupBy(BLOCK, *keys).agg(*(F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(AT))).alias(f"_v{i}") for i, c in enumerate(columns.values())))
    before = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(BLOCK).alias("_b"), *(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), *(F.last(f"_v{i}", ignorenulls=True).over(before).alias(f"_c{i}") for i in range(len(columns))))
    same = F.col(BLOCK) == F.col("_b")
    for i, k in enumerate(keys):
        same &= F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
    upto = spec(keys).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.join(carried, same, "left")
    own = {n: F.coalesce(F.last(F.col(f"`{c}`"), ignorenulls=True).over(upto), F.col(f"_c{i}")) for i, (n, c) in enumerate(columns.items())}
    return both.withColumns(own).select(*(F.col(f"`{c}`") for c in dict.fromkeys([*df.columns, *columns])))
