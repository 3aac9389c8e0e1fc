"""Places and ranks in a whole table's order, without a window over all of it.

Rows are dealt to ranges of the order, whose bounds come from a bounded sample and only say how evenly; ranges are counted,
and a row's place is the rows of all ranges before plus its own place in its range. All bounds are values in the plan, so
a task that runs again deals its rows as before.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.operators import profile

SAMPLED = 64  # rows of the sample for each range
SHARE = 256  # a value that more than a row in so many holds is frequent


def _ranges(df: DataFrame, names: Sequence[str], ranges: int) -> DataFrame:
    """``df`` with _range: how many bounds are below or at the row's key. Keys: whether NULL, then the value, for each of ``names``."""
    key = F.struct(*(x for c in names for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))))
    hashed = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    kept = df.select(key.alias("k"), hashed.alias("h")).orderBy("h", "k").limit(ranges * SAMPLED)  # at most so many rows, by hash
    sample = kept.select("k").orderBy("k").collect()
    step = max(1, -(-len(sample) // ranges))
    bounds = df.sparkSession.createDataFrame([([r["k"] for r in sample[step::step]],)], T.StructType([T.StructField("_bounds", T.ArrayType(kept.schema["k"].dataType))]))
    halves = F.array(*(F.lit(1 << i) for i in reversed(range(max(1, len(sample[step::step]).bit_length())))))
    upto = lambda k: F.aggregate(halves, F.lit(0), lambda at, n: F.when(F.get("_bounds", at + n - 1) <= k, at + n).otherwise(at))
    found = F.transform(F.array(key), upto)[0]  # by halves; the key is made once for each row
    return df.crossJoin(F.broadcast(bounds)).withColumn("_range", found).drop("_bounds")  # one row


def positions(df: DataFrame, by: Sequence[str], name: str = "position", ranges: int = 64) -> DataFrame:
    """``df`` with the place of each row, from 0, in ascending order of ``by``; NULL comes last.

    Rows of equal keys are placed by a hash of all their columns. One key's rows are in one range, unless ``by`` names more columns.
    """
    dealt = _ranges(df, by, ranges)
    sizes = dict(dealt.groupBy("_range").count().collect())  # at most ``ranges`` rows
    before = F.array(*(F.lit(n) for n in accumulate((sizes.get(i, 0) for i in range(max(sizes, default=0))), initial=0)))
    order = [F.col(f"`{c}`").asc_nulls_last() for c in by]
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order, F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))))
    return dealt.withColumn("_own", own).select(*(F.col(f"`{c}`") for c in df.columns), (before[F.col("_range")] + F.col("_own") - 1).cast("long").alias(name))


def mid_ranks(long: DataFrame, ranges: int = 64) -> DataFrame:
    """(column, v, n, rank): of each column's distinct values, how many rows hold it and their mean place from 1.

    ``long`` has column (int) and v (double, no NULL). Values are counted first, so many rows of one value are one row from then on.
    """
    counts = long.groupBy("column", "v").agg(F.count("*").alias("n"))
    dealt = _ranges(counts, ("column", "v"), ranges)
    within = dealt.groupBy("column", "_range").agg(F.sum("n").alias("_n"))
    before = within.withColumn("_before", F.sum("_n").over(Window.partitionBy("column").orderBy("_range")) - F.col("_n")).drop("_n")
    upto = F.sum("n").over(Window.partitionBy("_range", "column").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("_upto", upto).join(before, ["column", "_range"])
    return placed.select("column", "v", "n", (F.col("_before") + F.col("_upto") - (F.col("n") - 1) / 2).alias("rank"))


def ranked(df: DataFrame, columns: Sequence[str], keys: Sequence[str], ranges: int = 64) -> DataFrame:
    """The keys, and each column's mid-ranks among its own values in place of them; NULL has none.

    Ranks come back to rows by value: frequent values, at most SHARE a column, by a broadcast, the others by a join whose keys
    hold few rows each.
    """
    plain = [F.col(f"`{c}`") for c in keys]
    whole = df.select(*plain, *(F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    again = F.row_number().over(Window.partitionBy(*plain).orderBy(*(f"c{i}" for i in range(len(columns)))))
    whole = whole.withColumn("_again", again)
    pairs = F.array(*(F.struct(F.lit(i).alias("column"), F.col(f"c{i}").alias("v")) for i in range(len(columns))))
    held = whole.select(*plain, "_again", F.explode(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("_p")).select(*plain, "_again", "_p.column", "_p.v")
    ranks = mid_ranks(held.select("column", "v"), ranges)
    total = held.groupBy("column").agg(F.count("*").alias("_total"))
    marked = ranks.join(F.broadcast(total), "column").withColumn("_often", F.col("n") * SHARE > F.col("_total"))  # a row for each column
    often, rare = marked.where("_often").select("column", "v", "rank"), marked.where("not _often").select("column", "v", F.col("rank").alias("_rank"))
    found = held.join(F.broadcast(often), ["column", "v"], "left")  # at most SHARE rows a column
    some = found.where("rank is not null").select(*plain, "_again", "column", "rank")
    rest = found.where("rank is null").drop("rank").join(rare, ["column", "v"]).select(*plain, "_again", "column", F.col("_rank").alias("rank"))
    wide = some.unionByName(rest).groupBy(*plain, "_again").agg(*(F.max(F.when(F.col("column") == i, F.col("rank"))).alias(c) for i, c in enumerate(columns)))
    return wide.drop("_again")


def rank_correlations(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("Date", "Ticker"), complete: bool = False, ranges: int = 64) -> DataFrame:
    """(a, b, pos_a, pos_b, corr): Spearman correlations of all pairs of columns, a before b.

    Each value's rank is among all of its column; a pair is correlated over the rows that have both. With ``complete``, only
    rows with a value in every column count, for ranks too. NULL for a constant column.
    """
    if complete:
        df = df.dropna(subset=list(columns))
    return profile.correlations(ranked(df, columns, keys, ranges), columns)


def quantile_bounds(df: DataFrame, column: str, bins: int, ranges: int = 64) -> list[float]:
    """The exact inner bounds of ``bins`` bins of about as many values each: the values at places n * i / bins, each bound once."""
    values = df.where(F.col(f"`{column}`").isNotNull()).select(F.lit(0).alias("column"), F.col(f"`{column}`").cast("double").alias("v"))
    ranks = mid_ranks(values, ranges)
    n = F.broadcast(values.agg(F.count("*").alias("_total")))
    first, last = F.col("rank") - (F.col("n") - 1) / 2 - 1, F.col("rank") + (F.col("n") - 1) / 2 - 1  # places from 0
    wanted = F.array(*(F.floor(F.col("_total") * F.lit(i) / F.lit(bins)) for i in range(1, bins)))
    hit = ranks.crossJoin(n).where(F.exists(wanted, lambda p: (p >= first) & (p <= last)))
    return sorted({r[0] for r in hit.select("v").collect()})  # at most bins - 1

