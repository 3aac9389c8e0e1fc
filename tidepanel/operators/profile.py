"""What a panel is like: gaps, outliers, correlations, coverage and bias."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import stats
from tidepanel.functions.columns import half_even, ratio
from tidepanel.operators.reshape import melt

KEYS = ("Date", "Ticker")


def duplicates(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(n_rows, n_duplicates): rows beyond the first of their key; NULL keys are equal."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def _tall(one_row: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
    parts = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias(value)) for i, c in enumerate(columns)))
    return one_row.select(F.explode(parts).alias("s")).select("s.*")


def null_shares(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, null_share), in one pass."""
    columns = list(columns or df.columns)
    return _tall(df.agg(*(stats.null_share(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns))), columns, "null_share")


def outlier_shares(df: DataFrame, columns: Sequence[str], limit: float = 5.0) -> DataFrame:
    """(column, outlier_share): rows beyond ``limit`` sample deviations, of all rows. Two passes: moments, then counts."""
    moments = df.agg(*(f(F.col(f"`{c}`")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    far = lambda i, c: F.abs(ratio(F.col(f"`{c}`") - F.col(f"m{i}"), F.col(f"s{i}"))) > limit
    counts = df.crossJoin(F.broadcast(moments)).agg(*(F.avg(F.when(far(i, c), 1.0).otherwise(0.0)).alias(f"c{i}") for i, c in enumerate(columns)))
    return _tall(counts, columns, "outlier_share")


def summary(shares: DataFrame, value: str) -> DataFrame:
    """(n_columns, n_above_zero, mean_share) of a table of shares."""
    return shares.agg(F.count("*").alias("n_columns"), F.count(F.when(F.col(value) > 0, 1)).alias("n_above_zero"), F.avg(value).alias("mean_share"))


def target_correlations(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(column, corr) of each column with the target over the rows that have both."""
    one = df.agg(*(stats.pair_corr(F.col(f"`{c}`"), F.col(f"`{target}`")).alias(f"c{i}") for i, c in enumerate(columns)))
    return _tall(one, columns, "corr")


def _centres(df: DataFrame, columns: Sequence[str], tile: int) -> np.ndarray:
    """About each column's mean over its finite values, ``tile`` columns to a scan; 0 without any."""

    def run(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in b.columns], 1)
            there = np.isfinite(x)
            yield pa.record_batch([pa.array(np.arange(at, at + x.shape[1])), pa.array(there.sum(0)), pa.array(np.where(there, x, 0.0).sum(0))], ["pos", "n", "x"])

    parts = [_numbers(df, columns[i : i + tile]).mapInArrow(lambda b, i=i: run(b, i), "pos long, n long, x double") for i in range(0, len(columns), tile)]
    centre = np.zeros(len(columns))
    if parts:
        sums = reduce(DataFrame.unionByName, parts).groupBy("pos").agg((F.sum("x") / F.nullif(F.sum("n"), F.lit(0))).alias("mean")).where("mean is not null")
        for pos, mean in sums.collect():  # a row per column
            centre[pos] = mean if np.isfinite(mean) else 0.0
    return centre


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)))


def correlations(df: DataFrame, columns: Sequence[str], tile: int = 512, tasks: int | None = None) -> DataFrame:
    """(a, b, pos_a, pos_b, corr) for all pairs of columns, a before b, over the rows that have both.

    Batches of rows become sums of products by matrix multiplication; those are summed by pair. Columns are
    centred by about their means first, so large offsets don't cancel. NULL where a side is constant.

    Columns are cut into tiles of at most ``tile``, and each pair of tiles has its own scan of only its columns. A
    task so holds six tile x tile matrices (13 MB at 512), however many columns there are. Beyond one tile the
    scans have about ``tasks`` tasks in all (by default four for each core), as each task gives a row for every
    pair of its tiles; ``df`` is then best a stored table, since it is read once for each pair of tiles.
    """
    columns = list(columns)
    centre = _centres(df, columns, tile)
    starts = range(0, len(columns), tile)

    def run(batches: Iterator[pa.RecordBatch], i: int, j: int) -> Iterator[pa.RecordBatch]:
        left = min(tile, len(columns) - i)
        right = slice(0, left) if i == j else slice(left, None)
        middle = np.concatenate([centre[i : i + left], *([] if i == j else [centre[j : j + tile]])])
        total = np.zeros((6, left, left if i == j else len(middle) - left))
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                x = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in b.slice(at, 1024).columns], 1) - middle
                there = np.isfinite(x)
                x, m = np.where(there, x, 0.0), there.astype(float)
                xa, ma, xb, mb = x[:, :left].T, m[:, :left].T, x[:, right], m[:, right]
                for t, part in zip(total, (lambda: ma @ mb, lambda: xa @ mb, lambda: ma @ xb, lambda: (xa * xa) @ mb, lambda: ma @ (xb * xb), lambda: xa @ xb), strict=True):
                    t += part()
        for a in range(left):
            c = np.arange(a + 1 if i == j else 0, total.shape[2])
            if len(c):
                yield pa.record_batch([pa.array(np.full(len(c), i + a), pa.int32()), pa.array(c + j, pa.int32()), *(pa.array(t[a, c]) for t in total)], ["pos_a", "pos_b", "n", "x", "y", "xx", "yy", "xy"])

    pairs = [(i, j) for i in starts for j in starts if i <= j]
    each = max(1, -(-(tasks or 4 * df.sparkSession.sparkContext.defaultParallelism) // max(1, len(pairs))))
    schema = "pos_a int, pos_b int, n double, x double, y double, xx double, yy double, xy double"

    def scan(i: int, j: int) -> DataFrame:
        own = _numbers(df, columns[i : i + tile] + ([] if i == j else columns[j : j + tile]))
        return (own if len(pairs) == 1 else own.coalesce(each)).mapInArrow(lambda b: run(b, i, j), schema)

    parts = [scan(i, j) for i, j in pairs] or [df.sparkSession.createDataFrame([], schema)]
    sums = reduce(DataFrame.unionByName, parts).groupBy("pos_a", "pos_b").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")))
    var = lambda s, ss: F.col(ss) - ratio(F.col(s) * F.col(s), F.col("n"))
    apart = lambda s, ss: F.when(var(s, ss) > F.col(ss) * 1e-14, var(s, ss))
    corr = ratio(F.col("xy") - ratio(F.col("x") * F.col("y"), F.col("n")), F.sqrt(apart("x", "xx")) * F.sqrt(apart("y", "yy")))
    named = F.array(*(F.lit(c) for c in columns)).cast("array<string>")
    return sums.select(named[F.col("pos_a")].alias("a"), named[F.col("pos_b")].alias("b"), "pos_a", "pos_b", corr.alias("corr"))


def matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(row, column, corr) for every cell of the correlation matrix; 1 on the diagonal, NULL for a constant column."""
    pairs = correlations(df, columns).select("a", "b", "corr")
    spread = df.agg(*(F.var_pop(F.col(f"`{c}`").cast("double")).alias(f"c{i}") for i, c in enumerate(columns)))
    own = _tall(spread, columns, "spread").select(F.col("column").alias("row"), "column", F.when(F.col("spread") > 0, 1.0).alias("corr"))
    both = pairs.select(F.array(F.struct(F.col("a").alias("row"), F.col("b").alias("column"), "corr"), F.struct(F.col("b").alias("row"), F.col("a").alias("column"), "corr")).alias("s"))
    return both.select(F.explode("s").alias("s")).select("s.*").unionByName(own)


def strong(pairs: DataFrame, least: float = 0.7) -> DataFrame:
    """The correlation matrix's upper triangle where it is strong."""
    return pairs.where(F.abs("corr") >= least)


def shares(df: DataFrame, column: str = "Ticker", digits: int | None = 4) -> DataFrame:
    """(column, n, share) of each value that is not NULL."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    share = ratio(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy()))
    return counts.select(column, "n", (share if digits is None else half_even(share, digits)).alias("share"))


def coverage(valid: DataFrame) -> DataFrame:
    """(Ticker, first_day, last_day, obs_days, calendar_days, years)."""
    span = valid.groupBy("Ticker").agg(F.min("Date").alias("first_day"), F.max("Date").alias("last_day"), F.countDistinct("Date").alias("obs_days"))
    days = F.datediff("last_day", "first_day") + 1
    return span.withColumn("calendar_days", days).withColumn("years", F.col("calendar_days") / 365.0)


def late_starts(valid: DataFrame) -> DataFrame:
    """Tickers that begin after the panel's first day."""
    span = coverage(valid)
    return span.crossJoin(F.broadcast(valid.agg(F.min("Date").alias("global_first")))).where("first_day > global_first").select("Ticker", "first_day")


def short_histories(valid: DataFrame, least: int = 250) -> DataFrame:
    return coverage(valid).where(F.col("obs_days") < least).select("Ticker", "obs_days")


def active_per_day(valid: DataFrame) -> DataFrame:
    return valid.groupBy("Date").agg(F.countDistinct("Ticker").alias("n_active"))


def training_start(valid: DataFrame, share: float = 0.9) -> DataFrame:
    """(train_start): the first day with ``share`` of the most tickers that any day has."""
    days = active_per_day(valid)
    need = days.agg(half_even(share * F.max("n_active"), 0).alias("need"))
    return days.crossJoin(F.broadcast(need)).where("n_active >= need").agg(F.min("Date").alias("train_start"))


def tickers_per_day(df: DataFrame) -> DataFrame:
    """(n_tickers, min_per_day, avg_per_day, max_per_day)."""
    days = df.groupBy("Date").agg(F.countDistinct("Ticker").alias("n"))
    return days.agg(F.min("n").alias("min_per_day"), F.avg("n").alias("avg_per_day"), F.max("n").alias("max_per_day")).crossJoin(df.agg(F.countDistinct("Ticker").alias("n_tickers")))


def medians(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, median), exact: the mean of the two middle values. Rows with a NULL key or value are left out.

    A sketch of bounded size gives two values that lie a thousandth of the group before and after the
    middle, ten times its error. Only values between them are counted one by one, those below in one sum,
    so about a five-hundredth of a group's distinct values meet in one task, not all of them.
    """
    named = df.where(F.col(value).isNotNull())
    for k in keys:
        named = named.where(F.col(k).isNotNull())
    bounds = named.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx(value, [0.499, 0.501], 10_000).alias("_q"))
    inner = named.select(*keys, F.col(value).alias("_v")).join(bounds, list(keys)).where("_v <= _q[1]")
    counts = inner.groupBy(*keys, "_n", F.when(F.col("_v") >= F.col("_q")[0], F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumn("_upto", upto)
    low, high = (F.min(F.when(F.col("_upto") > F.floor(at / 2), F.col("_v"))) for at in (F.col("_n") - 1, F.col("_n")))
    return ranked.groupBy(*keys).agg((low * 0.5 + high * 0.5).alias("median"))


def feature_bias(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature and ticker: mean, std, min, max, median and count, rounded half-even to 5 digits.

    ``mean_shift_sigma`` and ``cv`` come from the rounded figures; the global mean and deviation don't.
    """
    numbers = df.select("Ticker", *(F.col(f"`{f}`").cast("double").alias(f) for f in features))
    tall = melt(numbers, ["Ticker"], features, "feature", "v").where("v is not null")
    whole = tall.groupBy("feature").agg(F.avg("v").alias("global_mean"), F.stddev_samp("v").alias("global_std"))
    named = tall.where("Ticker is not null")
    per = named.groupBy("feature", "Ticker").agg(*(half_even(f("v"), 5).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))), F.count("v").alias("non_null"))
    middle = medians(named, ["feature", "Ticker"], "v").select("feature", "Ticker", half_even(F.col("median"), 5).alias("median"))
    out = per.join(middle, ["feature", "Ticker"]).select("feature", "Ticker", "mean", "std", "min", "max", "median", "non_null").join(whole, "feature")
    out = out.withColumn("mean_shift_sigma", half_even(ratio(F.col("mean") - F.col("global_mean"), F.col("global_std")), 2))
    return out.withColumn("cv", half_even(ratio(F.col("std"), F.col("mean")), 3))
