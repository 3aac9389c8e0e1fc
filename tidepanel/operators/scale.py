"""Per-split, per-ticker z-scores with statistics of the training part alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import stats
from tidepanel.functions.columns import clip, ratio
from tidepanel.operators.clean import numeric_columns
from tidepanel.operators.reshape import melt, stack_stats
from tidepanel.operators.split import Split


def scaled_features(df: DataFrame, target: str = "Excess_5d_fwd", leak_safe: bool = True, keys: Sequence[str] = ("Date", "Ticker", "split_id", "part")) -> list[str]:
    """Numeric columns but keys and target; leak-safe: nor any other that looks ahead."""
    return [c for c in numeric_columns(df, [*keys, target]) if not (leak_safe and c.endswith("_fwd"))]


def skew_figures(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, least, skew, n), over the whole table."""
    one = df.agg(*(f(F.col(f"`{c}`").cast("double")).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("lo", F.min), ("sk", stats.skewness), ("n", F.count))))
    parts = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"lo{i}").alias("least"), F.col(f"sk{i}").alias("skew"), F.col(f"n{i}").alias("n")) for i, c in enumerate(features)))
    return one.select(F.explode(parts).alias("s")).select("s.*")


def log_columns(df: DataFrame, features: Sequence[str], auto: bool = True, manual: Sequence[str] = ()) -> list[str]:
    """Columns never below 0 with a skewness above 1, and those named, in order."""
    chosen = {r[0] for r in skew_figures(df, features).where("n > 0 and least >= 0 and skew > 1").collect()} if auto and features else set()  # a row per feature
    return sorted(chosen | {c for c in manual if c in df.columns})


def apply_log(df: DataFrame, columns: Sequence[str], whole: DataFrame | None = None, tolerance: float = 1e-12) -> DataFrame:
    """``ln(1 + max(x, 0))`` of columns that are nowhere below 0 in ``whole`` (else ``df``); others stay."""
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    least = (df if whole is None else whole).agg(*(F.min(f"`{c}`").alias(f"_l{i}") for i, c in enumerate(columns)))
    wide = df.crossJoin(F.broadcast(least))
    grown = lambda i, c: F.when(F.col(f"_l{i}") >= -tolerance, F.log1p(clip(F.col(f"`{c}`"), F.lit(0.0)))).otherwise(F.col(f"`{c}`"))
    return wide.select(*(grown(columns.index(c), c).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns))


def fit(assigned: DataFrame, features: Sequence[str]) -> DataFrame:
    """(split_id, Ticker, mean__f, std__f ...) over training rows; population deviation."""
    train = assigned.where("part = 'train'")
    return train.groupBy("split_id", "Ticker").agg(*(f(F.col(f"`{c}`").cast("double")).alias(f"{n}__{c}") for c in features for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def fit_by_dates(df: DataFrame, splits: Sequence[Split], features: Sequence[str]) -> DataFrame:
    """As :func:`fit` of the training rows that ``splits`` take from ``df`` by their dates, without a row for each of them.

    Dates between two neighbouring bounds of training parts are in the same splits; so moments are taken
    once for each ticker and such a stretch, and stretches are put together by split.
    """
    edges = sorted({d for s in splits for d in (s.train_start, s.train_end)})
    dates = F.array(*(F.lit(d) for d in edges))
    within = F.array(*(F.struct(F.lit(s.split_id).alias("split_id"), F.lit(s.train_start).alias("a"), F.lit(s.train_end).alias("b")) for s in splits))
    stretch = df.withColumn("_from", F.array_max(F.filter(dates, lambda d: d <= F.col("Date")))).where("_from is not null")
    moments = lambda i, c: F.struct(F.count(c).alias("n"), F.avg(c).alias("m"), F.var_pop(c).alias("v")).alias(f"_m{i}")
    once = stretch.groupBy("Ticker", "_from").agg(*(moments(i, F.col(f"`{c}`").cast("double")) for i, c in enumerate(features)))
    dealt = once.withColumn("_s", F.explode(F.filter(within, lambda s: (F.col("_from") >= s.a) & (F.col("_from") < s.b))))
    held = dealt.groupBy(F.col("_s.split_id").alias("split_id"), "Ticker").agg(*(F.array_sort(F.collect_list(F.struct("_from", f"_m{i}"))).alias(f"_m{i}") for i in range(len(features))))

    def together(i: int) -> Column:
        """Count, mean and sum of squares about it, a stretch at a time: equal values stay without any spread."""
        step = f"""named_struct('n', a.n + x._m{i}.n, 'm', a.m + if(x._m{i}.n = 0, 0D, (x._m{i}.m - a.m) * x._m{i}.n / (a.n + x._m{i}.n)),
            'q', a.q + if(x._m{i}.n = 0, 0D, x._m{i}.v * x._m{i}.n + if(a.n = 0, 0D, (x._m{i}.m - a.m) * (x._m{i}.m - a.m) * a.n * x._m{i}.n / (a.n + x._m{i}.n))))"""
        return F.expr(f"aggregate(_m{i}, named_struct('n', 0L, 'm', 0D, 'q', 0D), (a, x) -> {step}, a -> if(a.n = 0, null, named_struct('m', a.m, 's', sqrt(a.q / a.n))))").alias(f"_m{i}")

    whole = held.select("split_id", "Ticker", *(together(i) for i in range(len(features))))
    return whole.select("split_id", "Ticker", *(F.col(f"_m{i}.{k}").alias(f"{n}__{c}") for i, c in enumerate(features) for n, k in (("mean", "m"), ("std", "s"))))


def transform(assigned: DataFrame, fitted: DataFrame, features: Sequence[str], fill: float | None = None) -> DataFrame:
    """z-scores in place of the features: 0 where training had no spread, NULL for tickers that it lacked.

    ``fill`` replaces what stays NULL.
    """
    both = assigned.join(fitted, ["split_id", "Ticker"], "left")

    def z(c: str) -> Column:
        x, mean, sd = F.col(f"`{c}`").cast("double"), F.col(f"`mean__{c}`"), F.col(f"`std__{c}`")
        out = F.when((sd == 0) & x.isNotNull(), 0.0).otherwise(ratio(x - mean, sd))
        return (out if fill is None else F.coalesce(out, F.lit(fill))).alias(c)

    return both.select(*(z(c) if c in features else F.col(f"`{c}`") for c in assigned.columns))


def long_stats(fitted: DataFrame, features: Sequence[str]) -> DataFrame:
    """(split_id, Ticker, feature, mean, std)."""
    return stack_stats(fitted, ["split_id", "Ticker"], features)


def meta(assigned: DataFrame, features: Sequence[str], logs: Sequence[str], fill: float | None = None) -> DataFrame:
    """(split_id, n_train, n_test, n_features, log1p_cols, impute_na)."""
    count = lambda p: F.count(F.when(F.col("part") == p, 1))
    names = F.array(*(F.lit(c) for c in logs)).cast("array<string>")
    return assigned.groupBy("split_id").agg(count("train").alias("n_train"), count("test").alias("n_test")).select("split_id", "n_train", "n_test", F.lit(len(features)).alias("n_features"), names.alias("log1p_cols"), F.lit(fill).cast("double").alias("impute_na"))


def drift(scaled: DataFrame, features: Sequence[str]) -> DataFrame:
    """(split_id, feature, part, mean, std) of scaled rows."""
    return melt(scaled, ["split_id", "part"], features, "feature", "v").groupBy("split_id", "feature", "part").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
