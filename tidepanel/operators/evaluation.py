"""Judging signals and strategies: rankings, equity curves, hedges, drift and hit rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import stats
from tidepanel.functions.columns import ln, ratio
from tidepanel.operators.windows import by_ticker, share_rank


def yearly_returns(valid: DataFrame) -> DataFrame:
    """(Ticker, y, total_return, rank): from a year's first to its last price, best first; ties by ticker."""
    y = valid.groupBy("Ticker", F.year("Date").alias("y")).agg((ratio(F.max_by("Price", "Date"), F.min_by("Price", "Date")) - 1).alias("total_return"))
    return y.withColumn("rank", F.row_number().over(Window.partitionBy("y").orderBy(F.col("total_return").desc_nulls_last(), "Ticker")))


def years_ahead(yearly: DataFrame, bench: DataFrame) -> DataFrame:
    """(Ticker, n_years, n_ahead) against (y, bench_return)."""
    both = yearly.join(bench, "y")
    return both.groupBy("Ticker").agg(F.count("*").alias("n_years"), F.count(F.when(F.col("total_return") > F.col("bench_return"), 1)).alias("n_ahead"))


def signs(df: DataFrame, excess: str = "Excess_5d_fwd") -> DataFrame:
    """With ``label``: 1 for a positive excess, else 0; NULL where there is none."""
    return df.withColumn("label", F.when(F.col(excess).isNotNull(), (F.col(excess) > 0).cast("int")))


def equity_curve(df: DataFrame, value: str = "r", key: str = "Ticker") -> DataFrame:
    """With ``equity``, the compounded product of returns so far (NULL counts as 0), and ``drawdown`` from its peak.

    A return of -1 or less loses all: equity is 0 from then on.
    """
    w = by_ticker(key).rowsBetween(Window.unboundedPreceding, 0)
    grown = 1 + F.coalesce(F.col(value), F.lit(0.0))
    out = df.withColumn("equity", F.when(F.min(grown).over(w) <= 0, 0.0).otherwise(F.exp(F.sum(ln(grown)).over(w))))
    return out.withColumn("drawdown", ratio(F.col("equity"), F.max("equity").over(w)) - 1)


def performance(curve: DataFrame, value: str = "r", key: str = "Ticker", per_year: float = 52.0) -> DataFrame:
    """(key, cagr, sharpe, max_drawdown) of an :func:`equity_curve`."""
    n, last = F.count("*"), F.max_by("equity", "Date")
    sharpe = ratio(F.avg(value), F.stddev_samp(value)) * per_year**0.5
    return curve.groupBy(key).agg((F.pow(last, per_year / n) - 1).alias("cagr"), sharpe.alias("sharpe"), F.min("drawdown").alias("max_drawdown"))


def betas(df: DataFrame, own: str, bench: str, key: str = "Ticker") -> DataFrame:
    """(key, beta) over the rows that have both."""
    x, y = F.when(F.col(bench).isNotNull(), F.col(own)), F.when(F.col(own).isNotNull(), F.col(bench))
    return df.groupBy(key).agg(ratio(F.covar_samp(x, y), F.var_samp(y)).alias("beta"))


def information_coefficients(df: DataFrame, signal: str, target: str) -> DataFrame:
    """(Date, ic): Spearman correlation of signal and target over a date's tickers that have both."""
    both = df.where(F.col(signal).isNotNull() & F.col(target).isNotNull())
    ranks = both.select("Date", share_rank(F.col(signal)).alias("a"), share_rank(F.col(target)).alias("b"))
    return ranks.groupBy("Date").agg(stats.pair_corr(F.col("a"), F.col("b")).alias("ic"))


def precision_at(df: DataFrame, signal: str, target: str, k: int) -> DataFrame:
    """(Date, precision): of a date's ``k`` best by signal (ties by ticker), the share with a target above 0."""
    both = df.where(F.col(signal).isNotNull() & F.col(target).isNotNull())
    order = F.row_number().over(Window.partitionBy("Date").orderBy(F.col(signal).desc(), "Ticker"))
    return both.withColumn("_n", order).where(F.col("_n") <= k).groupBy("Date").agg(F.avg((F.col(target) > 0).cast("double")).alias("precision"))


def stability(train: DataFrame, test: DataFrame, feature: str, edges: list[float]) -> DataFrame:
    """(psi): the population stability index of a feature over bins with the given inner edges; empty bins count as one in a million."""
    x = F.col(feature)
    where = sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0))
    part = lambda df, name: df.where(x.isNotNull()).groupBy(where.alias("bin")).agg(F.count("*").alias(name))
    bins = train.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    both = bins.join(part(train, "a"), "bin", "left").join(part(test, "b"), "bin", "left")
    total = both.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    share = lambda n, t: F.greatest(F.coalesce(ratio(F.col(n).cast("double"), F.col(t)), F.lit(0.0)), F.lit(1e-6))
    return both.crossJoin(F.broadcast(total)).agg(F.sum((share("b", "tb") - share("a", "ta")) * F.ln(share("b", "tb") / share("a", "ta"))).alias("psi"))
