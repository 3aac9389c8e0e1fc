"""From forecasts to a strategy: positions that are carried, a hedge from the past only, costs, and its equity.

All is one sort by ticker; a portfolio adds one exchange by date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import ratio
from tidepanel.operators import evaluation
from tidepanel.operators.windows import by_ticker, filled


def position(signal: Column, key: str = "Ticker", enter: float = 0.55, leave: float = 0.5) -> Column:
    """1 from a row with a signal of at least ``enter`` on, 0 from one of at most ``leave`` on; else as before, at first 0.

    Rows without a signal keep the position.
    """
    if leave >= enter:
        raise ValueError(f"leave ({leave}) must be below enter ({enter})")
    turn = F.when(signal >= enter, 1.0).when(signal <= leave, 0.0)
    return F.coalesce(filled(turn, by_ticker(key)), F.lit(0.0))


def expanding_beta(own: Column, bench: Column, key: str = "Ticker", least: int = 20) -> Column:
    """Covariance by variance of the benchmark over all rows up to this one that have both; NULL before ``least`` of them."""
    w = by_ticker(key).rowsBetween(Window.unboundedPreceding, 0)
    x, y = F.when(bench.isNotNull(), own), F.when(own.isNotNull(), bench)
    n, mx, my = F.count(x).over(w), F.avg(x).over(w), F.avg(y).over(w)
    return F.when(n >= least, ratio(F.avg(x * y).over(w) - mx * my, F.avg(y * y).over(w) - my * my))


def strategy(df: DataFrame, signal: str = "p", own: str = "r", bench: str = "br", key: str = "Ticker", enter: float = 0.55, leave: float = 0.5, cost: float = 0.001, least: int = 20) -> DataFrame:
    """``df`` with position, beta, gross, cost and net.

    A position is taken at a row's end and earns the next row's return, less ``beta`` (known at the row before; 0 while there
    is none) times the benchmark's. A missing return of either side earns 0 on that side. ``cost`` is paid for each unit
    of the ticker that is bought or sold, and for the hedge that goes with it (the change of position times beta).
    """
    w = by_ticker(key)
    df = df.withColumns({"position": position(F.col(signal), key, enter, leave), "beta": expanding_beta(F.col(own), F.col(bench), key, least)})
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    held, hedge = zero(F.lag("position").over(w)), zero(F.lag("beta").over(w))
    df = df.withColumns({"gross": held * (zero(F.col(own)) - hedge * zero(F.col(bench))), "cost": F.abs(F.col("position") - held) * (1 + F.abs(zero(F.col("beta")))) * cost})
    return df.withColumn("net", F.col("gross") - F.col("cost"))


def portfolio(traded: DataFrame, value: str = "net") -> DataFrame:
    """(Date, r, n_held): the mean of all tickers' returns of a date, and how many held a position at its end."""
    return traded.groupBy("Date").agg(F.avg(value).alias("r"), F.sum("position").cast("long").alias("n_held"))


def results(traded: DataFrame, key: str = "Ticker", per_year: float = 252.0) -> DataFrame:
    """(key, cagr, sharpe, max_drawdown, turnover, share_held) of each ticker's strategy."""
    curve = evaluation.equity_curve(traded, "net", key)
    more = traded.withColumn("_change", F.abs(F.col("position") - F.coalesce(F.lag("position").over(by_ticker(key)), F.lit(0.0))))
    return evaluation.performance(curve, "net", key, per_year).join(more.groupBy(key).agg(F.sum("_change").alias("turnover"), F.avg("position").alias("share_held")), key)
