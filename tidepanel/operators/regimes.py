"""Bull and bear sub-periods of a price: turns of at least a given share, and figures by period.

A machine walks each ticker's rows by date. In a bull period it keeps the highest price so far; a price that is ``fall`` below
confirms that a bear period began after that peak, and so on in mirror image from the lowest price with ``rise``. The first period is a
bull one. Which period a row belongs to is known only after its turn is confirmed: periods are for judging a past, not for trading.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import ratio


def turns(price: np.ndarray, fall: float, rise: float) -> list[tuple[int, int, int]]:
    """(number, first row, row that confirmed it) of each period after the first; odd numbers are bear periods.

    Of equal extremes the first one counts. A stretch of rows is looked at once for each turn within it, doubling its length until the turn is found.
    """
    out: list[tuple[int, int, int]] = []
    at, bear = 0, False
    while at < len(price):
        found, size = None, 256
        while found is None:
            part = price[at : at + size]
            extreme = np.minimum.accumulate(part) if bear else np.maximum.accumulate(part)
            there = part >= extreme * (1 + rise) if bear else part <= extreme * (1 - fall)
            if there.any():
                found = int(np.argmax(there))
            elif at + size >= len(price):
                return out
            size *= 2
        # the first row that has the extreme price
        top = at + int(np.argmax(price[at : at + found + 1] == extreme[found]))
        bear, at = not bear, at + found  # the confirming row is the lowest (highest) since the extreme
        out.append((len(out) + 1, top + 1, at))
    return out


def periods(df: DataFrame, price: str = "Price", key: str = "Ticker", fall: float = 0.2, rise: float = 0.2) -> DataFrame:
    """``df`` with period (from 0) and regime ('bull' or 'bear').

    Rows without a price, or with one of 0 or less, are of the period that the rows before them are of. Rows of one date are in the order of their price.
    """
    if not (0 < fall < 1 and rise > 0):
        raise ValueError("fall must be between 0 and 1, and rise above 0")

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("Date", "ascending"), ("price", "ascending")])
        found = turns(part["price"].to_numpy(), fall, rise)
        dates = part["Date"].to_pylist()
        return pa.table({key: pa.array([part[key][0].as_py()] * len(found), part.schema.field(key).type), "period": pa.array([n for n, _, _ in found], pa.int32()), "_from": pa.array([dates[i] for _, i, _ in found], pa.date32()), "confirmed": pa.array([dates[i] for _, _, i in found], pa.date32())})

    known = df.where((F.col(price) > 0) & F.col("Date").isNotNull()).select(key, "Date", F.col(price).cast("double").alias("price"))
    kind = dict(df.dtypes)[key]
    begun = known.groupBy(key).applyInArrow(run, f"`{key}` {kind}, period int, _from date, confirmed date")
    # gaps and islands: a turn is an event among the rows, and the last event before a row numbers its island
    events = begun.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_from", "period"))).alias("_turns"))
    joined = df.join(events.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    period = F.coalesce(F.array_max(F.transform(F.filter("_turns", lambda t: t["_from"] <= F.col("Date")), lambda t: t["period"])), F.lit(0))
    return joined.withColumn("period", period).withColumn("regime", F.when(F.col("period") % 2 == 1, "bear").otherwise("bull")).drop("_turns")


def figures(df: DataFrame, price: str = "Price", key: str = "Ticker") -> DataFrame:
    """(key, period, regime, first_day, last_day, n_rows, change): change is from the last price of the period before to its own last.

    The first period's is from its own first price.
    """
    own = df.where(F.col(price) > 0).groupBy(key, "period", "regime").agg(F.min("Date").alias("first_day"), F.max("Date").alias("last_day"), F.count("*").alias("n_rows"), F.min_by(price, "Date").alias("_first"), F.max_by(price, "Date").alias("_last"))
    before = F.coalesce(F.lag("_last").over(Window.partitionBy(key).orderBy("period")), F.col("_first"))
    return own.withColumn("change", ratio(F.col("_last"), before) - 1).drop("_first", "_last")
