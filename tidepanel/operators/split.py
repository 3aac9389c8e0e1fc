"""Walk-forward splits: dates, membership, cold starts and figures.

Splits are a small table that follows from the panel's first and last date. A row belongs to a split by
its date alone, never by position.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import ratio

SPLIT = "split_id int, train_start date, train_end date, test_start date, test_end date"


@dataclass(frozen=True)
class Split:
    split_id: int
    train_start: dt.date
    train_end: dt.date
    test_start: dt.date
    test_end: dt.date


def add_months(d: dt.date, n: int) -> dt.date:
    """The same day ``n`` months on, or that month's last."""
    year, month = divmod(d.year * 12 + d.month - 1 + n, 12)
    last = (dt.date(year + month // 11, (month + 1) % 12 + 1, 1) - dt.timedelta(1)).day
    return dt.date(year, month + 1, min(d.day, last))


def month_starts(first: dt.date, last: dt.date) -> list[dt.date]:
    out, d = [], first.replace(day=1)
    while d <= last:
        out.append(d)
        d = add_months(d, 1)
    return out


def make_splits(first: dt.date | None, last: dt.date | None, start: dt.date, train_years: int = 3, test_months: int = 1, embargo_days: int = 5, mode: str = "rolling") -> list[Split]:
    """One split per month from ``start`` on: training ends ``embargo_days`` before the test begins."""
    if mode not in ("rolling", "expanding"):
        raise ValueError(f"mode must be 'rolling' or 'expanding', not {mode!r}")
    out = []
    for test_start in month_starts(max(first, start), last) if first and last else []:
        if test_start < start:
            continue
        train_end = test_start - dt.timedelta(embargo_days)
        if train_end <= first:
            continue
        train_start = add_months(train_end, -12 * train_years) if mode == "rolling" else first
        out.append(Split(len(out), train_start, train_end, test_start, add_months(test_start, test_months)))
    return out


def bounds(df: DataFrame) -> tuple[dt.date | None, dt.date | None]:
    return tuple(df.agg(F.min("Date"), F.max("Date")).first())


def table(df: DataFrame, splits: list[Split]) -> DataFrame:
    return df.sparkSession.createDataFrame([tuple(vars(s).values()) for s in splits], SPLIT)


def assign(df: DataFrame, splits: list[Split]) -> DataFrame:
    """``df`` with split_id and part, a row for each split that it is in.

    The splits are an array in the plan (they number the months), so no shuffle or join is needed.
    """
    day = lambda d: f"DATE'{d.isoformat()}'"
    parts = [f"named_struct('split_id', {s.split_id}, 'part', '{p}', 'a', {day(a)}, 'b', {day(b)})" for s in splits for p, a, b in (("train", s.train_start, s.train_end), ("test", s.test_start, s.test_end))]
    if not parts:
        return df.where("false").withColumns({"split_id": F.lit(0), "part": F.lit("train")})
    within = F.expr(f"explode(filter(array({', '.join(parts)}), s -> Date >= s.a and Date < s.b))")
    return df.withColumn("_s", within).select(*df.columns, F.col("_s.split_id").alias("split_id"), F.col("_s.part").alias("part"))


def assign_by_table(df: DataFrame, splits: DataFrame, width: int = 32) -> DataFrame:
    """As :func:`assign`, with the splits as a table of any size (the columns of SPLIT).

    Parts of splits and rows meet by stretches of ``width`` days, so the join is one of equal keys; each row is
    looked at only beside the parts that reach into its stretch. Rows without a date, and parts that end before they begin, are in none.
    """
    part = lambda p: F.struct(F.lit(p).alias("part"), F.col(f"{p}_start").alias("a"), F.col(f"{p}_end").alias("b"))
    parts = splits.select(F.col("split_id").alias("_id"), F.explode(F.array(part("train"), part("test"))).alias("_p")).select("_id", "_p.*").where("a < b")
    at = lambda c: F.floor(F.unix_date(c) / width)
    binned = parts.withColumn("_bin", F.explode(F.sequence(at(F.col("a")), at(F.date_sub("b", 1))))).withColumnRenamed("part", "_part")
    met = df.withColumn("_at", at(F.col("Date"))).join(binned, F.col("_at") == F.col("_bin")).where((F.col("Date") >= F.col("a")) & (F.col("Date") < F.col("b")))
    return met.select(*df.columns, F.col("_id").alias("split_id"), F.col("_part").alias("part"))


def with_tests(df: DataFrame, splits: list[Split]) -> list[Split]:
    """The splits that have test rows, numbered anew."""
    there = {r[0] for r in assign(df.select("Date"), splits).where("part = 'test'").select("split_id").distinct().collect()}  # a row per split
    return [replace(s, split_id=i) for i, s in enumerate(s for s in splits if s.split_id in there)]


def warm(assigned: DataFrame, least_days: int = 250, strict: bool = False) -> DataFrame:
    """Test rows only of tickers with ``least_days`` training days in their split; strict: no split without test rows."""
    known = assigned.where("part = 'train'").groupBy("split_id", "Ticker").agg(F.countDistinct("Date").alias("days")).where(F.col("days") >= least_days).select("split_id", "Ticker")
    test = assigned.where("part = 'test'").join(known, ["split_id", "Ticker"], "left_semi").select(*assigned.columns)
    train = assigned.where("part = 'train'")
    if strict:
        train = train.join(test.select("split_id").distinct(), "split_id", "left_semi").select(*assigned.columns)
    return train.unionByName(test)


def part_figures(assigned: DataFrame) -> DataFrame:
    """(split_id, part, n_rows, n_days, first_day, last_day)."""
    return assigned.groupBy("split_id", "part").agg(F.count("*").alias("n_rows"), F.countDistinct("Date").alias("n_days"), F.min("Date").alias("first_day"), F.max("Date").alias("last_day"))


def part_shares(assigned: DataFrame) -> DataFrame:
    """(split_id, part, Ticker, share)."""
    counts = assigned.where("Ticker is not null").groupBy("split_id", "part", "Ticker").agg(F.count("*").alias("n"))
    return counts.select("split_id", "part", "Ticker", ratio(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy("split_id", "part"))).alias("share"))


def log(assigned: DataFrame, splits: list[Split], tickers: list[str] | None = None) -> DataFrame:
    """A row per split: its dates, the figures of both parts, and a share column per part and ticker."""
    figures = part_figures(assigned).groupBy("split_id").pivot("part", ["train", "test"]).agg(F.first("n_rows").alias("rows"), F.first("n_days").alias("days"), F.first("first_day").alias("date_min"), F.first("last_day").alias("date_max"))
    if tickers is None:
        tickers = sorted(r[0] for r in assigned.where("Ticker is not null").select("Ticker").distinct().collect())  # the log's columns
    named = part_shares(assigned).withColumn("c", F.concat(F.col("part"), F.lit("_share__"), F.col("Ticker")))
    wide = named.groupBy("split_id").pivot("c", [f"{p}_share__{t}" for p in ("train", "test") for t in tickers]).agg(F.first("share"))
    return table(assigned, splits).join(figures, "split_id").join(wide, "split_id", "left")
