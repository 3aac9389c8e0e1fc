"""The workflow end to end: clean a panel, split it walk-forward, scale every split, and report."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions import columns as C
from tidepanel.operators import clean, profile, rows, scale, split
from tidepanel.sources import readers, writers


@dataclass
class Cleaned:
    clean: DataFrame
    reduced: DataFrame
    dropped: list[str]
    macro: list[str]
    winsorised: list[str]


@dataclass
class SplitOptions:
    start: dt.date = dt.date(2021, 1, 1)
    train_years: int = 3
    test_months: int = 1
    embargo_days: int = 5
    mode: str = "rolling"
    date_col: str = "Date"
    ticker_col: str | None = None
    price_col: str = "Price"
    min_train_days_per_ticker: int = 250
    strict_coldstart: bool = False


@dataclass
class ScaleOptions:
    target: str = "Excess_5d_fwd"
    date_col: str = "Date"
    ticker_col: str | None = None
    price_col: str = "Price"
    include_cols: Sequence[str] = field(default_factory=tuple)
    exclude_cols: Sequence[str] = field(default_factory=tuple)
    auto_log1p: bool = False
    log1p_cols: Sequence[str] = field(default_factory=tuple)
    impute_na: float | None = None
    leak_safe: bool = True


def typed(df: DataFrame, date: str = "Date", texts: Sequence[str] = ("Ticker",)) -> DataFrame:
    """A panel read as text with its date a date and all but ``texts`` numbers."""
    day = lambda c: C.iso_first(F.col(f"`{c}`")).alias(c)
    return df.select(*(day(c) if c == date else F.col(f"`{c}`") if c in texts else C.to_double(F.col(f"`{c}`")).alias(c) for c in df.columns))


def keyed(df: DataFrame, date: str = "Date", ticker: str | None = None) -> DataFrame:
    """``df`` with its date column named Date and its ticker column, named or found, Ticker; rows without a date go."""
    ticker = ticker or readers.ticker_column(df)
    readers.require(df, date, ticker)
    new = {date: "Date", ticker: "Ticker"}
    names = [new.get(c, c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("Date and Ticker are other columns' names")
    return df.toDF(*names).where("Date is not null")


def priced(df: DataFrame, price: str) -> DataFrame:
    """Rows with a price above 0, where there is such a column."""
    return rows.priced(df, f"`{price}`") if price in df.columns else df


def clean_panel(df: DataFrame, cutoff: float = 0.95, window: int = 5) -> Cleaned:
    """Macro columns imputed and winsorised, then columns that others explain dropped."""
    readers.require(df, "Date", "Ticker")
    features = clean.feature_columns(df)
    macro = clean.macro_columns(features)
    winsorised = clean.winsor_columns(macro)
    done = clean.winsorise(clean.impute(df, macro, window), winsorised) if macro else df
    reduced, dropped = clean.reduce_columns(done, features, cutoff)
    return Cleaned(done, reduced, dropped, macro, winsorised)


def split_panel(df: DataFrame, options: SplitOptions | None = None) -> tuple[DataFrame, list[split.Split]]:
    """The priced rows of each split, cold starts taken out of the tests, and the splits."""
    o = options or SplitOptions()
    df = priced(keyed(df, o.date_col, o.ticker_col), o.price_col)
    made = split.make_splits(*split.bounds(df), o.start, o.train_years, o.test_months, o.embargo_days, o.mode)
    made = split.with_tests(df, made)
    if not made:
        raise ValueError("no split has test rows")
    members = split.warm(split.assign(df, made), o.min_train_days_per_ticker, o.strict_coldstart)
    if o.strict_coldstart:
        left = {r[0] for r in members.select("split_id").distinct().collect()}  # a row per split
        made = [s for s in made if s.split_id in left]
        if not made:
            raise ValueError("no ticker is known well enough in any split")
    return members, made


def scale_panel(members: DataFrame, options: ScaleOptions | None = None, panel: DataFrame | None = None, splits: Sequence[split.Split] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scaled rows, statistics and figures of all splits in one plan.

    Log columns are chosen over the whole ``panel``, in a split or not; without it, over the rows of
    ``members``. With ``panel`` and ``splits``, moments are taken from the panel by date, each row once.
    """
    o = options or ScaleOptions()
    members = priced(keyed(members, o.date_col, o.ticker_col), o.price_col)
    panel = None if panel is None else priced(keyed(panel, o.date_col, o.ticker_col), o.price_col)
    keys = ("Date", "Ticker", "split_id", "part", o.target)
    features = [c for c in o.include_cols if c in members.columns and c not in keys] if o.include_cols else scale.scaled_features(members, o.target, o.leak_safe)
    features = rows.not_matching(features, o.exclude_cols)
    if not features:
        raise ValueError("no feature columns")
    whole = members.dropDuplicates(["Ticker", "Date"]) if panel is None else panel
    logs = scale.log_columns(whole, features, o.auto_log1p, o.log1p_cols)
    members = scale.apply_log(members, logs, whole)
    fitted = scale.fit_by_dates(scale.apply_log(panel, logs), splits, features) if panel is not None and splits else scale.fit(members, features)
    return scale.transform(members, fitted, features, o.impute_na), scale.long_stats(fitted, features), scale.meta(members, features, logs, o.impute_na)


def sanity_report(df: DataFrame, name: str, target: str = "Excess_5d_fwd") -> str:
    """Structure, gaps, outliers and the leak check as Markdown."""
    numbers = clean.numeric_columns(df)
    size = profile.duplicates(df).first()
    nulls, far = profile.null_shares(df), profile.outlier_shares(df, numbers)
    n, f = profile.summary(nulls, "null_share").first(), profile.summary(far, "outlier_share").first()
    top = lambda t, c: writers.markdown_table(rows.top(t, 10, F.abs(c).desc_nulls_last(), "column"), ["column", c])
    parts = [f"# Sanity check: {name}", "", f"- rows: {size['n_rows']:,}", f"- columns: {len(df.columns)}", f"- duplicates: {size['n_duplicates']}", "", f"## Missing values: {n['n_above_zero']} columns, mean share {n['mean_share']:.3f}", top(nulls, "null_share")]
    parts += ["", f"## Outliers: {f['n_above_zero']} columns, mean share {f['mean_share']:.6f}", top(far, "outlier_share")]
    if target in df.columns:
        parts += ["", "## Correlation with the target", top(profile.target_correlations(df, numbers, target), "corr")]
    return "\n".join(parts)


def bias_report(df: DataFrame, features: Sequence[str]) -> str:
    """Shares, coverage, late and short tickers, and feature statistics as Markdown."""
    valid = rows.priced(df, readers.price_column(df))
    span = profile.coverage(valid).orderBy("Ticker")
    bounds = valid.agg(F.min("Date"), F.max("Date")).first()
    start = profile.training_start(valid).first()[0]
    names = lambda t: ", ".join(r["Ticker"] for r in t.orderBy("Ticker").collect()) or "none"  # noqa: E731  a row per ticker
    parts = ["# Bias review", "", f"- from {bounds[0]} to {bounds[1]}", f"- training start: {start}", "", "## Tickers", writers.markdown_table(profile.shares(df).orderBy(F.desc("n"), "Ticker"), ["Ticker", "n", "share"], 4)]
    parts += ["", "## Coverage", writers.markdown_table(span, ["Ticker", "first_day", "last_day", "years", "obs_days"], 2), "", f"Late: {names(profile.late_starts(valid))}", f"Short: {names(profile.short_histories(valid))}"]
    table = profile.feature_bias(df, [f for f in features if f in df.columns]).orderBy("feature", "Ticker")
    return "\n".join([*parts, "", "## Features", writers.markdown_table(table, ["feature", "Ticker", "mean", "std", "min", "max", "median", "non_null", "mean_shift_sigma", "cv"], 5)])


def cleaning_report(before: DataFrame, done: Cleaned) -> str:
    total = lambda df: profile.null_shares(df).agg(F.sum("null_share")).first()[0] * profile.duplicates(df).first()["n_rows"]
    size = profile.duplicates(before).first()
    lines = ["# Cleaning", "", f"- rows: {size['n_rows']:,}", f"- columns: {len(before.columns)} before, {len(done.reduced.columns)} after", f"- duplicates: {size['n_duplicates']}", f"- missing: {total(before):.0f} before, {total(done.reduced):.0f} after"]
    return "\n".join([*lines, f"- macro columns: {len(done.macro)}", f"- winsorised: {len(done.winsorised)}", f"- dropped: {len(done.dropped)} ({', '.join(done.dropped)})"])


def run(spark: SparkSession, path: str, out: str, splits: SplitOptions | None = None, scaling: ScaleOptions | None = None) -> None:
    """From a panel's CSV to cleaned tables, membership, log, scaled splits and reports under ``out``."""
    raw = readers.read_auto(spark, path)
    o = splits or SplitOptions()
    ticker = o.ticker_col or readers.ticker_column(raw)
    panel = keyed(typed(raw, o.date_col, (ticker,)), o.date_col, ticker)
    splits, scaling = replace(o, date_col="Date", ticker_col="Ticker"), replace(scaling or ScaleOptions(), date_col="Date", ticker_col="Ticker")
    done = clean_panel(panel)
    done.clean.write.mode("overwrite").parquet(f"{out}/clean")
    done.reduced.write.mode("overwrite").parquet(f"{out}/reduced")
    reduced = spark.read.parquet(f"{out}/reduced")
    writers.write_text(spark, cleaning_report(panel, done), f"{out}/cleaning_report")
    writers.write_text(spark, sanity_report(reduced, "reduced"), f"{out}/sanity_report")
    shown = clean.numeric_columns(reduced)[:60]  # as many as a picture can show
    writers.write_text(spark, writers.heatmap(profile.matrix(reduced, shown), shown), f"{out}/correlation_heatmap")
    members, made = split_panel(reduced, splits)
    writers.write_membership(members, f"{out}/membership")
    writers.write_csv(split.log(members, made).coalesce(1), f"{out}/splits_log")
    writers.write_scaled(*scale_panel(members, scaling, reduced, made), out)
