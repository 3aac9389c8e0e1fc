"""Feature sets of an equity panel: from wide or long tables to rows of (Date, Ticker)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import columns as C
from tidepanel.operators import reshape, rows, windows
from tidepanel.operators.windows import by_ticker
from tidepanel.sources.readers import benchmark_column, date_column, require

SQRT_YEAR = 252.0**0.5
# Rolling windows, with how many values each needs, and what the wide table's names hold.
WINDOWS = {5: 3, 10: 5, 20: 10}
WIDE_FIELDS = {"Price": "| Last Price", "Volume": "| Volume", "DivYld12m": "Dividend 12 Month Yld", "MktCap": "Current Market Cap"}


def equity_features(panel: DataFrame, compat: bool = False) -> DataFrame:
    """Past-only features of (Date, Ticker, Price[, Volume, DivYld12m, MktCap]); all share one sort by ticker."""
    w = by_ticker("Ticker")
    out = panel.withColumn("_p", C.finite(windows.filled(F.col("Price"), w)))
    r = F.col("Return_raw")
    out = out.withColumn("Return_raw", windows.growth(F.col("_p"), w))
    new: dict[str, Column] = {f"Return_lag{n}": F.lag(r, n).over(w) for n in (1, 5)}
    for n, least in WINDOWS.items():
        new[f"Return_MA{n}"] = windows.rolling(F.avg, r, w, n, least)
        new[f"Return_STD{n}"] = windows.rolling(F.stddev_pop, r, w, n, least)
    new["RealizedVol20_ann"] = windows.rolling(F.stddev_pop, r, w, 20, 10) * SQRT_YEAR
    new["Return_Z20"] = windows.z_before(r, w)
    new["Ret_5d_fwd"] = windows.forward_growth(F.col("_p"), w, compat=compat)
    if "Volume" in panel.columns:
        new["Volume_MA20"] = windows.rolling(F.avg, F.col("Volume"), w, 20, 10)
    for c in ("DivYld12m", "MktCap"):
        if c in panel.columns:
            new[f"{c}_lag1"] = F.lag(c).over(w)
    out = out.withColumns(new)
    if "Volume" in panel.columns:
        out = out.withColumn("Volume_to_MA20", F.lag(C.ratio(F.col("Volume"), F.col("Volume_MA20"))).over(w))
    return out.drop("_p")


def benchmark_returns(series: DataFrame, price: str, compat: bool = False) -> DataFrame:
    """(Date, Bench_Return_raw, Bench_Ret_5d_fwd) of one price per date; a series, so sorted in one task."""
    w = by_ticker()
    filled = series.select("Date", windows.filled(F.col(price), w).alias("_p"))
    return filled.select("Date", windows.growth(F.col("_p"), w).alias("Bench_Return_raw"), windows.forward_growth(F.col("_p"), w, compat=compat).alias("Bench_Ret_5d_fwd"))


def with_benchmark(panel: DataFrame, bench: DataFrame, compat: bool = False) -> DataFrame:
    """Excess return of the row before, and the forward excess as target.

    ``compat`` lets a ticker's first row have the last value of the ticker before it.
    """
    out = panel.join(bench, "Date", "left").withColumn("_x", F.col("Return_raw") - F.col("Bench_Return_raw"))
    own = F.lag("_x").over(by_ticker("Ticker"))
    if compat:
        last = out.groupBy("Ticker").agg(F.max_by("_x", "Date").alias("_last"))  # a row per ticker
        before = last.select(F.lead("Ticker").over(Window.orderBy("Ticker")).alias("Ticker"), "_last").where("Ticker is not null")
        first = F.row_number().over(by_ticker("Ticker")) == 1
        out = out.join(before, "Ticker", "left").withColumn("Excess_ret", F.when(first, F.col("_last")).otherwise(own)).drop("_last")
    else:
        out = out.withColumn("Excess_ret", own)
    return out.drop("_x").withColumn("Excess_5d_fwd", F.col("Ret_5d_fwd") - F.col("Bench_Ret_5d_fwd"))


def with_ranks(panel: DataFrame) -> DataFrame:
    """Cross-sectional ranks; all share one exchange by date."""
    new = {"Rank_MA20": windows.share_rank(F.col("Return_MA20")), "Rank_LowVol20": windows.share_rank(F.col("Return_STD20"))}
    if "Volume_MA20" in panel.columns:
        new["Rank_Liquidity"] = windows.share_rank(F.col("Volume_MA20"), descending=True)
    return panel.withColumns(new)


def macro_features(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Date and, per series, __lag1, __lag5, __logdiff1 and __chgstd20, on the table's own calendar."""
    w = by_ticker()
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    out = wide.select("Date", *(q(c) for c in columns)).withColumns({f"_d{i}": windows.log_change(q(c), w) for i, c in enumerate(columns)})
    new = []
    for i, c in enumerate(columns):
        d = F.col(f"_d{i}")
        new += [F.lag(q(c), 1).over(w).alias(f"{c}__lag1"), F.lag(q(c), 5).over(w).alias(f"{c}__lag5"), F.lag(d).over(w).alias(f"{c}__logdiff1"), windows.rolling(F.stddev_pop, d, w, 20, 10).alias(f"{c}__chgstd20")]
    return out.select("Date", *new)


def macro_lags(wide: DataFrame, columns: Sequence[str], lags: Sequence[int] = (1, 5)) -> DataFrame:
    """Date and, per series, its lags on its own calendar."""
    w = by_ticker()
    return wide.select("Date", *(F.lag(f"`{c}`", n).over(w).alias(f"{c}_lag{n}") for c in columns for n in lags))


def feature_set_a(wide: DataFrame, compat: bool = False) -> DataFrame:
    """The panel of a wide table with ``<ticker> | <field>`` columns, its benchmark and macro series."""
    date = date_column(wide)
    bench = benchmark_column(wide)
    fields = {f: [c for c in wide.columns if "SE Equity" in c and hint in c] for f, hint in WIDE_FIELDS.items()}
    fields = {f: cs for f, cs in fields.items() if cs}
    if "Price" not in fields:
        raise ValueError("no equity price columns")
    macros = [c for c in wide.columns if "| Last Price" in c and "SE Equity" not in c and c != bench]
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    numbers = {c: q(c).try_cast("double") for c in [*(c for cs in fields.values() for c in cs), *macros, *([bench] if bench else [])]}
    wide = wide.select(C.day_first(q(date)).alias("Date"), *(C.finite(v).alias(c) for c, v in numbers.items())).where("Date is not null")
    panel = equity_features(reshape.panel_of_fields(wide, "Date", fields, C.ticker_part(F.col("instrument"))), compat)
    if bench:
        panel = with_benchmark(panel, benchmark_returns(wide, f"`{bench}`", compat), compat)
    panel = with_ranks(panel)
    if macros:
        panel = panel.join(macro_features(wide, macros), "Date", "left")
    return panel


def benchmark_series(df: DataFrame) -> DataFrame:
    """(Date, smi_return) from a long (Field, Date, Value) or a wide table, by the first column that will do."""
    w = by_ticker()
    if {"Field", "Date", "Value"} <= set(df.columns):
        long = df.select(C.day_first(F.col("Date")).alias("Date"), C.field_name(F.col("Field")).alias("f"), C.to_double(F.col("Value")).alias("v"), F.monotonically_increasing_id().alias("_seq")).where("Date is not null")
        df = reshape.pivot_first(long, ["Date"], "f", "v", "_seq")
        returns, prices = ("smi_return",), ("close", "adj_close")
    else:
        df = df.withColumn("Date", C.day_first(F.col("Date"))).where("Date is not null")
        returns, prices = ("SMI_Return", "Return"), ("Close", "Adj Close", "AdjClose", "Price", "PX_LAST")
    for c in returns:
        if c in df.columns:
            return df.select("Date", C.to_double(F.col(f"`{c}`")).alias("smi_return"))
    for c in prices:
        if c in df.columns:
            filled = df.select("Date", windows.filled(C.to_double(F.col(f"`{c}`")), w).alias("_p"))
            return filled.select("Date", windows.growth(F.col("_p"), w).alias("smi_return"))
    raise ValueError("no benchmark return or price")


def feature_set_b(stocks: DataFrame, macro: DataFrame, benchmark: DataFrame | None = None, most_null: float = 0.2) -> DataFrame:
    """The panel of long tables (Ticker, Field, Date, Value, _seq): sample deviations over full windows, and a log target."""
    require(stocks, "Ticker", "Field", "Date", "Value")
    require(macro, "Field", "Date", "Value")
    tidy = lambda df, *keys: df.select(*keys, C.day_first(F.col("Date")).alias("Date"), C.field_name(F.col("Field")).alias("f"), C.to_double(F.col("Value")).alias("v"), *(["_seq"] if "_seq" in df.columns else [F.monotonically_increasing_id().alias("_seq")])).where("Date is not null")
    panel = reshape.pivot_first(tidy(stocks, "Ticker"), ["Date", "Ticker"], "f", "v", "_seq")
    wide = reshape.pivot_first(tidy(macro), ["Date"], "f", "v", "_seq")
    series = [c for c in wide.columns if c != "Date"]
    w = by_ticker("Ticker")
    have_excess = "excess" in panel.columns
    if "return" not in panel.columns and "close" in panel.columns:
        panel = panel.withColumn("_p", windows.filled(F.col("close"), w)).withColumn("return", windows.growth(F.col("_p"), w)).drop("_p")
    if have_excess:
        panel = panel.withColumn("Excess_5d_fwd", windows.log_target(F.col("excess"), None, w))
    else:
        if "smi_return" in series:
            bench = wide.select("Date", "smi_return")
        elif benchmark is not None:
            bench = benchmark_series(benchmark)
        else:
            raise ValueError("no excess and no benchmark to make it from")
        panel = panel.join(bench, "Date", "left").withColumn("Excess_5d_fwd", windows.log_target(F.col("return"), F.col("smi_return"), w)).drop("smi_return")
    new, need = {}, ["Excess_5d_fwd"]
    for name, c in (("Return", "return"), ("Excess", "excess")):
        if c in panel.columns:
            for n in WINDOWS:
                new[f"{name}_MA{n}"] = windows.rolling(F.avg, F.col(c), w, n, n)
                new[f"{name}_STD{n}"] = windows.rolling(F.stddev_samp, F.col(c), w, n, n)
            new[f"{name}_lag1"] = F.lag(c).over(w)
    panel = panel.withColumns(new).join(macro_lags(wide, series), "Date", "left")
    kept = rows.complete(panel, [*need, *new])
    front = ["Date", "Ticker"]
    return rows.without_sparse_columns(kept.select(*front, *(f"`{c}`" for c in kept.columns if c not in front)), most_null, front)


def combined_wide(stocks: DataFrame, macro: DataFrame) -> DataFrame:
    """Long stocks and macro tables, by feature name, side by side for the dates that both have."""
    tidy = lambda df, name: df.select(C.day_first(F.col("Date")).alias("Date"), name.alias("f"), C.loose_double(F.col("Value")).alias("v"), "_seq").where("Date is not null")
    left = reshape.pivot_first(tidy(rows.with_fields(stocks), C.feature_name(F.col("Ticker"), F.col("Field"))), ["Date"], "f", "v", "_seq")
    right = reshape.pivot_first(tidy(macro, C.macro_name(F.col("Ticker"))), ["Date"], "f", "v", "_seq")
    return left.join(right, "Date").orderBy("Date")
