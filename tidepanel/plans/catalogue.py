"""The query catalogue: every operator applied to a panel made from the order tables, with its SQL.

The panel: brands are tickers, weeks are dates, the price is revenue per unit, the volume is units. Sums
are of decimals, so the numbers are the same in any order and engine. The benchmark is the same ratio over
all brands; the macro series are the mean order value of each priority.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions import columns as C
from tidepanel.operators import backtest, blocked, clean, evaluation, joins, order, profile, regimes, reshape, rows, scale, signal, split, windows
from tidepanel.operators.windows import by_ticker
from tidepanel.plans import features, workflow
from tidepanel.sources import readers, writers
from tidepanel.streaming import daily

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SPLIT_START, LEAST_DAYS = dt.date(1998, 1, 1), 140
FEATURES = ("px", "vol", "r", "ma20", "sd20")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _exact(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def _week(c: str) -> Column:
    return F.date_trunc("week", F.col(c)).cast("date")


def panel(spark: SparkSession, sf_dir: str, bucket: str = "week") -> DataFrame:
    """(Date, Ticker, Price, Volume)."""
    sold = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    day = F.date_trunc(bucket, F.col("l_shipdate")).cast("date")
    return sold.groupBy(day.alias("Date"), F.col("p_brand").alias("Ticker")).agg(C.ratio(_exact("l_extendedprice"), _exact("l_quantity")).alias("Price"), _exact("l_quantity").alias("Volume"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Date, bpx)."""
    sold = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return sold.groupBy(_week("l_shipdate").alias("Date")).agg(C.ratio(_exact("l_extendedprice"), _exact("l_quantity")).alias("bpx"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Date, one column per priority)."""
    weekly = table(spark, sf_dir, "orders").groupBy(_week("o_orderdate").alias("Date"), "o_orderpriority").agg((_exact("o_totalprice") / F.count("*")).alias("v"), F.lit(0).alias("_seq"))
    return reshape.pivot_first(weekly, ["Date"], "o_orderpriority", "v", "_seq", PRIORITIES)


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The panel and the benchmark by one pass over the lines: a row of sums for each week and brand, written to the shared folder.

    The benchmark adds up the brands' sums; all are of decimals, so both hold the numbers of :func:`panel` and :func:`benchmark`.
    """
    sold = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    cents = lambda c: F.sum(F.col(c).cast("decimal(18,2)"))
    sums = sold.groupBy(_week("l_shipdate").alias("Date"), F.col("p_brand").alias("Ticker")).agg(cents("l_extendedprice").alias("paid"), cents("l_quantity").alias("units"))
    path = writers.scratch(spark, "panel")
    sums.coalesce(8).write.parquet(path)  # as many rows as the panel, and no more with more lines
    kept = spark.read.schema(sums.schema).parquet(path)
    price = lambda c: C.ratio(c("paid").cast("double"), c("units").cast("double"))
    bench = kept.groupBy("Date").agg(price(F.sum).alias("bpx"))
    return kept.select("Date", "Ticker", price(F.col).alias("Price"), F.col("units").cast("double").alias("Volume")), bench


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with r, ma20, sd20 and vma20."""
    return returns_of(panel(spark, sf_dir))


def returns_of(p: DataFrame) -> DataFrame:
    return features.equity_features(p).select("Date", "Ticker", "Price", "Volume", "Return_raw", "Return_MA20", "Return_STD20", "Volume_MA20", "Ret_5d_fwd")


def valid_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with gaps: no price in a week of even volume for some brands, and late brands."""
    gap = (F.col("Volume").cast("long") % 7 < 2) | ((F.length("Ticker") == 8) & (F.col("Date") < F.lit("1997-01-01").cast("date")))
    return panel(spark, sf_dir).withColumn("Price", F.when(~gap, F.col("Price")))


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def dk(df: DataFrame, **named: Column) -> DataFrame:
    return df.select(F.col("Date").alias("d"), F.col("Ticker").alias("k"), *(c.alias(n) for n, c in named.items()))


PANEL = """panel AS (SELECT cast(date_trunc('week', l_shipdate) AS date) AS d, p_brand AS k,
  cast(sum(cast(l_extendedprice AS decimal(18,2))) AS double) / nullif(cast(sum(cast(l_quantity AS decimal(18,2))) AS double), 0) AS px,
  cast(sum(cast(l_quantity AS decimal(18,2))) AS double) AS vol
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
BENCH = """bench AS (SELECT cast(date_trunc('week', l_shipdate) AS date) AS d,
  cast(sum(cast(l_extendedprice AS decimal(18,2))) AS double) / nullif(cast(sum(cast(l_quantity AS decimal(18,2))) AS double), 0) AS bpx
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""
MACRO = """mac AS (SELECT cast(date_trunc('week', o_orderdate) AS date) AS d, o_orderpriority AS p,
  cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) / count(*) AS v FROM orders GROUP BY 1, 2)"""
GAPS = PANEL + """, gaps AS (SELECT d, k, vol, CASE WHEN cast(vol AS bigint) % 7 < 2 OR (length(k) = 8 AND d < DATE '1997-01-01') THEN NULL ELSE px END AS px FROM panel)"""
RET = PANEL + """, ret AS (SELECT *, px / nullif(lag(px) OVER (PARTITION BY k ORDER BY d), 0) - 1 AS r FROM panel)"""
W = "OVER (PARTITION BY k ORDER BY d)"
PAST = "OVER (PARTITION BY k ORDER BY d ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def roll(f: str, x: str, n: int, least: int) -> str:
    w = PAST.format(n=n)
    return f"CASE WHEN count({x}) {w} >= {least} THEN {f}({x}) {w} END"


FEAT = RET + f""", feat AS (SELECT *, {roll("avg", "r", 20, 10)} AS ma20, {roll("stddev_pop", "r", 20, 10)} AS sd20,
  {roll("avg", "vol", 20, 10)} AS vma20, lead(px, 5) {W} / nullif(px, 0) - 1 AS fwd FROM ret)"""


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# Rows, parsing and names


@register("scan_filter_isin", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM')")
def _(s: SparkSession, d: str) -> DataFrame:
    return rows.with_fields(table(s, d, "orders"), ("1-URGENT", "3-MEDIUM"), "o_orderpriority").select("o_orderkey", "o_orderpriority", "o_totalprice")


@register("valid_price_filter", f"WITH {GAPS} SELECT d, k, px FROM gaps WHERE px > 0")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(rows.priced(valid_week(s, d)), px=F.col("Price"))


@register("date_range_filter", f"WITH {PANEL} SELECT d, k, px FROM panel WHERE d >= DATE '1997-01-01' AND d < DATE '1998-01-01'")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(rows.between(panel(s, d), dt.date(1997, 1, 1), dt.date(1998, 1, 1)), px=F.col("Price"))


RAW = """CASE o_orderkey % 7 WHEN 0 THEN '  1,' || cast(o_orderkey AS varchar(20)) || '.5 ' WHEN 1 THEN '#N/A N/A' WHEN 2 THEN '' WHEN 3 THEN '1 ' || cast(o_orderkey AS varchar(20)) WHEN 4 THEN 'abc' WHEN 5 THEN '-' || cast(o_orderkey AS varchar(20)) || ',5' ELSE '#n/a' END"""


@register("parse_number_coerce", f"SELECT o_orderkey, CASE WHEN trim(raw) <> '' AND NOT starts_with(lower(trim(raw)), '#n/a') THEN try_cast(replace(replace(trim(raw), ' ', ''), ',', '') AS double) END AS loose, try_cast(trim(raw) AS double) AS strict FROM (SELECT o_orderkey, {RAW} AS raw FROM orders)")
def _(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "orders").select("o_orderkey", F.expr(RAW).alias("raw"))
    return raw.select("o_orderkey", C.loose_double(F.col("raw")).alias("loose"), C.to_double(F.trim("raw")).alias("strict"))


KIND = "CASE p_partkey % 4 WHEN 0 THEN ' SE Equity' WHEN 1 THEN ' Index' WHEN 2 THEN ' Curncy' ELSE '' END"
DAYS = "CASE o_orderkey % 4 WHEN 0 THEN {dmy} WHEN 1 THEN {iso} WHEN 2 THEN 'not a day' ELSE '31.02.2020' END"


@register("parse_date_dayfirst", f"SELECT o_orderkey, coalesce(cast(try_strptime(raw, '%d.%m.%Y') AS date), cast(try_strptime(raw, '%Y-%m-%d') AS date)) AS day FROM (SELECT o_orderkey, {DAYS.format(dmy="strftime(o_orderdate, '%d.%m.%Y')", iso="strftime(o_orderdate, '%Y-%m-%d')")} AS raw FROM orders)")
def _(s: SparkSession, d: str) -> DataFrame:
    raw = F.expr(DAYS.format(dmy="date_format(o_orderdate, 'dd.MM.yyyy')", iso="date_format(o_orderdate, 'yyyy-MM-dd')"))
    return table(s, d, "orders").select("o_orderkey", C.day_first(raw).alias("day"))


@register("parse_date_default", f"SELECT o_orderkey, coalesce(cast(try_strptime(raw, '%Y-%m-%d') AS date), cast(try_strptime(raw, '%d.%m.%Y') AS date)) AS day FROM (SELECT o_orderkey, {DAYS.format(dmy="strftime(o_orderdate, '%d.%m.%Y')", iso="strftime(o_orderdate, '%Y-%m-%d')")} AS raw FROM orders)")
def _(s: SparkSession, d: str) -> DataFrame:
    raw = F.expr(DAYS.format(dmy="date_format(o_orderdate, 'dd.MM.yyyy')", iso="date_format(o_orderdate, 'yyyy-MM-dd')"))
    return table(s, d, "orders").select("o_orderkey", C.iso_first(raw).alias("day"))


@register("macro_name", f"SELECT p_partkey, replace(replace(replace(t, ' Index', ''), ' Curncy', ''), ' ', '') AS name FROM (SELECT p_partkey, replace(p_brand, '#', ' ') || {KIND} AS t FROM part)")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", C.macro_name(F.expr(f"replace(p_brand, '#', ' ') || {KIND}")).alias("name"))


@register("parse_date_strict", "SELECT o_orderkey, cast(try_strptime(CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'x' END, '%Y-%m-%d') AS date) AS day FROM orders")
def _(s: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("x")
    return table(s, d, "orders").select("o_orderkey", C.to_day(raw, "yyyy-MM-dd").alias("day"))


FIELD = "CASE p_partkey % 3 WHEN 0 THEN 'BEst P/E Ratio' WHEN 1 THEN ' Last Price ' ELSE 'Dividend 12 Month Yld - Gross' END"


@register("tidy_feature_name", f"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(t), '\\s+SE Equity$', ''), '\\s+Index$', ''), '\\s+Curncy$', ''), ' ', '', 'g') || '_' || regexp_replace(trim(f), '[ /-]', '', 'g') AS name, replace(replace(replace(t, ' Index', ''), ' Curncy', ''), ' ', '') AS macro FROM (SELECT p_partkey, p_brand || {KIND} AS t, {FIELD} AS f FROM part)")
def _(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "part").select("p_partkey", F.expr(f"p_brand || {KIND}").alias("t"), F.expr(FIELD).alias("f"))
    return t.select("p_partkey", C.feature_name(F.col("t"), F.col("f")).alias("name"), C.macro_name(F.col("t")).alias("macro"))


NAMES = "CASE p_partkey % 9 WHEN 0 THEN 'PX_LAST' WHEN 1 THEN ' Ret ' WHEN 2 THEN 'Daily  Return' WHEN 3 THEN 'Adj Close' WHEN 4 THEN 'Div %' WHEN 5 THEN 'ALPHA' WHEN 6 THEN 'SMI_Ret' WHEN 7 THEN 'Last Price' ELSE p_name END"
ALIASES = ", ".join(f"('{a}', '{b}')" for a, b in C.FIELD_ALIASES.items())


@register("norm_field", f"WITH alias(a, b) AS (VALUES {ALIASES}), x AS (SELECT p_partkey, replace(regexp_replace(lower(trim(n)), '\\s+', '_', 'g'), '%', 'pct') AS x FROM (SELECT p_partkey, {NAMES} AS n FROM part)) SELECT p_partkey, coalesce(b, x) AS field FROM x LEFT JOIN alias ON a = x")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", C.field_name(F.expr(NAMES)).alias("field"))


@register("split_ticker", "SELECT p_partkey, trim(split_part(p_brand || ' SE Equity | ' || p_type, '|', 1)) AS ticker FROM part")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", C.ticker_part(F.concat("p_brand", F.lit(" SE Equity | "), "p_type")).alias("ticker"))


@register("guarded_math", f"WITH {PANEL} SELECT d, k, round(CASE WHEN px - 1500 > 0 THEN ln(px - 1500) END, 6) AS ln, round(expm1_, 6) AS expm1, px / nullif(vol % 3, 0) AS ratio, round_even(vol / 8, 2) AS even, least(greatest(px, 1400.0), 1600.0) AS held FROM (SELECT *, exp(vol / 10000) - 1 AS expm1_ FROM panel)")
def _(s: SparkSession, d: str) -> DataFrame:
    px, vol = F.col("Price"), F.col("Volume")
    return dk(panel(s, d), ln=r6(C.ln(px - 1500)), expm1=r6(F.expm1(vol / 10000)), ratio=C.ratio(px, vol % 3), even=C.half_even(vol / 8, 2), held=C.clip(px, F.lit(1400.0), F.lit(1600.0)))


@register("calendar_parts", "SELECT o_orderkey, cast(year(o_orderdate) AS int) AS y, cast(o_orderdate AS date) - 5 AS embargo, cast(cast(o_orderdate AS date) - INTERVAL 3 YEAR AS date) AS three_years, cast(cast(o_orderdate AS date) + INTERVAL 1 MONTH AS date) AS next_month, cast(date_trunc('month', o_orderdate) AS date) AS month FROM orders")
def _(s: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(s, d, "orders").select("o_orderkey", F.year(day).alias("y"), F.date_sub(day, 5).alias("embargo"), F.add_months(day, -36).alias("three_years"), F.add_months(day, 1).alias("next_month"), F.trunc(day, "MM").alias("month"))


@register("month_starts", "SELECT cast(unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS date) AS month FROM orders")
def _(s: SparkSession, d: str) -> DataFrame:
    ends = table(s, d, "orders").agg(F.trunc(F.min("o_orderdate"), "MM").alias("a"), F.trunc(F.max("o_orderdate"), "MM").alias("b"))
    return ends.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))


# Shapes and joins


@register("pivot_first", "SELECT cast(date_trunc('week', o_orderdate) AS date) AS d, " + ", ".join(f"arg_min(v, o_orderkey) FILTER (WHERE o_orderpriority = '{p}' AND v IS NOT NULL) AS \"{p}\"" for p in PRIORITIES) + " FROM (SELECT *, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS v FROM orders) WHERE v IS NOT NULL GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    long = table(s, d, "orders").select(_week("o_orderdate").alias("d"), "o_orderpriority", "o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("v"))
    return reshape.pivot_first(long, ["d"], "o_orderpriority", "v", "o_orderkey", PRIORITIES)


@register("pivot_two_keys", f"WITH {PANEL} SELECT d, k, max(px) AS px, max(vol) AS vol FROM panel GROUP BY d, k")
def _(s: SparkSession, d: str) -> DataFrame:
    tall = reshape.melt(panel(s, d), ["Date", "Ticker"], ["Price", "Volume"], "f", "v").withColumn("_seq", F.lit(0))
    return dk(reshape.pivot_first(tall, ["Date", "Ticker"], "f", "v", "_seq", ("Price", "Volume")), px=F.col("Price"), vol=F.col("Volume"))


@register("unpivot_panel", f"WITH {MACRO}, days AS (SELECT DISTINCT d FROM mac), names AS (SELECT unnest({list(PRIORITIES)}) AS p) SELECT days.d, names.p, round(v, 6) AS v FROM days CROSS JOIN names LEFT JOIN mac ON mac.d = days.d AND mac.p = names.p")
def _(s: SparkSession, d: str) -> DataFrame:
    tall = reshape.melt(macro(s, d), ["Date"], PRIORITIES, "p", "v")
    return tall.select(F.col("Date").alias("d"), "p", r6("v").alias("v"))


@register("union_rows", "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).unionByName(table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))


@register("join_inner_date", f"WITH {PANEL}, {BENCH}, {MACRO}, wide AS (SELECT d, max(v) FILTER (WHERE p = '1-URGENT') AS urgent FROM mac GROUP BY d) SELECT bench.d, round(bpx, 6) AS bpx, round(urgent, 6) AS urgent FROM bench JOIN wide ON bench.d = wide.d")
def _(s: SparkSession, d: str) -> DataFrame:
    both = joins.on_date(benchmark(s, d), macro(s, d), "inner")
    return both.select(F.col("Date").alias("d"), r6("bpx").alias("bpx"), r6(F.col("`1-URGENT`")).alias("urgent"))


@register("join_left_bench", f"WITH {PANEL}, {BENCH} SELECT panel.d, k, round(px - bpx, 6) AS over FROM panel LEFT JOIN bench ON panel.d = bench.d")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(joins.on_date(panel(s, d), benchmark(s, d)), over=r6(F.col("Price") - F.col("bpx")))


@register("join_left_macro", f"WITH {PANEL}, {MACRO} SELECT panel.d, k, round(v, 6) AS low FROM panel LEFT JOIN mac ON panel.d = mac.d AND p = '5-LOW'")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(joins.on_date(panel(s, d), macro(s, d)), low=r6(F.col("`5-LOW`")))


@register("join_scalar_aggregate", f"WITH {PANEL} SELECT d, k, round((px - m) / nullif(sd, 0), 6) AS z FROM panel CROSS JOIN (SELECT avg(px) AS m, stddev_samp(px) AS sd FROM panel)")
def _(s: SparkSession, d: str) -> DataFrame:
    p = panel(s, d)
    both = joins.with_aggregates(p, p.agg(F.avg("Price").alias("m"), F.stddev_samp("Price").alias("sd")))
    return dk(both, z=r6(C.ratio(F.col("Price") - F.col("m"), F.col("sd"))))


# Windows


@register("pct_change", f"WITH {RET} SELECT d, k, round(r, 6) AS r FROM ret")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(returns(s, d), r=r6("Return_raw"))


@register("pct_change_ffill", f"WITH {GAPS}, f AS (SELECT d, k, last_value(px IGNORE NULLS) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM gaps) SELECT d, k, round(p / nullif(lag(p) {W}, 0) - 1, 6) AS r FROM f")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(features.equity_features(valid_week(s, d)), r=r6("Return_raw"))


@register("pct_change_series", f"WITH {BENCH} SELECT d, round(bpx / nullif(lag(bpx) OVER (ORDER BY d), 0) - 1, 6) AS r, round(lead(bpx, 5) OVER (ORDER BY d) / nullif(bpx, 0) - 1, 6) AS fwd FROM bench")
def _(s: SparkSession, d: str) -> DataFrame:
    b = features.benchmark_returns(benchmark(s, d), "bpx")
    return b.select(F.col("Date").alias("d"), r6("Bench_Return_raw").alias("r"), r6("Bench_Ret_5d_fwd").alias("fwd"))


@register("fwd_return_5", f"WITH {FEAT} SELECT d, k, round(fwd, 6) AS fwd FROM feat")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(returns(s, d), fwd=r6("Ret_5d_fwd"))


@register("fwd_return_5_compat", f"WITH {PANEL} SELECT d, k, round(px / nullif(lead(px, 5) {W}, 0) - 1, 6) AS fwd FROM panel")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(features.equity_features(panel(s, d), compat=True), fwd=r6("Ret_5d_fwd"))


@register("lag_1_5", f"WITH {RET} SELECT d, k, round(lag(r) {W}, 6) AS lag1, round(lag(r, 5) {W}, 6) AS lag5 FROM ret")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(features.equity_features(panel(s, d)), lag1=r6("Return_lag1"), lag5=r6("Return_lag5"))


@register("level_lags", f"WITH {PANEL} SELECT d, k, lag(px) {W} AS yield_lag1, lag(vol) {W} AS cap_lag1 FROM panel")
def _(s: SparkSession, d: str) -> DataFrame:
    f = features.equity_features(panel(s, d).withColumns({"DivYld12m": F.col("Price"), "MktCap": F.col("Volume")}))
    return dk(f, yield_lag1=F.col("DivYld12m_lag1"), cap_lag1=F.col("MktCap_lag1"))


@register("rolling_mean_5_10_20", f"WITH {RET} SELECT d, k, round({roll('avg', 'r', 5, 3)}, 6) AS ma5, round({roll('avg', 'r', 10, 5)}, 6) AS ma10, round({roll('avg', 'r', 20, 10)}, 6) AS ma20 FROM ret")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(features.equity_features(panel(s, d)), ma5=r6("Return_MA5"), ma10=r6("Return_MA10"), ma20=r6("Return_MA20"))


@register("rolling_std_pop", f"WITH {RET} SELECT d, k, round({roll('stddev_pop', 'r', 5, 3)}, 6) AS sd5, round({roll('stddev_pop', 'r', 10, 5)}, 6) AS sd10, round({roll('stddev_pop', 'r', 20, 10)}, 6) AS sd20 FROM ret")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(features.equity_features(panel(s, d)), sd5=r6("Return_STD5"), sd10=r6("Return_STD10"), sd20=r6("Return_STD20"))


@register("rolling_std_samp", f"WITH {RET} SELECT d, k, round({roll('avg', 'r', 5, 5)}, 6) AS ma5, round({roll('stddev_samp', 'r', 5, 5)}, 6) AS sd5, round({roll('stddev_samp', 'r', 20, 20)}, 6) AS sd20 FROM ret")
def _(s: SparkSession, d: str) -> DataFrame:
    w, r = by_ticker("Ticker"), F.col("Return_raw")
    return dk(returns(s, d), ma5=r6(windows.rolling(F.avg, r, w, 5, 5)), sd5=r6(windows.rolling(F.stddev_samp, r, w, 5, 5)), sd20=r6(windows.rolling(F.stddev_samp, r, w, 20, 20)))


@register("realized_vol_ann", f"WITH {RET} SELECT d, k, round({roll('stddev_pop', 'r', 20, 10)} * sqrt(252), 6) AS vol FROM ret")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(features.equity_features(panel(s, d)), vol=r6("RealizedVol20_ann"))


@register("return_z20", f"WITH {FEAT} SELECT d, k, round((lag(r) {W} - ma20) / nullif(sd20, 0), 6) AS z FROM feat")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(features.equity_features(panel(s, d)), z=r6("Return_Z20"))


@register("volume_ma20", f"WITH {FEAT} SELECT d, k, round(vma20, 6) AS vma20 FROM feat")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(returns(s, d), vma20=r6("Volume_MA20"))


@register("volume_to_ma20", f"WITH {FEAT} SELECT d, k, round(lag(vol / nullif(vma20, 0)) {W}, 6) AS v FROM feat")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(features.equity_features(panel(s, d)), v=r6("Volume_to_MA20"))


EXCESS = RET + f""", {BENCH}, b AS (SELECT d, bpx / nullif(lag(bpx) OVER (ORDER BY d), 0) - 1 AS br, lead(bpx, 5) OVER (ORDER BY d) / nullif(bpx, 0) - 1 AS bf FROM bench),
  x AS (SELECT ret.d, k, px, r, br, r - br AS e, lead(px, 5) {W.replace('ORDER BY d', 'ORDER BY ret.d')} / nullif(px, 0) - 1 - bf AS target FROM ret LEFT JOIN b ON ret.d = b.d)"""


def excess(s: SparkSession, d: str, compat: bool = False) -> DataFrame:
    return features.with_benchmark(returns(s, d), features.benchmark_returns(benchmark(s, d), "bpx"), compat)


@register("excess_ret_lag", f"WITH {EXCESS} SELECT d, k, round(lag(e) {W}, 6) AS e FROM x")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(excess(s, d), e=r6("Excess_ret"))


@register("excess_ret_lag_compat", f"WITH {EXCESS} SELECT d, k, round(lag(e) OVER (ORDER BY k, d), 6) AS e FROM x")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(excess(s, d, compat=True), e=r6("Excess_ret"))


@register("target_excess_simple", f"WITH {EXCESS} SELECT d, k, round(target, 6) AS target FROM x")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(excess(s, d), target=r6("Excess_5d_fwd"))


FRAME5 = "OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"


@register("target_excess_log5", f"WITH {EXCESS}, l AS (SELECT *, ln(1 + r + 1e-12) - ln(1 + br + 1e-12) AS g FROM x) SELECT d, k, round(CASE WHEN count(g) {FRAME5} = 5 THEN exp(sum(g) {FRAME5}) - 1 END, 6) AS target FROM l")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(excess(s, d), target=r6(windows.log_target(F.col("Return_raw"), F.col("Bench_Return_raw"), by_ticker("Ticker"))))


@register("target_from_excess_log5", f"WITH {EXCESS}, l AS (SELECT *, ln(1 + e + 1e-12) AS g FROM x) SELECT d, k, round(CASE WHEN count(g) {FRAME5} = 5 THEN exp(sum(g) {FRAME5}) - 1 END, 6) AS target FROM l")
def _(s: SparkSession, d: str) -> DataFrame:
    e = F.col("Return_raw") - F.col("Bench_Return_raw")
    return dk(excess(s, d), target=r6(windows.log_target(e, None, by_ticker("Ticker"))))


SERIES = MACRO + ", days AS (SELECT DISTINCT d FROM mac), u AS (SELECT days.d, v FROM days LEFT JOIN mac ON mac.d = days.d AND p = '2-HIGH'), g AS (SELECT *, ln(v) - ln(lag(v) OVER (ORDER BY d)) AS g FROM u)"


@register("macro_lags", f"WITH {SERIES} SELECT d, round(lag(v) OVER (ORDER BY d), 6) AS lag1, round(lag(v, 5) OVER (ORDER BY d), 6) AS lag5 FROM u")
def _(s: SparkSession, d: str) -> DataFrame:
    m = features.macro_lags(macro(s, d), ["2-HIGH"])
    return m.select(F.col("Date").alias("d"), r6(F.col("`2-HIGH_lag1`")).alias("lag1"), r6(F.col("`2-HIGH_lag5`")).alias("lag5"))


@register("macro_own_lags", f"WITH {MACRO}, days AS (SELECT DISTINCT d FROM mac)" + "".join(f", u{i} AS (SELECT days.d, v FROM days LEFT JOIN mac ON mac.d = days.d AND p = '{p}'), l{i} AS (SELECT d, round(lag(v) OVER (ORDER BY d), 6) AS l1, round(lag(v, 5) OVER (ORDER BY d), 6) AS l5 FROM u{i})" for i, p in enumerate(PRIORITIES)) + " SELECT l0.d, " + ", ".join(f'l{i}.l1 AS "{p}_lag1", l{i}.l5 AS "{p}_lag5"' for i, p in enumerate(PRIORITIES)) + " FROM l0" + "".join(f" JOIN l{i} ON l{i}.d = l0.d" for i in range(1, len(PRIORITIES))))
def _(s: SparkSession, d: str) -> DataFrame:
    m = features.macro_lags(macro(s, d), PRIORITIES)
    return m.select(F.col("Date").alias("d"), *(r6(F.col(f"`{c}`")).alias(c) for c in m.columns if c != "Date"))


@register("benchmark_resolver", f"WITH {BENCH}, f AS (SELECT d, CASE WHEN day(d) % 5 <> 0 THEN bpx END AS c FROM bench), g AS (SELECT d, last_value(c IGNORE NULLS) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM f) SELECT d, round(c / nullif(lag(c) OVER (ORDER BY d), 0) - 1, 6) AS smi_return FROM g")
def _(s: SparkSession, d: str) -> DataFrame:
    close = F.when(F.dayofmonth("Date") % 5 != 0, F.col("bpx")).cast("string")
    wide = benchmark(s, d).select(F.date_format("Date", "dd.MM.yyyy").alias("Date"), F.lit("x").alias("Name"), close.alias("Close"))
    return features.benchmark_series(wide).select(F.col("Date").alias("d"), r6("smi_return").alias("smi_return"))


@register("join_left_fields", f"WITH {GAPS}, days AS (SELECT DISTINCT d FROM gaps), ks AS (SELECT DISTINCT k FROM gaps) SELECT days.d, ks.k, px, vol FROM days CROSS JOIN ks LEFT JOIN gaps ON gaps.d = days.d AND gaps.k = ks.k")
def _(s: SparkSession, d: str) -> DataFrame:
    long = valid_week(s, d).withColumn("_seq", F.lit(0))
    names = sorted(r[0] for r in long.select("Ticker").distinct().collect())  # the wide table's columns
    wide = long.groupBy("Date").pivot("Ticker", names).agg(F.first("Price").alias("Last Price"), F.first("Volume").alias("Volume"))
    fields = {f: [f"{k}_{f}" for k in names] for f in ("Last Price", "Volume")}
    out = reshape.panel_of_fields(wide, "Date", fields, F.split_part(F.col("instrument"), F.lit("_"), F.lit(1)))
    return dk(out, px=F.col("Last Price"), vol=F.col("Volume"))


@register("macro_logdiff", f"WITH {SERIES} SELECT d, round(lag(g) OVER (ORDER BY d), 6) AS g FROM g")
def _(s: SparkSession, d: str) -> DataFrame:
    return features.macro_features(macro(s, d), ["2-HIGH"]).select(F.col("Date").alias("d"), r6(F.col("`2-HIGH__logdiff1`")).alias("g"))


@register("macro_chgstd20", f"WITH {SERIES} SELECT d, round(CASE WHEN count(g) OVER w >= 10 THEN stddev_pop(g) OVER w END, 6) AS sd FROM g WINDOW w AS (ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
def _(s: SparkSession, d: str) -> DataFrame:
    return features.macro_features(macro(s, d), ["2-HIGH"]).select(F.col("Date").alias("d"), r6(F.col("`2-HIGH__chgstd20`")).alias("sd"))


def rank_sql(x: str, desc: str = "") -> str:
    return f"round(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY d ORDER BY {x} {desc} NULLS LAST) + (count(*) OVER (PARTITION BY d, {x}) - 1) / 2.0) / nullif(count({x}) OVER (PARTITION BY d), 0) END, 6)"


@register("xs_rank_pct", f"WITH {FEAT} SELECT d, k, {rank_sql('ma20')} AS by_ma, {rank_sql('sd20')} AS by_sd, {rank_sql('vma20', 'DESC')} AS by_vol FROM feat")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(features.with_ranks(returns(s, d)), by_ma=r6("Rank_MA20"), by_sd=r6("Rank_LowVol20"), by_vol=r6("Rank_Liquidity"))


@register("xs_rank_ties", f"WITH {PANEL}, t AS (SELECT d, k, CASE WHEN vol > 20 THEN floor(vol / 50) END AS x FROM panel) SELECT d, k, {rank_sql('x')} AS up, {rank_sql('x', 'DESC')} AS down FROM t")
def _(s: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("Volume") > 20, F.floor(F.col("Volume") / 50))
    return dk(panel(s, d).withColumn("x", x), up=r6(windows.share_rank(F.col("x"))), down=r6(windows.share_rank(F.col("x"), descending=True)))


# Cleaning and profiles

FILL = "last_value(px IGNORE NULLS) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@register("ffill_group", f"WITH {GAPS} SELECT d, k, {FILL} AS px FROM gaps")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(valid_week(s, d), px=windows.filled(F.col("Price"), by_ticker("Ticker")))


@register("impute_ffill_roll5", f"WITH {GAPS}, f AS (SELECT d, k, {FILL} AS p FROM gaps) SELECT d, k, round(avg(p) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS px FROM f")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(clean.impute(valid_week(s, d), ["Price"]), px=r6("Price"))


@register("winsorize_3sd", f"WITH {RET} SELECT d, k, round(CASE WHEN r IS NULL OR sd IS NULL OR sd = 0 THEN r ELSE least(greatest(r, m - 3 * sd), m + 3 * sd) END, 6) AS r FROM ret CROSS JOIN (SELECT avg(r) AS m, stddev_samp(r) AS sd FROM ret)")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(clean.winsorise(returns(s, d).select("Date", "Ticker", "Return_raw"), ["Return_raw"]), r=r6("Return_raw"))


NUMBERS = FEAT + ", num AS (SELECT d, k, px, vol, r, ma20, sd20, fwd, px * 2 + 1 AS twin, CASE WHEN px IS NOT NULL THEN 1.0 END AS flat FROM feat)"
COLUMNS = ("px", "vol", "r", "ma20", "sd20", "fwd", "twin", "flat")


def numbers(s: SparkSession, d: str) -> DataFrame:
    return dk(returns(s, d), px=F.col("Price"), vol=F.col("Volume"), r=F.col("Return_raw"), ma20=F.col("Return_MA20"), sd20=F.col("Return_STD20"), fwd=F.col("Ret_5d_fwd"), twin=F.col("Price") * 2 + 1, flat=F.when(F.col("Price").isNotNull(), 1.0))


def corr_sql(a: str, b: str) -> str:
    return f"CASE WHEN regr_count({a}, {b}) > 0 AND stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) > 1e-9 AND stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END) > 1e-9 THEN corr({a}, {b}) END"


PAIRS = NUMBERS + ", pairs AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {i} AS pos_a, {j} AS pos_b, {corr_sql(a, b)} AS corr FROM num" for i, a in enumerate(COLUMNS) for j, b in enumerate(COLUMNS) if i < j) + ")"


@register("corr_pairs", f"WITH {PAIRS} SELECT a, b, round(corr, 6) AS corr FROM pairs")
def _(s: SparkSession, d: str) -> DataFrame:
    return profile.correlations(numbers(s, d), COLUMNS).select("a", "b", r6("corr").alias("corr"))


@register("corr_drop_candidates", f"WITH {PAIRS} SELECT DISTINCT b AS \"column\" FROM pairs WHERE abs(corr) > 0.95")
def _(s: SparkSession, d: str) -> DataFrame:
    return clean.explained(profile.correlations(numbers(s, d), COLUMNS))


@register("corr_strong_mask", f"WITH {PAIRS} SELECT a, b, round(corr, 6) AS corr FROM pairs WHERE abs(corr) >= 0.7")
def _(s: SparkSession, d: str) -> DataFrame:
    return profile.strong(profile.correlations(numbers(s, d), COLUMNS)).select("a", "b", r6("corr").alias("corr"))


@register("corr_matrix", f"WITH {PAIRS} SELECT a AS row, b AS \"column\", round(corr, 6) AS corr FROM pairs UNION ALL SELECT b, a, round(corr, 6) FROM pairs" + "".join(f" UNION ALL SELECT '{a}', '{a}', CASE WHEN var_pop({a}) > 0 THEN 1.0 END FROM num" for a in COLUMNS))
def _(s: SparkSession, d: str) -> DataFrame:
    return profile.matrix(numbers(s, d), COLUMNS).withColumn("corr", r6("corr"))


@register("corr_pairs_tiled", ORACLE_SQL["corr_pairs"])
def _(s: SparkSession, d: str) -> DataFrame:
    return profile.correlations(numbers(s, d), COLUMNS, tile=3).select("a", "b", r6("corr").alias("corr"))


@register("ticker_correlations", f"WITH {RET} SELECT x.k AS a, y.k AS b, round({corr_sql('x.r', 'y.r')}, 6) AS corr FROM ret x JOIN ret y ON x.d = y.d AND x.k < y.k GROUP BY x.k, y.k")
def _(s: SparkSession, d: str) -> DataFrame:
    r = returns(s, d).select("Date", "Ticker", "Return_raw", F.lit(0).alias("_seq"))
    wide = reshape.pivot_first(r, ["Date"], "Ticker", "Return_raw", "_seq")
    return profile.correlations(wide, [c for c in wide.columns if c != "Date"], tile=10).select("a", "b", r6("corr").alias("corr"))


@register("leak_check_topk", f"WITH {NUMBERS}, c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS \"column\", {corr_sql(a, 'fwd')} AS corr FROM num" for a in COLUMNS) + ") SELECT \"column\", round(corr, 6) AS corr FROM c ORDER BY abs(corr) DESC NULLS LAST, \"column\" LIMIT 5")
def _(s: SparkSession, d: str) -> DataFrame:
    c = profile.target_correlations(numbers(s, d), COLUMNS, "fwd")
    return rows.top(c, 5, F.abs("corr").desc_nulls_last(), "column").select("column", r6("corr").alias("corr"))


@register("dup_count", "SELECT count(*) AS n_rows, (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS n_duplicates FROM lineitem")
def _(s: SparkSession, d: str) -> DataFrame:
    return profile.duplicates(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("null_ratio_topk", f"WITH {NUMBERS}, c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS \"column\", avg(CASE WHEN {a} IS NULL THEN 1.0 ELSE 0.0 END) AS s FROM num" for a in COLUMNS) + ") SELECT \"column\", round(s, 6) AS null_share FROM c ORDER BY s DESC, \"column\" LIMIT 5")
def _(s: SparkSession, d: str) -> DataFrame:
    return rows.top(profile.null_shares(numbers(s, d), COLUMNS), 5, F.desc("null_share"), "column").select("column", r6("null_share").alias("null_share"))


OUT = NUMBERS + ", c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS \"column\", avg(CASE WHEN abs(({a} - m) / nullif(sd, 0)) > 2.5 THEN 1.0 ELSE 0.0 END) AS s FROM num CROSS JOIN (SELECT avg({a}) AS m, stddev_samp({a}) AS sd FROM num)" for a in COLUMNS) + ")"


@register("outlier_ratio_sd", f"WITH {OUT} SELECT \"column\", round(s, 6) AS outlier_share FROM c")
def _(s: SparkSession, d: str) -> DataFrame:
    return profile.outlier_shares(numbers(s, d), COLUMNS, 2.5).select("column", r6("outlier_share").alias("outlier_share"))


@register("profile_summary", f"WITH {OUT} SELECT count(*) AS n_columns, count(CASE WHEN s > 0 THEN 1 END) AS n_above_zero, round(avg(s), 6) AS mean_share FROM c")
def _(s: SparkSession, d: str) -> DataFrame:
    return profile.summary(profile.outlier_shares(numbers(s, d), COLUMNS, 2.5), "outlier_share").withColumn("mean_share", r6("mean_share"))


@register("nan_ratio_column_drop", f"WITH {GAPS} SELECT d, k, vol FROM gaps")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(rows.without_sparse_columns(valid_week(s, d), 0.2, ("Date", "Ticker")), vol=F.col("Volume"))


@register("dropna_required", f"WITH {FEAT} SELECT d, k, round(fwd, 6) AS fwd FROM feat WHERE fwd IS NOT NULL AND ma20 IS NOT NULL AND sd20 IS NOT NULL")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(rows.complete(returns(s, d), ["Ret_5d_fwd", "Return_MA20", "Return_STD20", "absent"]), fwd=r6("Ret_5d_fwd"))


@register("ticker_share", "SELECT p_brand, count(*) AS n, round_even(count(*) / cast(sum(count(*)) OVER () AS double), 4) AS share FROM part GROUP BY p_brand")
def _(s: SparkSession, d: str) -> DataFrame:
    return profile.shares(table(s, d, "part"), "p_brand")


VALID = GAPS + ", valid AS (SELECT * FROM gaps WHERE px > 0), span AS (SELECT k, min(d) AS first_day, max(d) AS last_day, count(DISTINCT d) AS obs_days FROM valid GROUP BY k)"


def valid(s: SparkSession, d: str) -> DataFrame:
    return rows.priced(valid_week(s, d))


@register("coverage_span", f"WITH {VALID} SELECT k, first_day, last_day, obs_days, cast(last_day - first_day + 1 AS int) AS calendar_days, round((last_day - first_day + 1) / 365.0, 6) AS years FROM span")
def _(s: SparkSession, d: str) -> DataFrame:
    return profile.coverage(valid(s, d)).withColumnRenamed("Ticker", "k").withColumn("years", r6("years"))


@register("late_ipo", f"WITH {VALID} SELECT k, first_day FROM span WHERE first_day > (SELECT min(d) FROM valid)")
def _(s: SparkSession, d: str) -> DataFrame:
    return profile.late_starts(valid(s, d)).withColumnRenamed("Ticker", "k")


@register("short_history", f"WITH {VALID} SELECT k, obs_days FROM span WHERE obs_days < 200")
def _(s: SparkSession, d: str) -> DataFrame:
    return profile.short_histories(valid(s, d), 200).withColumnRenamed("Ticker", "k")


@register("active_per_day", f"WITH {VALID} SELECT d, count(DISTINCT k) AS n_active FROM valid GROUP BY d")
def _(s: SparkSession, d: str) -> DataFrame:
    return profile.active_per_day(valid(s, d)).withColumnRenamed("Date", "d")


@register("train_start_reco", f"WITH {VALID}, a AS (SELECT d, count(DISTINCT k) AS n FROM valid GROUP BY d) SELECT min(d) AS train_start FROM a WHERE n >= (SELECT round_even(0.9 * max(n), 0) FROM a)")
def _(s: SparkSession, d: str) -> DataFrame:
    return profile.training_start(valid(s, d))


@register("tickers_per_day", f"WITH {VALID}, a AS (SELECT d, count(DISTINCT k) AS n FROM valid GROUP BY d) SELECT min(n) AS min_per_day, round(avg(n), 6) AS avg_per_day, max(n) AS max_per_day, (SELECT count(DISTINCT k) FROM valid) AS n_tickers FROM a")
def _(s: SparkSession, d: str) -> DataFrame:
    return profile.tickers_per_day(valid(s, d)).withColumn("avg_per_day", r6("avg_per_day"))


@register("feature_bias_stats", f"""WITH {FEAT}, t AS (SELECT k, 'px' AS feature, px AS v FROM feat UNION ALL SELECT k, 'vol', vol FROM feat), v AS (SELECT * FROM t WHERE v IS NOT NULL),
  g AS (SELECT feature, avg(v) AS gm, stddev_samp(v) AS gs FROM v GROUP BY feature),
  p AS (SELECT feature, k, round_even(avg(v), 5) AS mean, round_even(stddev_samp(v), 5) AS std, round_even(min(v), 5) AS min, round_even(max(v), 5) AS max, round_even(median(v), 5) AS median, count(v) AS non_null FROM v GROUP BY feature, k)
  SELECT p.feature, k, round(mean, 3) AS mean, round(std, 3) AS std, round(min, 4) AS min, round(max, 4) AS max, round(median, 4) AS median, non_null, round((mean - gm) / nullif(gs, 0), 1) + 0.0 AS shift, round(std / nullif(mean, 0), 2) AS cv FROM p JOIN g ON p.feature = g.feature""")
def _(s: SparkSession, d: str) -> DataFrame:
    b = profile.feature_bias(numbers(s, d).withColumnRenamed("k", "Ticker"), ["px", "vol"])
    digits = {"mean": 3, "std": 3, "min": 4, "max": 4, "median": 4}
    shift = F.round(C.ratio(F.col("mean") - F.col("global_mean"), F.col("global_std")), 1) + 0.0
    return b.select("feature", F.col("Ticker").alias("k"), *(r6(c, n).alias(c) for c, n in digits.items()), "non_null", shift.alias("shift"), F.round(C.ratio(F.col("std"), F.col("mean")), 2).alias("cv"))


@register("skew_log1p_choice", f"WITH {NUMBERS}, c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS feature, min({a}) AS least, CASE WHEN count({a}) > 2 AND stddev_pop({a}) > 0 THEN skewness({a}) END AS skew, count({a}) AS n FROM num" for a in COLUMNS[:6]) + ") SELECT feature, round(least, 6) AS least, round(skew, 4) AS skew, n FROM c")
def _(s: SparkSession, d: str) -> DataFrame:
    return scale.skew_figures(numbers(s, d), COLUMNS[:6]).select("feature", r6("least").alias("least"), r6("skew", 4).alias("skew"), "n")


@register("log1p_apply", f"WITH {FEAT} SELECT d, k, round(ln(1 + vol), 6) AS vol, round(r, 6) AS r FROM feat")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(scale.apply_log(returns(s, d).select("Date", "Ticker", "Volume", "Return_raw"), ["Volume", "Return_raw"]), vol=r6("Volume"), r=r6("Return_raw"))


@register("count_per_year", f"WITH {VALID} SELECT k, cast(year(d) AS int) AS y, count(px) AS n FROM valid GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    return valid(s, d).groupBy(F.col("Ticker").alias("k"), F.year("Date").alias("y")).agg(F.count("Price").alias("n"))


# P24, P25, F-10, R9 and the panel's orders


@register("fixed_digits", f"WITH {FEAT} SELECT d, k, CASE WHEN r IS NULL THEN '' ELSE printf('%.3f', vol / 4) END AS quarter FROM feat")
def _(s: SparkSession, d: str) -> DataFrame:
    return numbers(s, d).select("d", "k", C.text_number(F.when(F.col("r").isNotNull(), F.col("vol") / 4), 3).alias("quarter"))


KIND_COLUMNS = ("l_quantity", "l_tax", "l_orderkey", "l_shipdate", "l_returnflag")


@register("column_kinds", "WITH t AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {f}::BOOLEAN AS feature, {n}::BOOLEAN AS number, {k}::BOOLEAN AS kept, cast({c} AS varchar) AS v FROM lineitem" for c, f, n, k in (("l_quantity", 1, 1, 1), ("l_tax", 1, 1, 0), ("l_orderkey", 0, 1, 1), ("l_shipdate", 0, 0, 1), ("l_returnflag", 0, 0, 1))) + ") SELECT \"column\", any_value(feature) AS feature, any_value(number) AS number, any_value(kept) AS kept, count(v) AS n, CASE WHEN count(v) = 0 THEN 'empty' WHEN min(v) = max(v) THEN 'constant' WHEN count(try_cast(v AS double)) = count(v) THEN 'number' WHEN count(try_cast(v AS timestamp)) = count(v) THEN 'date' ELSE 'text' END AS kind FROM t GROUP BY \"column\"")
def _(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "lineitem").select(*KIND_COLUMNS)
    found, whole, kept = clean.feature_columns(items, ids=("l_orderkey",)), clean.numeric_columns(items), rows.not_matching(items.columns, ["tax$", ""])
    c = F.col("column")
    return clean.kinds(items).select("column", c.isin(found).alias("feature"), c.isin(whole).alias("number"), c.isin(kept).alias("kept"), "n", "kind")


def placed(df: DataFrame, *by: str) -> DataFrame:
    """Each row of the panel with its place in the order."""
    return order.positions(df.select("Ticker", "Date"), by).select(F.col("Ticker").alias("k"), F.col("Date").alias("d"), (F.col("position") + 1).alias("place"))


@register("sort_ticker_date", f"WITH {PANEL} SELECT k, d, row_number() OVER (ORDER BY k, d) AS place FROM panel")
def _(s: SparkSession, d: str) -> DataFrame:
    return placed(panel(s, d), "Ticker", "Date")


@register("sort_date_ticker", f"WITH {PANEL} SELECT k, d, row_number() OVER (ORDER BY d, k) AS place FROM panel")
def _(s: SparkSession, d: str) -> DataFrame:
    return placed(panel(s, d), "Date", "Ticker")


@register("first_dates_sorted", f"WITH {VALID} SELECT k, first_day FROM span ORDER BY first_day, k")
def _(s: SparkSession, d: str) -> DataFrame:
    return profile.coverage(valid(s, d)).select(F.col("Ticker").alias("k"), "first_day").orderBy("first_day", "k")


@register("topn_rows", f"WITH {VALID} SELECT d, k, px FROM valid WHERE k = 'Brand#12' ORDER BY d LIMIT 10")
def _(s: SparkSession, d: str) -> DataFrame:
    return rows.top(dk(valid(s, d).where("Ticker = 'Brand#12'"), px=F.col("Price")), 10, "d")


@register("distinct_tickers", "SELECT count(DISTINCT p_brand) AS n FROM part")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").agg(F.countDistinct("p_brand").alias("n"))


# Splits and scaling


def splits_sql(mode: str) -> str:
    start = "cast(ts - 5 - INTERVAL 3 YEAR AS date)" if mode == "rolling" else "gmin"
    return FEAT + f""", b AS (SELECT min(d) AS gmin, max(d) AS gmax FROM feat),
  m AS (SELECT cast(unnest(generate_series(date_trunc('month', gmin), date_trunc('month', gmax), INTERVAL 1 MONTH)) AS date) AS ts, gmin FROM b),
  c AS (SELECT {start} AS train_start, cast(ts - 5 AS date) AS train_end, ts AS test_start, cast(ts + INTERVAL 1 MONTH AS date) AS test_end FROM m WHERE ts >= DATE '{SPLIT_START}' AND ts - 5 > gmin),
  s AS (SELECT cast(row_number() OVER (ORDER BY test_start) - 1 AS int) AS split_id, * FROM c WHERE EXISTS (SELECT 1 FROM feat WHERE feat.d >= test_start AND feat.d < test_end)),
  a AS (SELECT split_id, 'train' AS part, feat.* FROM feat JOIN s ON feat.d >= train_start AND feat.d < train_end UNION ALL SELECT split_id, 'test', feat.* FROM feat JOIN s ON feat.d >= test_start AND feat.d < test_end)"""


def splits(df: DataFrame, mode: str = "rolling") -> list[split.Split]:
    return split.with_tests(df, split.make_splits(*split.bounds(df), SPLIT_START, mode=mode))


def features_panel(s: SparkSession, d: str) -> DataFrame:
    """(Date, Ticker, *FEATURES)."""
    return returns(s, d).select("Date", "Ticker", F.col("Price").alias("px"), F.col("Volume").alias("vol"), F.col("Return_raw").alias("r"), F.col("Return_MA20").alias("ma20"), F.col("Return_STD20").alias("sd20"))


def assigned(s: SparkSession, d: str, mode: str = "rolling") -> DataFrame:
    return split.assign(features_panel(s, d), splits(panel(s, d), mode))


@register("make_splits_rolling", f"WITH {splits_sql('rolling')} SELECT * FROM s")
def _(s: SparkSession, d: str) -> DataFrame:
    p = panel(s, d)
    return split.table(p, splits(p))


@register("make_splits_expanding", f"WITH {splits_sql('expanding')} SELECT * FROM s")
def _(s: SparkSession, d: str) -> DataFrame:
    p = panel(s, d)
    return split.table(p, splits(p, "expanding"))


@register("split_membership_counts", f"WITH {splits_sql('rolling')} SELECT split_id, part, count(*) AS n_rows, count(DISTINCT d) AS n_days, min(d) AS first_day, max(d) AS last_day FROM a GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    return split.part_figures(assigned(s, d))


WARM = f""", ok AS (SELECT split_id, k FROM a WHERE part = 'train' GROUP BY 1, 2 HAVING count(DISTINCT d) >= {LEAST_DAYS}),
  kept AS (SELECT a.* FROM a LEFT JOIN ok ON a.split_id = ok.split_id AND a.k = ok.k WHERE part = 'train' OR ok.k IS NOT NULL)"""


@register("cold_start_filter", f"WITH {splits_sql('rolling')}{WARM} SELECT split_id, part, count(*) AS n_rows, count(DISTINCT k) AS n_tickers FROM kept GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    return split.warm(assigned(s, d), LEAST_DAYS).groupBy("split_id", "part").agg(F.count("*").alias("n_rows"), F.countDistinct("Ticker").alias("n_tickers"))


@register("split_shares", f"WITH {splits_sql('rolling')} SELECT split_id, part, k, round(count(*) / cast(sum(count(*)) OVER (PARTITION BY split_id, part) AS double), 6) AS share FROM a GROUP BY 1, 2, 3")
def _(s: SparkSession, d: str) -> DataFrame:
    return split.part_shares(assigned(s, d)).select("split_id", "part", F.col("Ticker").alias("k"), r6("share").alias("share"))


FIT = ", fit AS (SELECT split_id, k, " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES) + " FROM a WHERE part = 'train' GROUP BY 1, 2)"


@register("scaler_stats", f"WITH {splits_sql('rolling')}{FIT} " + " UNION ALL ".join(f"SELECT split_id, k, '{c}' AS feature, round(m_{c}, 6) AS mean, round(s_{c}, 6) AS std FROM fit" for c in FEATURES))
def _(s: SparkSession, d: str) -> DataFrame:
    return scale.long_stats(scale.fit(assigned(s, d), FEATURES), FEATURES).select("split_id", F.col("Ticker").alias("k"), "feature", r6("mean").alias("mean"), r6("std").alias("std"))


@register("zscore_scaled", f"WITH {splits_sql('rolling')}{FIT} SELECT a.split_id, part, d, a.k, " + ", ".join(f"round(CASE WHEN s_{c} = 0 AND {c} IS NOT NULL THEN 0 ELSE ({c} - m_{c}) / nullif(s_{c}, 0) END, 5) AS {c}" for c in FEATURES) + " FROM a LEFT JOIN fit ON a.split_id = fit.split_id AND a.k = fit.k")
def _(s: SparkSession, d: str) -> DataFrame:
    a = assigned(s, d)
    z = scale.transform(a, scale.fit(a, FEATURES), FEATURES)
    return z.select("split_id", "part", F.col("Date").alias("d"), F.col("Ticker").alias("k"), *(r6(c, 5).alias(c) for c in FEATURES))


@register("scaler_stats_by_dates", ORACLE_SQL["scaler_stats"])
def _(s: SparkSession, d: str) -> DataFrame:
    f = scale.fit_by_dates(features_panel(s, d), splits(panel(s, d)), FEATURES)
    return scale.long_stats(f, FEATURES).select("split_id", F.col("Ticker").alias("k"), "feature", r6("mean").alias("mean"), r6("std").alias("std"))


SKEWED = "vol * vol * vol"
LOGGED = f", t AS (SELECT *, {SKEWED} / 1e6 AS cube FROM feat), lg AS (SELECT " + ", ".join(f"min({c}) >= 0 AND skewness({c}) > 1 AS l_{c}, min({c}) >= -1e-12 AS o_{c}" for c in ("px", "cube", "r")) + " FROM t), grown AS (SELECT t.d, t.k, " + ", ".join(f"CASE WHEN l_{c} AND o_{c} THEN ln(1 + greatest({c}, 0)) ELSE {c} END AS {c}" for c in ("px", "cube", "r")) + " FROM t, lg)"
SCALED = splits_sql("rolling") + LOGGED + """, ga AS (SELECT split_id, 'train' AS part, grown.* FROM grown JOIN s ON grown.d >= train_start AND grown.d < train_end UNION ALL SELECT split_id, 'test', grown.* FROM grown JOIN s ON grown.d >= test_start AND grown.d < test_end),
  gf AS (SELECT split_id, k, """ + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in ("px", "cube", "r")) + " FROM ga WHERE part = 'train' GROUP BY 1, 2)"


@register("scale_all_splits", f"WITH {SCALED} SELECT ga.split_id, part, d, ga.k, " + ", ".join(f"round(coalesce(CASE WHEN s_{c} = 0 AND {c} IS NOT NULL THEN 0 ELSE ({c} - m_{c}) / nullif(s_{c}, 0) END, 0), 5) AS {c}" for c in ("px", "cube", "r")) + " FROM ga LEFT JOIN gf ON ga.split_id = gf.split_id AND ga.k = gf.k")
def _(s: SparkSession, d: str) -> DataFrame:
    whole = features_panel(s, d).select("Date", "Ticker", "px", F.expr(f"{SKEWED} / 1e6").alias("cube"), "r")
    made = splits(panel(s, d))
    o = workflow.ScaleOptions(include_cols=("px", "cube", "r"), price_col="", auto_log1p=True, impute_na=0.0)
    z, _, _ = workflow.scale_panel(split.assign(whole, made), o, whole, made)
    return z.select("split_id", "part", F.col("Date").alias("d"), F.col("Ticker").alias("k"), *(r6(c, 5).alias(c) for c in ("px", "cube", "r")))


BRANDS = [f"Brand#{i}{j}" for i in range(1, 6) for j in range(1, 6)]
SHARES = ", sh AS (SELECT split_id, part, k, count(*) / cast(sum(count(*)) OVER (PARTITION BY split_id, part) AS double) AS share FROM a GROUP BY 1, 2, 3), fg AS (SELECT split_id, " + ", ".join(f"count(CASE WHEN part = '{p}' THEN 1 END) AS {p}_rows, count(DISTINCT CASE WHEN part = '{p}' THEN d END) AS {p}_days, min(CASE WHEN part = '{p}' THEN d END) AS {p}_date_min, max(CASE WHEN part = '{p}' THEN d END) AS {p}_date_max" for p in ("train", "test")) + " FROM a GROUP BY 1), wd AS (SELECT split_id, " + ", ".join(f"""round(max(CASE WHEN part = '{p}' AND k = '{b}' THEN share END), 6) AS "{p}_share__{b}\"""" for p in ("train", "test") for b in BRANDS) + " FROM sh GROUP BY 1)"


@register("split_log", f"WITH {splits_sql('rolling')}{SHARES} SELECT s.*, fg.* EXCLUDE (split_id), wd.* EXCLUDE (split_id) FROM s JOIN fg ON s.split_id = fg.split_id LEFT JOIN wd ON s.split_id = wd.split_id")
def _(s: SparkSession, d: str) -> DataFrame:
    out = split.log(assigned(s, d), splits(panel(s, d)), BRANDS)
    return out.select(*(r6(F.col(f"`{c}`")).alias(c) if "_share__" in c else F.col(c) for c in out.columns))


@register("split_meta", f"WITH {splits_sql('rolling')} SELECT split_id, count(CASE WHEN part = 'train' THEN 1 END) AS n_train, count(CASE WHEN part = 'test' THEN 1 END) AS n_test, 5 AS n_features FROM a GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return scale.meta(assigned(s, d), FEATURES, []).select("split_id", "n_train", "n_test", "n_features")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly features, forward target and ranks of each brand."""
    f = features.with_ranks(features.equity_features(panel(spark, sf_dir, "month")))
    return f.orderBy("Ticker", "Date")




# Evaluation


@register("yearly_return_rank", f"WITH {VALID}, y AS (SELECT k, cast(year(d) AS int) AS y, arg_max(px, d) / nullif(arg_min(px, d), 0) - 1 AS t FROM valid GROUP BY 1, 2) SELECT k, y, round(t, 6) AS total_return, cast(row_number() OVER (PARTITION BY y ORDER BY t DESC NULLS LAST, k) AS int) AS rank FROM y")
def _(s: SparkSession, d: str) -> DataFrame:
    return evaluation.yearly_returns(valid(s, d)).select(F.col("Ticker").alias("k"), "y", r6("total_return").alias("total_return"), "rank")


@register("sign_label", f"WITH {EXCESS} SELECT d, k, cast(CASE WHEN target IS NOT NULL THEN CASE WHEN target > 0 THEN 1 ELSE 0 END END AS double) AS label FROM x")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(evaluation.signs(excess(s, d)), label=F.col("label").cast("double"))


CURVE = RET + """, e AS (SELECT *, exp(sum(ln(1 + coalesce(r, 0))) OVER (PARTITION BY k ORDER BY d ROWS UNBOUNDED PRECEDING)) AS equity FROM ret),
  c AS (SELECT *, equity / max(equity) OVER (PARTITION BY k ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM e)"""


def curve(s: SparkSession, d: str) -> DataFrame:
    return evaluation.equity_curve(returns(s, d).withColumnRenamed("Return_raw", "r"))


@register("equity_curve", f"WITH {CURVE} SELECT d, k, round(equity, 5) AS equity, round(drawdown, 6) AS drawdown FROM c")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(curve(s, d), equity=r6("equity", 5), drawdown=r6("drawdown"))


@register("performance", f"WITH {CURVE} SELECT k, round(pow(arg_max(equity, d), 52.0 / count(*)) - 1, 6) AS cagr, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(52), 6) AS sharpe, round(min(drawdown), 6) AS max_drawdown FROM c GROUP BY k")
def _(s: SparkSession, d: str) -> DataFrame:
    return evaluation.performance(curve(s, d)).select(F.col("Ticker").alias("k"), *(r6(c).alias(c) for c in ("cagr", "sharpe", "max_drawdown")))


@register("beta_hedge", f"WITH {EXCESS} SELECT k, round(covar_samp(r, br) / nullif(var_samp(CASE WHEN r IS NOT NULL THEN br END), 0), 6) AS beta FROM x GROUP BY k")
def _(s: SparkSession, d: str) -> DataFrame:
    return evaluation.betas(excess(s, d), "Return_raw", "Bench_Return_raw").select(F.col("Ticker").alias("k"), r6("beta").alias("beta"))


IC = FEAT + f", pair AS (SELECT d, k, ma20, fwd FROM feat WHERE ma20 IS NOT NULL AND fwd IS NOT NULL), ranks AS (SELECT d, {rank_sql('ma20')} AS a, {rank_sql('fwd')} AS b FROM pair)"


@register("rank_ic", f"WITH {IC.replace('round(CASE', '(CASE').replace('END, 6)', 'END)')} SELECT d, round({corr_sql('a', 'b')}, 6) AS ic FROM ranks GROUP BY d")
def _(s: SparkSession, d: str) -> DataFrame:
    return evaluation.information_coefficients(returns(s, d), "Return_MA20", "Ret_5d_fwd").select(F.col("Date").alias("d"), r6("ic").alias("ic"))


@register("precision_at_5", f"WITH {IC}, o AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY ma20 DESC, k) AS n FROM pair) SELECT d, round(avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END), 6) AS precision FROM o WHERE n <= 5 GROUP BY d")
def _(s: SparkSession, d: str) -> DataFrame:
    return evaluation.precision_at(returns(s, d), "Return_MA20", "Ret_5d_fwd", 5).select(F.col("Date").alias("d"), r6("precision").alias("precision"))


@register("stability_index", f"WITH {PANEL}, b AS (SELECT CASE WHEN px >= 1700 THEN 3 WHEN px >= 1500 THEN 2 WHEN px >= 1300 THEN 1 ELSE 0 END AS bin, d < DATE '1999-01-01' AS train FROM panel WHERE px IS NOT NULL), n AS (SELECT bin, count(*) FILTER (WHERE train) AS a, count(*) FILTER (WHERE NOT train) AS b FROM b GROUP BY bin), p AS (SELECT greatest(a / cast(sum(a) OVER () AS double), 1e-6) AS a, greatest(b / cast(sum(b) OVER () AS double), 1e-6) AS b FROM n) SELECT round(sum((b - a) * ln(b / a)), 6) AS psi FROM p")
def _(s: SparkSession, d: str) -> DataFrame:
    p, day = panel(s, d), F.lit("1999-01-01").cast("date")
    return evaluation.stability(p.where(F.col("Date") < day), p.where(F.col("Date") >= day), "Price", [1300.0, 1500.0, 1700.0]).select(r6("psi").alias("psi"))


@register("daily_panel", "SELECT cast(ts AS date) AS d, event_type AS k, round(avg(value), 6) AS px, count(*) AS vol FROM events GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(daily.daily_panel(table(s, d, "events")), px=r6("Price"), vol=F.col("Volume"))


# Files: what is written is read again


LONG = PANEL + """, long AS (SELECT d, k, 'Last Price' AS field, px AS v FROM panel UNION ALL SELECT d, k, 'Volume', vol FROM panel)"""


def long_file(s: SparkSession, d: str) -> str:
    """The panel as an export of four text columns, with blanks around names and values."""
    tall = reshape.melt(panel(s, d).withColumnRenamed("Price", "Last Price"), ["Date", "Ticker"], ["Last Price", "Volume"], "field", "v")
    text = tall.select(F.concat(F.lit(" "), "Ticker", F.lit(" ")).alias(" ticker"), F.col("field").alias("FIELD"), F.date_format("Date", "dd.MM.yyyy").alias("Date "), F.col("v").cast("string").alias("Wert"))
    path = writers.scratch(s, "long")
    writers.write_csv(text, path, ";")
    return path


@register("read_long_csv", f"WITH {LONG} SELECT d, k, field, v FROM long")
def _(s: SparkSession, d: str) -> DataFrame:
    long = readers.read_long(s, long_file(s, d))
    return long.select(C.day_first(F.col("Date")).alias("d"), F.col("Ticker").alias("k"), F.col("Field").alias("field"), C.loose_double(F.col("Value")).alias("v"))


@register("read_long_then_pivot", f"WITH {PANEL} SELECT d, k, px, vol FROM panel")
def _(s: SparkSession, d: str) -> DataFrame:
    long = readers.read_long(s, long_file(s, d))
    held = long.withColumns({"Date": C.day_first(F.col("Date")), "v": C.loose_double(F.col("Value"))})
    wide = reshape.pivot_first(rows.with_fields(held, ("Last Price", "Volume")), ["Date", "Ticker"], "Field", "v", "_seq", ("Last Price", "Volume"))
    return dk(wide, px=F.col("Last Price"), vol=F.col("Volume"))


CUSTOMERS = "SELECT c_custkey AS id, c_name AS who, round(cast(c_acctbal AS double), 2) AS balance FROM customer"


def customer_file(s: SparkSession, d: str, sep: str) -> str:
    path = writers.scratch(s, "customers")
    names = (" id", "who ", " balance ")
    writers.write_csv(table(s, d, "customer").select("c_custkey", "c_name", F.round(F.col("c_acctbal").cast("double"), 2)).toDF(*names), path, sep)
    return path


def customers(df: DataFrame, pad: bool = False) -> DataFrame:
    one, who, balance = (" id", "who ", " balance ") if pad else ("id", "who", "balance")
    return df.select(F.col(one).cast("long").alias("id"), F.col(who).alias("who"), C.to_double(F.col(balance)).alias("balance"))


@register("read_auto_semicolons", CUSTOMERS)
def _(s: SparkSession, d: str) -> DataFrame:
    return customers(readers.read_auto(s, customer_file(s, d, ";")))


@register("read_auto_commas", CUSTOMERS)
def _(s: SparkSession, d: str) -> DataFrame:
    return customers(readers.read_auto(s, customer_file(s, d, ",")))


@register("read_auto_names_kept", CUSTOMERS)
def _(s: SparkSession, d: str) -> DataFrame:
    return customers(readers.read_auto(s, customer_file(s, d, ";"), strip=False), pad=True)


@register("write_csv_read_plain", f"WITH {PANEL} SELECT d, k, px, vol FROM panel")
def _(s: SparkSession, d: str) -> DataFrame:
    path = writers.scratch(s, "panel")
    writers.write_csv(panel(s, d), path)
    read = readers.read_plain(s, path)
    return read.select(C.iso_first(F.col("Date")).alias("d"), F.col("Ticker").alias("k"), C.to_double(F.col("Price")).alias("px"), C.to_double(F.col("Volume")).alias("vol"))


@register("write_membership", f"WITH {splits_sql('rolling')} SELECT split_id, part, d, k FROM a")
def _(s: SparkSession, d: str) -> DataFrame:
    path = writers.scratch(s, "members")
    writers.write_membership(assigned(s, d), path)
    return writers.read_membership(s, path).select("split_id", "part", F.col("Date").alias("d"), F.col("Ticker").alias("k"))


@register("split_discovery", f"WITH {splits_sql('rolling')} SELECT DISTINCT split_id FROM a")
def _(s: SparkSession, d: str) -> DataFrame:
    path = writers.scratch(s, "members")
    writers.write_membership(assigned(s, d), path)
    return s.createDataFrame([(i,) for i in writers.split_ids(s, path)], "split_id int")


def scaled_files(s: SparkSession, d: str) -> str:
    a, path = assigned(s, d), writers.scratch(s, "scaled")
    f = scale.fit(a, FEATURES)
    writers.write_scaled(scale.transform(a, f, FEATURES), scale.long_stats(f, FEATURES), scale.meta(a, FEATURES, []), path)
    return path


@register("write_scaled_rows", ORACLE_SQL["zscore_scaled"])
def _(s: SparkSession, d: str) -> DataFrame:
    z = s.read.parquet(f"{scaled_files(s, d)}/scaled")
    return z.select("split_id", "part", F.col("Date").alias("d"), F.col("Ticker").alias("k"), *(r6(c, 5).alias(c) for c in FEATURES))


@register("write_scaled_meta", f"WITH {splits_sql('rolling')} SELECT split_id, count(CASE WHEN part = 'train' THEN 1 END) AS n_train, count(CASE WHEN part = 'test' THEN 1 END) AS n_test, cast(5 AS bigint) AS n_features FROM a GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    meta = s.read.schema("split_id int, n_train long, n_test long, n_features long").json(f"{scaled_files(s, d)}/meta")
    return meta.select("split_id", "n_train", "n_test", "n_features")


@register("ticker_detection", f"WITH {PANEL} SELECT k, count(*) AS n FROM panel GROUP BY k")
def _(s: SparkSession, d: str) -> DataFrame:
    p = panel(s, d).select("Date", F.lit("one").alias("kind"), F.col("Ticker").alias("who"))
    return p.groupBy(F.col(readers.ticker_column(p)).alias("k")).agg(F.count("*").alias("n"))


@register("pattern_exclusion", f"WITH {FEAT} SELECT d, k, px, vol, round(r, 6) AS r FROM feat")
def _(s: SparkSession, d: str) -> DataFrame:
    p = features_panel(s, d)
    names = rows.not_matching([c for c in FEATURES if c not in reshape.missing_columns(p, FEATURES)], ("^ma", "20$", ""))
    return dk(p, **{c: r6(c) if c == "r" else F.col(c) for c in names})


# A signal per split, the strategy that follows it, and sub-periods

RIDGE, ENTER, LEAVE, COST = 2.0, 0.51, 0.495, 0.001


def returns_beside(p: DataFrame, bench: DataFrame) -> DataFrame:
    """(Date, Ticker, Price, r, br, ma20, sd20): the panel's returns beside the benchmark's."""
    own = returns_of(p).select("Date", "Ticker", "Price", F.col("Return_raw").alias("r"), F.col("Return_MA20").alias("ma20"), F.col("Return_STD20").alias("sd20"))
    return joins.on_date(own, features.benchmark_returns(bench, "bpx").select("Date", F.col("Bench_Return_raw").alias("br")))


def labelled(p: DataFrame, bench: DataFrame) -> DataFrame:
    """Rows of all splits, features scaled by split and ticker, with the label."""
    df = returns_beside(p, bench).withColumn("label", signal.next_sign(F.col("r"), F.col("br"))).select("Date", "Ticker", "ma20", "sd20", "label")
    a = split.assign(df, splits(p))
    return scale.transform(a, scale.fit(a, ("ma20", "sd20")), ("ma20", "sd20"))


_Z = ", ".join(f"CASE WHEN s_{c} = 0 AND {c} IS NOT NULL THEN 0 ELSE ({c} - m_{c}) / nullif(s_{c}, 0) END AS {z}" for c, z in (("ma20", "z1"), ("sd20", "z2")))
LOGIT = splits_sql("rolling") + FIT + f""", {BENCH}, bb AS (SELECT d, bpx / nullif(lag(bpx) OVER (ORDER BY d), 0) - 1 AS br FROM bench),
  rb AS (SELECT feat.d, feat.k, r, br FROM feat LEFT JOIN bb ON feat.d = bb.d),
  lab AS (SELECT d, k, r, br, lead(r - br) {W} AS e1 FROM rb),
  t AS MATERIALIZED (SELECT a.split_id, part, a.d, a.k, {_Z}, CASE WHEN e1 IS NOT NULL THEN CASE WHEN e1 > 0 THEN 1 ELSE 0 END END AS y
    FROM a LEFT JOIN fit ON a.split_id = fit.split_id AND a.k = fit.k JOIN lab ON a.d = lab.d AND a.k = lab.k),
  tr AS MATERIALIZED (SELECT * FROM t WHERE part = 'train' AND y IS NOT NULL AND z1 IS NOT NULL AND z2 IS NOT NULL),
  it AS (SELECT 0 AS step, split_id, 0::DOUBLE AS b, 0::DOUBLE AS w1, 0::DOUBLE AS w2 FROM s
    UNION ALL SELECT step + 1, split_id,
      b - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det,
      w1 - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det,
      w2 - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det
    FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM (
      SELECT step, split_id, b, w1, w2, sum(p - y) AS g0, sum((p - y) * z1) + {RIDGE} * w1 AS g1, sum((p - y) * z2) + {RIDGE} * w2 AS g2,
        sum(q) AS h00, sum(q * z1) AS h01, sum(q * z2) AS h02, sum(q * z1 * z1) + {RIDGE} AS h11, sum(q * z1 * z2) AS h12, sum(q * z2 * z2) + {RIDGE} AS h22
      FROM (SELECT *, p * (1 - p) AS q FROM (SELECT step, it.split_id, b, w1, w2, z1, z2, y, 1 / (1 + exp(-(b + w1 * z1 + w2 * z2))) AS p FROM it JOIN tr ON it.split_id = tr.split_id WHERE step < 8))
      GROUP BY step, split_id, b, w1, w2))),
  model AS (SELECT * FROM it WHERE step = 8), n AS (SELECT split_id, count(*) AS n_train FROM tr GROUP BY split_id),
  said AS MATERIALIZED (SELECT t.split_id, d, k, 1 / (1 + exp(-(b + w1 * z1 + w2 * z2))) AS p FROM t JOIN model ON t.split_id = model.split_id WHERE part = 'test')"""


def said(p: DataFrame, bench: DataFrame) -> DataFrame:
    rows_ = labelled(p, bench)
    return signal.forecasts(rows_, signal.fit(rows_, ("ma20", "sd20"), ridge=RIDGE), ("ma20", "sd20"))


@register("logit_models", f"WITH RECURSIVE {LOGIT} SELECT split_id, n_train, round(b, 6) AS intercept, round(w1, 6) AS w_ma20, round(w2, 6) AS w_sd20 FROM model JOIN n USING (split_id)")
def _(s: SparkSession, d: str) -> DataFrame:
    m = signal.fit(labelled(*stored(s, d)), ("ma20", "sd20"), ridge=RIDGE)
    return m.select("split_id", "n_train", r6("intercept").alias("intercept"), r6(F.col("weights")[0]).alias("w_ma20"), r6(F.col("weights")[1]).alias("w_sd20"))


@register("logit_forecasts", f"WITH RECURSIVE {LOGIT} SELECT split_id, d, k, round(p, 6) AS p FROM said")
def _(s: SparkSession, d: str) -> DataFrame:
    return said(*stored(s, d)).select("split_id", F.col("Date").alias("d"), F.col("Ticker").alias("k"), r6("p").alias("p"))


def traded(s: SparkSession, d: str) -> DataFrame:
    """The strategy on every row of the panel; months before the first split have no forecast."""
    p, bench = stored(s, d)
    told = said(p, bench).select("Date", "Ticker", "p")
    return backtest.strategy(returns_beside(p, bench).join(told, ["Date", "Ticker"], "left"), enter=ENTER, leave=LEAVE, cost=COST)


TRADED = LOGIT + f""", f AS (SELECT rb.*, p FROM rb LEFT JOIN said ON rb.d = said.d AND rb.k = said.k),
  po AS (SELECT *, coalesce(last_value(CASE WHEN p >= {ENTER} THEN 1.0 WHEN p <= {LEAVE} THEN 0.0 END IGNORE NULLS) OVER (PARTITION BY k ORDER BY d ROWS UNBOUNDED PRECEDING), 0) AS position,
    CASE WHEN count(r + br) OVER (PARTITION BY k ORDER BY d ROWS UNBOUNDED PRECEDING) >= 20 THEN covar_pop(r, br) OVER (PARTITION BY k ORDER BY d ROWS UNBOUNDED PRECEDING) / nullif(var_pop(CASE WHEN r IS NOT NULL THEN br END) OVER (PARTITION BY k ORDER BY d ROWS UNBOUNDED PRECEDING), 0) END AS beta FROM f),
  tg AS (SELECT *, coalesce(lag(position) {W}, 0) AS held, coalesce(lag(beta) {W}, 0) AS hedge FROM po),
  tn AS (SELECT d, k, held, position, beta, held * (coalesce(r, 0) - hedge * coalesce(br, 0)) AS gross, abs(position - held) * (1 + abs(coalesce(beta, 0))) * {COST} AS cost FROM tg),
  net AS (SELECT *, gross - cost AS net FROM tn)"""
NET_CURVE = """, ne AS (SELECT *, CASE WHEN min(1 + net) OVER (PARTITION BY k ORDER BY d ROWS UNBOUNDED PRECEDING) <= 0 THEN 0 ELSE exp(sum(CASE WHEN 1 + net > 0 THEN ln(1 + net) END) OVER (PARTITION BY k ORDER BY d ROWS UNBOUNDED PRECEDING)) END AS equity FROM net),
  nc AS (SELECT *, equity / max(equity) OVER (PARTITION BY k ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM ne)"""


@register("strategy_rows", f"WITH RECURSIVE {TRADED} SELECT d, k, position, round(beta, 5) AS beta, round(gross, 6) AS gross, round(cost, 6) AS cost FROM net")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(traded(s, d), position=F.col("position"), beta=r6("beta", 5), gross=r6("gross"), cost=r6("cost"))


@register("strategy_results", f"WITH RECURSIVE {TRADED}{NET_CURVE} SELECT k, round(pow(arg_max(equity, d), 52.0 / count(*)) - 1, 6) AS cagr, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(52), 5) AS sharpe, round(min(drawdown), 6) AS max_drawdown, cast(sum(abs(position - held)) AS double) AS turnover, round(avg(position), 6) AS share_held FROM nc GROUP BY k")
def _(s: SparkSession, d: str) -> DataFrame:
    out = backtest.results(traded(s, d), per_year=52.0)
    return out.select(F.col("Ticker").alias("k"), r6("cagr").alias("cagr"), r6("sharpe", 5).alias("sharpe"), r6("max_drawdown").alias("max_drawdown"), "turnover", r6("share_held").alias("share_held"))


@register("portfolio_curve", f"WITH RECURSIVE {TRADED}, pf AS (SELECT d, avg(net) AS r, cast(sum(position) AS bigint) AS n_held FROM net GROUP BY d), pe AS (SELECT *, CASE WHEN min(1 + r) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) <= 0 THEN 0 ELSE exp(sum(CASE WHEN 1 + r > 0 THEN ln(1 + r) END) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING)) END AS equity FROM pf) SELECT d, n_held, round(CASE WHEN equity > 0 THEN ln(equity) END, 6) AS log_equity, round(equity / max(equity) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) - 1, 5) AS drawdown FROM pe")
def _(s: SparkSession, d: str) -> DataFrame:
    whole = backtest.portfolio(traded(s, d)).withColumn("Ticker", F.lit("all"))
    return evaluation.equity_curve(whole).select(F.col("Date").alias("d"), "n_held", r6(C.ln(F.col("equity"))).alias("log_equity"), r6("drawdown", 5).alias("drawdown"))


FALL, RISE = 0.15, 0.15
PERIODS = VALID + f""", o AS MATERIALIZED (SELECT k, d, px, row_number() OVER (PARTITION BY k ORDER BY d) AS n FROM valid),
  st AS (SELECT k, n, false AS bear, px AS ext, n AS ext_n, NULL::BIGINT AS begins FROM o WHERE n = 1
    UNION ALL SELECT o.k, o.n, CASE WHEN turned THEN NOT bear ELSE bear END, CASE WHEN turned OR further THEN px ELSE ext END,
      CASE WHEN turned OR further THEN o.n ELSE ext_n END, CASE WHEN turned THEN ext_n + 1 END
    FROM (SELECT o.k, o.n, px, bear, ext, ext_n, CASE WHEN bear THEN px >= ext * (1 + {RISE}) ELSE px <= ext * (1 - {FALL}) END AS turned,
      CASE WHEN bear THEN px < ext ELSE px > ext END AS further FROM st JOIN o ON o.k = st.k AND o.n = st.n + 1) AS o),
  tu AS (SELECT k, begins FROM st WHERE begins IS NOT NULL),
  pd AS (SELECT o.*, (SELECT count(*) FROM tu WHERE tu.k = o.k AND tu.begins <= o.n) AS period FROM o)"""


@register("bull_bear_rows", f"WITH RECURSIVE {PERIODS} SELECT d, k, cast(period AS int) AS period, CASE WHEN period % 2 = 1 THEN 'bear' ELSE 'bull' END AS regime FROM pd")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(regimes.periods(valid(s, d), fall=FALL, rise=RISE), period=F.col("period"), regime=F.col("regime"))


@register("bull_bear_periods", f"WITH RECURSIVE {PERIODS}, own AS (SELECT k, period, min(d) AS first_day, max(d) AS last_day, count(*) AS n_rows, arg_min(px, d) AS a, arg_max(px, d) AS b FROM pd GROUP BY 1, 2) SELECT k, cast(period AS int) AS period, first_day, last_day, n_rows, round(b / coalesce(lag(b) OVER (PARTITION BY k ORDER BY period), a) - 1, 6) AS change FROM own")
def _(s: SparkSession, d: str) -> DataFrame:
    f = regimes.figures(regimes.periods(valid(s, d), fall=FALL, rise=RISE))
    return f.select(F.col("Ticker").alias("k"), "period", "first_day", "last_day", "n_rows", r6("change").alias("change"))


# Places and ranks in a whole table's order

RANKED = FEAT + ", rk AS (SELECT d, k, " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 END AS {c}" for c in FEATURES) + " FROM feat)"


@register("sort_date", f"WITH {PANEL}, days AS (SELECT d, count(*) AS n FROM panel GROUP BY d) SELECT d, n, cast(sum(n) OVER (ORDER BY d) AS bigint) AS last_place FROM days")
def _(s: SparkSession, d: str) -> DataFrame:
    at = order.positions(panel(s, d), ["Date"])
    return at.groupBy(F.col("Date").alias("d")).agg(F.count("*").alias("n"), (F.max("position") + 1).alias("last_place"))


@register("membership_positions", f"WITH {splits_sql('rolling')}, pos AS (SELECT d, k, row_number() OVER (ORDER BY d, k) - 1 AS pl FROM feat) SELECT split_id, part, min(pl) AS first_at, max(pl) AS last_at, cast(sum(pl) AS bigint) AS sum_at, count(*) AS n FROM a JOIN pos ON a.d = pos.d AND a.k = pos.k GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    at = order.positions(panel(s, d).select("Date", "Ticker"), ["Date", "Ticker"])
    found = split.assign(at, splits(panel(s, d)))
    return found.groupBy("split_id", "part").agg(F.min("position").alias("first_at"), F.max("position").alias("last_at"), F.sum("position").alias("sum_at"), F.count("*").alias("n"))


@register("rank_corr_pairs", f"WITH {RANKED} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({corr_sql(a, b)}, 6) AS corr FROM rk" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]))
def _(s: SparkSession, d: str) -> DataFrame:
    return order.rank_correlations(features_panel(s, d), FEATURES).select("a", "b", r6("corr").alias("corr"))


QUANTILES = 10


@register("stability_quantiles", f"WITH {PANEL}, tr AS (SELECT px FROM panel WHERE d < DATE '1999-01-01' AND px IS NOT NULL), so AS (SELECT px, row_number() OVER (ORDER BY px) - 1 AS pl, count(*) OVER () AS total FROM tr), cuts AS (SELECT DISTINCT px FROM so JOIN range(1, {QUANTILES}) AS q(i) ON pl = (total * i) // {QUANTILES}), b AS (SELECT (SELECT count(*) FROM cuts WHERE panel.px >= cuts.px) AS bin, d < DATE '1999-01-01' AS train FROM panel WHERE px IS NOT NULL), n AS (SELECT bin, count(*) FILTER (WHERE train) AS a, count(*) FILTER (WHERE NOT train) AS b FROM b GROUP BY bin), p AS (SELECT greatest(a / cast(sum(a) OVER () AS double), 1e-6) AS a, greatest(b / cast(sum(b) OVER () AS double), 1e-6) AS b FROM n) SELECT round(sum((b - a) * ln(b / a)), 6) AS psi FROM p")
def _(s: SparkSession, d: str) -> DataFrame:
    p, day = panel(s, d), F.lit("1999-01-01").cast("date")
    train = p.where(F.col("Date") < day)
    return evaluation.stability(train, p.where(F.col("Date") >= day), "Price", order.quantile_bounds(train, "Price", QUANTILES)).select(r6("psi").alias("psi"))


# Years ahead of the benchmark, drift by fold, and a report read again


@register("years_ahead", f"WITH {VALID}, {BENCH}, y AS (SELECT k, year(d) AS y, arg_max(px, d) / nullif(arg_min(px, d), 0) - 1 AS t FROM valid GROUP BY 1, 2), yb AS (SELECT year(d) AS y, arg_max(bpx, d) / nullif(arg_min(bpx, d), 0) - 1 AS b FROM bench GROUP BY 1) SELECT k, count(*) AS n_years, count(*) FILTER (WHERE t > b) AS n_ahead FROM y JOIN yb ON y.y = yb.y GROUP BY k")
def _(s: SparkSession, d: str) -> DataFrame:
    bench = evaluation.yearly_returns(benchmark(s, d).select("Date", F.lit("b").alias("Ticker"), F.col("bpx").alias("Price"))).select("y", F.col("total_return").alias("bench_return"))
    return evaluation.years_ahead(evaluation.yearly_returns(valid(s, d)), bench).select(F.col("Ticker").alias("k"), "n_years", "n_ahead")


@register("drift_by_fold", f"WITH {splits_sql('rolling')}{FIT}, z AS (SELECT a.split_id, part, " + ", ".join(f"CASE WHEN s_{c} = 0 AND {c} IS NOT NULL THEN 0 ELSE ({c} - m_{c}) / nullif(s_{c}, 0) END AS {c}" for c in FEATURES) + " FROM a LEFT JOIN fit ON a.split_id = fit.split_id AND a.k = fit.k) " + " UNION ALL ".join(f"SELECT split_id, '{c}' AS feature, part, round(avg({c}), 5) + 0.0 AS mean, round(stddev_pop({c}), 5) AS std FROM z GROUP BY split_id, part" for c in FEATURES))
def _(s: SparkSession, d: str) -> DataFrame:
    a = assigned(s, d)
    return scale.drift(scale.transform(a, scale.fit(a, FEATURES), FEATURES), FEATURES).select("split_id", "feature", "part", (r6("mean", 5) + 0.0).alias("mean"), r6("std", 5).alias("std"))


@register("write_report_shares", f"WITH {PANEL} SELECT k, count(*) AS n, round(round_even(count(*) / cast(sum(count(*)) OVER () AS double), 4), 4) AS share FROM panel GROUP BY k")
def _(s: SparkSession, d: str) -> DataFrame:
    path = writers.scratch(s, "report")
    writers.write_text(s, workflow.bias_report(panel(s, d), ["Price"]), path)
    cells = F.split("value", r"\s*\|\s*")
    lines = s.read.text(path).where(F.col("value").rlike(r"^\| Brand#\d+ \| \d+ \| [0-9.]+ \|$"))
    return lines.select(cells[1].alias("k"), cells[2].cast("long").alias("n"), cells[3].cast("double").alias("share"))


# Long series in blocks, and splits as a table


@register("rolling_in_blocks", f"WITH {FEAT} SELECT d, k, round(ma20, 6) AS ma20, round(sd20, 6) AS sd20, round(vma20, 4) AS vma20, round(fwd, 6) AS fwd FROM feat")
def _(s: SparkSession, d: str) -> DataFrame:
    r = windows.growth(F.col("Price"), by_ticker("Ticker"))

    def made(w: object) -> dict[str, Column]:
        mean = lambda c: windows.rolling(F.avg, F.col(c), w, 20, 10)
        return {"ma20": mean("r"), "sd20": windows.rolling(F.stddev_pop, F.col("r"), w, 20, 10), "vma20": mean("Volume"), "fwd": windows.forward_growth(F.col("Price"), w)}

    out = blocked.windowed(panel(s, d).withColumn("r", r), made, size=200, back=20, ahead=5)
    return dk(out, ma20=r6("ma20"), sd20=r6("sd20"), vma20=r6("vma20", 4), fwd=r6("fwd"))


@register("long_series_rolling", "SELECT l_orderkey, l_linenumber, count(l_quantity) OVER w AS n, round(avg(l_extendedprice) OVER w, 4) AS mean, round(stddev_pop(l_quantity) OVER w, 6) AS sd FROM lineitem WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)")
def _(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")

    def made(w: object) -> dict[str, Column]:
        past = w.rowsBetween(-50, -1)
        return {"n": F.count("l_quantity").over(past), "mean": F.avg("l_extendedprice").over(past), "sd": F.stddev_pop("l_quantity").over(past)}

    out = blocked.windowed(lines, made, keys=(), by=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), size=5000, back=50)
    return out.select("l_orderkey", "l_linenumber", "n", r6("mean", 4).alias("mean"), r6("sd").alias("sd"))


@register("ffill_in_blocks", f"WITH {GAPS} SELECT d, k, last_value(px IGNORE NULLS) OVER (PARTITION BY k ORDER BY d ROWS UNBOUNDED PRECEDING) AS px FROM gaps")
def _(s: SparkSession, d: str) -> DataFrame:
    return dk(blocked.filled(valid_week(s, d), {"filled": "Price"}, size=100), px=F.col("filled"))


WEEKLY = f"WITH {PANEL}, s AS (SELECT cast(row_number() OVER (ORDER BY d) - 1 AS int) AS split_id, d - 364 AS train_start, d - 7 AS train_end, d AS test_start, d + 28 AS test_end FROM (SELECT DISTINCT d FROM panel))"


@register("membership_by_table", WEEKLY + " SELECT split_id, part, count(*) AS n_rows, count(DISTINCT k) AS n_tickers, min(d) AS first_day, max(d) AS last_day FROM (SELECT split_id, 'train' AS part, d, k FROM s JOIN panel ON d >= train_start AND d < train_end UNION ALL SELECT split_id, 'test', d, k FROM s JOIN panel ON d >= test_start AND d < test_end) GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    p = panel(s, d).select("Date", "Ticker")
    days = order.positions(p.select("Date").distinct(), ["Date"])
    shifted = lambda n: F.date_add("Date", n)
    made = days.select(F.col("position").cast("int").alias("split_id"), shifted(-364).alias("train_start"), shifted(-7).alias("train_end"), F.col("Date").alias("test_start"), shifted(28).alias("test_end"))
    found = split.assign_by_table(p, made).groupBy("split_id", "part")
    return found.agg(F.count("*").alias("n_rows"), F.countDistinct("Ticker").alias("n_tickers"), F.min("Date").alias("first_day"), F.max("Date").alias("last_day"))
