from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel import cli
from tidepanel.operators import clean, evaluation, profile, reshape, rows, scale, split, windows
from tidepanel.operators.windows import by_ticker
from tidepanel.plans import features, workflow
from tidepanel.sources import readers, writers
from tidepanel.streaming import daily


def frame(spark: SparkSession, df: pd.DataFrame, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(None if v is None or isinstance(v, float) and math.isnan(v) else v for v in r) for r in df.itertuples(index=False)], schema)


@pytest.fixture(scope="module")
def prices() -> pd.DataFrame:
    rng = np.random.default_rng(1)
    out = []
    for t, first in (("A", 0), ("B", 0), ("C", 25)):
        for i in range(first, 70):
            price = 100 * math.exp(rng.normal() * 0.1)
            out.append((dt.date(2020, 1, 1) + dt.timedelta(i), t, None if i % 11 == 5 else price, float(rng.integers(1, 9)) if i % 13 else None))
    return pd.DataFrame(out, columns=["Date", "Ticker", "Price", "Volume"])


def test_features_against_pandas(spark: SparkSession, prices: pd.DataFrame) -> None:
    got = features.equity_features(frame(spark, prices, "Date date, Ticker string, Price double, Volume double")).toPandas().sort_values(["Ticker", "Date"]).reset_index(drop=True)
    for t, g in prices.groupby("Ticker"):
        p = g["Price"].astype(float).ffill().reset_index(drop=True)
        v = g["Volume"].astype(float).reset_index(drop=True)
        r = p / p.shift(1) - 1
        own = got[got["Ticker"] == t].reset_index(drop=True)
        ma = v.rolling(20, min_periods=10).mean().shift(1)
        want = {
            "Return_raw": r,
            "Return_lag5": r.shift(5),
            "Return_MA5": r.rolling(5, min_periods=3).mean().shift(1),
            "Return_STD10": r.rolling(10, min_periods=5).std(ddof=0).shift(1),
            "RealizedVol20_ann": r.rolling(20, min_periods=10).std(ddof=0).shift(1) * math.sqrt(252),
            "Return_Z20": ((r - r.rolling(20, min_periods=10).mean()) / r.rolling(20, min_periods=10).std(ddof=0)).shift(1),
            "Volume_MA20": ma,
            "Volume_to_MA20": (v / ma).shift(1),
            "Ret_5d_fwd": p.shift(-5) / p - 1,
        }
        for c, w in want.items():
            np.testing.assert_allclose(own[c].astype(float), w.astype(float), rtol=1e-9, atol=1e-12, err_msg=f"{t} {c}")


def test_features_are_past_only(spark: SparkSession, prices: pd.DataFrame) -> None:
    schema = "Date date, Ticker string, Price double, Volume double"
    day = dt.date(2020, 2, 15)
    other = prices.copy()
    other.loc[other["Date"] >= day, ["Price", "Volume"]] = [1.0, 1.0]
    past = [c for c in ("Return_lag1", "Return_MA5", "Return_STD20", "Return_Z20", "Volume_MA20", "Volume_to_MA20")]
    a, b = (features.equity_features(frame(spark, p, schema)).where(F.col("Date") <= day).orderBy("Ticker", "Date").select(*past).toPandas() for p in (prices, other))
    pd.testing.assert_frame_equal(a, b)


def test_ranks_with_ties_and_gaps(spark: SparkSession) -> None:
    values = [3.0, 1.0, None, 3.0, 2.0, 3.0]
    df = spark.createDataFrame([(1, str(i), v) for i, v in enumerate(values)], "Date int, k string, x double")
    for descending in (False, True):
        got = [r[0] for r in df.select("k", windows.share_rank(F.col("x"), descending=descending).alias("r")).orderBy("k").select("r").collect()]
        want = pd.Series(values).rank(method="average", ascending=not descending, pct=True)
        np.testing.assert_allclose(np.array(got, float), want)


def test_log_target(spark: SparkSession) -> None:
    r = [0.01 * i for i in range(9)] + [None]
    df = spark.createDataFrame([(i, "A", v, 0.0) for i, v in enumerate(r)], "Date int, Ticker string, r double, b double")
    got = [x[0] for x in df.select("Date", windows.log_target(F.col("r"), F.col("b"), by_ticker("Ticker")).alias("t")).orderBy("Date").select("t").collect()]
    assert got[0] == pytest.approx(math.prod(1 + x for x in r[1:6]) - 1) and got[4] is None and got[5] is None


def test_impute_and_winsorise(spark: SparkSession) -> None:
    df = spark.createDataFrame([(i, "A", None if i in (0, 3) else float(i), 1.0) for i in range(8)] + [(0, "B", None, 1.0)], "Date int, Ticker string, x double, c double")
    got = {(r.Ticker, r.Date): r.x for r in clean.impute(df, ["x"]).collect()}
    want = pd.Series([None if i in (0, 3) else float(i) for i in range(8)]).astype(float).ffill().rolling(5, min_periods=1).mean()
    assert got["A", 0] is None and got["B", 0] is None
    np.testing.assert_allclose([got["A", i] for i in range(1, 8)], want[1:])
    far = spark.createDataFrame([(float(v), 1.0) for v in [0] * 50 + [1000]] + [(None, 1.0)], "x double, c double")
    out = clean.winsorise(far, ["x", "c"])
    s = pd.Series([0.0] * 50 + [1000.0])
    assert out.agg(F.max("x")).first()[0] == pytest.approx(s.mean() + 3 * s.std()) and out.where("x is null").count() == 1 and out.agg(F.max("c")).first()[0] == 1.0


def test_reduce_columns(spark: SparkSession) -> None:
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=200), rng.normal(size=200)
    df = spark.createDataFrame([(float(x), float(x + 0.05 * y), float(x + 0.3 * y), float(y), float(x)) for x, y in zip(a, b, strict=True)], "a double, b double, c double, d double, Ret_5d_fwd double")
    out, gone = clean.reduce_columns(df, ["a", "b", "c", "d"])
    assert gone == ["b", "c"] and out.columns == ["a", "d", "Ret_5d_fwd"]


def test_splits() -> None:
    d = dt.date
    assert split.add_months(d(2024, 2, 29), -36) == d(2021, 2, 28) and split.add_months(d(2020, 12, 31), 2) == d(2021, 2, 28) and split.add_months(d(2020, 11, 30), 1) == d(2020, 12, 30)
    s = split.make_splits(d(2015, 9, 30), d(2025, 9, 30), d(2021, 1, 1))
    assert len(s) == 57 and s[0] == split.Split(0, d(2017, 12, 27), d(2020, 12, 27), d(2021, 1, 1), d(2021, 2, 1))
    assert {x.train_start for x in split.make_splits(d(2015, 9, 30), d(2025, 9, 30), d(2021, 1, 1), mode="expanding")} == {d(2015, 9, 30)}
    assert split.make_splits(None, None, d(2021, 1, 1)) == []
    with pytest.raises(ValueError, match="mode"):
        split.make_splits(d(2020, 1, 1), d(2021, 1, 1), d(2020, 1, 1), mode="other")


@pytest.fixture(scope="module")
def calendar(spark: SparkSession) -> DataFrame:
    """20 tickers on weekdays, one late and one very late."""
    days = [x.date() for x in pd.bdate_range("2019-01-01", "2022-03-31")]
    late = {"T18": 500, "T19": 780}
    out = [(d, f"T{t:02d}", 100.0 + t + (i * 7 + t) % 13, float((i + t) % 5), 0.01 * ((i * t) % 7)) for t in range(20) for i, d in enumerate(days) if i >= late.get(f"T{t:02d}", 0)]
    return spark.createDataFrame(out, "Date date, Ticker string, Price double, Volume double, Excess_5d_fwd double").withColumn("Ret_5d_fwd", F.col("Price") * 0 + 1)


def test_walk_forward(spark: SparkSession, calendar: DataFrame) -> None:
    options = workflow.SplitOptions(start=dt.date(2021, 6, 1), train_years=2)
    members, made = workflow.split_panel(calendar, options)
    assert len(made) == 10
    per = {(r.split_id, r.part): r for r in split.part_figures(members).collect()}
    for s in made:
        assert per[s.split_id, "train"].last_day < s.train_end < s.test_start <= per[s.split_id, "test"].first_day
    tests = {r.Ticker for r in members.where("part = 'test'").select("Ticker").distinct().collect()}
    assert "T19" not in tests and len(tests) == 19
    log = split.log(members, made).toPandas()
    assert len(log) == 10 and "train_share__T00" in log and log["test_rows"].sum() == members.where("part = 'test'").count()
    scaled, stats, meta = workflow.scale_panel(members, workflow.ScaleOptions(auto_log1p=True))
    train = scaled.where("part = 'train'").groupBy("split_id", "Ticker").agg(F.avg("Price").alias("m"), F.stddev_pop("Price").alias("s")).toPandas()
    assert np.allclose(train["m"], 0, atol=1e-9) and np.allclose(train["s"], 1)
    assert "Ret_5d_fwd" not in {r.feature for r in stats.select("feature").distinct().collect()}
    assert meta.count() == 10 and {r.n_features for r in meta.collect()} == {2}
    with pytest.raises(ValueError):
        workflow.split_panel(calendar, workflow.SplitOptions(start=dt.date(2021, 6, 1), min_train_days_per_ticker=5000, strict_coldstart=True))


def test_unknown_tickers_and_constants(spark: SparkSession) -> None:
    df = spark.createDataFrame([(0, "train", "A", 1.0), (0, "train", "A", 1.0), (0, "test", "A", 5.0), (0, "test", "N", 2.0), (0, "test", "A", None)], "split_id int, part string, Ticker string, x double")
    fitted = scale.fit(df, ["x"])
    got = sorted((r.Ticker, r.x) for r in scale.transform(df, fitted, ["x"]).where("part = 'test' and x is not null").collect())
    assert got == [("A", 0.0)]
    assert {r.x for r in scale.transform(df, fitted, ["x"], fill=-9.0).where("part = 'test'").collect()} == {0.0, -9.0}


def test_log_columns(spark: SparkSession) -> None:
    df = spark.createDataFrame([(float(i**4), float(i - 3), None) for i in range(20)], "a double, b double, c double")
    assert scale.log_columns(df, ["a", "b", "c"], manual=["b", "zz"]) == ["a", "b"]
    out = scale.apply_log(df, ["a", "b"]).orderBy("b").collect()
    assert out[-1].a == pytest.approx(math.log1p(19**4)) and out[0].b == -3.0


def test_reshape(spark: SparkSession) -> None:
    df = spark.createDataFrame([(1, "x", None, 0), (1, "x", 5.0, 2), (1, "x", 4.0, 1), (1, "y", None, 3), (2, "x", 7.0, 4)], "d int, n string, v double, _seq int")
    assert sorted(map(tuple, reshape.pivot_first(df, ["d"], "n", "v", "_seq").collect())) == [(1, 4.0), (2, 7.0)]
    wide = spark.createDataFrame([(1, 2.0, None)], "d int, `a | b` double, `c.d` double")
    assert sorted(map(tuple, reshape.melt(wide, ["d"], ["a | b", "c.d"]).collect())) == [(1, "a | b", 2.0), (1, "c.d", None)]
    assert rows.without_sparse_columns(wide, 0.2, ("d",)).columns == ["d", "a | b"]
    assert rows.not_matching(["a_x", "b"], [r"_x$", ""]) == ["b"]


def test_readers(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    (tmp_path / "long.csv").write_text("﻿ticker;FIELD;Date;Wert\nABBN SE Equity;Last Price;02.01.2020;1 234\nABBN SE Equity;Last Price;02.01.2020;99\nABBN SE Equity;Volume;03.01.2020;#N/A\n")
    long = readers.read_long(spark, str(tmp_path / "long.csv"))
    assert long.columns == ["Ticker", "Field", "Date", "Value", "_seq"] and long.count() == 3
    (tmp_path / "quoted.csv").write_text('"Ticker;Field;Date;Value"\n"A;Last Price;02.01.2020;5"\n')
    assert tuple(readers.read_long(spark, str(tmp_path / "quoted.csv")).first())[:4] == ("A", "Last Price", "02.01.2020", "5")
    (tmp_path / "comma.csv").write_text("Date , x\n2020-01-01,1\n")
    assert readers.read_auto(spark, str(tmp_path / "comma.csv")).columns == ["Date", "x"]
    df = spark.createDataFrame([("u", "A", 1.0), ("u", None, 2.0)], "kind string, who string, Price double")
    assert readers.ticker_column(df) == "who" and readers.price_column(df) == "Price"
    assert readers.ticker_column(df.withColumnRenamed("kind", "symbol")) == "symbol"
    with pytest.raises(ValueError, match="missing"):
        readers.require(df, "Price", "Nope")
    macro = spark.createDataFrame([("VIX Index", "Last Price", "02.01.2020", "12,5", 0)], "Ticker string, Field string, Date string, Value string, _seq long")
    both = features.combined_wide(long, macro).collect()
    assert len(both) == 1 and both[0]["ABBN_LastPrice"] == 1234.0 and both[0]["VIX"] == 125.0


def wide_csv(path, n: int = 60) -> None:  # noqa: ANN001
    lines = ["Date;A SE Equity | Last Price;B SE Equity | Last Price;A SE Equity | Volume;B SE Equity | Volume;SMI Index | PX_LAST;VIX Index | Last Price"]
    for i in range(n):
        d = dt.date(2020, 1, 1) + dt.timedelta(i)
        lines.append(f"{d:%d.%m.%Y};{100 + i % 7};{'' if i < 20 else 50 + i % 5};{i + 1};{i % 3 + 1};{9000 + i % 11};{20 + i % 4}")
    path.write_text("\n".join(lines))


def test_feature_set_a(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    wide_csv(tmp_path / "wide.csv")
    panel = features.feature_set_a(readers.read_auto(spark, str(tmp_path / "wide.csv")))
    assert panel.count() == 120
    names = {"Return_MA20", "Excess_ret", "Excess_5d_fwd", "Rank_Liquidity", "VIX Index | Last Price__chgstd20", "Volume_to_MA20"}
    assert names <= set(panel.columns)
    first = panel.where("Ticker = 'A SE Equity'").orderBy("Date").limit(7).collect()
    assert first[0].Return_raw is None and first[1].Return_raw == pytest.approx(0.01)
    bench = lambda i: (9000 + (i + 5) % 11) / (9000 + i % 11) - 1
    assert first[0].Excess_5d_fwd == pytest.approx(105 / 100 - 1 - bench(0))


def test_feature_set_b(spark: SparkSession) -> None:
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(60)]
    stocks = spark.createDataFrame([(t, f, f"{d:%d.%m.%Y}", str(v), 100 * i + k) for i, d in enumerate(days) for k, (t, f, v) in enumerate([("A", "PX_LAST", 100 + i % 7), ("B", "Price", 50 + i % 5)])], "Ticker string, Field string, Date string, Value string, _seq long")
    macro = spark.createDataFrame([("SMI_Ret", f"{d:%d.%m.%Y}", str(0.001 * (i % 3)), i) for i, d in enumerate(days)] + [("VIX", f"{days[-1]:%d.%m.%Y}", "20", 99)], "Field string, Date string, Value string, _seq long")
    out = features.feature_set_b(stocks, macro)
    assert out.count() == 2 * (60 - 21 - 5) and "vix_lag1" not in out.columns and "smi_return_lag5" in out.columns
    assert out.select("Return_STD20").where("Return_STD20 is null").count() == 0
    with pytest.raises(ValueError, match="excess"):
        features.feature_set_b(stocks, macro.where("Field = 'VIX'"))


def test_first_value_is_that_of_the_first_file(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    """Spark reads large files first; rows count in the files' order all the same."""
    (tmp_path / "long").mkdir()
    (tmp_path / "long" / "1.csv").write_text("Ticker;Field;Date;Value\nA;Last Price;02.01.2020;1\n")
    (tmp_path / "long" / "2.csv").write_text("Ticker;Field;Date;Value\n" + "A;Last Price;02.01.2020;2\n" * 2000)
    long = readers.read_long(spark, str(tmp_path / "long"))
    assert reshape.pivot_first(long, ["Date"], "Field", "Value", "_seq").first()["Last Price"] == "1"


def test_moments_by_dates_are_those_of_the_exploded_rows(spark: SparkSession, calendar: DataFrame) -> None:
    odd = calendar.withColumn("Gap", F.when(F.dayofmonth("Date") % 3 == 0, F.col("Volume"))).withColumn("Never", F.lit(None).cast("double"))
    for mode in ("rolling", "expanding"):
        members, made = workflow.split_panel(odd, workflow.SplitOptions(start=dt.date(2021, 6, 1), train_years=2, mode=mode))
        names = ["Price", "Ret_5d_fwd", "Gap", "Never"]
        one, two = (f.orderBy("split_id", "Ticker").toPandas() for f in (scale.fit(members, names), scale.fit_by_dates(odd, made, names)))
        assert list(one.columns) == list(two.columns) and (one[["split_id", "Ticker"]] == two[["split_id", "Ticker"]]).all().all()
        assert np.allclose(one.drop(columns="Ticker").astype(float), two.drop(columns="Ticker").astype(float), equal_nan=True)
        assert (two["std__Ret_5d_fwd"] == 0).all()


def test_columns_by_other_names(spark: SparkSession, calendar: DataFrame, tmp_path) -> None:  # noqa: ANN001
    named = calendar.withColumn("Price", F.when(F.dayofmonth("Date") == 7, -1.0).otherwise(F.col("Price"))).selectExpr("Date as day", "Ticker as Symbol", "Price as px", "Volume", "Excess_5d_fwd")
    named.write.parquet(f"{tmp_path}/panel")
    dates = ["--date-col", "day", "--price-col", "px"]
    cli.main(["split", "--input", f"{tmp_path}/panel", "--output", f"{tmp_path}/members", "--start", "2021-06-01", "--train-years", "2", *dates])
    members = writers.read_membership(spark, f"{tmp_path}/members")
    assert members.where("dayofmonth(Date) = 7").isEmpty() and members.select("split_id").distinct().count() == 10
    cli.main(["scale", "--input", f"{tmp_path}/panel", "--membership", f"{tmp_path}/members", "--output", f"{tmp_path}/out", "--ticker-col", "Symbol", "--auto-log1p", *dates])
    assert spark.read.parquet(f"{tmp_path}/out/scaled").count() == members.count()
    with pytest.raises(ValueError, match="missing"):
        workflow.split_panel(named, workflow.SplitOptions(date_col="no"))


def test_log_columns_are_chosen_over_the_whole_panel(spark: SparkSession, calendar: DataFrame) -> None:
    panel = calendar.withColumn("Volume", F.when(F.col("Date") < "2019-03-01", -1.0).otherwise(F.exp("Volume")))
    members, made = workflow.split_panel(panel, workflow.SplitOptions(start=dt.date(2021, 6, 1), train_years=1))
    o = workflow.ScaleOptions(auto_log1p=True)
    assert workflow.scale_panel(members, o)[2].first().log1p_cols == ["Volume"]
    assert workflow.scale_panel(members, o, panel, made)[2].first().log1p_cols == []


def test_workflow_and_command_line(spark: SparkSession, calendar: DataFrame, tmp_path) -> None:  # noqa: ANN001
    flat = calendar.withColumn("MOVE Index__logdiff1", F.col("Price") * 2.0)
    writers.write_csv(flat.coalesce(1), f"{tmp_path}/panel")
    cli.main(["run", "--input", f"{tmp_path}/panel", "--output", f"{tmp_path}/out", "--start", "2021-06-01", "--train-years", "2", "--exclude-cols", "Volume"])
    reduced = spark.read.parquet(f"{tmp_path}/out/reduced")
    assert reduced.count() == calendar.count()
    assert writers.split_ids(spark, f"{tmp_path}/out/membership") == list(range(10)) == writers.split_ids(spark, f"{tmp_path}/out/scaled")
    meta = spark.read.json(f"{tmp_path}/out/meta").collect()
    assert len(meta) == 10 and all(m.n_train > 0 for m in meta)
    assert "Sanity" in spark.read.text(f"{tmp_path}/out/sanity_report").first()[0]
    assert "| T00 |" in workflow.bias_report(calendar, ["Price"])


def test_report_tables_are_whole(spark: SparkSession) -> None:
    panel = spark.range(1003).selectExpr("concat('T', lpad(id, 4, '0')) as Ticker", "date'2024-01-01' as Date", "double(id) as Price", "double(id) as Zeta")
    report = workflow.bias_report(panel, ["Price", "Zeta"]).splitlines()
    assert sum("| T" in line for line in report) >= 4 * 1003 and any(line.startswith("| Zeta | T1002 |") for line in report)


def test_evaluation(spark: SparkSession) -> None:
    r = [0.1, -0.5, 0.2, None]
    df = spark.createDataFrame([(i, "A", x) for i, x in enumerate(r)], "Date int, Ticker string, r double")
    curve = evaluation.equity_curve(df).orderBy("Date").collect()
    assert [c.equity for c in curve] == pytest.approx([1.1, 0.55, 0.66, 0.66]) and min(c.drawdown for c in curve) == pytest.approx(-0.5)
    perf = evaluation.performance(evaluation.equity_curve(df), per_year=4).first()
    assert perf.cagr == pytest.approx(0.66 - 1) and perf.max_drawdown == pytest.approx(-0.5)
    assert evaluation.years_ahead(spark.createDataFrame([("A", 1, 0.2), ("A", 2, 0.1)], "Ticker string, y int, total_return double"), spark.createDataFrame([(1, 0.1), (2, 0.3)], "y int, bench_return double")).first()[1:] == (2, 1)


def test_stream_equals_batch(spark: SparkSession, sf: str, tmp_path) -> None:  # noqa: ANN001
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events")
    q = daily.daily_panel(daily.stream(spark, f"{tmp_path}/events")).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = daily.daily_panel(spark.read.parquet(f"{sf}/events.parquet"))
    key = lambda d: sorted((str(r.Date), r.Ticker, round(r.Price, 6), r.Volume) for r in d.collect())
    assert key(spark.table("daily")) == key(want)


def test_coverage(spark: SparkSession, calendar: DataFrame) -> None:
    assert {r.Ticker for r in profile.late_starts(calendar).collect()} == {"T18", "T19"}
    assert {r.Ticker for r in profile.short_histories(calendar).collect()} == {"T19"}
    assert profile.training_start(calendar).first()[0] == dt.date(2019, 1, 1)
