from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidepanel.functions import columns as C
from tidepanel.functions import stats
from tidepanel.operators import profile
from tidepanel.sources import writers


def column(spark: SparkSession, values: list, f, kind: str = "string") -> list:  # noqa: ANN001
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x"))).collect()]


def test_numbers(spark: SparkSession) -> None:
    raw = ["1 234", "1,234.5", " 7 ", "#N/A N/A", "#n/a", "", None, "1,5", "abc", "-3e2", "nan", "inf"]
    assert column(spark, raw, C.loose_double) == [1234.0, 1234.5, 7.0, None, None, None, None, 15.0, None, -300.0, None, None]
    assert column(spark, raw, C.to_double)[:3] == [None, None, 7.0]


def test_dates(spark: SparkSession) -> None:
    d = dt.date
    raw = ["31.01.2020", "2020-01-31", "1.2.2020", "31.02.2020", "2020-02-03 10:00:00", "x", None, ""]
    assert column(spark, raw, C.day_first) == [d(2020, 1, 31), d(2020, 1, 31), d(2020, 2, 1), None, d(2020, 2, 3), None, None, None]
    assert column(spark, raw[:2], lambda c: C.to_day(c, "yyyy-MM-dd")) == [None, d(2020, 1, 31)]


def test_names(spark: SparkSession) -> None:
    assert column(spark, [" PX_LAST", "Daily  Return", "Div %", "Last Price", "SMI_Ret", None], C.field_name) == ["close", "return", "div_pct", "last_price", "smi_return", None]
    assert column(spark, ["ABBN SE Equity | Last Price", "x"], C.ticker_part) == ["ABBN SE Equity", "x"]
    assert column(spark, ["VIX Index", "EUR Index Curncy x", None], C.macro_name) == ["VIX", "EURx", None]
    df = spark.createDataFrame([("ABBN SE Equity", "BEst P/E Ratio"), ("VIX Index ", "Last-Price")], "t string, f string")
    assert [r[0] for r in df.select(C.feature_name(F.col("t"), F.col("f"))).collect()] == ["ABBN_BEstPERatio", "VIX_LastPrice"]


def test_guarded(spark: SparkSession) -> None:
    assert column(spark, [0.0, -1.0, 1.0, None], C.ln, "double") == [None, None, 0.0, None]
    assert column(spark, [-2.0, 0.0, None], C.log_growth, "double")[0] is None
    assert column(spark, [0.5, 1.5, 2.5, None], lambda c: C.half_even(c, 0), "double") == [0.0, 2.0, 2.0, None]
    assert column(spark, [5.0, None, -5.0], lambda c: C.clip(c, F.lit(-1.0), F.lit(1.0)), "double") == [1.0, None, -1.0]
    assert column(spark, [float("nan"), float("inf"), 1.0], C.finite, "double") == [None, None, 1.0]
    assert column(spark, [1.23456, None], lambda c: C.text_number(c, 2), "double") == ["1.23", ""]
    assert spark.createDataFrame([(1.0, 0.0)], "a double, b double").select(C.ratio(F.col("a"), F.col("b"))).first()[0] is None


def test_statistics_against_pandas(spark: SparkSession) -> None:
    rng = np.random.default_rng(0)
    df = pd.DataFrame({"a": rng.lognormal(size=200), "b": rng.normal(size=200), "c": 1.0})
    df.loc[::7, "a"] = None
    df.loc[::5, "b"] = None
    s = spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in r) for r in df.itertuples(index=False)], "a double, b double, c double")
    r = s.agg(stats.skewness(F.col("a")), stats.pair_corr(F.col("a"), F.col("b")), stats.pair_corr(F.col("a"), F.col("c")), stats.skewness(F.col("c"))).first()
    assert r[0] == pytest.approx(df["a"].skew()) and r[1] == pytest.approx(df["a"].corr(df["b"])) and r[2] is None and r[3] is None
    wide = s.withColumns({"d": F.col("a") * 1e9 + 1e12, "e": F.lit(None).cast("double")})
    got = {(x.a, x.b): x["corr"] for x in profile.correlations(wide, ["a", "b", "c", "d", "e"]).collect()}
    assert got["a", "b"] == pytest.approx(df["a"].corr(df["b"])) and got["a", "d"] == pytest.approx(1.0)
    assert got["a", "c"] is None and got["a", "e"] is None and len(got) == 10


@pytest.mark.parametrize("n", [1, 2, 3, 4, 999, 60_000])
def test_medians_are_exact(spark: SparkSession, n: int) -> None:
    rng = np.random.default_rng(n)
    df = pd.DataFrame({"k": "hot", "v": rng.standard_normal(n).round(3 if n > 999 else 9)})
    df = pd.concat([df, pd.DataFrame({"k": ["flat"] * 5 + ["cold"] * 4, "v": [2.0] * 5 + [1.0, -3.0, 8.0, 8.0]})])
    made = spark.createDataFrame(df, "k string, v double").unionByName(spark.createDataFrame([("cold", None), (None, 7.0)], "k string, v double"))
    got = {r["k"]: r["median"] for r in profile.medians(made, ["k"], "v").collect()}
    assert got == pytest.approx(df.groupby("k")["v"].median().to_dict(), abs=1e-12)


def test_heatmap(spark: SparkSession) -> None:
    df = spark.createDataFrame([(1.0, -1.0, 5.0), (2.0, -2.0, 5.0), (3.0, -3.0, 5.0)], "a double, `b<` double, c double")
    cells = profile.matrix(df, df.columns)
    got = {(r["row"], r["column"]): r["corr"] for r in cells.collect()}
    assert len(got) == 9 and got["a", "b<"] == got["b<", "a"] == pytest.approx(-1.0) and got["a", "a"] == 1.0 and got["c", "c"] is None
    picture = writers.heatmap(cells, df.columns)
    assert picture.count("<rect") == 9 and picture.count("rgb(255,0,0)") == 2 and picture.count("rgb(0,0,255)") == 2 and picture.count("#ccc") == 5 and "b&lt;" in picture


def test_profiles(spark: SparkSession) -> None:
    df = spark.createDataFrame([("2020-01-01", "A", 1.0), ("2020-01-01", "A", 2.0), (None, "A", None), (None, "A", 3.0), ("2020-01-02", None, 4.0)], "Date string, Ticker string, x double")
    assert tuple(profile.duplicates(df).first()) == (5, 2)
    assert dict(profile.null_shares(df).collect()) == {"Date": 0.4, "Ticker": 0.2, "x": 0.2}
    assert profile.duplicates(df.limit(0)).first()["n_rows"] == 0
    bias = profile.feature_bias(spark.createDataFrame([("A", 0.00432), ("A", 0.0044), ("A", 0.00424), ("B", None)], "Ticker string, f double"), ["f"]).collect()
    assert len(bias) == 1 and bias[0]["cv"] == pytest.approx(round(bias[0]["std"] / bias[0]["mean"], 3)) and bias[0]["non_null"] == 3
