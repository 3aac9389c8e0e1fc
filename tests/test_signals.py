"""Signals, strategies, sub-periods, places and ranks against plain computations."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators import backtest, blocked, clean, evaluation, order, profile, regimes, signal, split, windows
from tidepanel.plans import catalogue

DAY = dt.date(2020, 1, 1)


def day(i: int) -> dt.date:
    return DAY + dt.timedelta(i)


# --- logistic regression


def assigned(spark: SparkSession, rng: random.Random) -> tuple[DataFrame, pd.DataFrame]:
    rows = []
    for split in (0, 1, 4):
        for i in range(300):
            x, z = rng.gauss(0, 1), rng.gauss(split, 3)
            y = int(rng.random() < 1 / (1 + math.exp(-(0.3 + (1 + split) * x - 0.2 * z))))
            rows.append((split, "train" if i < 200 else "test", day(i), "T", None if i % 31 == 0 else x, z, None if i % 37 == 0 else y))
    names = ["split_id", "part", "Date", "Ticker", "a b", "z", "label"]
    return spark.createDataFrame(rows, "split_id int, part string, Date date, Ticker string, `a b` double, z double, label int").repartition(5), pd.DataFrame(rows, columns=names)


def newton(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
    return w


def test_models_equal_a_plain_fit(spark: SparkSession) -> None:
    df, plain = assigned(spark, random.Random(1))
    models = signal.fit(df, ["a b", "z"], ridge=0.5)
    said = {(r["split_id"], r["Date"]): r["p"] for r in signal.forecasts(df, models, ["a b", "z"]).collect()}
    assert len(said) == 300
    for r in models.collect():
        own = plain[plain.split_id == r["split_id"]]
        train = own[own.part == "train"].dropna()
        want = newton(train[["a b", "z"]].to_numpy(), train["label"].to_numpy(float), 0.5)
        assert r["n_train"] == len(train)
        assert np.allclose([r["intercept"], *r["weights"]], want, atol=1e-8)
        for t in own[own.part == "test"].itertuples(index=False):
            p = said[r["split_id"], t.Date]
            assert p is None if math.isnan(t[4]) else abs(p - 1 / (1 + math.exp(-(want @ [1, t[4], t[5]])))) < 1e-8


def test_separable_and_empty_training(spark: SparkSession) -> None:
    rows = [(0, "train", float(i), int(i > 10)) for i in range(20)] + [(1, "test", 1.0, 1)]
    df = spark.createDataFrame(rows, "split_id int, part string, x double, label int")
    model = signal.fit(df, ["x"], ridge=1e-3).collect()
    assert len(model) == 1 and model[0]["weights"][0] > 1 and model[0]["n_steps"] < 50
    assert signal.fit(df.where("split_id = 1"), ["x"]).count() == 0
    assert signal.forecasts(df, signal.fit(df, ["x"]), ["x"]).count() == 0


def test_labels_are_of_the_next_row(spark: SparkSession) -> None:
    df = spark.createDataFrame([("A", day(i), r, b) for i, (r, b) in enumerate([(0.0, 0.0), (0.2, 0.1), (0.1, 0.1), (None, 0.1), (0.3, 0.2)])], "Ticker string, Date date, r double, b double")
    got = [r[0] for r in df.withColumn("y", signal.next_sign(F.col("r"), F.col("b"))).orderBy("Date").select("y").collect()]
    assert got == [1, 0, None, 1, None]


# --- strategies


def test_strategy_step_by_step(spark: SparkSession) -> None:
    rng = random.Random(2)
    rows = [(k, day(i), rng.choice([None, 0.4, 0.5, 0.52, 0.56, 0.7]), None if rng.random() < 0.1 else rng.gauss(0, 0.02), None if rng.random() < 0.1 else rng.gauss(0, 0.02)) for k in ("A", "B") for i in range(80)]
    df = spark.createDataFrame(rows, "Ticker string, Date date, p double, r double, br double").repartition(4)
    traded = backtest.strategy(df, cost=0.002, least=10)
    got = {(r["Ticker"], r["Date"]): r for r in traded.collect()}
    for k in ("A", "B"):
        held, beta, seen, equity, peak, worst = 0.0, None, [], 1.0, 1.0, 0.0
        for _, d, p, r, b in (x for x in rows if x[0] == k):
            gross = held * ((r or 0.0) - (beta or 0.0) * (b or 0.0))
            if r is not None and b is not None:
                seen.append((r, b))
            beta = np.cov(np.array(seen).T)[0, 1] / np.var([y for _, y in seen], ddof=1) if len(seen) >= 10 else None
            now = 1.0 if p is not None and p >= 0.55 else 0.0 if p is not None and p <= 0.5 else held
            cost = abs(now - held) * (1 + abs(beta or 0.0)) * 0.002
            held = now
            x = got[k, d]
            assert x["position"] == held and (x["beta"] is None) == (beta is None)
            assert np.allclose([x["beta"] or 0.0, x["gross"], x["cost"], x["net"]], [beta or 0.0, gross, cost, gross - cost], atol=1e-9)
            equity *= 1 + gross - cost
            peak = max(peak, equity)
            worst = min(worst, equity / peak - 1)
        r = backtest.results(traded).where(F.col("Ticker") == k).first()
        assert abs(r["cagr"] - (equity ** (252 / 80) - 1)) < 1e-8 and abs(r["max_drawdown"] - worst) < 1e-8
    with pytest.raises(ValueError):
        backtest.position(F.col("p"), enter=0.5, leave=0.5)
    assert backtest.portfolio(traded).count() == 80
    assert backtest.results(traded.limit(0)).count() == 0


def test_a_total_loss_stays_one(spark: SparkSession) -> None:
    df = spark.createDataFrame([("A", day(i), r) for i, r in enumerate([0.1, -1.2, 5.0])], "Ticker string, Date date, r double")
    assert [round(r[0], 9) for r in evaluation.equity_curve(df).orderBy("Date").select("equity").collect()] == [1.1, 0.0, 0.0]


# --- sub-periods


def walked(price: list[float], fall: float, rise: float) -> list[int]:
    """The period of each row, by walking the machine."""
    starts, bear, extreme, at = [], False, price[0], 0
    for i, p in enumerate(price):
        if (p >= extreme * (1 + rise)) if bear else (p <= extreme * (1 - fall)):
            starts.append(at + 1)
            bear, extreme, at = not bear, p, i
        elif (p < extreme) if bear else (p > extreme):
            extreme, at = p, i
    return [sum(s <= i for s in starts) for i in range(len(price))]


def test_periods_equal_a_walk(spark: SparkSession) -> None:
    rng, rows, want = random.Random(4), [], {}
    for k in range(30):
        p, prices = 100.0, []
        for _ in range(rng.choice([1, 5, 700])):
            p *= math.exp(rng.gauss(0, 0.06))
            prices.append(round(p, 1) if k % 2 else p)
        for i, (x, n) in enumerate(zip(prices, walked(prices, 0.15, 0.2))):
            rows.append((f"T{k}", day(i), x))
            want[f"T{k}", day(i)] = n
    rows += [("none", day(0), None), (None, day(0), 1.0), ("T0", day(90_000), None)]
    df = spark.createDataFrame(rows, "Ticker string, Date date, Price double").repartition(3)
    got = regimes.periods(df, fall=0.15, rise=0.2)
    found = {(r["Ticker"], r["Date"]): (r["period"], r["regime"]) for r in got.collect()}
    assert len(found) == len(rows)
    for key, n in want.items():
        assert found[key] == (n, "bear" if n % 2 else "bull")
    assert found["none", day(0)][0] == 0 and found["T0", day(90_000)][0] == max(n for (k, _), n in want.items() if k == "T0")
    assert sum(r["n_rows"] for r in regimes.figures(got).collect()) == len(want) + 1
    assert regimes.periods(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        regimes.periods(df, fall=1.0)


# --- places and ranks


def test_positions_number_a_sorted_table(spark: SparkSession) -> None:
    rng = random.Random(6)
    rows = [(None if rng.random() < 0.05 else "hot" if rng.random() < 0.4 else f"k{rng.randrange(50)}", None if rng.random() < 0.05 else rng.randrange(40), i % 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, n int, x int").repartition(7)
    got = order.positions(df, ["k", "n"], ranges=16)
    found = got.orderBy("position").collect()
    assert [r["position"] for r in found] == list(range(3000))
    key = lambda r: (r[0] is None, r[0] or "", r[1] is None, r[1] or 0)
    assert [key(r) for r in found] == sorted(map(key, rows))
    assert {tuple(r)[:4] for r in found} == {tuple(r)[:4] for r in order.positions(df.repartition(3), ["k", "n"], ranges=5).collect()}
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert order.positions(df.limit(0), ["k"]).count() == 0


def test_rank_correlations_equal_pandas(spark: SparkSession) -> None:
    rng = random.Random(8)
    rows = [(i % 900, "T", rng.gauss(0, 1), 0.0 if rng.random() < 0.4 else rng.gauss(0, 1), float(rng.randrange(5)), 1.0) for i in range(1000)]
    rows = [(i, t, a, b + a / 2, c, e) for i, t, a, b, c, e in rows]
    df = spark.createDataFrame(rows, "Date int, Ticker string, a double, b double, c double, e double").repartition(4)
    want = pd.DataFrame(rows, columns=df.columns)[["a", "b", "c", "e"]].corr("spearman")
    for r in order.rank_correlations(df, ["a", "b", "c", "e"], ranges=8).collect():
        w = want.loc[r["a"], r["b"]]
        assert r["corr"] is None if math.isnan(w) else abs(r["corr"] - w) < 1e-9
    holes = df.withColumn("b", F.when(F.col("Date") % 7 > 0, F.col("b")))
    plain = pd.DataFrame([(a, b, c) for i, t, a, b, c, e in rows if i % 7 > 0], columns=["a", "b", "c"]).corr("spearman")
    for r in order.rank_correlations(holes, ["a", "b", "c"], complete=True, ranges=8).collect():
        assert abs(r["corr"] - plain.loc[r["a"], r["b"]]) < 1e-9
    assert order.ranked(df.limit(0), ["a", "b"], ["Date"]).count() == 0


def test_correlations_by_tiles_equal_pandas(spark: SparkSession) -> None:
    rng = random.Random(3)
    names = [f"x {i}" if i == 4 else f"x{i}" for i in range(23)]
    rows = []
    for _ in range(400):
        base = rng.gauss(0, 1)
        rows.append([None if rng.random() < 0.1 else 1e6 * (i % 3) + base * (i % 5) + rng.gauss(0, 1) for i in range(21)] + [7.0, None])
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in names)).repartition(5)
    want = pd.DataFrame(rows, columns=names, dtype=float).corr()
    for tile in (1, 4, 23, 512):
        got = profile.correlations(df, names, tile=tile, tasks=6).collect()
        assert sorted((r["pos_a"], r["pos_b"]) for r in got) == [(i, j) for i in range(23) for j in range(i + 1, 23)]
        for r in got:
            w = want.loc[r["a"], r["b"]]
            assert (r["a"], r["b"]) == (names[r["pos_a"]], names[r["pos_b"]])
            assert r["corr"] is None if math.isnan(w) or 21 in (r["pos_a"], r["pos_b"]) else abs(r["corr"] - w) < 1e-9
    assert all(r["corr"] is None for r in profile.correlations(df.limit(0), names, tile=9).collect())
    assert profile.correlations(df, [], tile=9).count() == profile.correlations(df, names[:1], tile=9).count() == 0


def test_correlations_scan_only_a_pair_of_tiles(spark: SparkSession, tmp_path) -> None:
    n = 40
    spark.range(50).select(*(F.rand(i).alias(f"x{i}") for i in range(n))).write.parquet(f"{tmp_path}/wide")
    plan = profile.correlations(spark.read.parquet(f"{tmp_path}/wide"), [f"x{i}" for i in range(n)], tile=10)._jdf.queryExecution().executedPlan().toString()
    scans = [line.count(":double") for line in plan.split("ReadSchema: ")[1:]]
    assert len(scans) == 10 and max(scans) <= 20


def test_quantile_bounds_are_exact(spark: SparkSession) -> None:
    values = [float(i % 97) for i in range(1000)] + [5.0] * 600
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
    ranked = sorted(values)
    assert order.quantile_bounds(df, "v", 8, ranges=7) == sorted({ranked[1600 * i // 8] for i in range(1, 8)})


def test_kinds_by_content(spark: SparkSession) -> None:
    rows = [("1", " 2.5", "2020-01-01", "x", None, "same"), ("2", "-1e3", "2021-12-31", "1", None, "same"), (None, "0", None, "", None, "same")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string").selectExpr("*", "3 as `g h`")
    got = {r["column"]: (r["kind"], r["n"]) for r in clean.kinds(df).collect()}
    assert got == {"a": ("number", 2), "b": ("number", 3), "c": ("date", 2), "d": ("text", 3), "e": ("empty", 0), "f": ("constant", 3), "g h": ("constant", 3)}
    assert {r["kind"] for r in clean.kinds(df.limit(0)).collect()} == {"empty"}


# --- long series in blocks, and splits as a table


@pytest.mark.parametrize("size", [7, 40, 5000])
def test_blocks_give_what_whole_series_give(spark: SparkSession, size: int) -> None:
    rng = random.Random(size)
    rows = [("long" if i % 3 else f"T{i % 7}", day(i), None if rng.random() < 0.3 else rng.gauss(0, 1)) for i in range(900)] + [(None, day(3), 1.0), ("gone", day(1), None)]
    df = spark.createDataFrame(rows, "Ticker string, Date date, v double").repartition(6)
    w = windows.by_ticker("Ticker")
    make = lambda w: {"m": windows.rolling(F.avg, F.col("v"), w, 7, 3), "l": F.lag("v", 2).over(w), "n": F.lead("v", 5).over(w)}
    key = lambda r: repr(tuple(r))
    got = blocked.windowed(df, make, size=size, back=7, ahead=5, ranges=9)
    want = df.withColumns(make(w))
    close = lambda d: sorted(map(key, d.selectExpr("Ticker", "Date", "v", "round(m, 9) m", "l", "n").collect()))
    assert close(got) == close(want)
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    full = blocked.filled(df, {"f": "v"}, size=size, ranges=9)
    assert sorted(map(key, full.collect())) == sorted(map(key, df.withColumn("f", windows.filled(F.col("v"), w)).collect()))
    with pytest.raises(ValueError):
        blocked.windowed(df, make, size=6, back=7)
    assert blocked.windowed(df.limit(0), make, size=size, back=7, ahead=5).count() == blocked.filled(df.limit(0), {"f": "v"}).count() == 0


def test_one_series_is_spread_over_tasks(spark: SparkSession) -> None:
    df = spark.range(20_000).selectExpr("'one' as Ticker", "date_add(DATE'1990-01-01', cast(id as int)) as Date", "cast(id as double) as v")
    out = blocked.windowed(df, lambda w: {"m": F.avg("v").over(w.rowsBetween(-9, 0))}, size=500, back=9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be put together
    parts = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in parts) == 20_000 and len(parts) > 3


def test_splits_as_a_table(spark: SparkSession) -> None:
    rng = random.Random(3)
    made = [split.Split(i, day(a), day(a + rng.randrange(0, 90)), day(a + 95), day(a + 95 + rng.randrange(0, 40))) for i, a in enumerate(rng.randrange(0, 700) for _ in range(60))]
    df = spark.createDataFrame([("T", day(i)) for i in range(0, 900)] + [("U", day(5))] * 3 + [("V", None)], "Ticker string, Date date")
    got = split.assign_by_table(df, split.table(df, made), width=10)
    key = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert key(got) == key(split.assign(df, [s for s in made]))
    many = spark.range(10_000).selectExpr("cast(id as int) split_id", "date_add(DATE'2020-01-01', cast(id % 700 as int)) train_start").selectExpr("split_id", "train_start", "date_add(train_start, 60) train_end", "date_add(train_start, 61) test_start", "date_add(train_start, 70) test_end")
    plan = split.assign_by_table(df, many)
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString() and plan.count() > 400_000


def test_ranges_are_found_by_few_comparisons(spark: SparkSession) -> None:
    df = spark.range(3_000).select(F.expr("CASE WHEN id % 11 = 0 THEN NULL ELSE (id * 7919) % 500 END").alias("a"), (F.col("id") % 13).alias("b"), "id")
    dealt = order._ranges(df, ["a", "b"], 64)
    assert "filter(" not in dealt._jdf.queryExecution().optimizedPlan().toString().lower().replace("filter (", "")
    rows = [((r["a"] is None, -1 if r["a"] is None else r["a"], r["b"]), r["_range"]) for r in dealt.collect()]
    rows.sort()
    assert [r for _, r in rows] == sorted(r for _, r in rows) and len({r for _, r in rows}) > 32
    for n in (0, 1, 2, 3, 64):  # no bounds, fewer than ranges, as many
        got = order.positions(df.limit(n), ["a", "b"], ranges=64).collect()
        assert sorted(r["position"] for r in got) == list(range(n))


def test_the_strategy_reads_the_lines_once(spark: SparkSession, sf: str, monkeypatch: pytest.MonkeyPatch) -> None:
    read = []
    monkeypatch.setattr(catalogue, "table", lambda s, d, name, table=catalogue.table: read.append(name) or table(s, d, name))
    out = catalogue.traded(spark, sf)
    assert read == ["lineitem", "part"]
    assert "lineitem" not in " ".join(out.inputFiles())


def test_stored_panel_and_benchmark_equal_the_direct_ones(spark: SparkSession, sf: str) -> None:
    for got, want in zip(catalogue.stored(spark, sf), (catalogue.panel(spark, sf), catalogue.benchmark(spark, sf)), strict=True):
        assert got.dtypes == want.dtypes
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
