"""Joins with hot keys: the same rows as a plain join, no task with most of them."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import chosenpath, components, vectors
from tidepanel.llm.skew import dealt


def rows_of(df: DataFrame) -> Counter:
    return Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def largest(df: DataFrame) -> tuple[int, float]:
    """The rows of the largest partition, and the mean over those that have any."""
    n = [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]
    return max(n), sum(n) / len(n)


@pytest.fixture
def many_partitions(spark: SparkSession):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(before, ("40", "false", "-1"), strict=True):
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_dealt_joins_as_a_plain_join_does(many_partitions: SparkSession, how: str) -> None:
    rows = many_partitions.range(6_000).select(F.expr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 5 = 0 THEN NULL WHEN id % 7 = 0 THEN -1 ELSE id % 500 END").alias("k"), F.lit("x").alias("K2"), (F.col("id") % 50).alias("_n"), F.lit(1).alias("_salt"))
    table = many_partitions.range(400).select(F.expr("CASE WHEN id = 9 THEN NULL ELSE id END").alias("k"), (F.col("id") * 2).alias("_parts"))
    assert rows_of(dealt(rows, table, ["k"], how)) == rows_of(rows.join(table, "k", how))
    assert dealt(rows, table, ["k"], how).columns == rows.join(table, "k", how).columns
    assert rows_of(dealt(rows.limit(0), table, ["k"], how)) == rows_of(dealt(rows, table.limit(0), ["k"], "inner")) == Counter()


def test_a_hot_key_and_nulls_go_to_many_tasks(many_partitions: SparkSession) -> None:
    n = 40_000
    rows = many_partitions.range(n).select("id", F.expr("CASE WHEN id % 3 = 0 THEN -1 WHEN id % 3 = 1 THEN NULL ELSE id END").alias("k"))
    table = many_partitions.range(-1, n).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    plain, _ = largest(rows.join(table, "k", "left"))
    most, mean = largest(dealt(rows, table, ["k"], "left"))
    assert plain > n / 3 and most < 4 * mean


@pytest.mark.parametrize("hub", [0, 50_000])
def test_edges_of_a_hub_go_to_many_tasks(many_partitions: SparkSession, hub: int) -> None:
    leaves = many_partitions.range(1, 6_001).select(F.lit(hub).cast("long").alias("src"), F.col("id").alias("dst"))
    others = many_partitions.range(10_000, 40_000).select(F.col("id").alias("src"), (F.col("id") + 60_000).alias("dst"))
    edges = leaves.unionByName(others)
    for large in (True, False):
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        least = both.groupBy("src").agg(F.min("dst").alias("low"))
        most, mean = largest(dealt(both, least, ["src"]))
        assert most < 4 * mean
    got = dict(components.connected_components(edges).collect())
    low = 0 if hub == 0 else 1
    assert len(got) == 6_001 + 60_000
    assert all(got[i] == low for i in (hub, 1, 3_000, 6_000)) and all(got[i] == got[i + 60_000] == i for i in (10_000, 25_000, 39_999))
    assert Counter(got.values())[low] == 6_001


def test_components_of_random_graphs_with_hubs(spark: SparkSession) -> None:
    rng = random.Random(3)
    edges = [(rng.choice((5, 9_999, rng.randrange(10_000))), rng.randrange(10_000)) for _ in range(6_000)]
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want: dict[int, int] = {}
    for i in sorted(near):
        todo = [] if i in want else [i]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = i
                todo += near[x]
    assert dict(components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()) == want


def test_merged_with_a_giant_component(spark: SparkSession) -> None:
    parts = spark.range(5_000).select("id", F.expr("CASE WHEN id < 4000 THEN 0 ELSE id END").alias("component"))
    links = spark.range(4_000, 4_500).select(F.col("id").alias("a"), F.lit(17).cast("long").alias("b")).unionByName(spark.range(3_000).select((F.col("id") % 2 + 8_000).alias("a"), F.lit(4_600).cast("long").alias("b")))
    got = dict(components.merged(parts, links).collect())
    want = {i: 0 if i < 4_500 else i for i in range(5_000)} | {8_000: 4_600, 8_001: 4_600}
    assert got == want


def test_vectors_that_cannot_link_and_copies(spark: SparkSession) -> None:
    rows = [(i, None if i % 3 == 0 else [1.0, 2.0] if i % 3 == 1 else [float(i), -1000.0 - i * i]) for i in range(1_500)]
    got = {r[0]: tuple(r)[1:] for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), threshold=0.9999999).collect()}
    assert len(got) == 1_500
    assert all(got[i] == (0, i, True) for i in range(0, 1_500, 3))
    assert all(got[i] == (499, 1, i == 1) for i in range(1, 1_500, 3))


def test_rows_of_large_nodes_are_not_shuffled(many_partitions: SparkSession, tmp_path) -> None:
    rows = many_partitions.range(20_000).select((F.col("id") % 3).alias("node"), "id")
    rows.groupBy("node").agg(F.count("*").alias("m")).write.parquet(str(tmp_path / "nodes"))
    nodes = many_partitions.read.parquet(str(tmp_path / "nodes"))
    for how, n in (("inner", 20_000), ("left_semi", 20_000), ("left_anti", 0)):
        held = chosenpath.in_nodes(rows, nodes, how)
        assert "hashpartitioning" not in held._jdf.queryExecution().executedPlan().toString()
        assert held.count() == n


def test_components_without_edges_and_of_stars_take_one_round_at_most(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    rounds = []
    monkeypatch.setattr(components, "_stars", lambda *a, stars=components._stars: rounds.append(a[1]) or stars(*a))
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert rounds == []
    assert dict(components.connected_components(spark.createDataFrame([(2, 1), (3, 1)], "src long, dst long")).collect()) == {1: 1, 2: 1, 3: 1}
    assert len(rounds) == 2
