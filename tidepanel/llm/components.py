"""Connected components of a graph that is a table of edges, and groups of sorted Arrow streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.skew import HOT, LEAST, dealt
from tidepanel.llm.store import drop, gathered, saved


def _hubs(edges: DataFrame, total: int) -> DataFrame | None:
    """(src) of the nodes that over a HOT-th of the ``total`` edges touch, if any: at most 2 * HOT."""
    if total <= LEAST:
        return None
    ends = edges.select(F.explode(F.array("src", "dst")).alias("src"))
    hubs = ends.groupBy("src").count().where(F.col("count") > max(LEAST, total // HOT)).select("src")
    found = hubs.collect()
    return edges.sparkSession.createDataFrame(found, hubs.schema) if found else None


def _lowest(edges: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """``edges`` with low, the least dst of the src; a hub's edges stay where they are and get it by a broadcast."""
    low = F.min("dst")
    if hubs is None:
        return edges.withColumn("low", low.over(Window.partitionBy("src")))
    rest = edges.join(F.broadcast(hubs), "src", "left_anti").withColumn("low", low.over(Window.partitionBy("src")))
    held = edges.join(F.broadcast(hubs), "src", "left_semi")
    return rest.unionByName(held.join(F.broadcast(held.groupBy("src").agg(low.alias("low"))), "src"))  # a row for each hub


def _stars(edges: DataFrame, large: bool, hubs: DataFrame | None, total: int) -> DataFrame:
    """One half-round over at most ``total`` edges: neighbours of each node are tied to the least of them, or to the node if that is less."""
    if large:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        tied = gathered(_lowest(both, hubs), 2 * total).where("dst > src")
        return gathered(tied.select(F.col("dst").alias("src"), F.least("src", "low").alias("dst")).distinct(), total)
    tied = gathered(_lowest(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")), hubs), total)
    ends = F.explode(F.when(F.col("dst") == F.col("low"), F.array("src")).otherwise(F.array("src", "dst")))
    return gathered(tied.select(ends.alias("src"), F.col("low").alias("dst")).distinct(), total)


def connected_components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(src, dst) to (id, component): the least id that each id's edges lead to; ids without edges are left out.

    Large-star and small-star rounds, each written to the shared folder, until nothing changes. Edges may
    repeat, have either direction, or be loops; edges with a null end are none. The result reads the last
    round's table, which :func:`drop` of it deletes. ``most`` is a bound of the number of edges, if known.
    """

    def marked(table: DataFrame) -> tuple:
        return table.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()

    now = edges.where("src <> dst").select("src", "dst").distinct()
    now = saved(now if most is None else gathered(now, most), "edges")
    mark, seen = marked(now), None
    total = mark[0]  # rounds never add edges
    while total and mark != seen:
        hubs = _hubs(now, total)  # the second half of a round gives no node more edges than it had before the first
        now, past = saved(_stars(_stars(now, True, hubs, total), False, hubs, total), "edges"), now
        drop(past)
        mark, seen = marked(now), mark
    out = now.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct())
    out.path = now.path
    return out


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts`` (id, component) with what the links (a, b) tie together, written; ids not in ``parts`` are their own component.

    Only the links' ends and their components are tied anew, not all that these hold.
    """
    n = links.count()
    if not n:
        return saved(parts, "components")
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    touched = parts.join(ends, "id", "left_semi").select(F.col("id").alias("src"), F.col("component").alias("dst"))
    new = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(touched), 3 * n)
    total = parts.count()
    known = dealt(parts, new.select(F.col("id").alias("component"), F.col("component").alias("to")), ["component"], "left", total)
    out = known.select("id", F.coalesce("to", "component").alias("component")).unionByName(new.join(parts, "id", "left_anti"))
    out = saved(gathered(out, total + 2 * n), "components")
    drop(new)
    return out


def repeated(rows: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """(src, dst): from each id that several of the ``rows`` (src, *key) have to its classes' ids dst."""
    twice = rows.groupBy("src").agg(F.count("*").alias("n")).where("n > 1").select("src")
    return rows.join(twice, "src", "left_semi").join(classes, key).select("src", "dst").where("src <> dst").distinct()


def stretches(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Stretches of rows, and the places where a new run of equal integers in the first ``keys`` columns begins.

    Runs are whole, over the batches' edges too; the places end with the number of rows.
    """
    held: list[pa.RecordBatch] = []

    def cut_up() -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        k = np.stack([t.column(i).to_numpy() for i in range(keys)], 1)
        return t, np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, [len(k)]])

    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy() for i in range(keys)], 1)
        new = np.flatnonzero((k != k[-1]).any(1))
        last = int(new[-1]) + 1 if len(new) else 0  # the last run may go on in the next batch
        if last or held and (np.array([held[-1].column(i)[held[-1].num_rows - 1].as_py() for i in range(keys)]) != k[0]).any():
            if last:
                held.append(b.slice(0, last))
            yield cut_up()
            held.clear()
        held.append(b.slice(last))
    if held:
        yield cut_up()


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of :func:`stretches` one by one."""
    for t, at in stretches(batches, keys):
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield t.slice(i, j - i)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least item that each of ``n`` items is tied to by the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label
