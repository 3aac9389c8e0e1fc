"""Near-duplicate vectors: random-hyperplane hashing, exact cosine, connected components.

Equal vectors are one class, by its least vec_id, so copies are never compared. In each of ``tables``
tables a class falls into the bucket of the signs of its products with ``bits`` random planes. A pair at
the threshold shares a given bucket with probability ``(1 - acos(threshold) / pi) ** bits``; there are as many
tables as let more than 99.6% of such pairs meet in some table, and nearer pairs more often. The number of
bits follows that of classes (:func:`sized`), so that a bucket of unlike vectors holds about as many whatever the
table's size, and the pairs compared grow little faster than the table. Vectors in a
bucket are compared by exact cosine in double precision; a pair counts in the first table in which it
meets. Buckets of more than ``block`` classes are cut into blocks, and each pair of blocks is a task's unit
of work: memory is bounded and no bucket is cut short. No list of pairs is made: units give each class's
number of links, and a forest of the links for the components.

Null and zero vectors, and those with null or non-finite components, link with nothing, nor does a row
whose id is null (its component is null and it is kept). Vectors of different lengths link with nothing.
Repeated ids are rows of their own; their links count for the id's component. Columns of other names are
left alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.components import connected_components, forest, groups, repeated
from tidepanel.llm.skew import dealt
from tidepanel.llm.store import cut, drop, saved


HEAVY = 200_000  # buckets of more than a block that are sent whole to all tasks; beyond, they are joined


def sized(n: int, threshold: float, block: int, miss: float = 0.0033, least: int = 10) -> tuple[int, int]:
    """(bits, tables) for ``n`` classes: buckets of unlike vectors hold at most about ``block`` / 4, and a pair at the threshold meets in no table with probability ``miss``."""
    bits = min(30, max(least, math.ceil(math.log2(max(1, 4 * n / block)))))
    meets = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-meets))) if meets < 1 else 1


def planes(tables: int, bits: int, size: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((tables * bits, size))


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, offsets, and which vectors can link."""
    column = column.cast(pa.list_(pa.float64())) if not pa.types.is_large_list(column.type) else column
    valid = np.array(column.is_valid())
    offsets = np.asarray(column.offsets)
    flat = np.asarray(column.values.to_numpy(zero_copy_only=False), float)
    null = np.asarray(column.values.is_null())
    bad = np.concatenate([[0], np.cumsum(null | ~np.isfinite(flat))])
    some = np.concatenate([[0], np.cumsum(np.where(np.isfinite(flat), flat, 0) != 0)])
    ok = valid & (bad[offsets[1:]] == bad[offsets[:-1]]) & (some[offsets[1:]] > some[offsets[:-1]])
    return flat, offsets, ok


def classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, vector): ``key`` is null where the vector can't link, else equal for equal vectors."""
    kind = dict(vectors.dtypes)["vec_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, offsets, ok = _vectors(b.column(1))
            ok &= np.array(b.column(0).is_valid())
            raw = [(flat[i:j] + 0.0).tobytes() if o else None for i, j, o in zip(offsets[:-1], offsets[1:], ok, strict=True)]
            keys = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.record_batch([b.column(0), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "key", "vector"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, key binary, vector binary")


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw)).reshape(len(raw), -1)
    scale = np.abs(x).max(1, keepdims=True)  # so that neither very large nor very small vectors overflow
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def bucketed(reps: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """(place, code, size, id, copies, codes, vector): each class once in every table."""
    kind = dict(reps.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x.as_py() for x in b.column(2)]
            sizes = np.array([len(r) // 8 for r in raw], np.int64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                signs = (unit([raw[i] for i in at]) @ planes(tables, bits, size, seed).T > 0).reshape(len(at), tables, bits)
                codes = (signs * (1 << np.arange(bits))).sum(2).astype(np.int32)
                n = len(at)
                rows = pa.array(np.repeat(at, tables))
                packed = pa.array([c.tobytes() for c in codes], pa.binary()).take(pa.array(np.repeat(np.arange(n), tables)))
                yield pa.record_batch([pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(codes.ravel()), pa.array(np.full(n * tables, size, np.int32)), b.column(0).take(rows), b.column(1).take(rows), packed, b.column(2).take(rows)], ["place", "code", "size", "id", "copies", "codes", "vector"])

    return reps.mapInArrow(run, f"place int, code int, size int, id {kind}, copies long, codes binary, vector binary")


def links(reps: DataFrame, threshold: float, tables: int, bits: int, seed: int, block: int) -> DataFrame:
    """(id, n, other): parts of each class's number of linked vectors, and edges of a forest of the links."""
    kind = dict(reps.dtypes)["id"]
    rows = bucketed(reps, tables, bits, seed)
    heavy = cut(rows.groupBy("place", "code", "size").agg(F.count("*").alias("m")).where(F.col("m") > block).withColumn("parts", F.ceil(F.col("m") / block).cast("int")).drop("m"))
    few = heavy.count() <= HEAVY
    cut_up = rows.join(F.broadcast(heavy) if few else heavy, ["place", "code", "size"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut_up = cut_up.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    cells = cut_up.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("place", "code", "size", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "part", "id", "copies", "codes", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 5):
            if g.num_rows < 2:
                continue
            x = unit(g["vector"].to_pylist())
            codes = np.frombuffer(b"".join(g["codes"].to_pylist()), np.int32).reshape(len(x), -1)
            part, copies = g["part"].to_numpy(), g["copies"].to_numpy()
            place, low, high = g["place"][0].as_py(), g["low"][0].as_py(), g["high"][0].as_py()
            one, two = np.flatnonzero(part == low), np.flatnonzero(part == high)
            near = x[one] @ x[two].T >= threshold
            if low == high:
                near = np.triu(near, 1)
            a, b = np.nonzero(near)
            a, b = one[a], two[b]
            met = np.zeros(len(a), bool)
            for t in range(place):
                met |= codes[a, t] == codes[b, t]
            a, b = a[~met], b[~met]
            if not len(a):
                continue
            n = np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))
            root = forest(len(x), a, b)
            at = np.flatnonzero(n)
            tied = root[at] != at
            ids = g["id"].combine_chunks()
            other = ids.take(pa.array(np.where(tied, root[at], 0))).to_pylist()
            yield pa.record_batch([ids.take(pa.array(at)), pa.array(n[at].astype(np.int64)), pa.array([o if t else None for o, t in zip(other, tied, strict=True)], ids.type)], ["id", "n", "other"])

    key = ["place", "code", "size", "low", "high"]
    return cells.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, f"id {kind}, n long, other {kind}")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, tables: int | None = None, bits: int | None = None, seed: int = 0, block: int = 512) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept. ``bits`` and ``tables`` follow from the number of classes where they are not given."""
    rows = saved(classes(vectors), "vectors")
    own = saved(rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "classes")
    wanted = sized(own.count(), threshold, block) if bits is None else sized(1, threshold, block, least=bits)
    bits, tables = wanted[0] if bits is None else bits, wanted[1] if tables is None else tables
    found = saved(links(own.select("id", "copies", "vector"), threshold, tables, bits, seed, block), "links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    twice = repeated(rows.where("key is not null").select(F.col("vec_id").alias("src"), "key"), own.select("key", F.col("id").alias("dst")), ["key"])
    parts = connected_components(found.where("other is not null").select(F.col("id").alias("src"), F.col("other").alias("dst")).unionByName(twice))
    whole = own.select("key", "id", "copies").join(counts, "id", "left").join(parts, "id", "left")
    whole = cut(whole.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    ids = cut(rows.select("vec_id", "key"))
    drop(rows, own, found)
    out = dealt(ids, whole, ["key"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
