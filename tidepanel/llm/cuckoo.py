"""Line dedup with sharded cuckoo filters over exact reference counts.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` and with A-Z lower-cased, kept as a 128-bit hash.
Keys of at least ``min_chars`` code points are references. The exact state is the table of references
(key, doc_id), and counted over it (key, n_docs, last_doc). A key that at least ``min_docs`` documents hold
is common. Each shard of keys has a cuckoo filter of its common keys (:class:`CuckooFilter`), so that most
lines pass by without a look into the exact table; what a filter lets through is joined to the exact
counts, so results are exact.

:class:`LineIndex` keeps that state over batches: ``insert`` adds a batch's references and their new
common keys to the filters, ``delete`` takes documents out again and removes from the filters the keys that
are no longer common, and ``apply`` drops lines by the state of the moment. Only the keys of a batch are
counted anew, and a filter that would be more than nine tenths full is built larger from its shard's keys.
Inserting and deleting the same documents leaves the state as it was.

A null or empty text is one empty line. Documents that share a doc_id count as one holder, and all lose
the same lines. Null doc_ids hold nothing and lose nothing. An empty table gives an empty result. Columns of other names are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.store import drop, free, saved
from tidepanel.llm.textvec import mix

BLANK = b" \t\n\x0b\x0c\r"
SALTS = 64  # a shard's lines go to so many tasks
HOT = 1000  # a key's references are joined in parts of at most about so small a share of all
FILTER = "shard int, filter binary, slots long, held long"


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key has two buckets. What finds no place goes to a stash."""

    SLOTS, KICKS = 4, 200

    def __init__(self, capacity: int) -> None:
        self.buckets = 1 << max(1, (max(1, capacity) * 10 // (self.SLOTS * 8)).bit_length())
        self.table = np.zeros((self.buckets, self.SLOTS), np.uint16)
        self.stash: list[int] = []

    def _of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = mix(np.asarray(keys).astype(np.uint64))
        prints = (keys >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
        first = (keys & np.uint64(self.buckets - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(prints.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> None:
        for key, f, a, b in zip(np.asarray(keys).tolist(), *(x.tolist() for x in self._of(keys)), strict=True):
            at = a
            for kick in range(self.KICKS):
                for bucket in (a, b) if not kick else (at,):
                    free = np.flatnonzero(self.table[bucket] == 0)
                    if len(free):
                        self.table[bucket, free[0]] = f
                        break
                else:  # push one out, and find it its other place
                    slot = (f + kick) % self.SLOTS
                    f, self.table[at, slot] = int(self.table[at, slot]), f
                    at = int(self._other(np.array([at]), np.array([f], np.uint16))[0])
                    continue
                break
            else:  # undo by keeping what was pushed out where every lookup sees it
                self.stash.append((at << 16) | f)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        f, a, b = self._of(keys)
        found = (self.table[a] == f[:, None]).any(1) | (self.table[b] == f[:, None]).any(1)
        for s in self.stash:
            found |= (f == (s & 0xFFFF)) & ((a == s >> 16) | (b == s >> 16))
        return found

    def delete(self, keys: np.ndarray) -> None:
        """Removes keys that were inserted."""
        for f, a, b in zip(*(x.tolist() for x in self._of(keys)), strict=True):
            for s in ((a << 16) | f, (b << 16) | f):
                if s in self.stash:
                    self.stash.remove(s)
                    break
            else:
                for bucket in (a, b):
                    here = np.flatnonzero(self.table[bucket] == f)
                    if len(here):
                        self.table[bucket, here[0]] = 0
                        break

    @property
    def held(self) -> int:
        return int(np.count_nonzero(self.table)) + len(self.stash)

    def row(self, shard: pa.ChunkedArray) -> pa.Table:
        """A row of the table of filters."""
        return pa.table({"shard": shard.cast(pa.int32()), "filter": pa.array([self.to_bytes()], pa.binary()), "slots": pa.array([self.table.size], pa.int64()), "held": pa.array([self.held], pa.int64())})

    def to_bytes(self) -> bytes:
        return np.array([self.buckets, len(self.stash), *self.stash], np.int64).tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        f = cls(1)
        f.buckets, n = np.frombuffer(data, np.int64, 2).tolist()
        f.stash = np.frombuffer(data, np.int64, n, 16).tolist()
        f.table = np.frombuffer(data, np.uint16, offset=16 + 8 * n).reshape(f.buckets, cls.SLOTS).copy()
        return f


def split(text: bytes, min_chars: int = 20) -> tuple[list[bytes], list[bytes | None]]:
    """The lines, and each one's 16-byte key, or None if it is too short."""
    lines, keys = text.split(b"\n"), []
    for line in lines:
        key = line.strip(BLANK).lower()  # of bytes: A-Z alone
        long = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)
        keys.append(hashlib.blake2b(key, digest_size=16).digest() if long else None)
    return lines, keys


def _raw(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column.cast(pa.binary())]


def references(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """Distinct (k1, k2, doc_id): the keys of each document's lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                keys = [list({k for k in split(t, min_chars)[1] if k}) for t in _raw(part.column(1))]
                counts = np.array([len(k) for k in keys], np.int64)
                flat = np.frombuffer(b"".join(x for k in keys for x in k), np.int64).reshape(-1, 2)
                yield pa.record_batch([pa.array(flat[:, 0]), pa.array(flat[:, 1]), part.column(0).take(pa.array(np.repeat(np.arange(len(keys)), counts)))], ["k1", "k2", "doc_id"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"k1 long, k2 long, doc_id {kind}")


def counts(refs: DataFrame) -> DataFrame:
    """(k1, k2, n_docs, last_doc): the exact reference counts."""
    return refs.groupBy("k1", "k2").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def _shard(shards: int) -> F.Column:
    return F.pmod(F.col("k2"), F.lit(shards)).cast("int").alias("shard")


def filters(common: DataFrame, shards: int) -> DataFrame:
    """(shard, filter, slots, held): a cuckoo filter of each shard's common keys."""

    def build(t: pa.Table) -> pa.Table:
        keys = np.sort(t["k1"].to_numpy())
        f = CuckooFilter(len(keys))
        f.insert(keys)
        return f.row(t["shard"][:1])

    return common.select("k1", _shard(shards)).groupBy("shard").applyInArrow(build, FILTER)


def probe(refs: DataFrame, kept: DataFrame, shards: int) -> DataFrame:
    """The references that their shard's filter lets through.

    A shard's references go to ``SALTS`` tasks, each after a copy of the filter, and stream past it; so a
    key that very many documents hold is dealt out, and only filters stay in memory.
    """
    salted = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    kind = dict(refs.dtypes)["doc_id"]
    lines = refs.select(_shard(shards), salted, F.lit(1).alias("part"), "k1", "k2", "doc_id", F.lit(None).cast("binary").alias("filter"))
    heads = kept.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(None).cast(kind).alias("doc_id"), "filter")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, f = None, None
        for b in batches:
            place = b.column(0).to_numpy().astype(np.int64) * SALTS + b.column(1).to_numpy()
            part, keys = b.column(2).to_numpy(), b.column(3).to_numpy()
            keep = np.zeros(b.num_rows, bool)
            edges = [0, *(np.flatnonzero((place[1:] != place[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), b.num_rows]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if i < j and part[i] == 0:
                    at, f = place[i], CuckooFilter.from_bytes(b.column(6)[i].as_py())
                elif i < j and place[i] == at:
                    keep[i:j] = f.contains(keys[i:j])
            yield pa.record_batch([b.column(i) for i in (3, 4, 5)], ["k1", "k2", "doc_id"]).filter(pa.array(keep))

    laid = lines.unionByName(heads).repartition(F.col("shard"), F.col("salt")).sortWithinPartitions("shard", "salt", "part")
    return laid.mapInArrow(run, f"k1 long, k2 long, doc_id {kind}")


def drops(refs: DataFrame, common: DataFrame, kept: DataFrame, shards: int) -> DataFrame:
    """(doc_id, keys): what each document loses.

    A key of more than a ``HOT``-th of the common keys' references is dealt to several tasks. There are less than
    ``HOT`` such keys, as their references are no more than all; so they are broadcast.
    """
    total = common.agg(F.sum("n_docs")).first()[0] or 1
    dealt = common.withColumn("parts", F.ceil(F.col("n_docs") * HOT / F.lit(total)))
    hot = F.broadcast(dealt.where("parts > 1").select("k1", "k2", "parts"))
    salted = probe(refs, kept, shards).join(hot, ["k1", "k2"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0)))
    copies = dealt.select("k1", "k2", "last_doc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"))
    exact = salted.join(copies, ["k1", "k2", "salt"]).where("doc_id <> last_doc")
    key = F.concat(F.lpad(F.hex("k1"), 16, "0"), F.lpad(F.hex("k2"), 16, "0"))
    return exact.groupBy("doc_id").agg(F.collect_set(key).alias("keys"))


FIGURES = ("_n_lines", "_n_dropped", "_sha256")


def rebuilt(docs: DataFrame, lost: DataFrame, min_chars: int = 20, figures: bool = True) -> DataFrame:
    """``docs`` with ``text`` lacking the lines of its lost keys, and FIGURES added.

    Where ``docs`` has a column of such a name, the figure's gets one more underscore.
    """
    names = docs.columns
    text, added = names.index("text"), [free(x, names) for x in FIGURES] if figures else []
    doc, keys = free("_doc", names), free("_keys", names)
    both = docs.join(lost.select(F.col("doc_id").alias(doc), F.col("keys").alias(keys)), F.col("doc_id") == F.col(doc), "left").drop(doc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, lose in zip(_raw(b.column(text)), b.column(b.num_columns - 1).to_pylist(), strict=True):
                n = dropped = 0
                if lose:
                    gone = {np.array([int(k[:16], 16), int(k[16:], 16)], np.uint64).tobytes() for k in lose}
                    lines, keys = split(raw, min_chars)
                    left = [line for line, k in zip(lines, keys, strict=True) if k not in gone]
                    n, dropped, raw = len(lines), len(lines) - len(left), b"\n".join(left)
                out.append((raw.decode(), n or raw.count(b"\n") + 1, dropped, hashlib.sha256(raw).hexdigest() if added else ""))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kept = [b.column(i) for i in range(len(names))]
            kept[text] = pa.array(list(columns[0]), pa.string())
            more = [pa.array(list(x), t) for x, t in zip(columns[1:], (pa.int64(), pa.int64(), pa.string()), strict=True)] if added else []
            yield pa.record_batch([*kept, *more], [*names, *added])

    schema = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema)
    return both.mapInArrow(run, schema + "".join(f", `{c}` {t}" for c, t in zip(added, ("long", "long", "string"), strict=False)))


class LineIndex:
    """References, exact counts of common keys and their filters, each a table in the shared folder.

    References are kept as batches, with the ids taken out of each beside it; a batch that is put in or
    taken out reads the others but shuffles and writes no more than its own references, those of the same
    keys, and the common keys. After ``MOST_BATCHES`` batches they are written as one.
    """

    MOST_BATCHES, FULL = 16, 0.9

    def __init__(self, spark: SparkSession, kind: str = "long", min_docs: int = 3, min_chars: int = 20, per_shard: int = 65_536) -> None:
        self.min_docs, self.min_chars, self.per_shard, self.shards = min_docs, min_chars, per_shard, 1
        self.batches: list[DataFrame] = []
        self.none = spark.createDataFrame([], f"k1 long, k2 long, doc_id {kind}")
        self.common = counts(self.none)
        self.filters = spark.createDataFrame([], "shard int, filter binary, slots long, held long")

    @property
    def refs(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.batches, self.none)

    def _replace(self, name: str, table: DataFrame) -> DataFrame:
        """Sets a table of this index; gives the old one."""
        old = getattr(self, name)
        setattr(self, name, saved(table, name))
        return old

    @staticmethod
    def _gone(*tables: DataFrame) -> None:
        drop(*(t for t in tables if hasattr(t, "path")))

    def _settle(self, touched: DataFrame | None) -> None:
        """Counts the ``touched`` keys (k1, k2), or all, anew. Filters change by the keys that became or ceased to be common."""
        key = ["k1", "k2"]
        own = self.refs if touched is None else self.refs.join(touched, key, "left_semi")
        again = counts(own).where(F.col("n_docs") >= self.min_docs)
        before = self._replace("common", again if touched is None else self.common.join(touched, key, "left_anti").unionByName(again))
        n = self.common.count()
        if n > 2 * self.per_shard * self.shards or not hasattr(self.filters, "path"):
            self.shards = max(1, -(-n // self.per_shard))
            self._gone(before, self._replace("filters", filters(self.common, self.shards)))
            return
        shard = _shard(self.shards)
        change = self.common.join(before, key, "left_anti").select(shard, "k1", F.lit(True).alias("add")).unionByName(before.join(self.common, key, "left_anti").select(shard, "k1", F.lit(False).alias("add")))
        change = saved(change, "change")
        adds = change.groupBy("shard").agg(F.count(F.when(F.col("add"), 1)).alias("adds"))
        full = saved(adds.join(self.filters.select("shard", "slots", "held"), "shard", "left").where(F.coalesce(F.col("held") + F.col("adds") > self.FULL * F.col("slots"), F.lit(True))).select("shard"), "full")

        def update(own: pa.Table, new: pa.Table) -> pa.Table:
            if not new.num_rows:
                return own
            add, keys = new["add"].to_numpy(), new["k1"].to_numpy()
            f = CuckooFilter.from_bytes(own["filter"][0].as_py())
            f.delete(keys[~add])
            f.insert(keys[add])
            return f.row(own["shard"][:1])

        kept = self.filters.join(full, "shard", "left_anti").groupBy("shard").cogroup(change.join(full, "shard", "left_anti").groupBy("shard")).applyInArrow(update, FILTER)
        larger = filters(self.common.withColumn("shard", F.pmod("k2", F.lit(self.shards)).cast("int")).join(full, "shard", "left_semi").drop("shard"), self.shards)
        self._gone(before, self._replace("filters", kept.unionByName(larger)), change, full)

    def insert(self, *batches: DataFrame) -> LineIndex:
        """Puts documents in; one whose id is known adds its new keys to that id's."""
        for b in batches:
            new = saved(references(b, self.min_chars), "refs")
            self.batches.append(new)
            self._settle(new.select("k1", "k2").distinct() if len(self.batches) > 1 else None)
        self._compact()
        return self

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Takes the documents of ``doc_ids`` out."""
        ids = saved(doc_ids.select("doc_id").where("doc_id is not null").distinct(), "ids")
        out = saved(self.refs.join(ids, "doc_id", "left_semi").select("k1", "k2").distinct(), "touched")
        old, self.batches = self.batches, []
        for t in old:
            hit = not t.join(ids, "doc_id", "left_semi").isEmpty()
            self.batches.append(saved(t.join(ids, "doc_id", "left_anti").select("k1", "k2", "doc_id"), "refs") if hit else t)
        self._settle(out)
        self._gone(ids, out, *(t for t in old if all(t is not x for x in self.batches)))
        return self

    def _compact(self) -> None:
        if len(self.batches) > self.MOST_BATCHES:
            old, self.batches = self.batches, [saved(self.refs, "refs")]
            self._gone(*old)

    def lost(self, refs: DataFrame | None = None) -> DataFrame:
        return drops(self.refs if refs is None else refs, self.common, self.filters.select("shard", "filter"), self.shards)

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs`` without the lines that are common and not in their last document, and figures of that."""
        return rebuilt(docs, self.lost(), self.min_chars)

    def close(self) -> None:
        """Deletes the index's tables."""
        self._gone(*self.batches, self.common, self.filters)
        self.batches = []


def line_dedup(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, figures: bool = True) -> DataFrame:
    """``docs`` deduplicated against themselves: its columns, and FIGURES if asked for."""
    index = LineIndex(docs.sparkSession, dict(docs.dtypes)["doc_id"], min_docs, min_chars).insert(docs)
    lost = saved(index.lost(), "lost")
    index.close()
    return rebuilt(docs, lost, min_chars, figures)
