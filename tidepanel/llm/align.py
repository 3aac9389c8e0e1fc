"""Tokens of two tokenizers aligned by the bytes that they cover.

Both tokenizers cover a text's bytes after one space. Where tokens of both end, the text is cut into groups. Groups
are found by pointer jumping: every token points to the token of the other side that overlaps it farthest to the
right; doubling all pointers at once leads each token to the last token of its group, which names it. A link is a
pair of overlapping tokens; a pair of ids counts as often as there are documents that hold it linked.

Texts are tokenized once and kept as ids, by chunks of about 2 MB of text. Counts are gathered from each chunk's distinct
pairs, and given back to the chunks that hold them: what is shuffled is a chunk's distinct pairs and its ids, never one
row per link, and a pair that every document holds is one row a chunk.

A tokenizer gets each distinct segment of a run of texts once, and a worker keeps the ids of the first million short ones that it
met. Segments begin at a single space between two characters that
are not blank; no token of either vocabulary reaches over such a place (:meth:`Codec.crossing` checks it), so the
ids are those of the whole text.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm import textvec as T
from tidepanel.llm.store import saved

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
BITS = 20  # of an id in a pair's code
KEPT, SHORT, AT_ONCE = 1_000_000, 64, 20_000  # segments that a worker keeps, their bytes at most, and segments given to a tokenizer at once


class Codec:
    """A tokenizer over segments, and the bytes of its tokens."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.size)])
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.known, self.begin, self.many = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def looked_up(self, hashes: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each segment begin, how many), for segments of ascending hashes; short ones are kept for later calls."""
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        seen = self.known[at] == hashes if len(self.known) else np.zeros(len(hashes), bool)
        new = np.flatnonzero(~seen)
        new = new[np.argsort(end[new] - start[new] > SHORT, kind="stable")]
        flat, many = [self.flat], [np.zeros(0, np.int64)]
        for i in range(0, len(new), AT_ONCE):
            lists = self.ids([raw[s:e] for s, e in zip(start[new[i : i + AT_ONCE]].tolist(), end[new[i : i + AT_ONCE]].tolist(), strict=True)])
            many.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            flat.append(np.fromiter(chain.from_iterable(lists), np.int32, int(many[-1].sum())))
        flat, many = np.concatenate(flat), np.concatenate(many)
        first = len(self.flat) + np.cumsum(many) - many
        begin, size = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        begin[seen], size[seen], begin[new], size[new] = self.begin[at[seen]], self.many[at[seen]], first, many
        short = int((end[new] - start[new] <= SHORT).sum())
        if short and len(self.known) < KEPT:
            known = np.concatenate([self.known, hashes[new[:short]]])
            order = np.argsort(known, kind="stable")
            self.known, self.begin, self.many = known[order], np.concatenate([self.begin, first[:short]])[order], np.concatenate([self.many, many[:short]])[order]
            self.flat = flat[: first[short - 1] + many[short - 1]].copy()
        return flat, begin, size

    def ids(self, segments: list[bytes]) -> list[list[int]]:
        """Ids of each segment; segments begin with a space."""
        raise NotImplementedError

    def crossing(self) -> list[int]:
        """Ids of tokens that hold a place where a segment may start: if there are any, texts are tokenized whole."""
        of = np.repeat(np.arange(len(self.size)), self.size)
        at = np.flatnonzero(self.data == 32)
        return np.unique(of[at[(at > self.offsets[of[at]]) & ~_blank_before(self.data, at)]]).tolist()

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.data[np.repeat(self.offsets[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class ByteLevel(Codec):
    """A byte-level vocabulary of the ``tokenizers`` library; special tokens are plain text."""

    def __init__(self, file: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has its own tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(file)
        self.tokenizer.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        n = self.tokenizer.get_vocab_size()
        entries = (self.tokenizer.id_to_token(i) or "" for i in range(n))
        super().__init__([bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in entries])

    def ids(self, segments: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([s.decode() for s in segments], add_special_tokens=False)]


class Pieces(Codec):
    """A ``sentencepiece`` model with byte fallback, which puts a space before what it is given."""

    def __init__(self, file: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.tokenizer = t = SentencePieceProcessor(model_proto=file)
        super().__init__([bytes([int(t.id_to_piece(i)[3:5], 16)]) if t.is_byte(i) else t.id_to_piece(i).replace("▁", " ").encode() for i in range(t.get_piece_size())])

    def ids(self, segments: list[bytes]) -> list[list[int]]:
        return self.tokenizer.encode([s[1:].decode() for s in segments], num_threads=1)


@functools.lru_cache(maxsize=4)
def codec(kind: type[Codec], file: bytes) -> Codec:
    """Loaded once in each worker."""
    made = kind(file)
    made.whole = bool(made.crossing())
    return made


BLANK = T.SPACE.copy()
BLANK[0x1C:0x20] = True


def _blank_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a character that some alphabet counts as blank ends before each place; a few others of the same first bytes count too."""
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    wide = ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80))
    return BLANK[one] | wide


def _segments(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where segments start: at each document, and at single spaces between characters that are not blank in any alphabet."""
    n = len(data)
    at = np.flatnonzero(data == 32)
    at = at[(at > 2) & (at < n - 1)]
    at = at[~_blank_before(data, at) & ~BLANK[data[at + 1]]]
    starts = np.zeros(n + 1, bool)
    starts[at] = True
    starts[offsets] = True  # also takes a space away that ends a document: what follows it is the next one's
    inner = offsets[1:-1]
    starts[inner[inner > 0] - 1] &= np.isin(inner[inner > 0] - 1, offsets)
    return np.flatnonzero(starts[:n])


@dataclass
class _Distinct:
    """Segments of a run of documents: hash, start and end of each distinct one, which one each is, and its document."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    of: np.ndarray
    doc: np.ndarray


def _distinct(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> _Distinct:
    w = T.Words(data, starts, np.append(starts[1:], len(data)), np.zeros(0), np.zeros(0))
    hashes, first, of = np.unique(w.hashes(), return_index=True, return_inverse=True)
    return _Distinct(hashes, w.start[first], w.end[first], of, np.searchsorted(offsets, starts, "right") - 1)


def _tokens(c: Codec, d: _Distinct, data: np.ndarray, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents, and how many each has; none where the tokens' bytes are not the document's."""
    flat, begin, size = c.looked_up(d.hashes, raw, d.start, d.end)
    size, begin = size[d.of], begin[d.of]
    ends = np.cumsum(size)
    ids = flat[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].astype(np.int64)
    doc = np.repeat(d.doc, size)
    n = len(offsets) - 1
    good = np.bincount(doc, c.size[ids], n).astype(np.int64) == np.diff(offsets)
    if not good.all():
        kept = good[doc]
        ids, doc = ids[kept], doc[kept]
    covered = np.repeat(good, np.diff(offsets))
    wrong = np.flatnonzero(c.joined(ids) != data[covered])
    if len(wrong):
        good[np.repeat(np.arange(n), np.diff(offsets))[covered][wrong]] = False
        kept = good[doc]
        ids, doc = ids[kept], doc[kept]
    return ids, np.bincount(doc, minlength=n)


def encode(a: Codec, b: Codec, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids of a, number per text, ids of b, number per text); both none for empty texts and those that either does not cover."""
    data, offsets = T.utf8(texts)
    size = np.diff(offsets)
    some = np.flatnonzero(size)
    spaced = np.insert(data, offsets[some], 32)  # the space that the tokens cover first
    at = np.concatenate([[0], np.cumsum(size[some] + 1)])
    n_a, n_b = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    if not len(some):
        return np.zeros(0, np.int64), n_a, np.zeros(0, np.int64), n_b
    raw, pieces = spaced.tobytes(), None if a.whole and b.whole else _distinct(spaced, at, _segments(spaced, at))
    whole = _distinct(spaced, at, at[:-1]) if a.whole or b.whole else None
    ids_a, n_a[some] = _tokens(a, whole if a.whole else pieces, spaced, raw, at)
    ids_b, n_b[some] = _tokens(b, whole if b.whole else pieces, spaced, raw, at)
    both = (n_a > 0) & (n_b > 0)
    return ids_a[np.repeat(both, n_a)], n_a * both, ids_b[np.repeat(both, n_b)], n_b * both


def links(end_a: np.ndarray, size_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (place of a, place of b) whose bytes overlap."""
    first, last = np.searchsorted(end_b, end_a - size_a, "right"), np.searchsorted(end_b, end_a, "left")
    n = last - first + 1
    ends = np.cumsum(n)
    return np.repeat(np.arange(len(n)), n), np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def groups(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each token of a, of b, last token of b of each group), groups numbered in order."""
    n = len(end_a)
    over = np.searchsorted(end_a, end_b, "left")  # the token of a that holds the last byte of each of b
    points = np.concatenate([n + np.searchsorted(end_b, end_a, "left"), np.where(end_a[over] == end_b, n + np.arange(len(end_b)), over)])
    while True:
        farther = points[points]
        if np.array_equal(farther, points):
            break
        points = farther
    last = np.flatnonzero(points == np.arange(len(points)))
    number = np.zeros(len(points), np.int64)
    number[last] = np.arange(len(last))
    of = number[points]
    return of[:n], of[n:], last - n


def _decimal(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0 to ``most`` in rows that end in zero bytes, with a place left for a mark; numbers of digits."""
    texts = [str(i).encode() for i in range(most + 1)]
    wide = len(texts[-1]) + 1
    return np.frombuffer(b"".join(t.ljust(wide, b"\0") for t in texts), np.uint8).reshape(-1, wide), np.array([len(t) for t in texts])


def written(ids: tuple[np.ndarray, np.ndarray], of: tuple[np.ndarray, np.ndarray], doc_of_group: np.ndarray, n_docs: int, digits: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    """Each document's groups as ``a1,a2|b1;a3|b2,b3``."""
    key = np.concatenate([2 * of[0], 2 * of[1] + 1])
    order = np.argsort(key, kind="stable")
    key, ids = key[order], np.concatenate(ids)[order]
    table, size = digits
    rows, mark = table[ids], np.full(len(ids), ord(","), np.uint8)
    step = np.diff(key)
    mark[:-1][step > 0] = np.where(key[:-1][step > 0] % 2 == 0, ord("|"), ord(";"))
    doc = doc_of_group[key // 2]
    mark[:-1][doc[1:] != doc[:-1]] = 0
    mark[-1:] = 0
    rows[np.arange(len(ids)), size[ids]] = mark
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, size[ids] + (mark > 0), n_docs))]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(n_docs, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows[rows > 0].tobytes())).cast(pa.string())


def _read(column: pa.ChunkedArray | pa.Array, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows of a binary column, ``wide`` bytes each, and the number of each row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(flat.tobytes(), f"<u{wide}").astype(np.int64), np.diff(offsets) // wide


def _binary(ids: np.ndarray, n: np.ndarray, wide: int) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(wide * n)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.astype(f"<u{wide}").tobytes())])


def _wide(c: Codec) -> int:
    return 2 if len(c.size) <= 1 << 16 else 4


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def alignments(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE, chunk_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (text, see :func:`written`) of every document.

    ``n_best`` counts links whose pair is held by as many documents as any pair of the same id of ``a``; ``count_sum`` adds up
    the documents that hold each link's pair. Each row is a document, whether its id is null or repeated. A null or empty text, and one
    whose tokens do not give its bytes after one space, has no tokens: zeros and an empty text. Other columns are not
    read. The files are read on the driver; ``a`` is byte-level, ``b`` a piece model.
    """
    kind, file_a, file_b = dict(docs.dtypes)["doc_id"], _file(a), _file(b)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        one, two = codec(ByteLevel, file_a), codec(Pieces, file_b)
        chunk, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            _, offsets = T.utf8(batch.column(1))
            for i, j in T.runs(offsets):
                size = int(offsets[j] - offsets[i])
                if filled and filled + size > chunk_bytes:
                    chunk, filled = chunk + 1, 0
                filled += size
                ids_a, n_a, ids_b, n_b = encode(one, two, batch.column(1).slice(i, j - i))
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(np.full(j - i, chunk)), _binary(ids_a, n_a, _wide(one)), _binary(ids_b, n_b, _wide(two))], ["doc_id", "chunk", "a", "b"])

    kept = saved(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tokens, f"doc_id {kind}, chunk long, a binary, b binary"), "tokens", "zstd")

    def ends(batch: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
        one, two = codec(ByteLevel, file_a), codec(Pieces, file_b)
        (ids_a, n_a), (ids_b, n_b) = _read(batch.column("a"), _wide(one)), _read(batch.column("b"), _wide(two))
        return ids_a, n_a, ids_b, n_b, np.cumsum(one.size[ids_a]), np.cumsum(two.size[ids_b]), one.size[ids_a]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = batch.column(0).to_numpy()
            for chunk in np.unique(chunks).tolist():
                part = batch.filter(pa.array(chunks == chunk))
                ids_a, n_a, ids_b, _, end_a, end_b, size_a = ends(part)
                i, j = links(end_a, size_a, end_b)
                code, doc = ids_a[i] << BITS | ids_b[j], np.repeat(np.arange(len(n_a)), n_a)[i]
                order = np.lexsort((doc, code))
                code, doc = code[order], doc[order]
                first = np.ones(len(code), bool)
                first[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
                code, n = np.unique(code[first], return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(code), chunk)), pa.array(code), pa.array(n.astype(np.int64))], ["chunk", "code", "n"])

    held = saved(kept.select("chunk", "a", "b").mapInArrow(pieces, "chunk long, code long, n long"), "pairs", "zstd")
    counts = held.groupBy("code").agg(F.sum("n").alias("count"))
    best = F.max("count").over(Window.partitionBy(F.shiftright("code", BITS)))  # at most as many rows as ``b`` has ids
    counted = held.select("chunk", "code").join(counts.withColumn("best", F.col("count") == best), "code")
    digits = _decimal(1 << 17)

    def done(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        code = pairs["code"].to_numpy()
        order = np.argsort(code)
        code, count, top = code[order], pairs["count"].to_numpy()[order], pairs["best"].to_numpy().astype(bool)[order]
        parts = []
        for batch in texts.combine_chunks().to_batches(max_chunksize=4096):
            ids_a, n_a, ids_b, n_b, end_a, end_b, size_a = ends(batch)
            n, doc = batch.num_rows, np.repeat(np.arange(batch.num_rows), n_a)
            i, j = links(end_a, size_a, end_b)
            at, of_link = np.searchsorted(code, ids_a[i] << BITS | ids_b[j]), doc[i]
            of_a, of_b, last = groups(end_a, end_b) if len(end_a) else (doc, doc, doc)
            doc_of_group = np.repeat(np.arange(n), n_b)[last] if len(last) else doc
            whole = lambda x: np.asarray(x).astype(np.int64)
            sums = np.bincount(of_link, count[at], n) if len(at) else np.zeros(n)
            tops = np.bincount(of_link[top[at]], minlength=n)
            text = written((ids_a, ids_b), (of_a, of_b), doc_of_group, n, digits) if len(end_a) else pa.array([""] * n, pa.string())
            parts.append(pa.table({"doc_id": batch.column("doc_id"), "n_a": n_a, "n_b": n_b, "n_groups": whole(np.bincount(doc_of_group, minlength=n)), "n_links": whole(np.bincount(of_link, minlength=n)), "n_best": whole(tops), "count_sum": whole(sums), "groups": text}))
        return pa.concat_tables(parts) if parts else pa.table({"doc_id": texts["doc_id"], **dict.fromkeys(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), pa.array([], pa.int64())), "groups": pa.array([], pa.string())})

    fields = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return kept.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(done, fields)


def digests(df: DataFrame) -> DataFrame:
    """With groups_sha256 in place of groups; an empty text stays empty."""
    return df.select(*(c for c in df.columns if c != "groups"), F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))
