"""Periodic runs of words: a sparse diagonal dynamic programme over blocks of words.

Two equal words ``lag`` apart lie on the diagonal ``lag``; a run of period q is a stretch of the diagonal q on which
all words match. Word by word, each earlier occurrence would lengthen a diagonal, which is quadratic where words are
frequent. So the programme goes by blocks: lags from Q up to 2 * Q - 1, Q a power of two, are looked at where blocks
of Q words start, every Q words. A run of at least three periods holds such a block, so none is missed. A block's
earlier occurrences in this range of lags make their diagonals active, or longer by Q where the block before lay on
them too; a diagonal that the next block does not go on with has ended, is followed word by word to its exact ends,
and gives a run if it is long enough. That is at most n occurrences for each Q, whatever the text: time grows as n log(n).

Blocks are compared by names: equal blocks of 2 * Q words have equal pairs of names of their halves. Names are exact
(sorted, not hashed); words are the same if their 64-bit hashes and documents are. Blocks that occur once in their
document have no name and cost nothing further on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import textvec as T

RUNS = "array<struct<start:long,length:long,period:long>>"


def _named(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A name from 0 for each key that occurs twice or more, by place; below 0 and unlike any other elsewhere."""
    names = -1 - np.arange(n)
    if len(keys):
        order = np.argsort(keys, kind="stable")
        sorted_ = keys[order]
        first = np.ones(len(keys), bool)
        first[1:] = sorted_[1:] != sorted_[:-1]
        group = np.cumsum(first) - 1
        often = np.bincount(group)[group] > 1
        names[at[order[often]]] = group[often]
    return names


def find(doc: np.ndarray, hashes: np.ndarray, least: int = 24, times: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of at least ``least`` words and ``times`` (3 or more) of their smallest period, as (document, start, length, period).

    ``doc`` is the document of each word, ascending; starts count words of the document. Ordered by document, start, period.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods may hold no whole block")
    n_words, none = len(doc), np.zeros(0, np.int64)
    if n_words == 0:
        return none, none, none, none
    per_doc = np.bincount(doc)
    at = np.arange(n_words) + doc  # one place between documents, which matches nothing
    n = int(at[-1]) + 1
    by_word = np.argsort(hashes, kind="stable")
    word = np.empty(n_words, np.int64)
    word[by_word] = np.cumsum(np.concatenate([[False], np.diff(hashes[by_word].view(np.int64)) != 0]))
    names = _named(doc.astype(np.int64) * n_words + word, at, n)
    levels, found, q = [], [], 1
    while times * q <= per_doc.max():
        x = np.flatnonzero(names >= 0)
        if not len(x):
            break
        block = (x + 2 * q - 1) // q
        inside = block * q < n
        x, block = x[inside], block[inside]
        same = names[x] == names[block * q]
        block, lag = block[same], block[same] * q - x[same]
        if len(lag):
            rows = n // q + 3
            active = np.sort(lag * rows + block)
            ends = np.flatnonzero(np.diff(active) != 1)
            first, last = active[np.concatenate([[0], ends + 1])], active[np.concatenate([ends, [len(active) - 1]])]
            lag, begin, end = first // rows, first % rows * q, last % rows * q + q
            long = end - begin + 2 * (q - 1) >= np.maximum((times - 1) * lag, least - lag)
            lag, begin, end = lag[long], begin[long], end[long]
            for j in range(len(levels) - 1, -1, -1):  # fewer than q words are left on either side
                step = 1 << j
                on = np.flatnonzero(end + step <= n)
                on = on[levels[j][end[on]] == levels[j][end[on] - lag[on]]]
                end[on] += step
                on = np.flatnonzero(begin - step - lag >= 0)
                on = on[levels[j][begin[on] - step] == levels[j][begin[on] - step - lag[on]]]
                begin[on] -= step
            size = end - begin + lag
            long = size >= np.maximum(times * lag, least)
            found.append(np.stack([begin[long] - lag[long], size[long], lag[long]]))
        levels.append(names.astype(np.int32) if n < 2**31 else names)
        x = np.flatnonzero((names[: n - q] >= 0) & (names[q:] >= 0)) if q < n else none
        names = _named(names[x] * n + names[x + q], x, n)
        q *= 2
    start, size, period = np.concatenate(found, axis=1) if found else (none, none, none)
    order = np.lexsort((period, size, start))
    start, size, period = start[order], size[order], period[order]
    # a multiple of the smallest period has the same stretch
    least_period = np.ones(len(start), bool)
    least_period[1:] = (start[1:] != start[:-1]) | (size[1:] != size[:-1])
    start, size, period = start[least_period], size[least_period], period[least_period]
    order = np.lexsort((period, start))
    start, size, period = start[order], size[order], period[order]
    of = doc[np.searchsorted(at, start)] if len(start) else none
    begins = np.cumsum(per_doc) - per_doc + np.arange(len(per_doc))
    return of, start - begins[of], size, period


def _collapsed(w: T.Words, of: np.ndarray, start: np.ndarray, size: np.ndarray, period: np.ndarray) -> pa.Array:
    """Each document's words without what runs repeat, joined by one space."""
    first = np.cumsum(w.per_doc) - w.per_doc
    edges = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(edges, first[of] + start + period, 1)
    np.add.at(edges, first[of] + start + size, -1)
    kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
    doc = w.doc[kept]
    last = np.ones(len(kept), bool)
    last[:-1] = doc[1:] != doc[:-1]
    length = (w.end - w.start)[kept] + ~last
    ends = np.concatenate([[0], np.cumsum(length)])
    data = np.append(w.data, np.uint8(32))[np.minimum(np.repeat(w.start[kept] - ends[:-1], length) + np.arange(ends[-1]), len(w.data))]
    data[(ends[1:] - 1)[~last]] = 32
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, length, len(w.per_doc)).astype(np.int64))])
    return pa.LargeStringArray.from_buffers(len(w.per_doc), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())


def with_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """doc_id, runs (start, length and period in words, by start, then period) and collapsed, the text without repeats.

    Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch of at least ``least`` words and ``times`` periods that no
    neighbouring word extends; its period is the smallest one. ``collapsed`` leaves out each word that a run holds after
    its first period and joins the others by one space. A null or empty text, or one without words, has no runs and
    an empty ``collapsed``. Rows are taken one by one: repeated ids and null ids stay, other columns are not read.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ["start", "length", "period"]
        for b in batches:
            for i, j, w in T.word_runs(b.column(1), lower=False):
                of, start, size, period = find(w.doc, w.hashes(), least, times)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=j - i))]).astype(np.int32)
                spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, size, period)], fields))
                yield pa.record_batch([b.column(0).slice(i, j - i), spans, _collapsed(w, of, start, size, period)], ["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of the greatest length by period, exactly; of equal ones that of least start, then period. Null without runs."""
    more = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda a, r: F.when(more(a, r), r).otherwise(a))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the documents with a tail that repeats itself, as crc32 of the id says.

    With h the crc32 of the id in decimal (null: empty text) and g = floor(h / 10), a document of n words with h % 10 = 0 keeps
    its first a = g % n words; from there on its next 1 + floor((n - a) / (3 + g % 8)) words repeat up to n words.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"))
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    docs = docs.withColumn("n", F.coalesce(F.size("words"), F.lit(-1)))
    docs = docs.withColumn("a", F.expr("if(n > 0, cast((h div 10) % n as int), 0)"))
    docs = docs.withColumn("p", F.expr("1 + cast((n - a) div (3 + (h div 10) % 8) as int)"))
    tail = "slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)"
    return docs.select("doc_id", F.expr(f"if(n > 0, array_join(concat(slice(words, 1, a), {tail}), ' '), text)").alias("text"))


def digests(df: DataFrame) -> DataFrame:
    """The figures of :func:`with_runs`: their number, the strongest run, and digests of all runs and of the collapsed text."""
    best = strongest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[x].cast("string") for x in ("start", "length", "period")))), "\n")
    df = df.select("doc_id", "runs", "collapsed", best.alias("best"))
    exponent = F.expr("(best.length * 1000) div best.period").alias("exponent_milli")
    return df.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent, F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
