"""Words and shingles of whole Arrow batches with numpy: no Python object is made per word.

Words are the runs of bytes outside ``[\\x20\\x09-\\x0D]`` in UTF-8; A-Z may be lower-cased first.
A word's hash is a polynomial in its bytes modulo 2**64, mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E6C63D0876A9A47  # odd, so it has an inverse modulo 2**64
BASE_INVERSE = pow(BASE, -1, 2**64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept for later calls."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, (1 << 20) + (1 << 17))
        both = []
        for b in (BASE, BASE_INVERSE):
            steps = np.full(size, b, U64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=U64))
        _powers = (both[0], both[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_string(texts.type) and not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if offsets and len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words of a run of documents: ``data[start:end]`` each; ``per_doc`` counts them."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    per_doc: np.ndarray
    doc_bytes: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.per_doc)), self.per_doc)

    def hashes(self) -> np.ndarray:
        up, down = powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def strings(self, which: np.ndarray) -> pa.Array:
        """The chosen words as an Arrow array."""
        start, size = self.start[which], (self.end - self.start)[which]
        offsets = np.zeros(len(which) + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        data = self.data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
        return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, outside: np.ndarray = SPACE) -> Words:
    if lower:
        data = LOWER[data]
    inside = ~outside[data]
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[offsets < n]
    before[edges] = False
    edges = offsets[offsets > 0] - 1
    after[edges] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.diff(np.searchsorted(start, offsets)), np.diff(offsets))


def runs(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``most`` bytes, a longer document alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_runs(texts: pa.Array, lower: bool = True, most: int = 1 << 20, outside: np.ndarray = SPACE) -> Iterator[tuple[int, int, Words]]:
    """(first document, end, their words) over the whole array."""
    data, offsets = utf8(texts)
    for i, j in runs(offsets, most):
        yield i, j, words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower, outside)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles: (hashes ordered by document, number per document).

    A document of fewer than k words, but at least one, has its whole sequence as its one shingle.
    """
    h, n = w.hashes(), len(w.start)
    docs = w.doc
    joined = np.zeros(n, U64)
    for i in range(min(k, n)):
        joined[: n - i] += h[i:] * U64(pow(0xA0761D6478BD642F, i + 1, 2**64) | 1)
    last = np.cumsum(w.per_doc)[docs] if n else np.zeros(0, np.int64)  # the end of each word's document
    at = np.arange(n)
    whole = at + k <= last
    size = w.per_doc[docs]
    short = (size < k) & (at == last - size)
    if short.any():
        for i in np.flatnonzero(short):
            total = 0
            for s, x in enumerate(h[i : i + size[i]]):
                total += int(x) * (pow(0xA0761D6478BD642F, s + 1, 2**64) | 1)
            joined[i] = U64((total + int(size[i]) * 0x8EBC6AF09C88C6E3) % 2**64)
    keep = whole | short
    codes, docs = mix(joined[keep]), docs[keep]
    order = np.lexsort((codes, docs))
    codes, docs = codes[order], docs[order]
    first = np.ones(len(codes), bool)
    first[1:] = (codes[1:] != codes[:-1]) | (docs[1:] != docs[:-1])
    return codes[first], np.bincount(docs[first], minlength=len(w.per_doc))
