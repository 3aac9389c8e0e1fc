"""Quality classifier: a generalised additive model with pairwise interactions.

:func:`features` measures whole texts, batch by batch. :func:`fit` learns one lookup table per feature by
cyclic boosting: round after round, feature after feature, a tree of three leaves on that feature's bins is
fitted to the gradient of the logistic loss and added, shrunk, to the table. Pairs are ranked by what a tree
of four leaves on both gains, and the best of them get tables of their own in the same way. A score is the
logistic function of the intercept and the table entries of a text's bins.

Training uses at most ``most_labels`` labelled rows (:func:`tidepanel.llm.labels.labelled`). Without labels
of both kinds the score is the labels' smoothed mean. Null texts count as empty and are scored too; repeated
rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import textvec as T
from tidepanel.llm.labels import held_out, labelled

MOST_LABELS = 20_000
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".,;:", "call": b"!?", "bar": b"|", "symbol": b"#$%&*@^~+=<>/\\_`", "bracket": b"()[]{}\"'-", "line": b"\n"}
KIND = np.full(256, len(CLASSES), np.int64)
for _i, _chars in enumerate(CLASSES.values()):
    KIND[list(_chars)] = _i
KIND[128:] = len(CLASSES) + 1
NAMES = [*CLASSES, "other", "high", "bytes", "words", "word_mean", "word_sd", "word_max", "distinct", "bare", "symbol_end", "repeated_3", "line_words", "call_words", "bar_words"]


def features(texts: pa.Array) -> np.ndarray:
    """A row per text, a column per name in NAMES."""
    parts = [_features(w) for _, _, w in T.word_runs(texts, lower=False)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


def _features(w: T.Words) -> np.ndarray:
    n, kinds = len(w.per_doc), len(CLASSES) + 2
    bytes_ = np.zeros(n + 1, np.int64)
    bytes_[1:] = np.cumsum(w.doc_bytes)
    owner = np.repeat(np.arange(n), w.doc_bytes)
    byte_counts = np.bincount(owner * kinds + KIND[w.data], minlength=n * kinds).reshape(n, kinds)
    doc, size = w.doc, (w.end - w.start).astype(float)
    total = np.maximum(w.doc_bytes, 1)
    m = np.maximum(w.per_doc, 1)
    per = lambda x: np.bincount(doc, weights=x, minlength=n) / m
    longest = np.zeros(n)
    np.maximum.at(longest, doc, size)
    lower = T.Words(T.LOWER[w.data], w.start, w.end, w.per_doc, w.doc_bytes)
    hashes = lower.hashes()
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    _, distinct_3 = T.shingles(lower, 3)
    letters = np.concatenate([[0], np.cumsum((KIND[w.data] < 2) | (w.data >= 128))])
    ends = KIND[w.data[w.end - 1]] if len(w.end) else np.zeros(0, int)
    names = list(CLASSES)
    mean = per(size)
    columns = [byte_counts[:, k] / total for k in range(kinds)] + [
        np.log1p(w.doc_bytes),
        np.log1p(w.per_doc),
        mean,
        np.sqrt(np.maximum(per(size**2) - mean**2, 0)),
        np.log1p(longest),
        np.bincount(d[first], minlength=n) / m,
        per(letters[w.end] == letters[w.start]),
        per(ends == names.index("symbol")),
        1 - distinct_3 / np.maximum(w.per_doc - 2, 1),
        w.per_doc / (byte_counts[:, names.index("line")] + 1),
        per(ends == names.index("call")),
        per(ends == names.index("bar")),
    ]
    return np.stack(columns, 1)


@dataclass
class Additive:
    """Cut points per feature, a table per feature, and tables of pairs."""

    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)]) if self.cuts else np.zeros((0, len(x)), int)

    def margin(self, bins: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.intercept)
        for j, t in enumerate(self.tables):
            out += t[bins[j]]
        for (j, k), t in self.pairs.items():
            out += t[bins[j], bins[k]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x), len(x)), -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best place to cut the last axis in two; place 0 is no cut."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    at = int(np.argmax(gains))
    return (float(gains[at]), at + 1) if gains[at] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Leaf values, by bin, of a tree grown best cut first."""
    spans = [(0, len(g))]
    while len(spans) < leaves:
        gain, cut, k = max((*_best_cut(g[a:b], h[a:b]), i) for i, (a, b) in enumerate(spans))
        if not cut:
            break
        a, b = spans[k]
        spans[k : k + 1] = [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree of four leaves: one cut of the rows, then a cut of the columns on either side."""
    best, out = 0.0, np.zeros_like(g)
    lines_g, lines_h = np.cumsum(g, 0), np.cumsum(h, 0)
    for cut in range(1, len(g)):
        total, sides = -float(_gain(g.sum(), h.sum())), []
        for sg, sh in ((lines_g[cut - 1], lines_h[cut - 1]), (lines_g[-1] - lines_g[cut - 1], lines_h[-1] - lines_h[cut - 1])):
            gain, at = _best_cut(sg, sh)
            total += gain + float(_gain(sg.sum(), sh.sum()))
            sides.append((sg, sh, at))
        if total > best + 1e-9:
            best = total
            for rows, (sg, sh, at) in zip((slice(0, cut), slice(cut, None)), sides, strict=True):
                for columns in (slice(0, at), slice(at, None)):
                    if sg[columns].size:
                        out[rows, columns] = -sg[columns].sum() / (sh[columns].sum() + 1.0)
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, most_bins: int = 32, pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 40) -> Additive:
    """Learns the tables from rows ``x`` and labels ``y`` of 0 and 1."""
    rate_of_ones = (y.sum() + 1) / (len(y) + 2)
    model = Additive(float(np.log(rate_of_ones / (1 - rate_of_ones))))
    if len(set(y.tolist())) < 2:
        return model
    model.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, most_bins + 1)[1:-1])) for c in x.T]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins, margin = model.bins(x), np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for b, table in zip(bins, model.tables, strict=True):
            g, h = (np.bincount(b, v, len(table)) for v in slopes())
            step = rate * _tree(g, h)
            table += step
            margin += step[b]
    coarse = [(b * pair_bins // len(t), min(pair_bins, len(t))) for b, t in zip(bins, model.tables, strict=True)]

    def grid(j: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = coarse[j][0] * pair_bins + coarse[k][0]
        g, h = (np.bincount(at, v, pair_bins**2).reshape(pair_bins, pair_bins) for v in slopes())
        return at, g, h

    ranked = sorted(((_pair_tree(*grid(j, k)[1:])[0], -j, -k) for j in range(len(bins)) for k in range(j)), reverse=True)[:pairs]
    tables = {(-j, -k): np.zeros((pair_bins, pair_bins)) for gain, j, k in ranked if gain > 0}
    for _ in range(pair_rounds):
        for (j, k), table in tables.items():
            at, g, h = grid(j, k)
            step = rate * _pair_tree(g, h)[1]
            table += step
            margin += step.ravel()[at]
    for (j, k), table in tables.items():
        spread = [np.arange(len(model.tables[i])) * pair_bins // len(model.tables[i]) for i in (j, k)]
        model.pairs[j, k] = table[np.ix_(*spread)]
    return model


def learn(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> Additive:
    rows = labelled(docs, labels, "quality", most_labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(2), pa.array(list(features(b.column(1))), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    kind = dict(docs.dtypes)["doc_id"]
    seen = rows.select("doc_id", "text", "y").mapInArrow(run, f"doc_id {kind}, y int, x array<double>").toPandas()
    if seen.empty:
        return Additive(0.0)
    x = np.array(seen["x"].tolist())
    order = np.lexsort((*x.T, seen["doc_id"].to_numpy()))
    return fit(x[order], (seen["y"].to_numpy() > 0).astype(float)[order])


def with_scores(docs: DataFrame, model: Additive, score: str = "_quality") -> DataFrame:
    """``docs`` with a column ``score``, whose name must be free."""
    names = docs.columns
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array(model.score(features(b.column(text).cast(pa.string()))))], [*names, score])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{score}` double")


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_labels: int = MOST_LABELS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = with_scores(docs.select("doc_id", "text"), learn(docs, labels, most_labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_quality").alias("score"), (F.col("_quality") >= threshold).cast("int").alias("predicted"))
