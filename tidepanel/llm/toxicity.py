"""Toxicity with noisy-channel deobfuscation.

A writer who hides a word sends its letters through a channel: look-alike digits and symbols for letters,
letters repeated, blanks or marks between them, accents and look-alike letters of other scripts.
:func:`spans` finds the stretches of a text that may have passed it: every word with anything but single
letters a-z, be it a doubled letter, a mark, a separator or a letter beyond ASCII, and runs of single
characters between blanks (a blank is seen through there only). :func:`_restore` builds the lattice of
letters that each may stand for and takes the best path by Viterbi's algorithm, scored by the channel's
costs and a character language model of third order. The model mixes the trigrams of all training texts
with those of the words that the labels show to be toxic.

The score is a logistic regression on how often a text holds each form of a lexicon, as written or
restored. A form is a whole word or the beginning of words, as stems are inflected. The lexicon has the
forms of high lift that a fiftieth of the toxic texts hold, and those that tell most of the texts not yet
covered from the other texts, by their number times the form's log lift. Near copies of a text teach once:
a row of which 52 of 64 minhashes over shingles of three words are those of a row before it with the same
label is left out. Training labels are at most ``most_labels`` rows; every form of
theirs is weighed, and trigrams are of all training texts.

Null texts count as empty and get the score of a text without such words. Without labels of both kinds
every text has the labels' smoothed mean. Long texts and long stretches are decoded whole, in time in
proportion to their length. Repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import textvec as T
from tidepanel.llm.labels import held_out, labelled
from tidepanel.llm.store import drop, saved

MOST_LABELS, LEAST_Z, LEAST_LIFT, HIGH_LIFT = 20_000, 3.3, 1.5, 3.5
STEMS = range(4, 11)  # bytes of a beginning
LEAST_LETTERS = 3  # of a form
MARKS_KEPT, SAME_MARKS = 64, 52  # minhashes of a text, and how many of them near copies share: 80 %
WHOLE = np.uint64(0x5851F42D4C957F2D)
# What letters a mark may stand for.
LOOKS_LIKE = {"0": "ou", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h"}
OTHER_SCRIPTS = dict(zip("авеіконрстухѕјԁαεικορτυχν", "abeikohpctyxsjdaeikoptuxv", strict=True))
SEPARATORS = " .-_~*'`,/\\"
LETTERS = 28  # 0: word's edge; 1-26: a-z; 27: any other letter

IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
NOT_LETTER = ~IS_LETTER
MARKS = np.zeros(256, bool)
MARKS[list(b"0123456789@$!|+(*#")] = True
CODE = np.zeros(256, np.int64)
CODE[65:91] = CODE[97:123] = np.arange(1, 27)
CODE[128:] = 27


def trigrams(w: T.Words) -> np.ndarray:
    """Counts of letter trigrams within words, edges included; ``w`` are runs of letters."""
    data = w.data
    code = np.where((data & 0xC0) == 0x80, -1, CODE[data])  # a letter of several bytes counts once
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    inside = np.cumsum(inside[:-1]) > 0
    code = np.where(inside, code, 0)[code >= 0]
    code = np.concatenate([[0, 0], code, [0]])
    code = code[np.concatenate([[True, True], (code[2:] != 0) | (code[1:-1] != 0)])]
    first, second, third = code[:-2].copy(), code[1:-1], code[2:]
    first[second == 0] = 0
    return np.bincount((first * LETTERS + second) * LETTERS + third, minlength=LETTERS**3)


@lru_cache(1 << 16)
def _letter_like(code: int) -> bool:
    """Whether the channel may read the character beyond ASCII as one of a-z."""
    return any("a" <= x <= "z" for c in chr(code).lower() for x, _ in Channel._choices(c) if x)


def _capable(d: np.ndarray) -> np.ndarray:
    """Bytes that begin a character which the channel may read as one of a-z."""
    out = (IS_LETTER[d] & (d < 128)) | MARKS[d]
    at = np.flatnonzero(d >= 0xC0)
    if len(at):
        x = np.concatenate([d, np.zeros(3, np.uint8)]).astype(np.int64)
        size = 2 + (x[at] >= 0xE0) + (x[at] >= 0xF0)
        code = x[at] & (0x7F >> size)
        for i in (1, 2, 3):
            code = np.where(size > i, (code << 6) | (x[at + i] & 0x3F), code)
        codes, which = np.unique(code, return_inverse=True)
        out[at] = np.array([_letter_like(c) for c in codes.tolist()], bool)[which]
    return out


def spans(w: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, starts, ends) of stretches that the channel may read otherwise than written; ``w`` are words between blanks.

    These are all words, without the marks at their edges that it can only leave out, that hold anything
    but single letters a-z, and all runs of single characters between blanks. Stretches that cannot give
    LEAST_LETTERS letters a-z are left: no form is as short.
    """
    d, doc = T.LOWER[w.data], w.doc
    if not len(w.start):
        return doc, w.start, w.end
    ends = lambda x: np.concatenate([[0], np.cumsum(x)])
    idle = NOT_LETTER[d] & ~MARKS[d]
    capable, busy = ends(_capable(d)), ends(~idle)
    place = np.flatnonzero(~idle)
    some = busy[w.end] > busy[w.start]
    first, last = w.start.copy(), w.end.copy()
    first[some], last[some] = place[busy[w.start[some]]], place[busy[w.end[some]] - 1] + 1
    plain = IS_LETTER[d] & (d < 128)
    plain[1:] &= d[1:] != d[:-1]
    odd = ends(~plain)
    # the first letter of a word never repeats one before it
    chosen = some & ((odd[last] - odd[np.minimum(first + 1, last)] > 0) | ~IS_LETTER[d[first]] | (d[first] >= 128)) & (capable[last] - capable[first] >= LEAST_LETTERS)

    characters, marks = ends(~idle & ((d & 0xC0) != 0x80)), ends(MARKS[d])
    count = characters[w.end] - characters[w.start]
    short = np.flatnonzero((count <= 1) | ((count == 2) & (marks[w.end] - marks[w.start] == 1)))  # a letter may have a mark, as in brackets
    new = np.ones(len(short), bool)
    new[1:] = (np.diff(short) != 1) | (np.diff(doc[short]) != 0)
    run = np.cumsum(new) - 1
    held = short[count[short] > 0]
    runs, begin, n = np.unique(run[count[short] > 0], return_index=True, return_counts=True)
    begin, end = held[begin], held[begin + n - 1]
    whole = (n > 1) & (capable[w.end[end]] - capable[w.start[begin]] >= LEAST_LETTERS)
    begin, end = begin[whole], end[whole]
    return np.concatenate([doc[chosen], doc[begin]]), np.concatenate([first[chosen], first[begin]]), np.concatenate([last[chosen], last[end]])


@dataclass
class Channel:
    """The language model, log probabilities [before last, last, next]."""

    table: np.ndarray

    def __post_init__(self) -> None:
        self.rows = self.table.reshape(LETTERS * LETTERS, LETTERS).tolist()
        self.restore = lru_cache(200_000)(self._restore)

    def __reduce__(self) -> tuple:
        return _channel, (self.table.tobytes(),)

    @staticmethod
    def _choices(c: str) -> list[tuple[str, float]]:
        """What ``c`` may stand for, and at what cost."""
        if "a" <= c <= "z":
            return [(c, 0.0)]
        if c in SEPARATORS:
            return [("", 0.5), (" ", 1.0)] + ([(x, 2.5) for x in LOOKS_LIKE[c]] if c in LOOKS_LIKE else [])
        if c in LOOKS_LIKE:
            return [(x, 1.0) for x in LOOKS_LIKE[c]] + [("", 4.0)]
        plain = OTHER_SCRIPTS.get(c) or unicodedata.normalize("NFKD", c)[:1]
        return [(plain, 0.3)] if "a" <= plain <= "z" else [("#", 0.5)] if c.isalpha() else [("", 2.0)]

    def _restore(self, stretch: str) -> str:
        """The likeliest letters behind ``stretch``."""
        rows, state = self.rows, {0: (0.0, None, "")}  # by the last two letters: cost, the path before, last choice
        before, times = "", 0
        for c in stretch.lower():
            choices, following = self._choices(c), {}
            times = times + 1 if c == before else 1
            if times > 1 and c not in SEPARATORS:  # a pair is often meant, three seldom
                choices = [*choices, ("", 3.0 if times == 2 else 0.3)]
            for key, (cost, path, _) in state.items():
                for x, price in choices:
                    if not x:
                        new, total, way = key, cost + price, path
                    elif x == " ":
                        if key % LETTERS == 0:
                            continue
                        new, total, way = 0, cost + price - rows[key][0], (path, " ")
                    else:
                        k = 27 if x == "#" else ord(x) - 96
                        last = key % LETTERS
                        new, total, way = last * LETTERS + k, cost + price - rows[key][k], (path, x)
                    if new not in following or total < following[new][0]:
                        following[new] = (total, way, x)
            state, before = following or state, c
        _, path = min(((cost - (rows[key][0] if key % LETTERS else 0.0), i, path) for i, (key, (cost, path, _)) in enumerate(state.items())), key=lambda x: x[:2])[::2]
        out = []
        while path:
            path, x = path
            out.append(x)
        return "".join(reversed(out))


@lru_cache(2)
def _channel(table: bytes) -> Channel:
    """One channel for all tasks of a worker, so that they share what it has restored."""
    return Channel(np.frombuffer(table).reshape(LETTERS, LETTERS, LETTERS))


def language_model(corpus: np.ndarray, lexicon: list[str], share: float = 0.5) -> Channel:
    """``share`` is the weight of the lexicon's own trigrams, where it has any."""

    def shares(counts: np.ndarray, add: float) -> np.ndarray:
        c = counts.reshape(LETTERS, LETTERS, LETTERS) + add
        return c / c.sum(2, keepdims=True)

    own = np.zeros(LETTERS**3)
    for word in lexicon:
        data = np.frombuffer(word.encode(), np.uint8)
        own += trigrams(T.words(data, np.array([0, len(data)]), outside=NOT_LETTER))
    p = shares(corpus.astype(float), 0.1)
    if lexicon:
        p = (1 - share) * p + share * shares(own, 0.001)
    return Channel(np.log(p))


def forms(w: T.Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, hashes, ends) of all words, then of their beginnings of each length; ``w`` are runs of letters."""
    yield w.doc, T.mix(w.hashes() ^ WHOLE), w.end
    doc, start, end = w.doc, w.start, w.end
    following = np.concatenate([w.data, np.zeros(1, np.uint8)])
    for n in STEMS:
        doc, start, end = doc[start + n <= end], start[start + n <= end], end[start + n <= end]
        keep = (following[start + n] & 0xC0) != 0x80
        part = T.Words(w.data, start[keep], start[keep] + n, w.per_doc, w.doc_bytes)
        yield doc[keep], part.hashes(), part.end


def once(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the first of each (document, hash)."""
    order = np.lexsort((h, doc))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(h[order]) != 0) | (np.diff(doc[order]) != 0)
    return order[first]


def found(texts: pa.Array, known: np.ndarray, channel: Channel | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, end, letter words per text, texts, hashes): what texts hold of the sorted hashes ``known``."""
    data, offsets = T.utf8(texts)
    for i, j in T.runs(offsets):
        own, edges = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        plain = T.words(own, edges, outside=NOT_LETTER)
        hits = []
        for doc, h, _ in forms(plain):
            keep = _among(h, known)
            hits.append((doc[keep], h[keep]))
        if channel is not None:
            hits.append(disguised(own, edges, known, channel))
        yield i, j, plain.per_doc, np.concatenate([x[0] for x in hits]).astype(np.int64), np.concatenate([x[1] for x in hits])


def disguised(own: np.ndarray, edges: np.ndarray, known: np.ndarray, channel: Channel) -> tuple[np.ndarray, np.ndarray]:
    """(texts, hashes) of the sorted hashes ``known`` that restored stretches hold beyond what they hold as written.

    Each distinct stretch is restored once.
    """
    doc, start, end = spans(T.words(own, edges, lower=False))
    stretches = T.Words(T.LOWER[own], start, end, np.zeros(0, np.int64), np.zeros(0, np.int64))
    _, first, which, times = np.unique(stretches.hashes(), return_index=True, return_inverse=True, return_counts=True)
    written = stretches.strings(first)

    def held(texts: pa.Array) -> Counter[tuple[int, int]]:
        out: Counter[tuple[int, int]] = Counter()
        for i, h, _ in forms(T.words(*T.utf8(texts), outside=NOT_LETTER)):
            keep = _among(h, known)
            out.update(zip(i[keep].tolist(), h[keep].tolist(), strict=True))
        return out

    more = held(pa.array([channel.restore(x) for x in written.to_pylist()], pa.string())) - held(written)
    order, begin = np.argsort(which, kind="stable"), np.cumsum(times) - times
    at = [order[begin[i] : begin[i] + times[i]] for (i, _), n in more.items() for _ in range(n)]
    codes = [np.full(times[i], h, np.uint64) for (i, h), n in more.items() for _ in range(n)]
    return (doc[np.concatenate(at)], np.concatenate(codes)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


@dataclass
class Model:
    """The channel, the toxic forms' hashes in order, which of them hardly any other text holds, and the regression's weights."""

    channel: Channel | None
    words: np.ndarray
    strong: np.ndarray
    weights: np.ndarray

    def hits(self, texts: pa.Array) -> np.ndarray:
        """How often each text holds each form, restored words included."""
        out, k = [], len(self.words)
        for i, j, _, doc, h in found(texts, self.words, self.channel):
            out.append(np.bincount(doc * k + np.searchsorted(self.words, h), minlength=(j - i) * k).reshape(j - i, k))
        return np.concatenate(out) if out else np.zeros((0, k), int)

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs(self.hits(texts), self.strong) @ self.weights, -30, 30)))


def inputs(hits: np.ndarray, strong: np.ndarray) -> np.ndarray:
    sure = hits[:, strong].sum(1, keepdims=True)
    return np.concatenate([np.ones((len(hits), 1)), sure > 0, np.log1p(sure), np.log1p(hits)], 1)


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 0.2, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton's method."""
    weights, keep = np.zeros(x.shape[1]), np.where(np.arange(x.shape[1]) > 2, ridge, 0.005)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(curve, x.T @ (y - p) - keep * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-9:
            break
    return weights


def corpus_trigrams(docs: DataFrame) -> np.ndarray:
    """Letter trigrams of all texts; a task sends one row for each trigram that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for b in batches:
            for _, _, w in T.word_runs(b.column(0), outside=NOT_LETTER):
                total += trigrams(w)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], ["at", "n"])

    out = np.zeros(LETTERS**3, np.int64)
    for at, n in docs.select(F.col("text").cast("string")).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most LETTERS**3
        out[at] = n
    return out


def strength(a: np.ndarray, b: np.ndarray, ones: int, zeros: int) -> np.ndarray:
    """Log odds of being held by ``a`` of the toxic and ``b`` of the other texts, in standard errors."""
    odds = np.log((a + 0.5) / (ones - a + 0.5)) - np.log((b + 0.5) / (zeros - b + 0.5))
    return odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


def telling(held: DataFrame, ones: int, zeros: int) -> DataFrame:
    """The rows of ``held`` (toxic, other) that tell toxic texts from others, with their :func:`strength` z and their log lift."""
    odds = lambda c, n: F.log((F.col(c) + 0.5) / (n - F.col(c) + 0.5))
    z = (odds("toxic", ones) - odds("other", zeros)) / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
    lift = F.log((F.col("toxic") + 0.5) / (ones + 1)) - F.log((F.col("other") + 0.5) / (zeros + 1))
    return held.withColumns({"z": z, "lift": lift}).where((F.col("z") >= LEAST_Z) & (F.col("lift") >= LEAST_LIFT))


def cover(candidates: pd.DataFrame, toxic: list[np.ndarray], zeros: int) -> list[int]:
    """Rows of ``candidates`` for the lexicon; ``toxic`` has the candidates of each toxic text."""
    place = {h: k for k, h in enumerate(candidates["h"].tolist())}
    holders: list[list[int]] = [[] for _ in place]
    for text, hs in enumerate(toxic):
        for h in hs:
            holders[place[h]].append(text)
    held = [np.array(x, np.int64) for x in holders]
    other, size = candidates["other"].to_numpy(), candidates["text"].str.len().to_numpy()
    left, chosen = np.ones(len(toxic), bool), []

    def worth() -> tuple[np.ndarray, np.ndarray]:
        a = np.array([left[x].sum() for x in held], float)
        lift = np.log((a + 0.5) / (len(toxic) + 1)) - np.log((other + 0.5) / (zeros + 1))
        return np.where((a >= 3) & (strength(a, other, len(toxic), zeros) >= LEAST_Z) & (lift >= LEAST_LIFT), a * lift, -np.inf), lift

    value, lift = worth() if place else (np.zeros(0), np.zeros(0))
    for k in sorted(range(len(value)), key=lambda i: (-round(value[i], 9), -size[i], i)):
        common = len(held[k]) >= max(3, len(toxic) / 50)
        if value[k] > 0 and common and lift[k] >= HIGH_LIFT and all(len(np.intersect1d(held[k], held[c])) < 0.8 * len(np.union1d(held[k], held[c])) for c in chosen):
            chosen.append(k)
    for k in chosen:
        left[held[k]] = False
    while left.any():
        value, _ = worth() if place else (np.zeros(0), None)
        k = max(range(len(value)), key=lambda i: (round(value[i], 9), size[i], -i), default=-1)
        if k < 0 or value[k] <= 0:
            break
        chosen.append(k)
        left[held[k]] = False
    return chosen


def unlike(kinds: list[int], marks: np.ndarray) -> np.ndarray:
    """Which rows agree in at least SAME_MARKS of their minhashes with no earlier row of their kind that is kept itself."""
    bands = np.array_split(np.arange(marks.shape[1]), marks.shape[1] - SAME_MARKS + 1)  # such rows agree in the whole of one at least
    met: dict[tuple[int, int, bytes], list[int]] = {}
    out = np.ones(len(kinds), bool)
    for i, kind in enumerate(kinds):
        keys = [(kind, k, marks[i, band].tobytes()) for k, band in enumerate(bands)]
        near = sorted({x for key in keys for x in met.get(key, ())})
        out[i] = not ((marks[near] == marks[i]).sum(1) >= SAME_MARKS).any()
        if out[i]:
            for key in keys:
                met.setdefault(key, []).append(i)
    return out


def learn(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> Model:
    kind = dict(docs.dtypes)["doc_id"]
    rows = labelled(docs, labels, "toxic", most_labels).select("doc_id", "text", (F.col("y") > 0).cast("int").alias("y"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = []
            for _, _, w in T.word_runs(b.column(1)):
                codes, n = T.shingles(w, 3)
                for part in np.split(codes, np.cumsum(n)[:-1]):
                    marks.append([int(T.mix(part ^ np.uint64(k)).min() >> np.uint64(33)) for k in range(1, MARKS_KEPT + 1)] if len(part) else [0] * MARKS_KEPT)
            yield pa.record_batch([b.column(0), b.column(2), pa.array(marks, pa.list_(pa.int32()))], ["doc_id", "y", "marks"])

    seen = rows.mapInArrow(mark, f"doc_id {kind}, y int, marks array<int>").toPandas().sort_values(["doc_id", "y"], kind="stable")
    fresh = unlike(seen["y"].tolist(), np.array(seen["marks"].tolist(), np.int32).reshape(len(seen), MARKS_KEPT))
    seen = seen[fresh]
    ones, zeros = int(seen["y"].sum()), int((seen["y"] == 0).sum())
    if not ones or not zeros:
        rate = (ones + 1) / (ones + zeros + 2)
        return Model(None, np.zeros(0, np.uint64), np.zeros(0, bool), np.array([np.log(rate / (1 - rate)), 0.0, 0.0]))
    spark = docs.sparkSession
    kept = spark.createDataFrame([(x,) for x in seen["doc_id"].tolist()], f"doc_id {kind}").distinct()
    rows = saved(rows.join(F.broadcast(kept), "doc_id", "left_semi"), "labelled")  # at most ``most_labels``

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(2).to_numpy()
            for i, j, w in T.word_runs(b.column(1), outside=NOT_LETTER):
                for k, (doc, h, end) in enumerate(forms(w)):
                    one = once(doc, h)
                    codes, where, which = np.unique(h[one], return_index=True, return_inverse=True)
                    toxic = np.bincount(which[y[i:j][doc[one]] == 1], minlength=len(codes))
                    other = np.bincount(which, minlength=len(codes)) - toxic
                    start = w.start[np.searchsorted(w.start, end[one[where]] - 1, "right") - 1]
                    part = T.Words(w.data, start, end[one[where]], w.per_doc, w.doc_bytes)
                    text = part.strings(np.arange(len(codes))).cast(pa.string())
                    yield pa.record_batch([pa.array(codes.view(np.int64)), text, pa.array(np.full(len(codes), k == 0)), pa.array(toxic), pa.array(other)], ["h", "text", "whole", "toxic", "other"])

    held = rows.mapInArrow(counted, "h long, text string, whole boolean, toxic long, other long").groupBy("h", "text", "whole").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    candidates = telling(held.where(f"toxic >= 3 and length(text) >= {LEAST_LETTERS}"), ones, zeros).toPandas()  # forms of toxic texts, which are bounded
    candidates = candidates.sort_values(["toxic", "text", "whole"], ascending=[False, True, True]).reset_index(drop=True)
    best = np.sort(candidates["h"].to_numpy().view(np.uint64))

    def incident(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, _, doc, h in found(b.column(1), best, None):
                one = once(doc, h)
                lists = np.split(h[one].view(np.int64), np.cumsum(np.bincount(doc[one], minlength=j - i))[:-1])
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array([x.tolist() for x in lists], pa.list_(pa.int64()))], ["doc_id", "hs"])

    toxic = rows.where("y = 1").mapInArrow(incident, f"doc_id {kind}, hs array<long>").toPandas().sort_values("doc_id")["hs"].tolist()
    lexicon = candidates.iloc[cover(candidates, toxic, zeros)]
    channel = language_model(corpus_trigrams(docs.where(~held_out(F.col("doc_id")))), lexicon["text"].tolist())
    codes = lexicon["h"].to_numpy().view(np.uint64)
    order = np.argsort(codes)
    model = Model(channel, codes[order], (lexicon["toxic"] >= 20 * lexicon["other"]).to_numpy()[order], np.zeros(0))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = model.hits(b.column(1)).astype(np.int64)
            at = [np.flatnonzero(x) for x in hits]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(at, pa.list_(pa.int64())), pa.array([x[k] for x, k in zip(hits, at, strict=True)], pa.list_(pa.int64()))], ["doc_id", "y", "at", "x"])

    seen = rows.mapInArrow(measured, f"doc_id {kind}, y int, at array<long>, x array<long>").toPandas()
    x = np.zeros((len(seen), len(codes)), np.int64)
    for row, at, n in zip(x, seen["at"], seen["x"], strict=True):
        row[np.asarray(at, np.int64)] = n
    order = np.lexsort((*x.T, seen["y"].to_numpy(), seen["doc_id"].to_numpy()))
    model.weights = regression(inputs(x[order], model.strong), seen["y"].to_numpy().astype(float)[order])
    drop(rows)
    return model


def with_scores(docs: DataFrame, model: Model, score: str = "_toxicity") -> DataFrame:
    """``docs`` with a column ``score``, whose name must be free."""
    names = docs.columns
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array(model.score(b.column(text).cast(pa.string())))], [*names, score])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{score}` double")


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most_labels: int = MOST_LABELS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = with_scores(docs.select("doc_id", "text"), learn(docs, labels, most_labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_toxicity").alias("score"), (F.col("_toxicity") >= threshold).cast("int").alias("predicted"))
