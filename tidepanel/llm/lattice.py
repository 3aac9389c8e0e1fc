"""Language-model scores from a subword lattice.

A text is a sequence of words and one end. A word may be segmented in any way into pieces of an existing
vocabulary; each piece has a probability, and the word's probability is the sum over all segmentations of
their products, by a forward recursion in logarithms (:meth:`Lattice.forward`). The text's is the product
over its words, times the end's: as pieces that begin a word carry its mark, segmentations of a text are
those of its words.

The vocabulary's own scores give the pieces' first probabilities. Expectation-maximisation refines them:
the forward-backward recursion gives each piece's expected number of uses over all words of the training
texts, each word once, as pieces are to spell what is rare. Characters without a piece are spelt by the
vocabulary's byte pieces. Each training word also has an arc that spans it whole, weighing its count less
a discount, over all tokens; the discounts' sum is the weight of the way through pieces. So the
probabilities of all words, seen or not, and of the end sum to 1.

Nothing is collected but sums per piece. Word counts are one distributed table. To score, documents are
dealt by hash into chunks of about ``chunk_bytes`` of text; each chunk gets a dictionary of its own words
with their counts and scores, by a join of the distinct (chunk, word), far fewer than (document, word).

Null texts count as empty: one end. Repeated rows are scored each. An empty table gives an empty result;
without training texts pieces keep their first probabilities. Long texts and words are scored whole; words
of over ``LONG`` characters go in stretches, with the sums of their last few places carried over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import textvec as T
from tidepanel.llm.labels import fold
from tidepanel.llm.store import saved

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581  # begins a word's first piece
BITS = 22
LONG, STRETCH = 1000, 65536  # characters


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, one after the other, and offsets."""
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def _hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = T.powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, T.U64)
    np.cumsum((codes.astype(T.U64) + T.U64(1)) * up[: len(codes)], out=sums[1:])
    return sums, down


@dataclass
class Lattice:
    """Pieces' hashes in order with their ids, byte pieces' ids, and log probabilities by id; the last is the end's."""

    known: np.ndarray
    ids: np.ndarray
    bytes_: np.ndarray
    log_p: np.ndarray
    longest: int

    @classmethod
    def of(cls, pieces: list[tuple[str, float]], bytes_: dict[int, float]) -> Lattice:
        """``pieces`` and ``bytes_`` have scores; if none is above another's zero, scores are merge ranks and p falls as 1 / rank."""
        texts = [p for p, _ in pieces]
        scores = np.array([s for _, s in pieces] + [bytes_[b] for b in range(256)])
        if len(scores) and scores.min() < -1000:  # minus the rank of the merge that made the piece
            scores = -np.log(np.maximum(-scores, 0) + 50)
            scores[len(pieces) :] = -np.log(len(scores) * 10.0)
        codes, offsets = _codes(texts)
        sums, down = _hashes(codes)
        size = np.diff(offsets)
        h = T.mix((sums[offsets[1:]] - sums[offsets[:-1]]) * down[offsets[:-1]] + size.astype(T.U64))
        order = np.argsort(h)
        scores = np.append(scores, scores.max(initial=0.0))
        return cls(h[order], order, len(pieces) + np.arange(256), scores - np.logaddexp.reduce(scores), int(size.max(initial=1)))

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Lattice:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, bytes_ = [], dict.fromkeys(range(256), -1e6)
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                bytes_[int(sp.id_to_piece(i)[3:5], 16)] = sp.get_score(i)
            elif not sp.is_control(i) and not sp.is_unknown(i) and not sp.is_unused(i):
                pieces.append((sp.id_to_piece(i), sp.get_score(i)))
        return cls.of(pieces, bytes_)

    def with_p(self, log_p: np.ndarray) -> Lattice:
        return Lattice(self.known, self.ids, self.bytes_, log_p, self.longest)

    @property
    def sieve(self) -> np.ndarray:
        if not hasattr(self, "_sieve"):
            self._sieve = np.zeros(1 << BITS, bool)
            self._sieve[(self.known & T.U64((1 << BITS) - 1)).astype(np.int64)] = True
        return self._sieve

    def __reduce__(self) -> tuple:
        return Lattice, (self.known, self.ids, self.bytes_, self.log_p, self.longest)

    def arcs(self, marked: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray, list[tuple[int, bytes]]]:
        """Offsets of the words, which have their mark; for each length the ends and ids of the pieces found; ends that bytes spell."""
        codes, offsets = _codes(marked)
        sums, down = _hashes(codes)
        place = np.arange(len(codes)) - np.repeat(offsets[:-1], np.diff(offsets))
        sieve, low = self.sieve, T.U64((1 << BITS) - 1)
        out, single = [], np.zeros(len(codes), bool)
        for n in range(1, self.longest + 1):
            end = np.flatnonzero(place >= n - 1)
            if not len(end):
                break
            h = T.mix((sums[end + 1] - sums[end + 1 - n]) * down[end + 1 - n] + T.U64(n))
            keep = sieve[(h & low).astype(np.int64)]
            end, h = end[keep], h[keep]
            at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
            keep = self.known[at] == h if len(self.known) else np.zeros(len(h), bool)
            out.append((end[keep], self.ids[at[keep]]))
            if n == 1:
                single[end[keep]] = True
        spelt = np.flatnonzero(~single)
        return offsets, out, spelt, [(int(e), chr(codes[e]).encode("utf-8", "surrogatepass")) for e in spelt]

    def _tables(self, marked: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, bytes]]]:
        """Offsets, log weights and ids of arcs by (length, end); weight -inf is no arc."""
        offsets, arcs, _, spelt = self.arcs(marked)
        weight, ids = np.full((len(arcs) or 1, offsets[-1]), -np.inf), np.full((len(arcs) or 1, offsets[-1]), -1)
        for n, (end, piece) in enumerate(arcs):
            weight[n, end] = self.log_p[piece]
            ids[n, end] = piece
        for end, raw in spelt:
            weight[0, end] = self.log_p[self.bytes_[list(raw)]].sum()
        return offsets, weight, ids, spelt

    @staticmethod
    def _forward(offsets: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Log probability of each word's beginnings, ends at offsets shifted by the word's number."""
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        base, shift = offsets[:-1][order], np.arange(len(sizes))[order]
        alpha = np.full(offsets[-1] + len(sizes), -np.inf)
        alpha[base + shift] = 0.0
        live = np.searchsorted(-sizes[order], -np.arange(1, sizes.max(initial=0) + 1), "right")
        for t, k in enumerate(live, 1):
            end, at = base[:k] + t - 1, base[:k] + shift[:k] + t
            m = min(len(weight), t)
            part = np.stack([alpha[at - n] + weight[n - 1, end] for n in range(1, m + 1)])
            top = part.max(0)
            alpha[at] = top + np.log(np.exp(part - np.where(np.isfinite(top), top, 0.0)).sum(0))
        return alpha

    def _stretch(self, text: str, start: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, bytes]]]:
        """Log weights and ids of arcs by (length, end), of the ends from ``start`` on, one stretch; what bytes spell."""
        first = max(0, start - self.longest + 1)
        _, weight, ids, spelt = self._tables([text[first : start + STRETCH]])
        before = start - first
        return weight[:, before:], ids[:, before:], [(e - before, raw) for e, raw in spelt if e >= before]

    def _begun(self, text: str) -> np.ndarray:
        """Log probabilities of a long text's beginnings, by their size."""
        m = self.longest
        alpha = np.full(m + len(text) + 1, -np.inf)  # m places before the text, which nothing reaches
        alpha[m] = 0.0
        for start in range(0, len(text), STRETCH):
            weight = self._stretch(text, start)[0]
            rows = np.full((weight.shape[1], m), -np.inf)
            rows[:, m - len(weight) :] = weight[::-1].T  # as the places before an end stand
            for t, row in enumerate(rows, m + start + 1):
                alpha[t] = np.logaddexp.reduce(alpha[t - m : t] + row)
        return alpha[m:]

    def _expected_long(self, text: str, count: float) -> np.ndarray:
        """As :meth:`expected`, of one long text: the backward recursion goes by the same stretches, the last first."""
        m, alpha, out = self.longest, self._begun(text), np.zeros(len(self.log_p))
        back = np.full(m + len(text) + 1, -np.inf)
        back[-1] = 0.0
        for start in reversed(range(0, len(text), STRETCH)):
            weight, ids, spelt = self._stretch(text, start)
            rows = np.full((weight.shape[1], m), -np.inf)
            rows[:, m - len(weight) :] = weight[::-1].T
            for k in range(len(rows) - 1, -1, -1):
                t = m + start + k + 1
                np.logaddexp(back[t - m : t], rows[k] + back[t], out=back[t - m : t])
            for n in range(1, len(weight) + 1):
                end = np.flatnonzero(weight[n - 1] > -np.inf)
                place = start + end + 1
                share = np.exp(alpha[place - n] + weight[n - 1, end] + back[m + place] - alpha[-1]) * count
                piece = ids[n - 1, end]
                out += np.bincount(piece[piece >= 0], share[piece >= 0], len(out))
                if n == 1 and spelt:
                    at = dict(zip(end.tolist(), share.tolist(), strict=True))
                    for e, raw in spelt:
                        np.add.at(out, self.bytes_[list(raw)], at.get(e, 0.0))
        return out

    def forward(self, words: list[str]) -> np.ndarray:
        """Natural log probability of each word, over all segmentations."""
        out, long = np.zeros(len(words)), np.array([len(w) > LONG for w in words], bool)
        for i in np.flatnonzero(long):
            out[i] = self._begun(chr(MARK) + words[i])[-1]
        short = [chr(MARK) + w for w in words if len(w) <= LONG]
        if short:
            offsets, weight, _, _ = self._tables(short)
            out[~long] = self._forward(offsets, weight)[offsets[1:] + np.arange(len(short))]
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over ``counts`` copies of the words."""
        long = np.array([len(w) > LONG for w in words], bool)
        if long.any():
            out = self.expected([w for w in words if len(w) <= LONG], counts[~long])
            for i in np.flatnonzero(long):
                out += self._expected_long(chr(MARK) + words[i], counts[i])
            return out
        offsets, weight, ids, spelt = self._tables([chr(MARK) + w for w in words])
        n_words, sizes = len(words), np.diff(offsets)
        alpha = self._forward(offsets, weight)
        owner = np.repeat(np.arange(n_words), sizes)
        total = alpha[offsets[1:] + np.arange(n_words)]
        # The backward pass is the forward pass over the words reversed.
        place = np.arange(offsets[-1]) - offsets[owner]
        mirrored = np.full_like(weight, -np.inf)
        for n in range(1, len(weight) + 1):
            ok = place >= n - 1
            end = np.flatnonzero(ok)
            begin = end - n + 1
            mirrored[n - 1, offsets[owner[end]] + sizes[owner[end]] - 1 - (begin - offsets[owner[end]])] = weight[n - 1, end]
        back = self._forward(offsets, mirrored)
        out = np.zeros(len(self.log_p))
        for n in range(1, len(weight) + 1):
            end = np.flatnonzero(weight[n - 1] > -np.inf)
            w = owner[end]
            begin_at = end + w - n + 1
            end_back = offsets[w] + w + sizes[w] - (place[end] + 1)
            share = np.exp(alpha[begin_at] + weight[n - 1, end] + back[end_back] - total[w]) * counts[w]
            piece = ids[n - 1, end]
            known = piece >= 0
            out += np.bincount(piece[known], share[known], len(out))
            if n == 1 and spelt:
                at = dict(zip(end.tolist(), share.tolist(), strict=True))
                for e, raw in spelt:
                    np.add.at(out, self.bytes_[list(raw)], at.get(e, 0.0))
        return out


def _groups(words: list[str], most: int = 200_000) -> Iterator[slice]:
    """Slices of about ``most`` characters."""
    at = size = 0
    for i, w in enumerate(words):
        size += len(w) + 1
        if size >= most:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(words):
        yield slice(at, len(words))


def in_training(doc_id: Column) -> Column:
    return fold(doc_id) != 1


class _Bag:
    """Words met so far, with sums, sent on before they are too many."""

    def __init__(self, most: int) -> None:
        self.most, self.h, self.n, self.words = most, [], [], []
        self.held = 0

    def add(self, w: T.Words, weight: np.ndarray) -> None:
        h = w.hashes()
        codes, where, code = np.unique(h, return_index=True, return_inverse=True)
        self.h.append(codes)
        self.n.append(np.stack([np.bincount(code, x, len(codes)) for x in weight]).astype(np.int64) if len(codes) else np.zeros((len(weight), 0), np.int64))
        self.words.append(w.strings(where))
        self.held += len(codes)

    def full(self) -> bool:
        return self.held > self.most

    def empty(self) -> tuple[pa.Array, np.ndarray]:
        h = np.concatenate(self.h)
        codes, where, code = np.unique(h, return_index=True, return_inverse=True)
        n = np.concatenate(self.n, 1)
        sums = np.stack([np.bincount(code, x, len(codes)) for x in n]).astype(np.int64)
        words = pa.concat_arrays(self.words).take(pa.array(where)).cast(pa.string())
        self.__init__(self.most)
        return words, sums


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): every distinct word of the texts, and how often it is in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag = _Bag(1_000_000)
        for b in batches:
            train = b.column(1).to_numpy(zero_copy_only=False)
            for i, j, w in T.word_runs(b.column(0)):
                bag.add(w, np.repeat(train[i:j], w.per_doc)[None].astype(float))
                if bag.full():
                    words, n = bag.empty()
                    yield pa.record_batch([words, pa.array(n[0])], ["word", "c"])
        if bag.h:
            words, n = bag.empty()
            yield pa.record_batch([words, pa.array(n[0])], ["word", "c"])

    rows = docs.select(F.col("text").cast("string").alias("text"), in_training(F.col("doc_id")).alias("train"))
    return rows.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def refine(lattice: Lattice, words: DataFrame, rounds: int = 2, smoothing: float = 0.1) -> Lattice:
    """``rounds`` of expectation-maximisation over all training words, each once."""
    for _ in range(rounds):
        model = lattice

        def run(batches: Iterator[pa.RecordBatch], model: Lattice = model) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(model.log_p))
            for b in batches:
                words = sorted(b.column(0).to_pylist(), key=len)
                for s in _groups(words):
                    total += model.expected(words[s], np.ones(s.stop - s.start))
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at, pa.int64()), pa.array(np.round(total[at] * 65536).astype(np.int64))], ["piece", "n"])

        sums = words.where("c > 0").select("word").mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()  # a row per piece
        uses = np.zeros(len(lattice.log_p))
        uses[sums["piece"].to_numpy(np.int64)] = sums["n"].to_numpy(float) / 65536
        if not uses.any():
            return lattice
        uses[:-1] += smoothing
        lattice = lattice.with_p(np.log(np.maximum(uses, 1e-300) / uses.sum()))
    return lattice


def scored(docs: DataFrame, vocabulary: str = VOCABULARY, rounds: int = 2, chunk_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    size, ends = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.when(in_training(F.col("doc_id")), 1))).first()
    words = saved(word_counts(docs), "words")
    n, v, once, twice = words.agg(F.coalesce(F.sum("c"), F.lit(0)), *(F.count(F.when(x, 1)) for x in (F.col("c") > 0, F.col("c") == 1, F.col("c") == 2))).first()
    n, v = n + ends, v + (ends > 0)
    lattice = refine(Lattice.load(vocabulary), words, rounds)
    floor = np.log10(n + 0.5 * (v + 1))
    ten = 1 / np.log(10)
    discount = once / (once + 2 * twice) if once and twice else 0.5
    share = discount * v / n if n else 1.0  # of the way through pieces

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, c = b.column(0).to_pylist(), b.column(1).to_numpy()
            order = np.argsort([len(w) for w in own], kind="stable")
            sorted_, p = [own[i] for i in order], np.zeros(len(own))
            for s in _groups(sorted_):
                p[order[s]] = lattice.forward(sorted_[s])
            with np.errstate(divide="ignore"):
                p = np.logaddexp(np.log(np.maximum(c - discount, 0) / max(n, 1)), np.log(share) + p) * ten
            yield pa.record_batch([b.column(0), b.column(1), pa.array(p)], ["word", "c", "p"])

    weighed = words.select("word", "c").mapInArrow(weigh, "word string, c long, p double")
    chunks = max(1, -(-size // chunk_bytes))
    chunk = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(chunks))
    dealt = docs.select("doc_id", "text", chunk.alias("chunk")).repartition(int(chunks), "chunk")

    def own_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags: dict[int, _Bag] = {}
        for b in batches:
            of = b.column(2).to_numpy()
            for k in np.unique(of).tolist():
                bag = bags.setdefault(k, _Bag(1_000_000))
                for _, _, w in T.word_runs(b.column(1).filter(pa.array(of == k))):
                    bag.add(w, np.zeros((1, len(w.start))))
                    if bag.full():
                        words, _ = bag.empty()
                        yield pa.record_batch([pa.array(np.full(len(words), k)), words], ["chunk", "word"])
        for k, bag in bags.items():
            if bag.h:
                words, _ = bag.empty()
                yield pa.record_batch([pa.array(np.full(len(words), k)), words], ["chunk", "word"])

    dictionary = dealt.mapInArrow(own_words, "chunk long, word string").join(weighed, "word").select("chunk", "word", "c", "p")
    end_p = float(np.log10(max(ends - discount, 0.5) / n)) if n else float(lattice.log_p[-1]) * ten

    def score(texts: pa.Table, own: pa.Table) -> pa.Table:
        data, offsets = T.utf8(own["word"])
        w = T.words(data, offsets, lower=False)
        assert (w.per_doc == 1).all()
        known, where = np.unique(w.hashes(), return_index=True)
        c = own["c"].to_numpy()[where]
        base, p = np.log10(c + 0.5) - floor, own["p"].to_numpy()[where]
        columns = []
        for i, j, w in T.word_runs(texts["text"].combine_chunks()):
            at = np.searchsorted(known, w.hashes())
            doc, k = w.doc, j - i
            columns.append((w.per_doc + 1, np.bincount(doc[c[at] > 0], minlength=k) + (ends > 0), np.bincount(doc, base[at], k) + np.log10(ends + 0.5) - floor, np.bincount(doc, p[at], k) + end_p))
        n_tokens, n_known, base_score, total = (np.concatenate(x) for x in zip(*columns, strict=True)) if columns else (np.zeros(0),) * 4
        return pa.table({"doc_id": texts["doc_id"], "n_tokens": n_tokens.astype(np.int64), "n_known": n_known.astype(np.int64), "base_score": base_score, "score": total})

    out = dealt.groupBy("chunk").cogroup(dictionary.groupBy("chunk")).applyInArrow(score, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
