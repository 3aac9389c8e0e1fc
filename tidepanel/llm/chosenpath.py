"""Near-duplicate documents: a chosen-path set similarity join over minwise tokens.

A document's set is its distinct ``k``-word shingles (words are runs outside ``[\\x20\\x09-\\x0D]``, A-Z
lower-cased); with fewer words, their whole sequence; without words it is empty and links with nothing.
Documents with equal sets are one class. Each class has ``TOKENS`` minwise tokens, one for each of as many
hash functions; two sets agree in a share of them that is close to their Jaccard similarity. Eight bits of
each token, its marks, travel with the class.

Join trees (:func:`roots`, :func:`deeper`): at the root, and at every node that is too large, a few hash
functions are chosen at random (by the node's path), one for sure and another with the probability that
makes 1 / threshold of them on average, and each class goes to the child named by its token of each. Similar
classes share a token with the probability of their similarity, so on average a pair at the threshold
meets in as many children as it left behind; ``trees`` independent trees bring the chance to meet close to
1. Nodes of one class end.

Nodes of at most ``small`` classes (and ``MOST_SHINGLES`` shingles) are units, compared exhaustively by their
marks. What matters is which classes hang together, so not all pairs of a group of copies are confirmed
(:func:`decide`): a unit proposes the forest of its most similar pairs that agree in enough marks to reach the
threshold (:func:`forests`); these are confirmed on the full sets, taken anew from the whole texts
(:func:`confirmed`). A tree of a forest that a refuted pair leaves in several components is looked at once
more: those of its classes that may reach one of another component get their full sets, each once, and all
their pairs are compared (:func:`compared`). So no two documents whose sets reach the threshold and that met
in a unit stay apart, and no list of all pairs is made: every table has a few rows for a class in a unit.

Nodes that are larger can hold any share of all rows. In the largest of its large nodes each class is first
compared with a few hundred of the node's classes, in units of blocks beside these (:func:`beside`). What
that ties together is one component, and pairs within it have nothing left to show: a node that is one
component is done; one with few classes beside its largest component compares these with all, block by
block; others branch on (:func:`settled`). Every ``depth`` branchings, the comparison with a few hundred is
done anew. This goes on until no large node is left, so none is cut short.

Null texts count as empty. Null ids link with nothing. Repeated ids are rows of their own and count as one
node. Ties are broken by the least id. An empty table gives an empty result. Columns of other names are
left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import textvec as T
from tidepanel.llm.components import connected_components, groups, merged, repeated, stretches
from tidepanel.llm.skew import dealt
from tidepanel.llm.store import drop, gathered, saved

TOKENS = 64
FEW = 256
MOST_SHINGLES = 1 << 23
_keys = T.mix(np.arange(1, TOKENS + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def tokens(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The minwise tokens of each document's distinct shingles, 32 bits each; documents without shingles have none."""
    some = np.flatnonzero(counts)
    out = np.empty((len(some), TOKENS), np.uint32)
    if len(some):
        begin = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
        for t, key in enumerate(_keys):
            x = codes ^ key
            x = x * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            x = x * np.uint64(0x94D049BB133111EB)
            out[:, t] = np.minimum.reduceat(x, begin) >> np.uint64(32)
    return out


def sketches(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, tokens); k1 and k2 are equal for equal sets; tokens are null for empty sets and null ids."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in T.word_runs(b.column(1)):
                codes, n = T.shingles(w, k)
                found = iter(tokens(codes, n))
                one, two = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                some = np.flatnonzero(n)
                if len(some):
                    begin = np.concatenate([[0], np.cumsum(n[some])[:-1]])
                    one[some], two[some] = np.add.reduceat(codes, begin), np.add.reduceat(T.mix(codes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin)
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([next(found).tobytes() if x else None for x in n], pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "tokens"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_shingles long, k1 long, k2 long, tokens binary")


def _path(node: np.ndarray, step: np.ndarray | int, token: np.ndarray) -> np.ndarray:
    return T.mix(node ^ T.mix(token.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(step).astype(np.uint64) + np.uint64(1))))


def branch(node: np.ndarray, own: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and child nodes: each row's node chooses hash functions, and the row's tokens of them name the children."""
    rows, children = [], []
    at = np.arange(len(node))
    for step in (0, 1):
        draw = T.mix(node ^ np.uint64(0xC2B2AE3D27D4EB4F * (step + 1) % 2**64))
        go = at if not step else at[(T.mix(draw) >> np.uint64(11)).astype(float) / 2**53 < 1 / threshold - 1]
        which = (draw[go] % np.uint64(TOKENS)).astype(np.int64)
        rows.append(go)
        children.append(_path(node[go], which, own[go, which]))
    return np.concatenate(rows), np.concatenate(children)


def _matrix(column: pa.Array | pa.ChunkedArray, kind: type = np.uint8) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, TOKENS)


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of a matrix of bytes."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def roots(classes: DataFrame, threshold: float, trees: int) -> DataFrame:
    """(node, id, size, component, marks): the children of every tree's root; ``classes`` has id, size, component and tokens."""
    kind = dict(classes.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = _matrix(b.column(3), np.uint32)
            for tree in range(trees):
                rows, children = branch(T.mix(np.full(len(own), tree + 1, np.uint64)), own, threshold)
                at = pa.array(rows)
                yield pa.record_batch([pa.array(children.view(np.int64)), *(b.column(c).take(at) for c in range(3)), _binary(own[rows].astype(np.uint8))], ["node", "id", "size", "component", "marks"])

    return classes.select("id", "size", "component", "tokens").mapInArrow(run, f"node long, id {kind}, size long, component {kind}, marks binary")


def deeper(rows: DataFrame, threshold: float) -> DataFrame:
    """(node, id, size, component, marks): the children of the nodes of ``rows``, by their marks."""
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = _matrix(b.column(4))
            at, children = branch(b.column(0).to_numpy().view(np.uint64), own, threshold)
            yield pa.record_batch([pa.array(children.view(np.int64)), *(b.column(c).take(pa.array(at)) for c in range(1, 5))], ["node", "id", "size", "component", "marks"])

    return rows.select("node", "id", "size", "component", "marks").mapInArrow(run, f"node long, id {kind}, size long, component {kind}, marks binary")


UNIT = ["node", "part"]
TREE = [*UNIT, "tree"]


def units_of(rows: DataFrame, part: Column | int = 0) -> DataFrame:
    """(node, part, id, component, marks)."""
    return rows.select("node", (F.lit(part) if isinstance(part, int) else part).cast("int").alias("part"), "id", "component", "marks")


def _parts(m: str, weight: str, small: int) -> Column:
    """How many blocks make units of at most about ``small`` classes and MOST_SHINGLES shingles."""
    return F.ceil(F.greatest(F.col(m) / small, F.col(weight) / MOST_SHINGLES)).cast("int")


def _block(parts: Column) -> Column:
    return F.pmod(F.xxhash64("id", "node"), parts).cast("int")


def large_nodes(rows: DataFrame, small: int) -> DataFrame:
    """(node, m, weight) of the nodes that are no units, written."""
    per = rows.groupBy("node").agg(F.count("*").alias("m"), F.sum("size").alias("weight"))
    return saved(per.where((F.col("m") > 1) & ((F.col("m") > small) | (F.col("weight") > MOST_SHINGLES))), "large")


def in_nodes(rows: DataFrame, nodes: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined to stored large ``nodes``, which are few: each holds over ``small`` classes or MOST_SHINGLES shingles.

    So the nodes are broadcast, and rows of a very large one stay where they are.
    """
    return rows.join(F.broadcast(nodes), "node", how)


def beside(rows: DataFrame, small: int) -> DataFrame:
    """Units that compare each class, in the largest of its large nodes, with a few hundred of that node."""
    one = rows.groupBy("id").agg(F.max_by(F.struct("node", "size", "component", "marks"), F.struct("m", "node")).alias("x")).select("id", "x.*")
    per = one.groupBy("node").agg(F.count("*").alias("m"), F.sum("size").alias("weight"))
    one = in_nodes(one, per).withColumn("parts", _parts("m", "weight", small))
    few = F.pmod(F.xxhash64("node", "id", F.lit(1)), F.ceil(F.col("m") / min(FEW, small)).cast("long")) == 0
    to = F.when(few, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(_block(F.col("parts"))))
    return units_of(one.withColumn("part", F.explode(to)), F.col("part"))


def settled(rows: DataFrame, small: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of large nodes: units that compare what few classes are beside a node's largest component with all; the rows that branch on; a table that both read."""
    per = rows.groupBy("node", "component").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    per = per.groupBy("node").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("m"), F.sum("s").alias("weight"))
    per = saved(per.select("node", "m", "weight", F.col("top.n").alias("n"), F.col("top.component").alias("giant")).where("m > n"), "settled")
    few = F.col("m") - F.col("n") <= min(FEW, small)
    held = in_nodes(rows.drop("m", "weight"), per.where(few)).withColumn("parts", _parts("m", "weight", small))
    to = F.when(F.col("component") == F.col("giant"), F.array(_block(F.col("parts")))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    units = units_of(held.withColumn("part", F.explode(to)), F.col("part"))
    return units, in_nodes(rows, per.where(~few), "left_semi"), per


def _laid(units: DataFrame, keys: list[str], *columns: str, rows: int | None = None) -> DataFrame:
    """Rows by key, each key's in one partition; of ``rows`` rows at most, in no more partitions than these need."""
    laid = units.repartition(*keys).sortWithinPartitions(*keys, "id").select(*keys, *columns)
    return laid if rows is None else gathered(laid, rows, 1_000)


def _agreeing(marks: np.ndarray, which: int) -> np.ndarray:
    """In how many marks a class agrees with each; ``marks`` has a row for each token."""
    return (marks == marks[:, which : which + 1]).sum(0, dtype=np.uint8)


def spanning(marks: np.ndarray, component: np.ndarray, least: int) -> np.ndarray:
    """(a, b, tree) rows: a forest of the most similar pairs that agree in ``least`` marks or are of one component.

    Prim's way: a tree takes in the row that is most similar to any of its rows, until none is near enough.
    """
    n = marks.shape[1]
    best, by, free = np.zeros(n, np.uint8), np.zeros(n, np.int64), np.ones(n, bool)
    left, tree = [], 0
    for _ in range(n):
        now = int(best.argmax())
        if best[now]:
            left.append((by[now], now, tree))
        else:
            now = tree = int(free.argmax())
        free[now] = False
        best[now] = 0
        near = _agreeing(marks, now)
        near[near < least] = 0
        near[component == component[now]] = TOKENS + 1
        more = (near > best) & free
        best[more], by[more] = near[more], now
    return np.array(left, np.int64).reshape(-1, 3)


def _small_runs(own: np.ndarray, at: np.ndarray, component: np.ndarray, least: int, few: int) -> np.ndarray:
    """As :func:`spanning`, for all runs of at most ``few`` rows at once; trees are named by their least row."""
    size = np.diff(at)
    run = np.repeat(np.arange(len(size)), size)
    out = []
    for d in range(1, min(few, int(size.max(initial=0)))):
        a = np.flatnonzero((run[:-d] == run[d:]) & (size[run[:-d]] <= few))
        agree = (own[a] == own[a + d]).sum(1)
        agree[component[a] == component[a + d]] = TOKENS + 1
        keep = agree >= least
        out.append(np.stack([a[keep], a[keep] + d, agree[keep]], 1))
    pairs = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0], -pairs[:, 2]))]
    root: dict[int, int] = {}

    def top(i: int) -> int:
        while (up := root.setdefault(i, i)) != i:
            root[i] = i = root[up]
        return i

    ties = []
    for a, b, _ in pairs.tolist():
        p, q = top(a), top(b)
        if p != q:
            root[max(p, q)] = min(p, q)
            ties.append((a, b))
    return np.array([(a, b, top(a)) for a, b in ties], np.int64).reshape(-1, 3)


def forests(units: DataFrame, least: int) -> DataFrame:
    """(node, part, tree, a, b, same): the trees of each unit's forest that tie more than one component together.

    ``same`` marks pairs of one component, which need no look.
    """
    kind = dict(units.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, at in stretches(batches, 2):
            ids = g["id"].to_numpy()
            _, component = np.unique(g["component"].to_numpy(), return_inverse=True)
            own = _matrix(g["marks"])
            found = [_small_runs(own, at, component, least, 16)]
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if j - i > 16:
                    found.append(spanning(np.ascontiguousarray(own[i:j].T), component[i:j], least) + i)
            a, b, tree = np.concatenate(found).T
            same = component[a] == component[b]
            keep = np.isin(tree, tree[~same])
            a, b, tree, same = a[keep], b[keep], tree[keep], same[keep]
            x, y = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
            yield pa.record_batch([g["node"].take(pa.array(a)).combine_chunks(), g["part"].take(pa.array(a)).combine_chunks(), pa.array(tree), pa.array(x), pa.array(y), pa.array(same)], [*TREE, "a", "b", "same"])

    return _laid(units, UNIT, "id", "component", "marks").mapInArrow(run, f"node long, part int, tree long, a {kind}, b {kind}, same boolean")


def undecided(rows: DataFrame, least: int, most: int) -> DataFrame:
    """(node, part, tree, id, component, marks) of the ``rows`` that may reach one of another component in their tree; ``rows`` are ``most`` at most."""
    names = [*TREE, "id", "component"]
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 3):
            own = _matrix(g["tokens"], np.uint32).astype(np.uint8)
            marks, (_, component) = np.ascontiguousarray(own.T), np.unique(g["component"].to_numpy(), return_inverse=True)
            live = np.array([i for i in range(len(own)) if ((_agreeing(marks, i) >= least) & (component != component[i])).any()], np.int64)
            yield from g.select(names).take(pa.array(live)).append_column("marks", _binary(own[live])).combine_chunks().to_batches()

    return _laid(rows, TREE, "id", "component", "tokens", rows=most).mapInArrow(run, f"node long, part int, tree long, id {kind}, component {kind}, marks binary")


def shared(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections, by products of 0-1 matrices over the elements that more than one set has."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, code, n = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.cumsum(n > 1) - 1
    keep = n[code] > 1
    column, owner = rank[code[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float32)  # exact for whole numbers below 2**24
    for begin in range(0, int(rank[-1]) + 1 if len(rank) else 0, width):
        i, j = np.searchsorted(column, [begin, begin + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[i:j], column[i:j] - begin] = 1
        out += m @ m.T
    return out.astype(np.int32)


def _sets(texts: pa.Array | pa.ChunkedArray, k: int) -> list[np.ndarray]:
    """The full set of each text."""
    out: list[np.ndarray] = []
    for _, _, w in T.word_runs(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts):
        codes, n = T.shingles(w, k)
        out += np.split(codes, np.cumsum(n)[:-1])
    return out


def links(sets: list[np.ndarray], marks: np.ndarray, component: np.ndarray, least: int, percent: int) -> list[tuple[int, int]]:
    """A forest of the links between different components; ``marks`` has a row for each token."""
    n, size = len(sets), np.array([len(x) for x in sets])
    near = np.zeros((n, n), bool)
    for i in range(n):
        near[i] = (_agreeing(marks, i) >= least) & (component != component[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
    if near.sum() > 8 * n:
        both = shared(sets)
        for i in range(n):
            near[i] &= 100 * both[i] >= percent * (size[i] + size - both[i])
    else:
        for i, j in zip(*np.nonzero(np.triu(near)), strict=True):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            near[i, j] = near[j, i] = 100 * both >= percent * (size[i] + size[j] - both)
    out, seen = [], np.zeros(n, bool)
    for first in range(n):
        waiting = [] if seen[first] else [first]
        seen[first] = True
        while waiting:
            i = waiting.pop()
            to = np.flatnonzero(near[i] & ~seen)
            out += [(i, j) for j in to.tolist()]
            to = np.union1d(to, np.flatnonzero((component == component[i]) & ~seen))
            seen[to] = True
            waiting += to.tolist()
    return out


def compared(rows: DataFrame, texts: DataFrame, least: int, k: int, percent: int) -> DataFrame:
    """(a, b): a forest of the links between different components in each tree, by the full sets of its rows.

    Trees with the same rows are compared once.
    """
    kind = dict(rows.dtypes)["id"]
    members = rows.groupBy(TREE).agg(F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("x"), F.count("*").alias("n"))
    first = members.groupBy("x", "n").agg(F.min(F.struct(*TREE)).alias("u")).select("u.*")
    full = rows.join(first, TREE, "left_semi").join(texts, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 3):
            ids = g["id"].to_numpy()
            _, component = np.unique(g["component"].to_numpy(), return_inverse=True)
            found = links(_sets(g["text"], k), np.ascontiguousarray(_matrix(g["marks"]).T), component, least, percent)
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], ["a", "b"])

    return _laid(full, TREE, "id", "component", "marks", "text").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int, most: int) -> DataFrame:
    """(a, b, linked): whether the sets of the ``most`` pairs at most have 100 * intersection >= percent * union; ``texts`` has (id, text)."""
    kind = dict(pairs.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, linked = b.slice(at, 256), []
                for x, y in zip(_sets(part.column(2), k), _sets(part.column(3), k), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(bool(both) and 100 * both >= percent * (len(x) + len(y) - both))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
    one = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    return gathered(one, most, 500).mapInArrow(run, f"a {kind}, b {kind}, linked boolean")


def decide(units: DataFrame, classes: DataFrame, parts: DataFrame, texts: DataFrame, least: int, k: int, percent: int) -> DataFrame:
    """New components: ``parts`` (id, component; others are their own) with all links between the classes of each unit."""
    tied = saved(forests(units, least), "forests")
    most = tied.count()
    pairs = saved(gathered(tied.where("not same").select("a", "b").distinct(), most), "pairs")
    ids = saved(gathered(tied.select(F.explode(F.array("a", "b")).alias("id")).distinct(), 2 * most), "ids")
    needed = saved(texts.join(ids, "id", "left_semi"), "needed")  # whole texts are shuffled this once
    looked = saved(confirmed(pairs, needed, k, percent, most), "looked")
    drop(pairs, ids)
    now = merged(parts, looked.where("linked").select("a", "b"))
    doubtful = tied.join(looked.where("not linked").select("a", "b"), ["a", "b"], "left_semi").select(TREE).distinct()
    rows = tied.join(doubtful, TREE, "left_semi").select(*TREE, F.explode(F.array("a", "b")).alias("id")).distinct()
    rows = saved(gathered(rows.join(now, "id", "left").withColumn("component", F.coalesce("component", "id")), 2 * most), "rows")
    drop(tied, looked)
    mixed = rows.groupBy(TREE).agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select(TREE)
    rows, past = rows.join(mixed, TREE, "left_semi"), rows
    left = saved(undecided(rows.join(classes.select("id", "tokens"), "id"), least, 2 * most), "left")
    drop(past)
    if left.isEmpty():
        drop(left, needed)
        return now
    found = saved(compared(left, needed, least, k, percent), "links")
    last = merged(now, found)
    drop(left, needed, now, found)
    return last


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, trees: int = 10, small: int = 2048, depth: int = 4) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept."""
    threshold = percent / 100
    sketch = saved(sketches(docs, k), "sketches")
    can = sketch.where("tokens is not null and doc_id is not null")
    own = saved(can.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.first("tokens").alias("tokens"), F.first("n_shingles").alias("size")), "sets")
    spread = 3.6 * (TOKENS * threshold * (1 - threshold)) ** 0.5
    least = max(1, int(TOKENS * threshold - spread))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    parts = connected_components(repeated(can.select(F.col("doc_id").alias("src"), "k1", "k2"), own.select("k1", "k2", F.col("id").alias("dst")), ["k1", "k2"]))

    def labelled(rows: DataFrame) -> DataFrame:
        """Rows with their components of now."""
        return rows.drop("component").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))

    rows = roots(labelled(own), threshold, trees)
    large = large_nodes(rows, small)
    units, old, level = [], [large], 0
    if not large.isEmpty():
        big = saved(in_nodes(rows, large), "nodes")
        while not big.isEmpty():
            if level % depth == 0:
                parts, past = decide(beside(big, small), own, parts, texts, least, k, percent), parts
                drop(past)
            few, more, per = settled(labelled(big), small)
            units.append(saved(few, "units"))
            if more.isEmpty():
                drop(big, per)
                break
            below = saved(deeper(more, threshold), "nodes")
            drop(big, per)
            level += 1
            more = large_nodes(below, small)
            units.append(saved(units_of(in_nodes(below, more, "left_anti")), "units"))
            big = saved(in_nodes(below, more), "nodes")
            drop(below, more)
        rows = in_nodes(roots(labelled(own), threshold, trees), large, "left_anti")
        old += units
        units = [labelled(x).select(*UNIT, "id", "component", "marks") for x in units]
    parts, past = decide(reduce(DataFrame.unionByName, units, units_of(rows)), own, parts, texts, least, k, percent), parts
    found = saved(own.join(parts, "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("component"), F.lit(True).alias("can")), "found")
    members = saved(sketch.select("doc_id", "n_shingles", "k1", "k2", (F.col("tokens").isNotNull() & F.col("doc_id").isNotNull()).alias("can")), "members")
    drop(past, parts, own, sketch, *old)
    out = dealt(members, found, ["k1", "k2", "can"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
