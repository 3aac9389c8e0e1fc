from __future__ import annotations

import hashlib
import html
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm import chosenpath, cuckoo, htmlcut, lattice, mixing, mpegts, packing, quality, toxicity, vectors
from tidepanel.llm.components import connected_components

from tests.llm import labelled_pages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark: SparkSession, rows: list[tuple], extra: bool = True) -> DataFrame:
    """Documents with columns whose names clash with the operators' own."""
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)
    clash = ["size", "h", "block", "k1", "k2", "tokens", "component", "component_id", "kept", "id", "a", "b", "node", "n_docs", "shard", "salt", "piece", "length", "rank", "word", "c", "chunk", "key", "keys", "drawn", "target", "y", "x", "media", "units", "n"]
    return df.selectExpr("*", *(f"'{c}' as `{c}`" for c in clash)) if extra else df


def words(t: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


ODD = [(1, "a b c d e f g h i j k l m n o p q r s t", "s"), (2, None, None), (3, "", "s"), (4, "   \n\t ", ""), (None, "no id here", "s"), (5, "x" * 60_000 + " " + "y z " * 9_000, "t"), (6, "a b c d e f g h i j k l m n o p q r s t", "s"), (6, "a b c d e f g h i j k l m n o p q r s t", "s"), (7, "Ünïcode ßtraße 日本", "u")]


@pytest.fixture(scope="module")
def odd(spark: SparkSession) -> DataFrame:
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def none(spark: SparkSession) -> DataFrame:
    return docs(spark, [])


LABELS = "doc_id long, quality int, toxic int"


def test_names_that_clash(spark: SparkSession) -> None:
    import corpus_pipeline

    names = ["_id", "_doc", "_keys", "_N_lines", "_n_dropped", "_sha256", "_again", "_quality", "_toxicity", "_shard", "_pass", "_place", "_size", "_h", "_block", "_one", "_drawn", "_before", "row", "start", "tree", "part", "units", "partial", "_c_id", "text_"]
    rows = [(i, f"The {'fox' if i % 2 else 'hare'} went {i} times\nThis line is long and many share it\nand came home", f"s{i % 3}") for i in range(40)]
    plain = docs(spark, rows, False)
    odd = plain.selectExpr("*", *(f"'{c}' as `{c}`" for c in names))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], LABELS)
    model = quality.Additive(0.5)
    for done in (cuckoo.line_dedup, lambda d: corpus_pipeline.near_dedup(spark, d, ""), mixing.mixed, lambda d: quality.with_scores(d, model, "_q"), packing.packed, lambda d: toxicity.scored(d, labels), mpegts.media_columns):
        a, b = done(plain), done(odd)
        own = [c for c in a.columns if c in b.columns and not c.startswith("_")]
        assert Counter(map(tuple, a.select(own).collect())) == Counter(map(tuple, b.select(own).collect()))
        assert len(set(b.columns)) == len(b.columns) and (b.columns[: len(odd.columns)] == odd.columns or "text" not in b.columns)


# 1 quality


def test_boosted_tables_learn_effects_and_interactions() -> None:
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0.5) | ((x[:, 1] > 0) ^ (x[:, 2] > 0))).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    assert (1, 2) in model.pairs or (2, 1) in model.pairs
    assert quality.fit(x, np.ones(len(x))).score(x).min() > 0.99


def test_scores_are_sums_of_table_entries() -> None:
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(300, 3)), (rng.random(300) > 0.5).astype(float)
    m = quality.fit(x, y, rounds=10, pair_rounds=5)
    for row, score in zip(x, m.score(x), strict=True):
        bins = [int(np.searchsorted(c, v, "right")) for c, v in zip(m.cuts, row, strict=True)]
        total = m.intercept + sum(t[b] for t, b in zip(m.tables, bins, strict=True)) + sum(t[bins[j], bins[k]] for (j, k), t in m.pairs.items())
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_of_odd_rows(spark: SparkSession, odd: DataFrame, none: DataFrame) -> None:
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, None), (None, 1, 1), (4, None, 0), (6, 1, 0)], LABELS)
    out = quality.scored(odd, labels).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert quality.scored(none, labels).count() == 0
    assert quality.scored(odd, spark.createDataFrame([], LABELS)).count() == len(ODD)


def test_quality_held_out(spark: SparkSession) -> None:
    sf = "/root/testdata/sf0.01"
    out = quality.scored(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert ((out.score >= 0.5) == (out.quality == 1)).mean() > 0.93
    assert out.held_out.equals(out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0))


# 2 vectors


def test_vectors_match_brute_force(spark: SparkSession) -> None:
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = [centres[i % 30] + rng.normal(size=16) * 0.12 for i in range(900)]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(1000 + i, x[i].tolist(), 1) for i in range(20)] + [(2000, (x[3] * 1e200).tolist(), 1)]
    rows += [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [1.0] * 15 + [None], 0), (3003, [float("nan")] * 16, 0), (3004, [float("inf")] + [1.0] * 15, 0), (3005, [], 0), (3006, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as key", "2 as copies", "3 as id")
    got = {r.vec_id: r for r in vectors.near_duplicates(df, block=64).collect()}
    ok = [(i, np.array(v, float)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 16]
    m = np.stack([v / np.abs(v).max() for _, v in ok])
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    ids = [i for i, _ in ok]
    links = {i: int(n) for i, n in zip(ids, near.sum(1), strict=True)}
    reach = {i: i for i in ids}
    for _ in range(50):
        for a, b in zip(*np.nonzero(near), strict=True):
            reach[ids[a]] = min(reach[ids[a]], reach[ids[b]])
    found = sum(got[i].n_links for i in ids)
    assert found >= 0.99 * sum(links.values()) and all(got[i].n_links <= links[i] for i in ids)
    assert all(got[i].component_id == reach[i] for i in ids)
    for i in range(3000, 3007):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert len(got) == len(rows)


def test_pairs_at_the_threshold_are_found(spark: SparkSession) -> None:
    rng = np.random.default_rng(5)
    n, size = 2000, 64
    a = rng.normal(size=(n, size))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=(n, size))
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = rng.uniform(0.9 + 1e-9, 0.92, n)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, c * a + np.sqrt(1 - c * c) * b]))]
    out = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("n_links > 0").collect()
    assert all(r.n_links == 1 and r.component_id == r.vec_id % n for r in out)
    assert len(out) / (2 * n) >= 0.99, len(out) / (2 * n)


def test_vectors_none_and_floats(spark: SparkSession) -> None:
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_duplicates(empty).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 1.0], 0), (None, [0.0, 1.0], 0)], "vec_id long, embedding array<float>, label int")
    out = sorted((r.vec_id or -1, r.n_links, r.component_id) for r in vectors.near_duplicates(two).collect())
    assert out == [(-1, 0, None), (1, 0, 1), (1, 1, 1), (2, 1, 1)]


def test_components(spark: SparkSession) -> None:
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 75), (75, 75), (200, 100), (7, 3)] + [(500, 500 + i) for i in range(1, 60)]
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert all(got[i] == 0 for i in range(41)) and {got[i] for i in (50, 75, 100, 200)} == {50} and all(got[500 + i] == 500 for i in range(60))
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "src long, dst long")).count() == 0


# 3 HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a></li></ul></nav><div id="cookie-notice">We use cookies. Please accept them.</div>
<aside class=sidebar><p>Read our newsletter, dear reader. It is free.</p></aside><script>var x = "<p>no</p>";</script>
<article><h1>A title</h1><p>First &amp; second.<p>Caf&eacute; &#8212; third   block
here.</p><div class="ad">Buy this now. It is cheap.</div><form><p>Sign up here.</p></form><blockquote>Said someone.</blockquote></article>
<section id="comments"><div class="comment"><p>I do not agree with this article at all.</p></div></section><footer>&copy; 2020 All rights reserved.</footer></body></html>"""


def test_main_text() -> None:
    assert htmlcut.main_text(PAGE) == "A title First & second. Café — third block here. Said someone."
    plain = PAGE.replace("<article>", '<div class="content">').replace("</article>", "</div>")
    assert htmlcut.main_text(plain) == htmlcut.main_text(PAGE)
    assert htmlcut.main_text(None) == htmlcut.main_text("") == htmlcut.main_text("<p>") == ""
    for cut_off in range(0, len(PAGE), 37):
        htmlcut.main_text(PAGE[:cut_off])


def test_precision_and_recall_on_pages_labelled_by_hand() -> None:
    shared = found = there = 0
    for page in labelled_pages.PAGES.values():
        plain = lambda b: html.unescape(re.sub(r"<[^>]*>", "", b))
        want = Counter(w for b in re.findall(r"\[\[(.*?)\]\]", page, re.S) for w in plain(b).split())
        got = Counter(htmlcut.main_text(page.replace("[[", "").replace("]]", "")).split())
        shared, found, there = shared + (want & got).total(), found + got.total(), there + want.total()
    assert shared / found >= 0.9 and shared / there >= 0.95, (shared / found, shared / there)


def test_min_cut_is_the_least_cost() -> None:
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 8)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda s: sum(-g if x else g for g, x in zip(gain, s, strict=True)) / 2 + sum(w for a, b, w in edges if s[a] != s[b])  # noqa: B023, E731
        # A cut pays |gain| for a wrong side; half the signed sum differs from that by a constant.
        best = min(cost(s) for s in itertools.product((False, True), repeat=n))
        assert cost(htmlcut.min_cut(gain, edges)) == pytest.approx(best)


def test_pages_of_the_test_table(spark: SparkSession, sf: str) -> None:
    out = htmlcut.extracted(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    assert all(r.n_chars == len(r.text) and "<" not in r.text and "©" not in r.text for r in out)
    odd = spark.createDataFrame([(1, None, None), (1, "u", ""), (None, "u", PAGE), (2, "u", "<div>" * 3000 + "Deep text is here. " * 2000)], "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")
    got = htmlcut.extracted(odd).collect()
    assert len(got) == 4 and {r.n_chars for r in got if r.page_id == 1} == {0}
    assert htmlcut.extracted(odd.limit(0)).count() == 0


def test_deep_pages_take_time_in_proportion() -> None:
    import time

    def took(n: int) -> float:
        page = "<div>" * n + "".join(f"<p>Some text here {i}.</b></section>" for i in range(n)) + "<b>" * n + "x</i>" * n
        began = time.process_time()
        htmlcut.blocks(page)
        return time.process_time() - began

    took(500)
    assert took(16_000) < 8 * max(took(4_000), 0.02)


# 4 mixing


def fill(sizes: dict[str | None, int], limit: int = 3) -> dict[str | None, float]:
    """Shares by weight, and what is above the limit shared anew, step by step."""
    order = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + [k for k in sizes if k is None]
    weight = {k: 1 + i % 3 for i, k in enumerate(order)}
    total, held = sum(sizes.values()), set()
    while True:
        rest = total - sum(limit * sizes[k] for k in held)
        w = sum(weight[k] for k in sizes if k not in held)
        out = {k: limit * sizes[k] if k in held else rest * weight[k] / w for k in sizes}
        over = {k for k in sizes if k not in held and out[k] > limit * sizes[k] + 1e-9}
        if not over:
            return out
        held |= over


def test_mixing(spark: SparkSession) -> None:
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 40))), rng.choice(["a", "b", "bb", "ä", "", None, "z"][: 7 if i % 3 else 2])) for i in range(400)]
    rows += [(1000, "one two", "tiny"), (1001, None, "empty"), (1002, "a b", "tiny2")]
    out = mixing.draw(docs(spark, rows)).collect()
    sizes: dict[str | None, int] = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want, taken = fill(sizes), Counter()
    for r in out:
        assert r.size == len(words(dict((i, t) for i, t, _ in rows)[r.doc_id])) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = {r.doc_id: (r.taken, [tuple(x) for x in r.drawn]) for r in mixing.draw(docs(spark, rows).repartition(5)).collect()}
    assert again == {r.doc_id: (r.taken, [tuple(x) for x in r.drawn]) for r in out}
    mixed = mixing.mix(docs(spark, rows))
    got, whole, most = Counter(), {i: t for i, t, _ in rows}, Counter()
    for _, t, s in rows:
        most[s] = max(most[s], len(words(t)))
    for r in mixed.collect():
        got[r.source] += len(words(r.text))
        assert r.text == whole[r.doc_id] and r.n_chars == len(r.text)
    assert all(abs(got[s] - taken[s]) <= most[s] / 2 for s in sizes)  # whole documents: the last one is drawn or not


def test_mixed_documents_lie_by_shard_and_place(spark: SparkSession) -> None:
    rng = random.Random(19)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(1, 30))), rng.choice("abc")) for i in range(600)]
    parts = mixing.mixed(docs(spark, rows), blocks=64, depth=3).selectExpr("doc_id", "source", "_shard", "_pass", "_place", "spark_partition_id() as at").collect()
    by_part = defaultdict(list)
    for r in parts:
        by_part[r["at"]].append((r._shard, r._place))
    assert all(x == sorted(x) for x in by_part.values())
    drawn = {(r.doc_id, d["pass"]): (d["shard"], d["place"]) for r in mixing.draw(docs(spark, rows), blocks=64, depth=3).collect() for d in r.drawn if 2 * d["words"] >= r.size}
    assert {(r.doc_id, r._pass): (r._shard, r._place) for r in parts} == drawn
    keyed = {r.doc_id: r._block for r in mixing._keyed(docs(spark, rows), 64, 0).collect()}
    units = defaultdict(set)
    for r in parts:
        units[r.source, keyed[r.doc_id], r._pass].add(r._shard)
    assert all(len(x) == 1 for x in units.values())  # a block goes to one shard, and shards have equal numbers of blocks
    per = Counter(next(iter(x)) for x in units.values())
    assert len(per) == 8 and max(per.values()) - min(per.values()) <= 1
    order = [r.doc_id for r in sorted(parts, key=lambda r: (r._shard, r._place))]
    assert order != sorted(order)


def test_quotas_split_exactly_and_like_a_hypergeometric_draw(spark: SparkSession) -> None:
    quota = {1: 100, 2: 7, 3: 0, 4: 513}
    q = spark.createDataFrame(list(quota.items()), "rank int, units long")
    firsts = []
    for seed in range(12):
        out = mixing.split_quotas(q, 2, seed).collect()
        per_source, per_shard = Counter(), Counter()
        for r in out:
            assert r.units >= 0
            per_source[r["rank"]] += r.units
            per_shard[r.shard] += r.units
        assert per_source == Counter(quota) and max(per_shard.values()) - min(per_shard.values()) <= 1
        firsts.append(sum(r.units for r in out if r["rank"] == 1 and r.shard < 2))
    assert 40 <= np.mean(firsts) <= 60 and len(set(firsts)) > 3
    assert mixing.split_quotas(q.limit(0), 2).count() == 0


def test_mixing_odd(odd: DataFrame, none: DataFrame) -> None:
    assert mixing.draw(odd).count() == len(ODD) and mixing.mix(odd).count() > 0
    assert mixing.draw(none).count() == mixing.mix(none).count() == 0


# 5 transport streams


def test_transport_streams_round_trip() -> None:
    rng = random.Random(6)
    for n in [0, 1, 3, 160, 169, 170, 171, 183, 184, 185, 575, 576, 5759, 5760, 5761, 70_000]:
        data = rng.randbytes(n)
        ts = mpegts.mux(data)
        t = mpegts.demux(ts)
        s = t.streams[mpegts.DATA_PID]
        assert len(ts) % 188 == 0 and s.data == data and not s.continuity_errors and not t.lost_sync
        assert [u[0] for u in s.units] == [90_000 + 3_600 * k for k in range(len(s.units))]
        assert [u[4] for u in s.units] == [k % 4 == 0 for k in range(len(s.units))]
        assert sum(u[3] for u in s.units) == n


def test_transport_streams_with_faults() -> None:
    data = random.Random(7).randbytes(20_000)
    p = [mpegts.mux(data)[i : i + 188] for i in range(0, len(mpegts.mux(data)), 188)]
    repeated = mpegts.demux(b"".join([*p[:10], p[9], *p[10:]])).streams[256]
    assert repeated.data == data and repeated.repeated == 1 and repeated.continuity_errors == 0
    lost = mpegts.demux(b"".join([*p[:10], *p[11:]])).streams[256]
    assert lost.continuity_errors == 1
    damaged = mpegts.demux(b"".join([*p[:5], b"\x00" * 188, *p[6:], b"\x47\x00"]))
    assert damaged.lost_sync == 2
    assert mpegts.demux(b"").streams == {} and mpegts.demux(b"x" * 1000).streams == {}


def test_media_columns(odd: DataFrame, none: DataFrame) -> None:
    texts = [(t or "").encode() for _, t, _ in ODD]
    out = mpegts.media_columns(odd).collect()
    want = Counter((len(t), hashlib.sha256(mpegts.padded(t)).hexdigest(), zlib.crc32(mpegts.padded(t)[-32:])) for t in texts)
    assert Counter((r.n_bytes, r.payload_sha256, r.tail_crc32) for r in out) == want
    assert all(r.payload_bytes % 576 == 0 and r.payload_bytes > 0 for r in out)
    assert len({(r.media_sha256, r.feature) for r in out if r.doc_id in (1, 6)}) == 1
    assert mpegts.media_columns(none).count() == 0


# 6 toxicity


def test_viterbi_is_the_best_path() -> None:
    rng = np.random.default_rng(8)
    c = toxicity.Channel(np.log(rng.dirichlet(np.ones(28), (28, 28))))

    def cost(s: str) -> float:
        total, a, b = 0.0, 0, 0
        for x in s:
            k = 0 if x == " " else ord(x) - 96
            total -= c.table[a, b, k]
            a, b = (b, k) if k else (0, 0)
        return total - (c.table[a, b, 0] if b else 0.0)

    for text in ("1a", "a0b1", "x4$", "7o0"):
        options = [c._choices(x) for x in text]
        best = min(((sum(p for _, p in path) + cost("".join(x for x, _ in path)), "".join(x for x, _ in path)) for path in itertools.product(*options)))
        assert cost(c.restore(text)) + 0 <= best[0] + 1e-9 and c.restore(text) == best[1]


def test_toxicity_learns_words_and_sees_through_disguise(spark: SparkSession) -> None:
    rng = random.Random(9)
    plain = ["ranet", "solim", "terano", "lidor", "menta", "korus", "vandel", "pirow", "siton", "galem"]
    text = lambda: " ".join(rng.choice(plain) + rng.choice(plain) for _ in range(rng.randint(20, 60)))
    rows, labels = [], []
    for i in range(600):
        t, bad = text(), i % 6 == 0
        rows.append((i, t + (" you are a " + rng.choice(["blorgus", "snafted", "wexling"]) if bad else ""), "s"))
        labels.append((i, 1, int(bad)))
    model = toxicity.learn(docs(spark, rows), spark.createDataFrame(labels, LABELS))
    hidden = ["you b1orgus", "a s n a f t e d one", "w.e.x.l.i.n.g", "bloooorgus!", "SNAFTED", "bl0rgu$ it is"]
    clean = [text() for _ in range(20)] + ["", None, "x86 and the 2nd of may, 10:30"]
    assert model.score(pa.array(hidden)).min() > 0.5
    assert model.score(pa.array(clean)).max() < 0.5


def test_every_disguise_reaches_the_channel(spark: SparkSession) -> None:
    rng = random.Random(9)
    plain = ["ranet", "solim", "terano", "lidor", "menta", "korus", "vandel", "pirow", "siton", "galem"]
    text = lambda: " ".join(rng.choice(plain) + rng.choice(plain) for _ in range(rng.randint(20, 60)))
    rows, labels = [], []
    for i in range(600):
        t, bad = text(), i % 6 == 0
        rows.append((i, t + (" you are a " + rng.choice(["blorgus", "snafted", "wexling"]) if bad else ""), "s"))
        labels.append((i, 1, int(bad)))
    model = toxicity.learn(docs(spark, rows), spark.createDataFrame(labels, LABELS))
    disguises = ["blorrgus", "snaffTed", "bblloorrgguuss", "wwweeexxxlllliiinnnggg", "blo-rgus", "sna.fted", "blo.rg.us", "wex:ling", "you blorgu$", "b|orgus", "bl*rgus", "snäfted", "ѕnаftеd", "“snafted”", "blor\u200bgus", "日blorgus", "(w e x l i n g)", "w. e. x. l. i. n. g.", "w - e - x - l - i - n - g", "ｓｎａｆｔｅｄ"]
    scores = model.score(pa.array([f"ranet solim {x}, terano" for x in disguises]))
    assert [x for x, p in zip(disguises, scores, strict=True) if p <= 0.5] == []
    same = model.hits(pa.array(["snafted", "it-is (snafted)!", "snafted-snafted"]))  # as written: nothing to restore
    assert (same[0] == same[1]).all() and (same[2] == 2 * same[0]).all()


def test_spans_are_what_the_channel_may_change() -> None:
    def stretches(*texts: str) -> list[list[str]]:
        data, offsets = toxicity.T.utf8(pa.array(texts))
        found = zip(*toxicity.spans(toxicity.T.words(data, offsets, lower=False)), strict=True)
        out: list[list[str]] = [[] for _ in texts]
        for i, start, end in found:
            out[i].append(bytes(data[start:end]).decode())
        return out

    assert stretches("plain words, [of] 日本語 an i", "i", "", "stuppid, id.iot! u p s - x") == [[], [], [], ["stuppid", "id.iot!", "u p s - x"]]


def test_only_near_copies_teach_once() -> None:
    rng = np.random.default_rng(2)
    sketch = lambda agree, k: np.concatenate([first[:agree], rng.integers(0, 2**31, k - agree)])
    first = rng.integers(0, 2**31, 64)
    marks = np.array([first, *(sketch(40, 64) for _ in range(5)), sketch(51, 64), sketch(52, 64), first, first], np.int32)
    assert toxicity.unlike([0] * 9 + [1], marks).tolist() == [True] * 7 + [False, False, True]
    assert toxicity.unlike([], marks[:0]).tolist() == []


def test_rare_toxic_forms_are_weighed_beside_many_common_ones(spark: SparkSession) -> None:
    held = spark.range(60_000).selectExpr("id as h", "50L as toxic", "500L as other").unionAll(spark.sql("select -1L, 9L, 0L"))
    assert [r.h for r in toxicity.telling(held, 100, 1000).collect()] == [-1]
    r = toxicity.telling(held, 100, 1000).first()
    assert r.z == pytest.approx(float(toxicity.strength(np.array([9]), np.array([0]), 100, 1000)[0]))
    many = toxicity.pd.DataFrame({"h": range(300), "text": [f"w{i}" for i in range(300)], "toxic": 10, "other": 0})
    assert len(toxicity.cover(many, [np.array([i % 300]) for i in range(3000)], 50_000)) == 300


def test_toxicity_of_odd_rows(spark: SparkSession, odd: DataFrame, none: DataFrame) -> None:
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, None), (None, 1, 1), (4, None, 1), (7, 1, 1)], LABELS)
    out = toxicity.scored(odd, labels).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert toxicity.scored(none, labels).count() == 0
    assert toxicity.scored(odd, spark.createDataFrame([], LABELS)).count() == len(ODD)


def test_toxicity_held_out(spark: SparkSession) -> None:
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.scored(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").toPandas()
    bad, found = out.toxic == 1, out.predicted == 1
    assert (bad & found).sum() / bad.sum() >= 0.8 and (bad & found).sum() / found.sum() >= 0.9 and (found & ~bad).sum() / (~bad).sum() <= 0.01


# 7 lattice


def test_forward_sums_all_segmentations() -> None:
    model = lattice.Lattice.of([("▁a", -1.0), ("a", -2.0), ("b", -1.5), ("ab", -1.2), ("▁", -3.0), ("ba", -2.5)], dict.fromkeys(range(256), -8.0))
    p = dict(zip(["▁a", "a", "b", "ab", "▁", "ba"], model.log_p, strict=False))

    def total(w: str, i: int = 0) -> float:
        if i == len(w):
            return 1.0
        out = sum(np.exp(p[w[i : i + n]]) * total(w, i + n) for n in (1, 2) if w[i : i + n] in p and i + n <= len(w))
        if w[i] not in p:
            out += np.exp(sum(model.log_p[model.bytes_[b]] for b in w[i].encode())) * total(w, i + 1)
        return out

    ws = ["a", "ab", "abba", "aé", "babab", "x", "aaaaaaaaab", "日"]
    assert np.allclose(model.forward(ws), [np.log(total("▁" + w)) for w in ws])
    uses = model.expected(ws, np.ones(len(ws)))
    for k in np.flatnonzero(uses):  # the gradient of the log probability
        up, down = model.log_p.copy(), model.log_p.copy()
        up[k], down[k] = up[k] + 1e-5, down[k] - 1e-5
        assert (model.with_p(up).forward(ws).sum() - model.with_p(down).forward(ws).sum()) / 2e-5 == pytest.approx(uses[k], abs=1e-6)
    assert model.forward([]).shape == (0,) and np.isfinite(model.forward(["ab" * 5000]))[0]


def test_scores_and_base(spark: SparkSession, odd: DataFrame, none: DataFrame) -> None:
    for rows, df, chunk in ((ODD, odd, 1 << 20), ([(i, f"w{i % 7} w{i % 3} Same", "s") for i in range(200)], None, 500)):
        out = lattice.scored(df if df is not None else docs(spark, rows), rounds=1, chunk_bytes=chunk).collect()
        fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
        low = lambda t: ["".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in w) for w in words(t)] + [None]
        c = Counter(w for i, t, _ in rows if fold(i) != 1 for w in low(t))
        n, v = sum(c.values()), len(c)
        want = Counter((i, len(low(t)), sum(c[w] > 0 for w in low(t)), round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in low(t)), 4)) for i, t, _ in rows)
        assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in out) == want
        assert all(r.train_tokens == n and r.held_out == (fold(r.doc_id) == 1) and r.score < 0 for r in out)
    assert lattice.scored(none).count() == 0


def test_scores_are_counts_and_lattice_sums(spark: SparkSession) -> None:
    rows = [(i, f"w{i % 7} w{i % 3} Same w{i}x", "s") for i in range(200)]
    out = {r.doc_id: r.score for r in lattice.scored(docs(spark, rows, False), rounds=1).collect()}
    train = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w.lower() for i in train for w in words(rows[i][1]))
    n, once, twice = sum(c.values()) + len(train), sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    discount = once / (once + 2 * twice) if once and twice else 0.5
    model = lattice.Lattice.load()
    uses = model.expected(sorted(c, key=len), np.ones(len(c)))
    uses = np.round(uses * 65536) / 65536
    uses[:-1] += 0.1
    model = model.with_p(np.log(np.maximum(uses, 1e-300) / uses.sum()))
    every = sorted({w.lower() for _, t, _ in rows for w in words(t)}, key=len)
    spelt = dict(zip(every, np.exp(model.forward(every)), strict=True))
    p = {w: max(c[w] - discount, 0) / n + discount * (len(c) + 1) / n * spelt[w] for w in every}
    end = (len(train) - discount) / n
    for i, t, _ in rows:
        assert out[i] == pytest.approx(sum(np.log10(p[w.lower()]) for w in words(t)) + np.log10(end), rel=1e-6)


# 8 chosen path


def near(rows: list[tuple], k: int, percent: int) -> dict[int, int]:
    sets = defaultdict(list)
    for i, t, _ in rows:
        w = [x.lower() for x in words(t)]
        s = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        if i is not None:
            sets[i].append(s)
    root = {i: i for i in sets}

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {i: top(i) for i in sets}


@pytest.mark.parametrize(("small", "depth"), [(512, 4), (8, 2)])
def test_near_documents_match_brute_force(spark: SparkSession, small: int, depth: int) -> None:
    rng = random.Random(10)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyzw") + str(rng.randint(0, 30))
    rows: list[tuple] = []
    for g in range(12):
        base = [word() for _ in range(rng.randint(30, 90))]
        for _ in range(rng.choice([1, 2, 3, 40])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                t[rng.randrange(len(t))] = word()
            rows.append((len(rows) * 3 % 1009, " ".join(t), f"s{g}"))
    rows += [(2000, "Short one", "s"), (2001, "short  ONE", "s"), (2002, "short", "s"), (2003, None, "s"), (2004, "", "s"), (2004, "short one", "s")]
    got = chosenpath.near_duplicates(docs(spark, rows), small=small, depth=depth).collect()
    want = near(rows, 3, 85)
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((i, want[i] if words(t) else i) for i, t, _ in rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_rows_follow_the_size_of_a_group(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """Twice as many loosely similar copies make about twice the rows of every table, in large nodes too."""

    def rows(n: int) -> list[tuple]:
        rng = random.Random(15)
        base = [f"w{i}" for i in range(60)]
        return [(i, " ".join(w if rng.random() < 0.96 else f"x{rng.randrange(10**6)}" for w in base), "s") for i in range(n)]

    def made(n: int) -> Counter:
        out: Counter = Counter()

        def counted(df: DataFrame, name: str) -> DataFrame:
            table = saved(df, name)
            out[name] = max(out[name], table.count())
            return table

        monkeypatch.setattr(chosenpath, "saved", counted)
        got = chosenpath.near_duplicates(docs(spark, rows(n), False), small=64).collect()
        want = near(rows(n), 3, 85)
        assert all(r.component_id == want[r.doc_id] for r in got)
        return out

    saved = chosenpath.saved
    one, two = made(150), made(300)
    assert one["settled"] and all(two[k] <= 3 * max(one[k], 300) for k in two)


def test_forest_takes_the_most_similar_first() -> None:
    rng = np.random.default_rng(16)
    marks = rng.integers(0, 2, (64, 40), np.uint8)
    agree = (marks[:, :, None] == marks[:, None, :]).sum(0)
    component = np.arange(40)
    component[7] = component[3]
    agree[3, 7] = agree[7, 3] = 65
    got = chosenpath.spanning(marks, component, 36)
    pairs = sorted(((int(agree[i, j]), i, j) for i, j in itertools.combinations(range(40), 2) if agree[i, j] >= 36), reverse=True)
    root, total = list(range(40)), []
    for n, i, j in pairs:
        while root[i] != i:
            i = root[i]
        while root[j] != j:
            j = root[j]
        if i != j:
            root[i] = j
            total.append(n)
    assert sorted(agree[a, b] for a, b, _ in got) == sorted(total)
    runs = chosenpath._small_runs(np.ascontiguousarray(marks.T), np.array([0, 40]), component, 36, 64)
    assert sorted(agree[a, b] for a, b, _ in runs) == sorted(total)


def test_shared_sizes() -> None:
    rng = random.Random(14)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(0, 40))), np.uint64) for _ in range(30)]
    got = chosenpath.shared(sets, width=7)
    for i, j in itertools.combinations(range(30), 2):
        assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_near_odd(odd: DataFrame, none: DataFrame) -> None:
    out = chosenpath.near_duplicates(odd, k=5, percent=80).collect()
    assert len(out) == len(ODD) and {(r.doc_id, r.component_id) for r in out} == {(1, 1), (2, 2), (3, 3), (4, 4), (None, None), (5, 5), (6, 1), (7, 7)}
    assert chosenpath.near_duplicates(none).count() == 0


# 9 line dedup


def kept_lines(rows: list[tuple], min_docs: int = 3, min_chars: int = 20) -> dict[int, tuple[int, int, str]]:
    key = lambda line: "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                holders[key(line)].add(i)
    out = {}
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not (i is not None and len(holders[key(x)]) >= min_docs and i != max(holders[key(x)]))]
        out[i] = (len(lines), len(lines) - len(left), "\n".join(left))
    return out


LINES = ["This line is one that many documents share", "  this LINE is one that many documents share\t", "short", "äöüäöüäöüäöüäöüäöüä", "äöüäöüäöüäöüäöüäöüäö", "Another line that is quite long too", "", "   "]


def line_rows() -> list[tuple]:
    rng = random.Random(11)
    rows = [(i, "\n".join(rng.choice([*LINES, f"unique line number {i} {rng.random()}"]) for _ in range(rng.randint(1, 6))), "s") for i in range(60)]
    return [*rows, (100, None, "s"), (101, "", "s"), (None, LINES[0], "s")]


def test_line_dedup(spark: SparkSession, none: DataFrame) -> None:
    rows = line_rows()
    got = {r.doc_id: (r._n_lines, r._n_dropped, r.text) for r in cuckoo.line_dedup(docs(spark, rows)).collect()}
    assert got == kept_lines(rows)
    assert all(r._sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in cuckoo.line_dedup(docs(spark, rows)).collect())
    assert cuckoo.line_dedup(none).count() == 0


def test_line_index_is_reversible(spark: SparkSession) -> None:
    rows = line_rows()
    a, b = docs(spark, rows[:30]), docs(spark, rows[30:])
    index = cuckoo.LineIndex(spark, per_shard=2).insert(a)
    before = sorted(map(tuple, index.common.collect()))
    index.insert(b)
    assert sorted(map(tuple, index.lost().collect())) == sorted(map(tuple, cuckoo.LineIndex(spark).insert(docs(spark, rows)).lost().collect()))
    index.delete(b.where("doc_id is not null"))
    assert sorted(map(tuple, index.common.collect())) == before
    got = {r.doc_id: (r._n_lines, r._n_dropped, r.text) for r in index.apply(a).collect()}
    assert got == kept_lines(rows[:30])
    keys = np.array([r.k1 for r in index.common.collect()])
    filters = [cuckoo.CuckooFilter.from_bytes(r["filter"]) for r in index.filters.collect()]
    assert all(any(f.contains(np.array([k]))[0] for f in filters) for k in keys)


def test_line_index_grows_its_filters(spark: SparkSession) -> None:
    line = lambda i: f"line number {i} that is long enough to count"
    batch = lambda a, b, first: docs(spark, [(first + j, "\n".join(line(i) for i in range(a, b)), "s") for j in range(3)], False)
    index = cuckoo.LineIndex(spark, per_shard=65_536).insert(batch(0, 10, 0))
    steps = [batch(10, 400, 10), batch(400, 1500, 20)]
    before = sorted(map(tuple, index.common.collect()))
    for b in steps:
        index.insert(b)
        f = [cuckoo.CuckooFilter.from_bytes(r["filter"]) for r in index.filters.collect()]
        assert sum(len(x.stash) for x in f) < 5 and all(x.held <= 0.95 * x.table.size for x in f)
        keys = np.array([r.k1 for r in index.common.collect()])
        assert all(any(x.contains(np.array([k]))[0] for x in f) for k in keys[::50])
    whole = cuckoo.LineIndex(spark).insert(steps[0].unionByName(steps[1]).unionByName(batch(0, 10, 0)))
    assert sorted(map(tuple, index.common.collect())) == sorted(map(tuple, whole.common.collect()))
    for b in reversed(steps):
        index.delete(b)
    assert sorted(map(tuple, index.common.collect())) == before
    index.close()


def test_cuckoo_filter() -> None:
    rng = np.random.default_rng(12)
    keys, others = rng.integers(-(2**62), 2**62, 5000), rng.integers(-(2**62), 2**62, 20_000)
    f = cuckoo.CuckooFilter(len(keys))
    f.insert(keys)
    assert f.contains(keys).all() and f.contains(others).mean() < 0.002
    f = cuckoo.CuckooFilter.from_bytes(f.to_bytes())
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01
    full = cuckoo.CuckooFilter(1)
    full.insert(np.arange(100))
    assert full.stash and full.contains(np.arange(100)).all()


# 10 packing


def best_fit(lengths: list[int], capacities: tuple[int, ...], overhead: int) -> tuple[list[int], list[int]]:
    """Bins and final sizes, bin by bin."""
    rooms, used, bins, since = [], [], [], []  # of bins with equal room, the one that came to it last
    left = sum(lengths)
    for now, n in enumerate(lengths):
        left -= n
        fits = [(r, b) for b, r in enumerate(rooms) if r >= n]
        if fits:
            least = min(r for r, _ in fits)
            b = max((since[b], b) for r, b in fits if r == least)[1]
        else:
            b = len(rooms)
            rooms.append(min((c for c in sorted(capacities) if c >= n), key=lambda c: ((c + overhead) / (n + min(c - n, left)), c)))
            used.append(0)
            since.append(0)
        since[b] = now
        rooms[b] -= n
        used[b] += n
        bins.append(b)
    return bins, [min(c for c in capacities if c >= u) for u in used]


def test_packing_is_best_fit() -> None:
    rng = random.Random(13)
    for _ in range(30):
        lengths = sorted((rng.randint(1, 64) for _ in range(rng.randint(0, 120))), reverse=True)
        bins, offsets, sizes = packing.pack(lengths, (16, 32, 64), 3)
        want, want_sizes = best_fit(lengths, (16, 32, 64), 3)
        full = lambda b: sorted((Counter(b).values()))
        assert full(bins) == full(want) and sorted(sizes.values()) == sorted(want_sizes)
        used = defaultdict(int)
        for n, b, o in zip(lengths, bins, offsets, strict=True):
            assert used[b] == o
            used[b] += n
        assert all(used[b] <= sizes[b] and all(c < used[b] for c in (16, 32, 64) if c < sizes[b]) for b in used)


def test_looking_ahead_costs_no_more() -> None:
    rng = random.Random(17)
    draws = [lambda: rng.randint(600, 700), lambda: rng.randint(5, 300), lambda: rng.randint(1, 4096), lambda: rng.choice([rng.randint(20, 60), rng.randint(1500, 2100)]), lambda: min(4096, max(1, int(rng.lognormvariate(5, 1.2))))]
    for draw in draws:
        lengths = sorted((draw() for _ in range(2000)), reverse=True)
        one, joint = packing.pack(lengths)[2].values(), packing.pack_jointly(lengths)[2].values()
        assert sum(joint) + 64 * len(joint) <= sum(one) + 64 * len(one) and sum(joint) <= sum(one)


def test_packing_is_near_the_best() -> None:
    rng = random.Random(18)

    def best(lengths: list[int], sizes: tuple[int, ...], overhead: int) -> int:
        """The least cost over all ways to deal the pieces into bins."""
        def go(i: int, bins: list[int]) -> int:
            if i == len(lengths):
                return sum(next(c for c in sizes if c >= b) + overhead for b in bins)
            out = go(i + 1, [*bins, lengths[i]])
            for k in range(len(bins)):
                if bins[k] + lengths[i] <= sizes[-1]:
                    out = min(out, go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]]))
            return out
        return go(0, [])

    total = least = 0
    for _ in range(40):
        lengths = sorted((rng.randint(1, 32) for _ in range(7)), reverse=True)
        sizes = packing.pack_jointly(lengths, (8, 16, 32), 2)[2].values()
        cost, bound = sum(sizes) + 2 * len(sizes), best(lengths, (8, 16, 32), 2)
        assert bound <= cost <= 1.4 * bound
        total, least = total + cost, least + bound
    assert total <= 1.06 * least


def test_repeated_rows_are_dealt_out(spark: SparkSession) -> None:
    same = spark.range(4000).selectExpr("cast(null as bigint) as doc_id", "'a b c' as text")
    shards = Counter(r.bin_id >> 32 for r in packing.packed(same, per_shard=500).collect())
    assert len(shards) == 8 and max(shards.values()) < 700


def test_packed_pieces_cover_documents(odd: DataFrame, none: DataFrame) -> None:
    out = packing.packed(odd, capacities=(64, 256), per_shard=20).collect()
    per = defaultdict(list)
    for r in out:
        per[r.doc_id].append((r.start, r.length))
    for i in {i for i, _, _ in ODD}:
        sizes = [len(words(t)) + 1 for j, t, _ in ODD if j == i]
        assert sum(n for _, n in per[i]) == sum(sizes)
    bins = defaultdict(list)
    for r in out:
        bins[r.bin_id].append((r.bin_offset, r.length, r.bin_capacity, r.bin_used))
    for b in bins.values():
        b.sort()
        assert all(x[0] + x[1] == y[0] for x, y in itertools.pairwise(b)) and b[-1][0] + b[-1][1] == b[0][3] <= b[0][2]
    assert packing.packed(none).count() == 0
