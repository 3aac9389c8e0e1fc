"""The tag scanner, packing under any partitioning, bounded training rows, and buckets that follow the table's size."""

from __future__ import annotations

import html.parser
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import htmlcut, labels, packing, vectors
from tidepanel.llm.queries import QUERIES


class Plain(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.texts.append(data)


class Apart(Plain):
    """With a blank where an element other than one within a line begins or ends."""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.texts.append("" if tag in htmlcut.INLINE else " ")

    def handle_endtag(self, tag: str) -> None:
        self.handle_starttag(tag, [])


def test_tags_end_where_a_parser_ends_them() -> None:
    rng = random.Random(1)
    parts = ["<p", "<b ", "<a href=", "</p>", "</b", "<div class=", '"', "'", "x", "word ", ">", "/>", "=", " ", " title=", "'q'", '"r s"', "\n", "a>b", "<i>", "</", "<!-- c -->", "<3 ", "1 < 2 ", "&amp;", "</3>", "<br>"]
    compared = unlike = 0
    for _ in range(5000):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) + rng.choice([" >zz", "\">zz", "'>zz"])
        parser = Plain()
        parser.feed(page)
        parser.close()
        want, got = (re.sub(r"\s", "", "".join(x)) for x in (parser.texts, [b.text for b in htmlcut.blocks(page)[0]]))
        assert not re.search(r"<[a-zA-Z]", got)
        if not re.search(r"<[a-zA-Z]", want):  # the parser gives up on a tag whose quote nothing closes, and calls it text
            compared += 1
            unlike += got != want  # the parser ends end tags at any ">", and takes no value after a blank before "="
    assert compared > 4000 and unlike < 0.01 * compared


def test_stray_quotes_and_frames_keep_the_text() -> None:
    long = "A paragraph of the article that is long enough to count. It has two sentences."
    assert htmlcut.main_text(f'<p title="5" tall">First. {long}</p><p>Second. {long}</p>') == f"First. {long} Second. {long}"
    assert htmlcut.main_text(f"<article><p>See <a href=x'>this</a>. {long}</p></article>") == f"See this. {long}"
    assert htmlcut.main_text(f'<div class="page-header-layout"><div class="content"><h1>Title</h1><p>{long}</p><p>{long}</p></div></div>') == f"Title {long} {long}"
    assert htmlcut.main_text(f'<div id="header"><h1>Title</h1><p>{long}</p><p>{long}</p></div>') == f"Title {long} {long}"
    inside = "".join(f'<div class="{c}"><p>{c}: {long}</p></div>' for c in ("alert", "story-share", "tags-and-more"))
    assert htmlcut.main_text(f"<article><p>{long}</p>{inside}</article>").count(long) == 4
    away = "".join(f'<div class="{c}"><p>{long}</p></div>' for c in ("site-header", "main-nav", "cookie-consent", "comment-list"))
    assert htmlcut.main_text(f"{away}<main><p>{long}</p></main>") == long
    assert htmlcut.main_text(f"<div><p>{long} One.</p></div><main><h1>T</h1><p>{long}</p></main><div><p>Short words.</p></div>") == f"T {long}"


@pytest.mark.parametrize("make", [lambda n: "<b " * (n // 3) + "'", lambda n: "<p>x</p>" + "<a b='" * (n // 6), lambda n: '<a b="' * (n // 6) + "x>y", lambda n: "<a " + "b = " * (n // 4) + ">", lambda n: "<x a" + " =" * (n // 2), lambda n: "<div class='" + "a-" * (n // 2) + "'>x"])
def test_scanning_takes_time_in_proportion(make) -> None:  # noqa: ANN001
    def took(n: int) -> float:
        began = time.process_time()
        htmlcut.blocks(make(n))
        return time.process_time() - began

    took(1000)
    assert took(400_000) < 10 * max(took(100_000), 0.02)


def test_html_query_is_the_extractor_on_every_page(spark: SparkSession, sf: str) -> None:
    pages = {(r.page_id, r.url): r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op3_html"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        page = pages[r.page_id, r.url] or ""
        inside = re.search(r"<article>(.*?)</article>", page, re.S)
        plain = Apart()
        plain.feed(re.sub(r"<(script|style|aside|form)\b.*?</\1>|<!--.*?-->", " ", inside[1], flags=re.S) if inside else "")
        assert r.n_chars == len(r.text)
        assert Counter(r.text.split()) - Counter("".join(plain.texts).split()) == Counter()  # nothing but the article's words


# --- packing


def lengths(spark: SparkSession, parts: int) -> DataFrame:
    rng = random.Random(9)
    rows = [(i if i % 11 else None, "w " * rng.choice([0, 3, 40, 500, rng.randrange(9000)])) for i in range(300)] + [(7, "a b")] * 40 + [(8, None), (8, "")]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def test_packing_hangs_on_no_partitioning(spark: SparkSession) -> None:
    plain = [sorted(map(tuple, packing.packed(lengths(spark, n), per_shard=50).collect()), key=repr) for n in (3, 5, 200)]
    assert plain[0] == plain[1] == plain[2]


def test_packed_query_matches_its_parts(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    """Pieces cover each document, and each shard is what the packing of its pieces in order gives."""
    df = lengths(spark, 4)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op10_packing"](spark, str(tmp_path)).collect()
    want: Counter = Counter()
    for r in df.collect():
        n = len((r.text or "").split()) + 1
        for start in range(0, n, 4096):
            want[r.doc_id, start // 4096, start, min(4096, n - start)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in got) == want
    shards = defaultdict(list)
    for r in got:
        shards[r.bin_id >> 32].append(r)
    for rows in shards.values():
        pieces = sorted((r.length for r in rows), reverse=True)
        bins, _, sizes = packing.pack_jointly(pieces)
        held: dict[int, int] = defaultdict(int)
        for b, n in zip(bins, pieces, strict=True):
            held[b] += n
        assert Counter((sizes[b], n) for b, n in held.items()) == Counter({(r.bin_id, r.bin_capacity, r.bin_used) for r in rows} and [(c, u) for _, c, u in {(r.bin_id, r.bin_capacity, r.bin_used) for r in rows}])


def test_costs_make_sizes_compete() -> None:
    pieces = sorted((random.Random(2).randrange(100, 900) for _ in range(400)), reverse=True)
    even, steep = packing.pack_jointly(pieces)[2], packing.pack_jointly(pieces, costs=(1024.0, 2600.0, 9000.0))[2]
    assert Counter(steep.values())[1024] > Counter(even.values())[1024] and 4096 not in steep.values()
    with pytest.raises(ValueError):
        packing.pack([1], costs=(3.0, 2.0, 1.0))


# --- training rows


def test_training_rows_are_bounded(spark: SparkSession) -> None:
    ids = [i for i in range(1, 400)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids] + [(7, f"again {i}") for i in range(5000)] + [(7, None)], "doc_id long, text string").repartition(6)
    known = spark.createDataFrame([(i, i % 2) for i in ids] + [(7, 1), (None, 1)], "doc_id long, quality int")
    for most in (10, 1000):
        rows = labels.labelled(docs, known, "quality", most).collect()
        assert len(rows) <= most and len({r.doc_id for r in rows}) == len(rows)
    assert {r.doc_id: r.text for r in rows}.get(7, "again").startswith(("again", "text"))
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, labels.labelled(docs.repartition(2), known, "quality", 1000).collect()))


# --- vectors


def test_bits_follow_the_number_of_vectors() -> None:
    assert vectors.sized(2000, 0.9, 512) == (10, 24)
    work = []
    for n in (10**6, 4 * 10**6, 10**9, 4 * 10**9):
        bits, tables = vectors.sized(n, 0.9, 512)
        assert n / 2**bits <= 128 and 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** tables > 0.996
        work.append(tables * n * n / 2**bits)
    assert work[1] / work[0] < 5.7 and work[3] / work[2] < 5.7 and work[2] / work[0] < 7000  # pairs compared: not a million times as many


def test_compared_pairs_grow_with_the_table(spark: SparkSession) -> None:
    rng = np.random.default_rng(3)
    pairs = []
    for n in (1000, 4000):
        bits, tables = vectors.sized(n, 0.9, 16, least=4)
        rows = spark.createDataFrame([(i, 1, x.tobytes()) for i, x in enumerate(rng.standard_normal((n, 64)))], "id long, copies long, vector binary")
        met = vectors.bucketed(rows, tables, bits, 0).groupBy("place", "code").count()
        pairs.append(met.agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0])
    assert pairs[1] < 6.5 * pairs[0]  # 16 times, were the bits fixed
