"""Chat formatting, periodic runs and token alignment, held against brute force."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import align, chat, lattice, periodic
from tidepanel.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    return df.selectExpr("*", *(f"'{c}' as `{c}`" for c in ("h", "n", "a", "b", "p", "words", "runs", "start", "length", "chunk", "code", "count", "groups", "collapsed")))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- chat formatting


def turns(*pairs: tuple[str, str]) -> list[tuple[str, str]]:
    return list(pairs)


RECORDS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"content": "ho", "role": "tool"}]}, "messages", turns(("user", "hi"), ("tool", "ho"))),
    ({"id": 7, "messages": []}, "messages", []),
    ({"messages": [{"role": None, "content": None}]}, "messages", turns(("", ""))),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "x", "value": 5}]}, "conversations", turns(("user", "a"), ("assistant", "b"), ("x", "5"))),
    ({"system": "s", "conversations": [{"from": "gpt", "value": ""}]}, "conversations", turns(("system", "s"), ("assistant", ""))),
    ({"system": None, "prompt": "p", "response": "r"}, "response", turns(("user", "p"), ("assistant", "r"))),
    ({"prompt": "p", "completion": None, "id": "q"}, "completion", turns(("user", "p"), ("assistant", ""))),
    ({"instruction": "i", "input": "j", "output": "o"}, "instruction", turns(("user", "i\n\nj"), ("assistant", "o"))),
    ({"instruction": "i", "output": "o"}, "instruction", turns(("user", "i"), ("assistant", "o"))),
    ({"data": {"question": "q", "answer": {"text": "a"}}}, "question", turns(("user", "q"), ("assistant", "a"))),
    ({"prompt": {"text": "nested"}, "completion": "c"}, None, None),
    ({"a b": 1, "c`d": [[2]]}, None, None),
    ([1, 2], None, None),
]


def test_layouts_become_turns(spark: SparkSession) -> None:
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(100, None), (101, "no json"), (102, "")]
    df = spark.createDataFrame(rows, "i int, record string").selectExpr("*", "'x' as turns", "'y' as _value", "'z' as layout")
    got = {r["i"]: r for r in chat.canonical(df, "record").collect()}
    for i, (_, layout, want) in enumerate(RECORDS):
        assert got[i]["layout"] == layout
        assert (got[i]["turns"] and [tuple(t) for t in got[i]["turns"]]) == want or (want == [] and got[i]["turns"] == [])
    assert all(got[i]["turns"] is None and got[i]["fingerprint"] is None for i in (100, 101, 102))
    left = {r["shape"]: r["n_records"] for r in chat.unmapped(df, "record").collect()}
    assert left == {None: 3, "OBJECT<completion: , prompt: OBJECT<text: >>": 1, "OBJECT<`a b`: , `c``d`: ARRAY<ARRAY<>>>": 1, "ARRAY<>": 1}
    assert chat.canonical(df.limit(0), "record").count() == 0


def test_fingerprints_don_t_hang_on_order_or_types(spark: SparkSession) -> None:
    texts = ['{"prompt":"a","completion":"b"}', '{"completion":1.5,"prompt":null}', '{"prompt":true,"completion":"b","x":1}']
    got = [r[0] for r in chat.canonical(spark.createDataFrame([(t,) for t in texts], "r string"), "r").select("fingerprint").collect()]
    assert got[0] == got[1] != got[2]


def test_one_layout_has_one_mapping() -> None:
    with pytest.raises(ValueError):
        chat.canonical(_Frame(), "r", (*chat.MAPPINGS, chat.Mapping("again", (chat.Say("user", ("prompt",)), chat.Say("assistant", ("completion",))))))


class _Frame:
    columns: list[str] = []


def test_templates_are_read_back(spark: SparkSession) -> None:
    rng = random.Random(5)
    parts = ["<|im_start|>", "<|im_end|>", "\n", "<", "|", "\\", "<\\|", "<\\\\|", "im_end|>", "assistant", "é", "日本", " ", "\\n", "user\n", ""]
    some = lambda k: "".join(rng.choice(parts) for _ in range(rng.randrange(k)))
    made = [[(rng.choice(["user", "assistant", "system", some(6)]), some(12)) for _ in range(rng.randrange(6))] for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made)], f"i int, turns {chat.TURNS}").selectExpr("*", "'x' as formatted", "1 as _read", "2 as _pieces")
    out = chat.read_back(chat.formatted(df)).collect()
    for r in out:
        want = made[r["i"]]
        assert [tuple(t) for t in r["read_turns"]] == want
        assert r["read_loss"] == "".join(t for role, t in want if role == "assistant")
        assert r["formatted"].count(chat.START) == r["formatted"].count(chat.END) == len(want)
        for piece, (start, length), (role, _) in zip(r["formatted"].split(chat.START)[1:], r["loss"], want, strict=True):
            assert (length == 0) <= (role != "assistant" or piece.split("\n", 1)[1] == f"{chat.END}\n")
            assert role != "assistant" or piece[start : start + length] == piece.split("\n", 1)[1][: -len(chat.END) - 1]


CONVERSATIONS = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "system", "s"), (2, 1, "user", None), (2, 2, "assistant", "<|x|> \\ <\\|"), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", ""), (3, 3, "user", "v"), (4, 0, "tool\nx", "t"), (5, 1, None, "y"), (5, 1, "assistant", "y"), (5, 1, "assistant", "y"), (5, None, "assistant", "last"), (None, 0, "user", "no id"), (None, 0, "assistant", "n\\n"), (6, 0, "system", "s"), (7, 0, "system", "s"), (7, 1, "tool", "s"), (8, 0, "human", "as it is"), (8, 1, "assistant", "日本" * 2000)]


@pytest.mark.parametrize("rows", [CONVERSATIONS, []])
def test_conversations_match_their_sql(spark: SparkSession, tmp_path: Path, rows: list[tuple]) -> None:
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'r' as record", "'t' as turns", "'l' as layout")
    df.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["op11_chat"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = duck.sql(ORACLE_SQL["op11_chat"])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r) for r in got.select(*names).collect()], key=key) == sorted(duck.sql(f"select {','.join(names)} from want").fetchall(), key=key)
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().executedPlan().toString())


# --- periodic runs


def runs(w: list[str]) -> list[tuple[int, int, int]]:
    """All maximal runs of at least 24 words and three smallest periods, word by word."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // 3 + 1):
        i = q
        while i < len(w):
            start = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(24, 3 * q):
                found.setdefault((start - q, length), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in found.items())


def plant(doc_id: int | None, w: list[str]) -> list[str]:
    h, n = zlib.crc32((str(doc_id) if doc_id is not None else "").encode()), len(w)
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def periodic_row(doc_id: int | None, text: str | None) -> tuple:
    w = plant(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *figures, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept))


def periodic_texts() -> list[tuple]:
    rng = random.Random(11)
    rows: list[tuple] = [(None, "no id of mine"), (None, None), (3, None), (4, ""), (5, " \n\t"), (6, "a " * 40), (6, "a " * 40), (7, "x" * 20_000), (8, "a b " * 11 + "a"), (9, "a b " * 12), (11, "é\xa0x " * 30), (12, "A a " * 30)]
    for i in range(20, 260):
        alphabet, w = [f"w{x}" for x in range(rng.choice([1, 2, 3, 8, 60]))], []
        while len(w) < rng.choice([1, 30, 200, 500]):
            root = [rng.choice(alphabet) for _ in range(rng.randrange(1, 30))]
            if rng.random() < 0.3:
                root = root * 3 + [rng.choice(alphabet)]
            w += (root * 6)[: rng.randrange(1, 5 * len(root) + 1)]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    return rows


def test_periodic_query_matches_brute_force(spark: SparkSession, tmp_path: Path) -> None:
    rows = periodic_texts()
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op12_periodic"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0, r[7])
    want = sorted((periodic_row(*r) for r in rows), key=key)
    assert sorted((tuple(r) for r in got.collect()), key=key) == want
    assert sum(r[1] for r in want) > 200


def test_periodic_time_grows_little_faster_than_the_text() -> None:
    """A word said over and over has a match on every diagonal; blocks keep it to n for each power of two."""
    import time

    took = []
    for n in (50_000, 400_000):
        began = time.perf_counter()
        of, start, size, period = periodic.find(np.zeros(n, np.int64), np.zeros(n, np.uint64))
        took.append(time.perf_counter() - began)
        assert (of.tolist(), start.tolist(), size.tolist(), period.tolist()) == ([0], [0], [n], [1])
    assert took[1] < 25 * took[0] + 1


def test_periodic_empty_table_and_limits(spark: SparkSession) -> None:
    assert periodic.digests(periodic.with_runs(docs(spark, []))).count() == 0
    row = periodic.with_runs(docs(spark, [(1, "a b " * 12 + "c")])).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 24, 2)] and row["collapsed"] == "a b c"
    assert periodic.with_runs(docs(spark, [(1, "a b " * 4)]), least=8, times=4).first()["collapsed"] == "a b"
    with pytest.raises(ValueError):
        periodic.find(np.zeros(3, np.int64), np.zeros(3, np.uint64), times=2)


# --- token alignment


@pytest.fixture(scope="module")
def codecs() -> tuple[align.Codec, align.Codec]:
    return align.codec(align.ByteLevel, Path(align.BYTE_BPE).read_bytes()), align.codec(align.Pieces, Path(align.PIECE_BPE).read_bytes())


def entry_bytes(c: align.Codec, i: int) -> bytes:
    return c.data[c.offsets[i] : c.offsets[i + 1]].tobytes()


def whole(codecs: tuple[align.Codec, align.Codec], text: str | None) -> tuple[list[int], list[int]]:
    """Ids of the whole text at once."""
    if not text:
        return [], []
    a, b = codecs[0].tokenizer.encode(" " + text, add_special_tokens=False).ids, codecs[1].tokenizer.encode(text)
    raw = (" " + text).encode()
    return (a, b) if all(b"".join(entry_bytes(c, i) for i in x) == raw for c, x in zip(codecs, (a, b), strict=True)) else ([], [])


def align_texts() -> list[tuple]:
    rng = random.Random(3)
    parts = ["a", "b", "the ", "  ", " ", "\n", "é", "ü ", "日本 ", "\xa0 ", "　", "  ", "'s", "'ll ", "12 ", "3.", "<|endoftext|> ", " <s> ", "\x1c ", "🙂 ", "\r\n", "word ", "Internationalization ", "_", "-", "\x00", " ▁x"]
    rows: list[tuple] = [(None, "no id"), (None, None), (2, ""), (3, " "), (4, "  "), (5, "a "), (6, " a"), (7, "the same"), (7, "the same"), (8, "x" * 3000), (9, "▁"), (10, "a  b   c")]
    return rows + [(i, "".join(rng.choices(parts, [8] * 25 + [1, 1], k=rng.randrange(60)))) for i in range(20, 320)]


def test_segments_give_the_ids_of_whole_texts(codecs: tuple[align.Codec, align.Codec]) -> None:
    assert not codecs[0].crossing() and not codecs[1].crossing()
    texts = [t for _, t in align_texts()]
    ids_a, n_a, ids_b, n_b = align.encode(*codecs, pa.array(texts))
    at_a, at_b, some = np.cumsum(n_a), np.cumsum(n_b), 0
    for t, i, j, k, m in zip(texts, at_a, n_a, at_b, n_b, strict=True):
        want = whole(codecs, t)
        some += bool(want[0])
        assert (ids_a[i - j : i].tolist(), ids_b[k - m : k].tolist()) == want
    assert some > 100


def test_alignment_query_matches_brute_force(spark: SparkSession, tmp_path: Path, codecs: tuple[align.Codec, align.Codec]) -> None:
    rows = align_texts()
    docs(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op13_alignment"](spark, str(tmp_path))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.columns == names
    linked, texts, held = [], [], Counter()
    for _, t in rows:
        a, b = whole(codecs, t)
        spans = []
        for c, x in zip(codecs, (a, b), strict=True):
            ends = np.cumsum([len(entry_bytes(c, i)) for i in x]).tolist()
            spans.append(list(zip([0, *ends], ends)))
        links = [(i, j) for i, (s, e) in zip(a, spans[0], strict=True) for j, (u, v) in zip(b, spans[1], strict=True) if s < v and u < e]
        held.update(set(links))
        linked.append(links)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        parts, before = [], 0
        for cut in cuts:
            parts.append("|".join(",".join(str(i) for i, (s, _) in zip(x, y, strict=True) if before <= s < cut) for x, y in zip((a, b), spans, strict=True)))
            before = cut
        texts.append((len(a), len(b), len(parts), ";".join(parts)))
    best: dict[int, int] = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    want = [(i, na, nb, ng, len(x), sum(held[y] == best[y[0]] for y in x), sum(held[y] for y in x), sha(text) if text else "") for (i, _), x, (na, nb, ng, text) in zip(rows, linked, texts, strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, r[7])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_small_chunks_and_empty_tables_align(spark: SparkSession) -> None:
    df = docs(spark, align_texts())
    one, many = align.alignments(df), align.alignments(df, chunk_bytes=300)
    assert one.exceptAll(many).count() == many.exceptAll(one).count() == 0
    assert align.digests(align.alignments(df.limit(0))).count() == 0
    assert align.alignments(df.where(F.col("doc_id") == 2)).first()["groups"] == ""


def test_groups_of_a_long_chain() -> None:
    """Tokens of two bytes against tokens of two bytes one byte later: no common end but the last."""
    n = 1000
    end_a, end_b = np.arange(2, 2 * n + 1, 2), np.append(np.arange(1, 2 * n, 2), 2 * n)
    of_a, of_b, last = align.groups(end_a, end_b)
    assert set(of_a) == set(of_b) == {0} and last.tolist() == [n]


def test_long_words_go_in_stretches_with_the_same_sums(monkeypatch: pytest.MonkeyPatch) -> None:
    model = lattice.Lattice.load()
    rng = random.Random(4)
    words = ["".join(rng.choice(("the", "ing", "x", "é", "9", "ω", "\U0001f600", "ab")) for _ in range(n)) for n in (1, 3, 40, 90, 200)]
    words += ["a", "", "b" * 70]
    want, uses = model.forward(words), model.expected(words, np.arange(1.0, 9.0))
    for stretch in (1, 7, 64, 65536):
        monkeypatch.setattr(lattice, "LONG", 2)
        monkeypatch.setattr(lattice, "STRETCH", stretch)
        assert np.allclose(model.forward(words), want, rtol=1e-12)
        assert np.allclose(model.expected(words, np.arange(1.0, 9.0)), uses, rtol=1e-9, atol=1e-12)


def test_a_very_long_word_takes_bounded_tables() -> None:
    model, seen = lattice.Lattice.load(), []
    plain = model._tables
    model._tables = lambda marked: seen.append(sum(map(len, marked))) or plain(marked)
    long = "QWxhZGRpbjpvcGVuIHNlc2FtZQ" * 6000
    p = model.forward(["a", long, "b"])
    assert np.isfinite(p).all() and p[1] < -100_000 and max(seen) <= lattice.STRETCH + model.longest
    assert model.forward([long[: len(long) // 2]])[0] == pytest.approx(p[1] / 2, rel=1e-3)
