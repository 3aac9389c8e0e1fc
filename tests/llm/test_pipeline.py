from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import SparkSession

import __spark_entry__
import corpus_pipeline
from tidepanel.llm.queries import ORACLE_SQL, QUERIES

from tests.llm.test_ops import fill, kept_lines, near, words

LABELS = "doc_id long, quality int, toxic int"


def test_registered() -> None:
    names = __spark_entry__.queries()
    assert "pipeline" in names and [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in names)] == []
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_stages_keep_columns_and_take_effect(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    good = [f"The {a} of {b} went on its way through {c} and came to rest near {d}." for a, b, c, d in itertools.product(["fox", "crow", "hare"], ["north", "south"], ["woods", "hills"], ["lakes", "towns"])]
    shared = "This very long line is found in many of the documents here"
    rows = [(i, f"{g}\n{shared}\n{g[::-1]}", "en", f"src{i % 3}", 0) for i, g in enumerate(good)]
    rows += [(100 + i, " ".join(f"{w}$$$%%%" for w in g.split()), "en", "src0", 0) for i, g in enumerate(good)]
    rows += [(200, rows[0][1].replace(shared, ""), "en", "src1", 0), (201, None, "en", None, 0), (202, "", None, "src2", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, *_ in rows[:-2]], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append({r.doc_id for r in now.select("doc_id").collect()})
        if name == "line_dedup":
            assert sum(shared in (r.text or "") for r in now.collect()) == 1
            assert all(r.n_chars == len(r.text) for r in now.collect())
    quality, lines, near, mixed, packed = ids
    assert not any(100 <= i < 124 for i in quality) and set(range(24)) <= quality
    assert lines == quality and 0 in near and 200 not in near and mixed <= near and packed == mixed
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_each_stage_matches_brute_force(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    rng = random.Random(21)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyzw") + str(rng.randint(0, 30))
    shared = [f"this passage number {i} is one that many documents hold" for i in range(4)]
    texts: list[str | None] = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(30, 120))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                t[rng.randrange(len(t))] = word()
            lines = [" ".join(t), *rng.sample(shared, rng.randint(0, 2))]
            texts.append("\n".join(rng.sample(lines, len(lines))))
    texts += ["", None, "two words", "one " * 5000]
    rows = [(i, t, "en", rng.choice(["a", "b", "c", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents")
    now, given, left = spark.read.parquet(f"{tmp_path}/documents"), {}, {}
    for name, stage in corpus_pipeline.STAGES[1:]:
        given[name] = [tuple(r) for r in now.select("doc_id", "text", "source").collect()]
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = now.collect()
    assert {r.doc_id: r.text for r in left["line_dedup"]} == {i: t for i, (_, _, t) in kept_lines(given["line_dedup"]).items()}
    group = near(given["near_dedup"], 5, 80)
    assert sorted(r.doc_id for r in left["near_dedup"]) == sorted(i for i, least in group.items() if i == least)
    before, taken, sizes = {i: (words(t), s) for i, t, s in given["mixing"]}, Counter(), Counter()
    for got, s in before.values():
        sizes[s] += len(got)
    times = Counter()
    for r in left["mixing"]:
        whole, source = before[r.doc_id]
        assert words(r.text) == whole and r.source == source
        taken[source] += len(words(r.text))
        times[r.doc_id] += 1
    most = {s: max(len(got) for got, t in before.values() if t == s) for s in sizes}
    assert max(times.values()) <= 3 and all(abs(taken[s] - x) <= 0.5 + most[s] / 2 for s, x in fill(sizes).items())
    pieces, bins = Counter(), defaultdict(list)
    for r in left["packing"]:
        pieces[r.doc_id] += r.length
        bins[r.bin_id, r.bin_capacity, r.bin_used].append((r.bin_offset, r.length))
    want = Counter()
    for i, t, _ in given["packing"]:
        want[i] += len(words(t)) + 1
    assert pieces == want
    for (_, capacity, used), held in bins.items():
        ends = list(itertools.accumulate(n for _, n in sorted(held)))
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] == used <= capacity and capacity in (1024, 2048, 4096)


def test_empty_tables(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nothing_else_imports_the_folder() -> None:
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent / "tidepanel"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"tidepanel\.llm|corpus_pipeline", p.read_text())
