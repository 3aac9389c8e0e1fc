from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidepanel.llm import textvec as T
from tidepanel.llm.components import forest, stretches

TEXTS = ["The cat  sat\ton the\nmat", None, "", "   ", "one", "two Words", "é É \x0bü", "a" * 3000 + " b", "The cat sat on the mat", " x"]


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def test_words_are_those_of_bytes_split() -> None:
    for _i, _j, w in T.word_runs(pa.array(TEXTS), most=50):
        at = 0
        for text, n in zip(TEXTS[_i:_j], w.per_doc, strict=True):
            found = [w.data[s:e].tobytes() for s, e in zip(w.start[at : at + n], w.end[at : at + n], strict=True)]
            assert found == words(text)
            at += n


def test_equal_words_have_equal_hashes_wherever_they_are() -> None:
    texts = ["x y z", "zz z x", "yx xy y"]
    seen: dict[bytes, set[int]] = {}
    for _, _, w in T.word_runs(pa.array(texts)):
        for s, e, h in zip(w.start, w.end, w.hashes(), strict=True):
            seen.setdefault(w.data[s:e].tobytes(), set()).add(int(h))
    assert all(len(h) == 1 for h in seen.values())
    assert len(set().union(*seen.values())) == len(seen)


def test_shingles_count_distinct_and_short_texts_are_one() -> None:
    texts = [*TEXTS, "a b c a b c a b c", "a b", "a b a"]
    for k in (3, 5):
        (_, _, w), *_ = T.word_runs(pa.array(texts), most=1 << 20)
        codes, n = T.shingles(w, k)
        sets = np.split(codes, np.cumsum(n)[:-1])
        for text, own in zip(texts, sets, strict=True):
            ws = words(text)
            want = {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} - {()}
            assert len(own) == len(want) == len(set(own.tolist()))
        assert set(sets[0].tolist()) == set(sets[8].tolist())  # white space makes no difference


def test_stretches_keep_runs_whole_over_batches() -> None:
    keys = [1, 1, 2, 2, 2, 3, 4, 4, 4, 4, 5]
    batches = [pa.record_batch([pa.array(keys[a:b], pa.int64()), pa.array(range(a, b), pa.int64())], ["k", "v"]) for a, b in ((0, 1), (1, 4), (4, 4), (4, 7), (7, 9), (9, 11))]
    runs = []
    for t, at in stretches(iter(batches), 1):
        runs += [(t["k"][i].as_py(), t["v"].to_pylist()[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    assert runs == [(1, [0, 1]), (2, [2, 3, 4]), (3, [5]), (4, [6, 7, 8, 9]), (5, [10])]
    assert list(stretches(iter([]), 1)) == []


def test_forest_labels_components() -> None:
    a, b = np.array([5, 1, 2, 8]), np.array([4, 2, 3, 5])
    assert forest(10, a, b).tolist() == [0, 1, 1, 1, 4, 4, 6, 7, 4, 9]
