from __future__ import annotations

import pyarrow as pa

from evenflow.llm import text
from evenflow.llm.store import connected_components
from evenflow.llm.text import Texts, pieces, word_hashes

ROWS = ["a b  c", "", None, "x", "b c\ta", " ", "w" * 60 + " " + "w" * 61, "é é é", "tail\n"]


def test_words_of_rows():
    t = Texts(pa.array(ROWS))
    starts, ends, rows = t.words()
    raw = t.data.tobytes()
    found = [[raw[starts[i]:ends[i]] for i in range(rows[r], rows[r + 1])] for r in range(len(ROWS))]
    assert found == [(x or "").encode().split() for x in ROWS]


def test_hash_depends_on_the_word_only():
    t = Texts(pa.array([" ".join(x for x in ROWS if x), "b a", "w" * 61]))
    starts, ends, _ = t.words()
    raw, seen = t.data.tobytes(), {}
    for s, e, h in zip(starts, ends, word_hashes(t.data, starts, ends).tolist(), strict=True):
        assert seen.setdefault(raw[s:e], h) == h
    assert len(set(seen.values())) == len(seen)


def test_pieces_cover_all_rows(monkeypatch):
    monkeypatch.setattr(text, "MAX_BYTES", 8)
    column = pa.array(ROWS).slice(1)
    parts = list(pieces(column))
    assert [b for b, _ in parts] == [sum(len(t) for _, t in parts[:i]) for i in range(len(parts))]
    assert sum(len(t) for _, t in parts) == len(column)
    assert b"".join(t.data.tobytes() for _, t in parts) == "".join(x or "" for x in ROWS[1:]).encode()


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 7), (20, 3), (None, 4), (2**62, 2**62 - 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {2: 1, 3: 1, 20: 1, 9: 7, 8: 7, 2**62: 2**62 - 1}
    path = [(i, i + 1) for i in range(60)]
    got = connected_components(spark.createDataFrame(path, "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in got} == {i: 0 for i in range(1, 61)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
