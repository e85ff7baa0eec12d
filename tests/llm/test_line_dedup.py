from __future__ import annotations

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from evenflow.llm import line_dedup
from evenflow.llm.line_dedup import later_matches, repeated_lines, without_repeated_lines
from tests.llm.samples import SCHEMA, documents, words


def bag(line):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
    return frozenset(re.findall(r"[^\x20\x09-\x0D]+", low))


def brute(rows, percent, least):
    lines = sorted({(r[0], i, bag(t)) for r in rows if r[0] is not None and r[1] is not None for i, t in enumerate(r[1].split("\n"))},
                   key=lambda x: x[:2])
    lines = [x for x in lines if len(x[2]) >= least]
    return {b[:2] for j, b in enumerate(lines) if any(100 * len(a[2] & b[2]) >= percent * len(a[2] | b[2]) for a in lines[:j] if a[:2] != b[:2])}


def corpus(seed):
    rng = random.Random(seed)
    rows = [(r[0], r[1], *r[2:]) for r in documents(seed) if r[1] is None or len(r[1]) < 20_000]
    common = [" ".join(words(rng, 20)) for _ in range(4)]
    for i in range(40):
        own = [" ".join(words(rng, rng.randint(1, 30))) for _ in range(3)]
        line = rng.choice(common).split()
        if rng.random() < 0.5:
            line[rng.randrange(20)] = "changed"
        own.insert(rng.randrange(4), " ".join(line))
        rows.append((1000 + i, "\n".join(own), "en", "s1", 0, -1, "x"))
    return rows


@pytest.mark.parametrize(("percent", "least", "block"), [(80, 5, 4096), (80, 5, 3), (60, 2, 4096)])
def test_lines_equal_brute_force(spark, monkeypatch, percent, least, block):
    monkeypatch.setattr(line_dedup, "BLOCK_WORDS", 1_500_000 if block > 3 else 90)
    monkeypatch.setattr(line_dedup, "HELD_ROWS", 200_000 if block > 3 else 50)
    rows = corpus(percent + least)
    got = {(r.doc_id, r.line) for r in repeated_lines(spark.createDataFrame(rows, SCHEMA), percent, least).collect()}
    assert got == brute(rows, percent, least)
    assert got


def test_text_and_columns(spark):
    line = "alpha beta gamma delta epsilon zeta"
    rows = [(1, f"first\n{line}\n", "en", "s", 0, -1, "x"), (2, f"{line.upper()}\nsecond", "en", "s", 0, -1, "x"), (3, line, "en", "s", 0, -1, "x"),
            (4, None, "en", "s", 0, -1, "x"), (5, "", "en", "s", 0, -1, "x"), (None, line, "en", "s", 0, -1, "x")]
    got = without_repeated_lines(spark.createDataFrame(rows, SCHEMA), removed="gone")
    assert got.columns == [*(c.split()[0] for c in SCHEMA.split(", ")), "gone"]
    found = {r.doc_id: (r.text, r.gone) for r in got.collect()}
    assert found == {1: (f"first\n{line}\n", []), 2: ("second", [0]), 3: ("", [0]), 4: (None, []), 5: ("", []), None: (line, [])}


def test_pipeline_compares_short_lines(spark):
    rows = [(1, "one two three four five\nshort line\nx x x x x x x x x x\n\nonly here", "en", "s", 0, -1, "x"),
            (2, "Short line\none two three four\nx x\n\nnever short line", "en", "s", 0, -1, "x"), (3, "short line", "en", "s", 0, -1, "x")]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert got == {1: rows[0][1], 2: "\nnever short line"}
    more = corpus(7)
    assert {(r.doc_id, r.line) for r in repeated_lines(spark.createDataFrame(more, SCHEMA), 80, 1).collect()} == brute(more, 80, 1)


def test_empty_table(spark):
    assert without_repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_later_matches_across_sides():
    s = np.array([1, 2, 3, 4, 5], dtype=np.uint64)
    assert later_matches([(2, 0), (1, 0), (3, 0)], [s, s, s], np.array([0, 0, 0]), 80) == [0, 2]
    assert later_matches([(2, 0), (1, 0), (3, 0)], [s, s, s], np.array([0, 0, 1]), 80) == [2]
