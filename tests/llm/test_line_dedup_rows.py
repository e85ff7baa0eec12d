from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from evenflow.llm import line_dedup
from evenflow.llm.line_dedup import (
    FEW, SLOTS, _members, _prefixes, _survey, _tie, _verify, bucket_ranges, held_by, joined, later_matches, repeated_lines,
)
from evenflow.llm.text import LOWER, SPACE, Texts, lowered
from tests.llm.samples import SCHEMA, words
from tests.llm.test_line_dedup import brute

LINES = [f"common{i % 7} shared{i % 50} w{i} x{i} y{i} z{i} v{i} u{i}" for i in range(3000)]


def prefix_batches(ranges):
    batch = pa.RecordBatch.from_arrays([pa.array(["\n".join(LINES[i:i + 300]) for i in range(0, 3000, 300)])], names=["text"])
    return list(_prefixes(1, 80, np.full(SLOTS, 8, dtype=np.uint8), ranges)(iter([batch])))


@pytest.mark.parametrize("ranges", [1, 2, 64])
def test_prefix_words_travel_in_a_row_per_range(ranges):
    out = prefix_batches(ranges)
    assert sum(b.num_rows for b in out) == ranges * len(out) == ranges
    buckets = [joined(out[0].column("bucket").slice(i, 1), np.uint64) for i in range(ranges)]
    assert sum(len(b) for b in buckets) == 2 * len(LINES)
    assert len(np.unique(np.concatenate(buckets))) == sum(len(np.unique(b)) for b in buckets)  # a bucket is in one range
    assert (bucket_ranges(0, 80), bucket_ranges(500_001, 80), bucket_ranges(111_000_000, 80), bucket_ranges(10**9, 100)) == (1, 2, 256, 1)


def test_ties_do_not_depend_on_ranges_and_batches():
    def components(out):
        batches = [b.slice(i, 1) for b in out for i in range(b.num_rows)]
        root = {}
        for t in _tie(80)(iter(batches)):
            for a, b in zip(*(c.to_pylist() for c in t.columns), strict=True):
                a, b = root.get(a, {a}), root.get(b, {b})
                a |= b
                root.update(dict.fromkeys(a, a))
        return {frozenset(x) for x in root.values()}

    assert components(prefix_batches(1)) == components(prefix_batches(64))


def test_slot_counts_are_few_rows():
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array(["\n".join(LINES)])], names=["doc_id", "key", "text"])
    out = [b for b in _survey(1)(iter([batch])) if b.column("part").null_count == 0]
    assert [b.num_rows for b in out] == [line_dedup.SLOT_PARTS]
    assert joined(out[0].column("counts"), np.int64).sum() == 8 * len(LINES)


def test_only_rows_with_a_wanted_line_are_cut(monkeypatch):
    cut, all_lines = [], line_dedup.line_sets

    def noted(texts, least):
        cut.append(len(texts))
        return all_lines(texts, least)

    monkeypatch.setattr(line_dedup, "line_sets", noted)
    bits = np.zeros(line_dedup.FILTER_BITS // 64, dtype=np.uint64)
    bits[0] = 1 << 5
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([5, -6, 7]), pa.array(["a b", "c d", "e f"])], names=["doc_id", "key", "text"])
    out, = _members(1, ~np.zeros_like(bits), bits)(iter([batch]))
    assert out.column("doc_id").to_pylist() == [1]
    assert cut == [1]
    assert held_by(bits, np.array([5, -6, 5 - line_dedup.FILTER_BITS]).view(np.uint64)).tolist() == [True, False, True]


@pytest.mark.parametrize("seed", range(3))
def test_work_items_equal_later_matches(seed, monkeypatch):
    monkeypatch.setattr(line_dedup, "PART", 150)  # few pairs and rows at once
    rng, rows, expected = random.Random(seed), [], []
    for grp in range(60):
        high = rng.choice([0, 1])
        base, sets, order, own = [rng.randrange(1 << 45) for _ in range(12)], [], [], []
        for i in range(rng.choice([1, 2, 2, 2, 3, 5, FEW, FEW + 1, 40])):
            sets.append(np.unique(np.array([w for w in base if rng.random() < 0.9] + [rng.randrange(1 << 45)], dtype=np.uint64)))
            order.append((rng.randrange(20) - 5, grp, i))
            own.append(rng.choice([0, high]))
            rows.append((grp, 0, high, own[-1], grp * 100 + i, *order[-1], sets[-1].tobytes()))
        if len(sets) > 1:
            expected += [order[i] for i in later_matches(order, sets, np.array([int(o == high) for o in own]), 80)]
    rows = sorted(rows + rows[::7], key=lambda r: r[:3])
    names = ["grp", "low", "high", "own", "cls", "doc_id", "key", "line", "words"]
    table = pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=names)
    got = [tuple(r.values()) for b in _verify(80)(iter(table.to_batches(max_chunksize=37))) for r in b.to_pylist()]
    assert sorted(got) == sorted(expected)
    assert got


def test_many_near_copies_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    base = words(rng, 25)
    rows = []
    for i in range(2 * FEW + 12):
        line = list(base)
        for _ in range(rng.randint(0, 4)):
            line[rng.randrange(25)] = f"other{rng.randrange(40)}"
        rows.append((i // 2, f"{' '.join(line)}\n{' '.join(words(rng, 3))}" + "\nlone" * (i % 2), "en", "s", 0, -1, "x"))
    rows = [r for i, r in enumerate(rows) if i % 2] + [(900 + i, r[1], *r[2:]) for i, r in enumerate(rows) if not i % 2]
    for block in (1_500_000, 200):
        monkeypatch.setattr(line_dedup, "BLOCK_WORDS", block)
        got = {(r.doc_id, r.line) for r in repeated_lines(spark.createDataFrame(rows + rows[:3], SCHEMA)).collect()}
        assert got == brute(rows, 80, 1)


def test_bytes_by_arithmetic_are_those_of_the_tables():
    data = np.arange(256, dtype=np.uint8)
    assert (lowered(data) == LOWER[data]).all()
    texts = Texts(pa.array(["".join(f"a{chr(c)}" for c in range(128)), "Éa\x85b c"]))
    starts, ends, rows = texts.words()
    assert not SPACE[texts.data[starts]].any()
    assert not SPACE[texts.data[ends - 1]].any()
    assert int((ends - starts).sum()) == int((~SPACE[texts.data]).sum())
    assert rows.tolist() == [0, 7, 8]
