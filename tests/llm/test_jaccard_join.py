from __future__ import annotations

import re

import numpy as np
import pytest

from evenflow.llm.jaccard_join import Bands, forest_of_links, jaccard_groups, keep_one_each, most_different, signatures
from tests.llm.samples import SCHEMA, documents


def shingles(text, k):
    if text is None:
        return frozenset()
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not found:
        return frozenset()
    return frozenset(tuple(found[i:i + k]) for i in range(max(1, len(found) - k + 1)))


def brute(rows, k, percent):
    sets = {}
    for r in rows:
        if r[0] is not None:
            sets[r[0]] = shingles(r[1], k)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= percent * len(sets[a] | sets[b]) and common:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize(("k", "percent", "block"), [(4, 85, 1_500_000), (5, 80, 60), (3, 60, 200)])
def test_groups_equal_brute_force(spark, k, percent, block):
    rows = documents(seed=k)
    got = jaccard_groups(spark.createDataFrame(rows, SCHEMA), k, percent, block).collect()
    want = brute(rows, k, percent)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r.doc_id


def test_one_of_each_group_stays(spark):
    rows = documents()
    kept = keep_one_each(spark.createDataFrame(rows, SCHEMA))
    want = {d for d, (_, c) in brute(rows, 5, 80).items() if d == c}
    got = kept.collect()
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(want)
    assert sum(r.doc_id is None for r in got) == 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard_groups(empty).count() == 0
    assert keep_one_each(empty).count() == 0


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(1)
    bands = Bands(85)
    for n in (6, 7, 13, 26, 60, 200, 1500):
        for _ in range(30):
            a = rng.integers(0, 2**64, n, dtype=np.uint64)
            d = most_different(n, n, 85) // 2
            b = np.concatenate([a[d:], rng.integers(0, 2**64, d, dtype=np.uint64)])
            x, y = (signatures(np.sort(s), bands)[0] for s in (a, b))
            assert set(x.tolist()) & set(y.tolist())


def test_forest_across_sides_only():
    size, sketch = np.array([10, 10, 10]), np.zeros((3, 2), dtype=np.uint64)
    assert len(forest_of_links(size, sketch, np.array([0, 0, 0]), 80, None)) == 2
    assert {frozenset(x) for x in forest_of_links(size, sketch, np.array([0, 0, 1]), 80, None)} == {frozenset((0, 2)), frozenset((1, 2))}
