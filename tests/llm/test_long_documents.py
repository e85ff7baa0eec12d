from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from evenflow.llm.jaccard_join import _profile, _work, bit_sketch, folded, jaccard_groups, narrowest_holds, sketch_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def long_text(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_long_documents_that_share_little_are_not_verified():
    """At 2,048 bits the difference that linked sets of 6,000 may have is as large as that of any two sets."""
    texts = [long_text(i, 6000) for i in range(5)]
    texts.append(texts[3][:5900] + long_text(9, 90))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([" ".join(t) for t in texts])], names=["doc_id", "text"])
    profile, = _profile(5, 80)(iter([batch]))
    same = [pa.array([7] * 6, pa.int64()), *[pa.array([0] * 6, pa.int32())] * 3]
    links, = _work(80, verify=False)(iter([pa.RecordBatch.from_arrays(
        [*same, profile["doc_id"], profile["sketch"]], names=["grp", "low", "high", "own", "doc_id", "data"])]))
    assert [sorted((r["a"], r["b"])) for r in links.to_pylist()] == [[3, 5]]


def test_wide_sketches_fold_to_narrow_ones():
    rng = np.random.default_rng(1)
    edge = narrowest_holds(80)
    assert [sketch_words(n, 80) for n in (1, edge, edge + 1, 2 * edge, 2 * edge + 1, 4 * edge + 1)] == [32, 32, 64, 64, 128, 256]
    a = np.sort(rng.integers(0, 2**64, edge + 1, dtype=np.uint64))
    wide, narrow = bit_sketch(a, 80), bit_sketch(a[:-1], 80)
    assert np.bitwise_count(folded(wide, 32) ^ narrow).sum() == 1


def test_near_copies_of_different_sketch_widths_link(spark):
    edge = narrowest_holds(80)
    one, far = long_text(1, edge + 150), long_text(2, edge + 150)
    rows = [(1, one), (2, one[:edge - 100]), (3, far), (4, far[:edge // 2]), (5, long_text(3, 3 * edge)), (6, long_text(4, 3 * edge))]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "a", 0) for i, t in rows], SCHEMA)
    for block in (1_500_000, 1000):
        got = {r.doc_id: r.component_id for r in jaccard_groups(docs, 5, 80, block).collect()}
        assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_line_stage_keeps_one_python_step_a_task(spark, capsys):
    docs = spark.createDataFrame([(1, "one two three\nfour", "en", "a", 1), (2, "one two three", "en", "a", 1)], SCHEMA)
    out = corpus_pipeline.line_dedup(spark, docs, "")
    capsys.readouterr()
    out.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
    assert {r.doc_id: r.text for r in out.collect()} == {1: "one two three\nfour"}
