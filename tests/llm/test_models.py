"""Language profiles, the additive quality model and decision lists."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenflow.llm.decision_list import BASE, Condition, covered, learn_rules, quality_rules, verdict
from evenflow.llm.labelled import held_out, training_sample
from evenflow.llm.language_id import Encoder, identify_languages
from evenflow.llm.quality_gam import bin_tree, fit_additive, keep_good, pair_tree, quality_scores, with_quality
from evenflow.llm.text_stats import FEATURES, STATS, ratios, with_statistics
from tests.conftest import SF
from tests.llm.samples import SCHEMA, documents

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


# -- counts ----------------------------------------------------------------------------------------------------

def brute_counts(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(found[i:i + 8]) for i in range(len(found) - 7)]
    covered_words = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)} if len(windows) < 3000 else set()
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(found), "word_chars": sum(map(len, found)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered_words), "n_distinct_words": len(set(found)),
        "n_upper": sum("A" <= c <= "Z" for c in text), "n_wide": sum(ord(c) > 127 for c in text),
        "max_word": max((len(w.encode()) for w in found), default=0), "n_stops": sum(w[-1] in ".!?" for w in found),
    }


def test_counts_equal_brute_force(spark):
    rows = documents(3)
    texts = [r[1] for r in rows] + ["a b c d e f g h x a b c d e f g h", "one two\n\none two\n \nthree # $", "|a|<b> *** é!\n|a|<b> *** é!", "z " * 40]
    df = with_statistics(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    for r in df.collect():
        want = brute_counts(texts[r.doc_id])
        assert {k: r["__counts"][k] for k in want} == want, r.doc_id


# -- samples ---------------------------------------------------------------------------------------------------

def test_sample_is_bounded_and_stable(spark, docs, labels):
    x, y = training_sample(docs, labels, max_rows=30)
    x2, _ = training_sample(docs.repartition(7).union(docs), labels.union(labels), max_rows=30)
    assert x.shape == (30, len(FEATURES)) and set(y) <= {0.0, 1.0}
    assert (x == x2).all()
    x, y = training_sample(docs, spark.createDataFrame([(None, 1, 0), (1, None, 0)], LABELS))
    assert x.shape == (0, len(FEATURES)) and y.shape == (0,)


# -- language --------------------------------------------------------------------------------------------------

def test_bundle_is_the_sum_of_bound_runs():
    import pyarrow as pa

    from evenflow.llm.text import Texts

    enc = Encoder(64)
    texts = ["Ab1!c", "x", "", "7 7", "öab", "abab abab"]
    for text, got in zip(texts, enc.bundles(Texts(pa.array(texts))), strict=True):
        symbols = [0, *(int(enc.table[ord(c)]) for c in re.sub(r"[\W\d_]+", " ", text)), 0]
        symbols = [s for i, s in enumerate(symbols) if s or not i or symbols[i - 1]] if any(symbols) else []
        if not any(symbols):
            assert got is None
            continue
        want = sum(np.roll(enc.letters[a], 2) * np.roll(enc.letters[b], 1) * enc.letters[c].astype(int)
                   for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False))
        if symbols[-2:] == [0, 0]:
            pass
        assert np.abs(got - want).max() <= (1 if text.endswith(("!", ".")) else 0) + 1e-6


def test_language_on_held_out_rows(spark):
    folder = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 150
    assert sum(r.lang == r.lang_pred for r in found) / len(found) >= 0.97


def test_language_edge_cases(spark):
    rows = documents()
    got = identify_languages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und")
    blank = {r[0] for r in rows if r[1] is None or not any(c.isalpha() for c in r[1])}
    assert {r.doc_id for r in got if r.lang_pred == "und"} == blank
    empty = spark.createDataFrame([], SCHEMA)
    assert identify_languages(empty).count() == 0
    unknown = spark.createDataFrame([(1, "some words", None, None, 0, 0, "")], SCHEMA)
    assert [r.lang_pred for r in identify_languages(unknown).collect()] == ["und"]


# -- additive model --------------------------------------------------------------------------------------------

def test_shallow_trees():
    g, h = np.array([5.0, 5.0, -5.0, -5.0]), np.full(4, 4.0)
    step = bin_tree(g, h)
    assert step[0] == step[1] > 0 > step[2] == step[3]
    grid = np.array([[9.0, -9.0], [-9.0, 9.0]])
    gain, values = pair_tree(grid, np.full((2, 2), 5.0))
    assert gain > 0 and (np.sign(values) == np.sign(grid)).all()


def test_model_learns_single_features_and_pairs():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.3) & ((x[:, 1] > 0.5) == (x[:, 2] > 0.5))).astype(float)
    model = fit_additive(x[:3000], y[:3000], rounds=40, pair_rounds=40)
    assert (1, 2) in {p[:2] for p in model.pairs}
    assert ((model.scores(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.95
    assert fit_additive(x[:0], y[:0]).scores(x[:2]).tolist() == [0.5, 0.5]
    assert (fit_additive(x[:10], np.ones(10)).scores(x[:2]) > 0.8).all()


def test_quality_on_held_out_rows(spark, labels):
    folder = SF.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 3000")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good = [r.score for r in found if r.quality == 1]
    bad = [r.score for r in found if r.quality == 0]
    assert len(bad) > 10 and np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert np.mean([(r.predicted == 1) == (r.quality == 1) for r in found]) > 0.95


def test_quality_edge_cases(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([(r[0], i % 2, 0) for i, r in enumerate(rows)] + [(None, 1, 1), (4, None, 0)], LABELS)
    got = quality_scores(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality_scores(docs, none).collect()} == {0.5}
    kept = keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert quality_scores(spark.createDataFrame([], SCHEMA), marks).count() == 0


# -- decision list ---------------------------------------------------------------------------------------------

def test_rules_find_planted_conjunctions():
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(FEATURES)))
    bad = ((x[:, 2] > 0.8) & (x[:, 5] <= 0.5)) | (x[:, 7] > 0.93)
    rules = learn_rules(x, 1.0 - bad)
    hit = np.any([covered(r, x) for r in rules], axis=0)
    assert (hit == bad).mean() > 0.97
    assert learn_rules(x[:0], np.zeros(0)) == [] and learn_rules(x, np.ones(len(x))) == []


def test_list_is_a_conditional_expression(spark):
    rules = [(Condition("symbols", True, 0.25),), (Condition("words", False, 1.5), Condition("upper", True, 0.5))]
    texts = ["## ## ab", "AB CD", "ab cd ef gh", "", None]
    df = with_statistics(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = [r.v for r in df.select("doc_id", verdict(rules, ratios()).alias("v")).orderBy("doc_id").collect()]
    assert got == [False, False, True, True, True]


def test_rules_query(spark, docs, labels):
    rows = documents()
    both = spark.createDataFrame(rows, SCHEMA)
    got = quality_rules(both, labels, rules=[]).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        want = brute_counts(texts[r.doc_id])
        assert {k: r[k] for k in BASE} == {k: want[k] for k in BASE}
        failed = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        assert (r.base_failed, r.kept) == (failed, not failed)
    assert quality_rules(spark.createDataFrame([], SCHEMA), labels).count() == 0
    assert set(BASE) <= set(STATS)


def test_held_out_part(spark):
    import zlib

    ids = [None, 1, 22, 333, -4]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("h")).collect()
    assert [r.h for r in got] == [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids]


def test_quality_counts_and_scores_in_one_python_step(spark, labels):
    rows = [(i, t) for i, t in enumerate([None, "", " \n", "One two. Three!", "a b a b\n" * 40, "#*| é 漢字 " * 9, "x" * 3000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    x = np.random.default_rng(3).random((400, len(FEATURES))) * 4
    model = fit_additive(x, (x.sum(axis=1) > 32).astype(float))
    found = with_quality(docs, model, "score")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    apart = with_statistics(docs).select("doc_id", F.array(*(ratios()[n] for n in FEATURES)).alias("x")).orderBy("doc_id").collect()
    want = model.scores(np.array([r.x for r in apart]))
    assert [r.score for r in found.orderBy("doc_id").collect()] == want.tolist()
    assert len(set(want.tolist())) > 2
