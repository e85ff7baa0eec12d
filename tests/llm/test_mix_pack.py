"""Mixing, packing and the pipeline."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evenflow.llm.mixing import mix_plan, mixed, source_targets
from evenflow.llm.packing import ContentOrder, Shard, Weights, fill_windows, pack, tokenizer
from evenflow.llm.text import Texts
from tests.conftest import SF
from tests.llm.samples import SCHEMA, documents

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def shared_targets(totals):
    """Share by weight, stop at three times the size, share the excess again."""
    names = sorted((s for s in totals if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in totals)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(totals.values()))
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * totals[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 3.0 * totals[s]
            rest -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("totals", [{"a": 10, "b": 1, "c": 5, None: 100}, {"a": 7}, {"a": 0, "b": 0}, {"z": 1, "Z": 1, "é": 1, "zz": 50, "y": 0}])
def test_targets(spark, totals):
    rows = [(s, n) for s, n in totals.items()]
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert got == pytest.approx(shared_targets(totals))


def test_mix(spark):
    rows = documents(9, 40)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix_plan(docs).collect()
    again = mix_plan(docs.repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert len(got) == len(rows)
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    totals, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.size == size[r.doc_id] and r.taken == r.copies * r.size and 0 <= r.copies <= 3
        totals[r.source] += r.size
        taken[r.source] += r.taken
    want = shared_targets(totals)
    for r in got:
        assert r.source_size == totals[r.source] and r.target == pytest.approx(want[r.source])
    largest = {s: max(r.size for r in got if r.source == s) for s in totals}
    for s in totals:  # whole documents: within half of a small one, unless one document is most of its source
        room = largest[s] / 2 if largest[s] > totals[s] / 2 else max(15, 0.02 * want[s])
        assert abs(taken[s] - want[s]) <= room, s
    many = mixed(docs)
    assert many.columns == docs.columns
    assert many.count() == sum(r.copies for r in got)
    assert mix_plan(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rates_are_exponential_tilts(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + i % 40)), "en", "a" if i % 3 else "b", 0, 0, "") for i in range(3000)], SCHEMA)
    by = mix_plan(docs, weights=(1, 6)).groupBy("source", "size").agg(F.avg("copies").alias("rate")).collect()
    for source in "ab":
        x = np.array([r["size"] for r in by if r.source == source], dtype=float)
        y = np.array([r.rate for r in by if r.source == source])
        free = (y > 0.1) & (y < 2.9)
        slope = np.log(y[free]) / x[free]
        assert np.std(slope[x[free] > 8]) < 0.35 * abs(np.mean(slope[x[free] > 8])) + 0.003


# -- packing ---------------------------------------------------------------------------------------------------

def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


TRICKY = ["Hello, World!!", "don't, it's... we'll;", "<|endoftext|>x <|startoftext|>", "Ünïcode é. ê! 語語", "é á.", "a b c", "###abc%%% x$$$",
          "1234.5", "O'Neil's,", "", "\x85\x1c a", "ΑΣ ΑΣ.", "(ab)(cd)", "'s 't", "A<|B|>.", "İstanbul, I."]


def test_word_cache_gives_the_tokenizers_ids():
    rows = documents(2)
    texts = TRICKY + [r[1] for r in rows if r[1]]
    tok = tokenizer(PATH)
    got = [np.frombuffer(b, dtype=tok.dtype).tolist() + [2] for b in tok.ids(Texts(pa.array(texts)))]
    assert got == plain_ids(texts)


@pytest.mark.parametrize(("size", "shard"), [(4096, 4_000_000), (64, 3000)])
def test_pieces_hold_every_id_once(spark, size, shard):
    rows = documents(4, 30) + [(9000 + i, t, None, None, 0, 0, "") for i, t in enumerate(TRICKY)]
    got = pack(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, size=size, shard_tokens=shard).collect()
    ids = dict(zip([r[0] for r in rows], plain_ids([r[1] for r in rows]), strict=True))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    copies = defaultdict(int)
    for r in rows:
        copies[r[0]] += 1
    for doc, parts in by_doc.items():
        assert sum(p.length for p in parts) == copies[doc] * len(ids[doc])
        for p in parts:
            own = np.array(ids[doc][p.start:p.start + p.length], dtype="<u4")
            assert p.length == len(own) > 0 and p.ids_crc32 == zlib.crc32(own.tobytes()) and p.doc_tokens == len(ids[doc])
        if copies[doc] == 1:
            assert [p.start for p in sorted(parts, key=lambda p: p.start)] == np.cumsum([0, *(p.length for p in sorted(parts, key=lambda p: p.start))])[:-1].tolist()
    assert set(by_doc) == set(ids)
    short = 0
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == np.cumsum([0, *(p.length for p in parts)])[:-1].tolist()
        total = sum(p.length for p in parts)
        assert total <= size
        short += total < size
    assert short <= 1


def test_neighbours_are_lexically_close():
    rng = np.random.default_rng(3)
    topics = [rng.integers(100 * t + 10, 100 * t + 60, (20, 40)) for t in range(5)]
    docs = [np.concatenate([d, [2]]).astype("<u2") for t in topics for d in t]
    order = rng.permutation(len(docs))
    shuffled = [docs[i] for i in order]
    frequency = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=1000).astype(float)
    shard = Shard(shuffled, Weights(frequency, len(docs), 41.0, 2))
    windows = defaultdict(list)
    for doc, _, _, window, _ in fill_windows(shard, 410):
        windows[window].append(order[doc] // 20)
    pure = sum(max(np.bincount(w)) / len(w) > 0.7 for w in windows.values())
    assert pure >= 0.8 * len(windows)


def bm25(docs, frequency, seed, end_id=2):
    """Scores of all documents for the seed's distinct terms."""
    mean, idf = np.mean([len(d) for d in docs]), np.log1p((len(docs) - frequency + 0.5) / (frequency + 0.5))
    query, out = set(docs[seed].tolist()) - {end_id}, []
    for d in docs:
        terms, count = np.unique(d[np.isin(d, list(query))], return_counts=True)
        out.append(float((idf[terms] * count * 2.2 / (count + 1.2 * (0.25 + 0.75 * len(d) / mean))).sum()))
    return np.array(out)


def assert_best_first(docs, frequency, pieces, size):
    """Every document is the best unused one for its window's seed; a new seed needs that no other shares a term."""
    unused, seed = np.ones(len(docs), dtype=bool), None
    for doc, start, length, _, offset in pieces:
        if start == 0:
            scores = np.zeros(len(docs)) if seed is None else bm25(docs, frequency, seed)
            if (scores[unused] > 0).any():
                assert scores[doc] >= scores[unused].max() * (1 - 1e-5)
            else:
                seed = doc
            unused[doc] = False
        if offset + length == size:
            seed = None
        elif offset == 0:
            seed = doc


def short_and_long(n=300):
    rng = np.random.default_rng(5)
    docs = [rng.integers(10, 400, k) for k in [90] * 5 + rng.integers(2, 9, n).tolist()]
    docs = [np.concatenate([d, [2]]).astype("<u2") for d in docs]
    return docs, np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=400).astype(float)


@pytest.mark.parametrize("size", [300, 700])
def test_all_terms_and_all_hits_count(size):
    docs, frequency = short_and_long()
    shard = Shard(docs, Weights(frequency, len(docs), float(np.mean([len(d) for d in docs])), 2))
    assert_best_first(docs, frequency, fill_windows(shard, size), size)


def mean_score(docs, weights, pieces, size):
    """Mean BM25 score for its window's seed over the documents that a window took as neighbours."""
    scores, windows = [], defaultdict(list)
    for doc, start, _, window, offset in pieces:
        windows[window].append((offset, doc, start))
    of = [dict(zip(*(x.tolist() for x in np.unique(d, return_counts=True)), strict=True)) for d in docs]
    for own in windows.values():
        (_, seed, _), *others = sorted(own)
        terms = set(of[seed]) - {weights.end_id}
        for _, doc, start in others:
            if start == 0:
                shared = np.array(sorted(terms & set(of[doc])), dtype=np.int64)
                scores.append(weights.of(shared, np.array([of[doc][t] for t in shared.tolist()]), np.float64(len(docs[doc]))).sum() if len(shared) else 0.0)
    return float(np.mean(scores))


def test_one_shard_is_brute_force(spark):
    rng, size = np.random.default_rng(11), 200
    topics = [[f"{c}{d}{e}" for d in "bcdfg" for e in "aeiou"] for c in "klmnpr"]
    rows = [(i, " ".join(rng.choice(topics[i % 6], int(rng.integers(5, 30)))), None, None, 0, 0, "") for i in range(240)]
    ids = {r[0]: np.array(x, dtype="<u2") for r, x in zip(rows, plain_ids([r[1] for r in rows]), strict=True)}
    got = pack(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, size=size).collect()
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    pieces = [(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in sorted(got, key=lambda r: (r.sequence_id, r.offset))]
    docs = [ids[r[0]] for r in rows]
    assert_best_first(docs, np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=50_000).astype(float), pieces, size)


def test_neighbours_across_shards_are_nearly_the_best(spark):
    """About thirty shards: the neighbours' mean score is at least 0.9 of what one index over the whole table finds."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    docs = [np.array(x, dtype="<u2") for x in plain_ids([t for _, t in rows])]
    number = {d: i for i, (d, _) in enumerate(rows)}
    frequency = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=50_000).astype(float)
    weights = Weights(frequency, len(docs), float(np.mean([len(d) for d in docs])), 2)
    whole = mean_score(docs, weights, list(fill_windows(Shard(docs, weights), 4096)), 4096)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = pack(table, PATH, shard_tokens=30_000, sample=400).collect()
    parts = mean_score(docs, weights, [(number[r.doc_id], r.start, r.length, r.sequence_id, r.offset) for r in got], 4096)
    shuffled = [docs[i] for i in np.random.default_rng(1).permutation(len(docs))]
    chance = mean_score(shuffled, weights, [p for p in windows_in_row_order(shuffled, 4096)], 4096)
    print("mean BM25 of neighbours: whole", whole, "shards", parts, "row order", chance)
    assert parts >= 0.9 * whole and parts > chance


def windows_in_row_order(docs, size):
    at = 0
    for i, d in enumerate(docs):
        start = 0
        while start < len(d):
            take = min(size - at % size, len(d) - start)
            yield i, start, take, at // size, at % size
            start, at = start + take, at + take


def test_copies_lie_together_in_the_order():
    rng = np.random.default_rng(2)
    base = [rng.integers(10, 900, 300).astype("<u2") for _ in range(200)]
    docs = base + [np.where(rng.random(300) < 0.02, 5, d).astype("<u2") for d in base] + base
    frequency = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=1000).astype(float)
    order = ContentOrder(Weights(frequency, len(docs), 300.0, 2), 1000)
    order.fit(order.sketches(docs))
    leaf, value = order.place(docs)
    assert (leaf[:200] == leaf[400:]).all() and np.allclose(value[:200], value[400:])
    place = np.argsort(np.lexsort((value, leaf)))
    near = np.abs(place[:200] - place[200:400])
    assert np.median(near) < 40 and len(set(leaf.tolist())) > 8


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


# -- pipeline --------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        seen.append((name, docs.count()))
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "ngram_jaccard_join":
            assert docs.count() == docs.select("doc_id").distinct().count()
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "mixing":
            assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} <= kept
    assert all(n > 0 for _, n in seen) and seen[2][1] <= seen[1][1] <= seen[0][1] <= 200
    assert docs.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
