"""Centroid clustering, substring dedup and fill-in-middle against brute force and awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenflow.llm.fill_in_middle import fill_in_middle, restored
from evenflow.llm.simplex_clusters import Simplex, nearest, simplex_clusters, squared
from evenflow.llm.substring_dedup import Recompressed, without_repeated_passages
from evenflow.llm.text import Texts
from tests.llm.samples import documents

VECTORS = "vec_id long, embedding array<float>, label int, cluster string, apex int"


def brute_clusters(rows, k, rounds, width, scale, seed):
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    ids = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in ids[:k]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            out.append((i, v, d.index(min(d)), min(d)))
        return out
    for _ in range(rounds):
        done = assign()
        for c in range(len(centroids)):
            own = [v for _, v, k_, _ in done if k_ == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    done = assign()
    inertia = Counter()
    for _, _, c, d in done:
        inertia[c] += d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
                   for i, _, c, d in done), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_brute_force(spark, seed):
    rng, width = random.Random(seed), 6
    rows = [(i, [rng.gauss(i % 4, 0.7) for _ in range(width)]) for i in range(300)]
    rows += [(i, [1.0] * width) for i in range(300, 340)] + rows[:5]  # ties, repeated rows
    rows += [(None, [0.5] * width), (900, None), (901, [1.0]), (902, [1.0] * 5 + [None]), (903, [1.0] * 5 + [float("nan")]),
             (904, [float("inf")] * 6), (905, [-0.0] * 6), (905, [-3.1] * 6)]
    table = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], VECTORS).repartition(4)
    got = simplex_clusters(table, clusters=5, rounds=3, width=width, scale=64, seed=seed, pivots=4)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_clusters(rows, 5, 3, width, 64, seed)


def test_clusters_of_few_and_no_rows(spark):
    few = spark.createDataFrame([(1, [0.25, 1.0], 0, "", 0), (2, [0.25, 1.0], 0, "", 0)], VECTORS)
    assert sorted(map(tuple, simplex_clusters(few, width=2).select("vec_id", "cluster", "distance").collect())) == [(1, 0, 0), (2, 0, 0)]
    assert simplex_clusters(few.limit(0), width=2).count() == 0
    huge = spark.createDataFrame([(1, [1e30, 0.0], 0, "", 0), (2, [1.0, 0.0], 0, "", 0)], VECTORS)
    assert [r["vec_id"] for r in simplex_clusters(huge, width=2).collect()] == [2]


def test_apex_bounds_hold_and_filter():
    rng = np.random.default_rng(3)
    centers = rng.integers(-60, 60, (16, 64))
    vectors = centers[rng.integers(0, 16, 2000)] + rng.integers(-8, 9, (2000, 64))
    simplex = Simplex(centers[[0, 1, 2, 2, 3, 4, 5, 6]])  # one pivot twice
    assert len(simplex.pivots) == 7
    apex, tops = simplex.apexes(vectors), simplex.apexes(centers)
    exact = np.stack([squared(vectors, c) for c in centers], axis=1)
    base = ((apex[:, None, :-1] - tops[None, :, :-1]) ** 2).sum(axis=2)
    assert (base + (apex[:, -1:] - tops[None, :, -1]) ** 2 <= exact + 1e-3).all()
    assert (base + (apex[:, -1:] + tops[None, :, -1]) ** 2 >= exact - 1e-3).all()
    cluster, distance, compared = nearest(vectors, apex, centers, tops)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert compared < 0.7 * exact.size


def brute_repeats(rows, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(w[i:i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = {i + j for i in range(len(w) - size + 1) if count[tuple(w[i:i + size])] > 1 for j in range(size)}
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "size", "letters"), [(1, 35, 60), (2, 35, 3), (3, 8, 4), (4, 5, 30), (5, 2, 200), (6, 1, 300)])
def test_repeats_equal_brute_force(spark, seed, size, letters):
    rng = random.Random(seed)
    alphabet = [f"w{i}" for i in range(letters)]
    shared = [[rng.choice(alphabet) for _ in range(n)] for n in (size - 1, size, size + 1, size + 3, 2 * size, 5 * size)]
    shared += [["a"] * (size + 2), ["a"] * size, ["a", "b"] * size]
    rows = []
    for d in range(50):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [rng.choice(alphabet) + (str(rng.random()) if rng.random() < 0.3 else "") for _ in range(rng.randint(0, 50))]
            text += rng.choice(shared) if rng.random() < 0.5 else []
        rows.append((d, rng.choice([" ", "\n", "\t "]).join(text)))
    rows += [(d, t) for d, t, *_ in documents()] + [(2 ** 60 + 1, "x y"), (5, None), (7, ""), rows[3], rows[3], (9, "\n\t "), (None, None)]
    table = spark.createDataFrame([(d, t, "en", 1, 2, 3, 4) for d, t in rows], "doc_id long, text string, key string, mark int, n int, kept int, spans int")
    got = without_repeated_passages(table.repartition(6), size).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=repr) == brute_repeats(rows, size)
    for r in got:
        assert sum(s["stop"] - s["first"] for s in r["spans"]) == r["n_removed"]
        assert all(a["stop"] < b["first"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))


def test_equal_substrings_share_symbols():
    rng = random.Random(7)
    shared = [str(rng.random()) for _ in range(60)]
    around = [[str(rng.random()) for _ in range(20)] for _ in range(4)]
    import pyarrow as pa

    texts = Texts(pa.array([" ".join(around[0] + shared + around[1]), " ".join(around[2] + shared + around[3])]))
    found = Recompressed(texts, 6)
    text = found.text_of_symbol()
    common = set(found.top[text == 0].tolist()) & set(found.top[text == 1].tolist())
    assert 5 <= len(common) < len(found.top) / 2


def test_repeats_of_no_rows(spark):
    assert without_repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_middle(doc, text, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return doc, len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return doc, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle_equals_brute_force_and_comes_back(spark):
    rng = random.Random(4)
    pool = ["", "a", "ünï", "語", "<", "<P", "S>", "\r", " ", " ", "x" * 50]
    rows = [(i, "".join(rng.choice(pool) + ("\n" if rng.random() < 0.5 else "") for _ in range(rng.randint(0, 12)))) for i in range(200)]
    rows += [(300, "has <M> in it\nand more"), (301, "\n" * 5), (302, "y\n" * 100_000), (303, "z" * 300_000), (None, "a\nb\nc"), (304, None), rows[0], (2 ** 60 + 1, "p\nq")]
    table = spark.createDataFrame([(i, t, "x", 1, "f", 2) for i, t in rows], "doc_id long, text string, cut string, h3 int, form string, output int")
    out = fill_in_middle(table).withColumn("back", restored(F.col("form"), F.col("output"))).collect()
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out), key=repr) == sorted(
        (brute_middle(i, t) for i, t in rows), key=repr)
    assert all(r["back"] == r["text"] for r in out)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_middle_options(spark):
    table = spark.createDataFrame([(i, "one two three") for i in range(60)], "doc_id long, text string")
    out = fill_in_middle(table, unit=r"\S+\s*|\s+", rate=50, spm_rate=0, marks=("[p]", "[s]", "[m]"))
    forms = Counter(r["form"] for r in out.collect())
    assert set(forms) == {"plain", "psm"} and 10 < forms["plain"] < 50
    assert fill_in_middle(table.limit(0)).count() == 0
    for marks in (("<a>", "<a>", "<b>"), ("", "x", "y"), ("ab", "bc", "d"), ("aa", "b", "c")):
        if marks == ("aa", "b", "c"):
            marks = ("aa", "aab", "c")
        with pytest.raises(ValueError, match="marks"):
            fill_in_middle(table, marks=marks)
