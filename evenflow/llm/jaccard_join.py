"""Set-similarity self-join of documents by word shingles, over parity sketches.

A document is the set of its distinct ``k``-word shingles. Two documents link when Jaccard >= ``percent`` / 100.

Parity sketch. The hash space of shingles is cut into P parts; a part's word is the XOR of the hashes of the
document's shingles in it. A shingle that only one of two documents has changes one word, so the number of differing
words, and likewise the Hamming distance of a bit sketch in which every shingle toggles one bit, is at most the
symmetric difference. Bit sketches get wider with the set, so that the bound tells unrelated sets apart at any size; two
of different widths are compared at the narrower one. Two sets of sizes a <= b with Jaccard >= J differ in at most
(1 - J) / (1 + J) * (a + b) shingles, and b <= a / J. So if both sign their first q non-zero words, where q exceeds that
bound for the largest partner, at least one signed word agrees (pigeonhole). P depends on a band of sizes; a document
near the upper end of its band signs for the next band too.

Plan. One pass over the texts gives sizes, set fingerprints, bit sketches and signatures. Equal sets become one class,
represented by its smallest doc_id. Representatives that share a signature are chained to the smallest of them: one
shuffle of signatures, no pairs. The chained groups of a band are cut into blocks of bounded size, and every pair of
blocks is one bounded work item. A first round of items compares bit sketches and leaves a forest of the pairs that
the Hamming bound allows; the components of those are cut into blocks again, and a second round verifies their sorted
shingle sets. Only a spanning forest leaves a work item, so a group of near copies never becomes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenflow.llm.store import connected_components, free_names, in_batches, row_key, stored
from evenflow.llm.text import LOWER, Texts, chain_hashes, distinct, few_words_hash, mix, pieces, word_hashes

SKETCH_WORDS = 32  # of the narrowest sketch, in 64 bits
BLOCK_SKETCHES = 8192  # narrowest ones; a wider sketch counts as several
BLOCK_SHINGLES = 1_500_000
SECOND = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: Texts, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text; ASCII letters in lower case."""
    data = LOWER[texts.data]
    starts, ends, rows = texts.words()
    words = word_hashes(data, starts, ends)
    chains = chain_hashes(words, k)
    for begin, end in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if end - begin >= k:
            yield distinct(chains[begin:end - k + 1])
        elif end > begin:
            yield np.array([few_words_hash(words[begin:end])], dtype=np.uint64)
        else:
            yield np.zeros(0, dtype=np.uint64)


def most_different(n, m, percent: int):
    """Largest symmetric difference of linked sets with sizes n and m."""
    least = -((-percent * (n + m)) // (100 + percent))
    return n + m - 2 * least


class Bands:
    """Bands of set sizes and the sketch parts of each band."""

    def __init__(self, percent: int, ratio: float = 1.5):
        self.percent, self.ratio = percent, ratio
        self.first = next(n for n in range(1, 1000) if self.needed(n) > 1)  # below, only equal sets can link

    def largest_partner(self, n: int) -> int:
        return 100 * n // self.percent

    def needed(self, n: int) -> int:
        return max(most_different(n, m, self.percent) for m in {n, self.largest_partner(n), self.largest_partner(n) - 1}) + 1

    def of(self, n: int) -> int:
        band = int(np.log(n / self.first) / np.log(self.ratio))
        while self.low(band + 1) <= n:
            band += 1
        while self.low(band) > n:
            band -= 1
        return band

    def low(self, band: int) -> int:
        return int(np.ceil(self.first * self.ratio ** band))

    def parts(self, band: int) -> int:
        """Enough parts that a set of the band has the needed number of non-empty ones."""
        needed = self.needed(self.low(band + 1) - 1)
        return max(needed + 6 + needed // 32, 64 if band == 0 else 20)


def signatures(shingles: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signed words of a sorted shingle set, each hashed together with its band and part; and their bands."""
    n = len(shingles)
    if n < bands.first:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
    band, needed, out = bands.of(n), bands.needed(n), []
    value = mix(shingles ^ SECOND)
    for b in range(band, bands.of(bands.largest_partner(n)) + 1):
        part = ((shingles >> np.uint64(32)) * np.uint64(bands.parts(b))) >> np.uint64(32)
        begin = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])[:needed]
        stop = int(np.searchsorted(part, part[begin[-1]], "right"))  # where the last signed part ends
        words = np.bitwise_xor.reduceat(value[:stop], begin)
        out.append((mix(words ^ mix(part[begin] + np.uint64(b << 32))), np.full(len(begin), b, dtype=np.int32)))
    return np.concatenate([w for w, _ in out]), np.concatenate([b for _, b in out])


def narrowest_holds(percent: int) -> int:
    """Up to this set size the narrowest sketch will do: linked pairs differ in a quarter of its bits at most, others in about half."""
    return max(1, SKETCH_WORDS * 8 * (100 + percent) // max(1, 100 - percent))


def sketch_words(n: int, percent: int) -> int:
    """Width of the sketch of a set of ``n`` shingles: SKETCH_WORDS times a power of 2, so that wide ones fold to narrow ones."""
    return SKETCH_WORDS << max(0, -(-n // narrowest_holds(percent)) - 1).bit_length()


def bit_sketch(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Every shingle toggles one bit."""
    place = mix(shingles + SECOND)
    size = sketch_words(len(shingles), percent) * 64
    bits = np.bincount((place % np.uint64(size)).astype(np.int64), minlength=size).astype(np.uint8) & 1
    return np.packbits(bits).view(np.uint64)


def _profile(k: int, percent: int):
    bands = Bands(percent)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, one, two, sketch, signed = [], [], [], [], []
        for _, texts in pieces(batch.column(1)):
            for s in shingle_sets(texts, k):
                sizes.append(len(s))
                one.append(int(np.bitwise_xor.reduce(mix(s), initial=0)))
                two.append(int(np.add.reduce(mix(s ^ SECOND))) if len(s) else 0)
                sketch.append(len(s).to_bytes(8, "little") + bit_sketch(s, percent).tobytes())
                signed.append(signatures(s, bands))
        at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x, _ in signed])]).astype(np.int32))
        return pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(sizes, pa.int64()),
            pa.array(np.array(one, dtype=np.uint64).view(np.int64)), pa.array(np.array(two, dtype=np.uint64).view(np.int64)),
            pa.array(sketch, pa.binary()),
            pa.ListArray.from_arrays(at, pa.array(np.concatenate([x for x, _ in signed]).view(np.int64))),
            pa.ListArray.from_arrays(at, pa.array(np.concatenate([b for _, b in signed]))),
        ], names=["doc_id", "n_shingles", "one", "two", "sketch", "signed", "bands"])
    return in_batches(run)


def _sets(k: int):
    """Rows (item columns, text) -> (item columns, shingle set)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [s.tobytes() for _, texts in pieces(batch.column(5)) for s in shingle_sets(texts, k)]
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sets, pa.binary())], names=ITEM)
    return in_batches(run)


class _Forest:
    """Union-find over the rows of one work item."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return int(i)

    def roots(self) -> np.ndarray:
        up = self.parent
        while True:
            higher = up[up]
            if (higher == up).all():
                self.parent = up
                return up
            up = higher

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch at a smaller width: the one that its set would have there."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def forest_of_links(size: np.ndarray, sketch: list[np.ndarray], side: np.ndarray, percent: int, sets: list[np.ndarray] | None) -> list[tuple[int, int]]:
    """Links of a spanning forest. Pairs are those the Hamming bound allows, verified if ``sets`` are given.

    If both sides 0 and 1 occur, only pairs across them count. Larger sets never have narrower sketches.
    """
    order = np.argsort(size, kind="stable")
    size, sketch, side = size[order], [sketch[i] for i in order], side[order]
    width = np.array([len(s) for s in sketch])
    across = side.min() != side.max()
    forest, links = _Forest(len(order)), []
    ends = np.searchsorted(size, 100 * size // percent, "right")
    for i, end in enumerate(ends.tolist()):
        if i == 0 or width[i] != width[i - 1]:  # at this width: its rows and their larger partners
            first, last = i, int(np.searchsorted(width, width[i], "right"))
            alike = np.stack([folded(s, width[i]) for s in sketch[first:ends[last - 1]]])
        if end <= i + 1:
            continue
        near = np.bitwise_count(alike[i + 1 - first:end - first] ^ alike[i - first]).sum(axis=1, dtype=np.int64)
        possible = near <= most_different(size[i], size[i + 1:end], percent)
        if across:
            possible &= side[i + 1:end] != side[i]
        if not possible.any():
            continue
        found = np.flatnonzero(possible) + i + 1
        found = found[forest.roots()[found] != forest.root(i)]
        for j in found[np.argsort(near[found - i - 1], kind="stable")].tolist():
            if forest.root(i) == forest.root(j):
                continue
            if sets is not None:
                a, b = sets[order[i]], sets[order[j]]
                common = len(a) + len(b) - len(distinct(np.concatenate([a, b])))
                if 100 * common < percent * (len(a) + len(b) - common):
                    continue
            forest.join(i, j)
            links.append((int(order[i]), int(order[j])))
    return links


ITEM = ["grp", "low", "high", "own", "doc_id", "data"]


def _work(percent: int, verify: bool):
    """Rows sorted by (grp, low, high) -> links (grp, a, b); one work item in memory at a time."""
    def solve(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
        ids, links = [r[0] for r in rows], []
        if len(rows) > 1:
            side = np.array([int(r[2] == key[2]) for r in rows])
            if verify:
                sets = [np.frombuffer(r[1], dtype=np.uint64) for r in rows]
                links = forest_of_links(np.array([len(s) for s in sets]), [bit_sketch(s, percent) for s in sets], side, percent, sets)
            else:
                size = np.array([int.from_bytes(r[1][:8], "little") for r in rows])
                sketch = [np.frombuffer(r[1], dtype=np.uint64)[1:] for r in rows]
                links = forest_of_links(size, sketch, side, percent, None)
        return pa.RecordBatch.from_arrays([
            pa.array([key[0]] * len(links), pa.int64()), pa.array([ids[i] for i, _ in links], pa.int64()),
            pa.array([ids[j] for _, j in links], pa.int64())], names=["grp", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, seen = None, [], set()
        for batch in batches:
            for g, low, high, own, doc, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, low, high) != key:
                    if rows:
                        yield solve(key, rows)
                    key, rows, seen = (g, low, high), [], set()
                if (doc, data) not in seen:  # a repeated row
                    seen.add((doc, data))
                    rows.append((doc, data, own))
        if rows:
            yield solve(key, rows)
    return run


def _in_blocks(members: DataFrame, load: str, block: int) -> DataFrame:
    """Members (grp, doc_id, ...) with the block pairs they belong to; a block has about ``block`` of summed ``load``."""
    total = members.groupBy("grp").agg(F.ceil(F.sum(load) / F.lit(block)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return members.join(total, "grp").withColumn("own", own).withColumn("other", other).withColumn(
        "low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))


def _links(items: DataFrame, percent: int, verify: bool) -> DataFrame:
    return items.select(*ITEM).repartition("grp", "low", "high").sortWithinPartitions("grp", "low", "high").mapInArrow(
        _work(percent, verify), "grp long, a long, b long")


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (columns doc_id and text).

    component_id is the smallest doc_id reachable by links, the own one included. Null, empty and blank texts have
    n_shingles 0 and link with nothing; a text of fewer than ``k`` words is one shingle. Rows that repeat a doc_id are
    kept, one result row each, and count as one document. A null doc_id gives a null component_id and takes no part.
    No pair is lost but by a 64-bit hash collision, or when the shingles of a small set crowd into too few sketch
    parts (probability below 1e-7 a document). An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(texts.mapInArrow(
        _profile(k, percent),
        "doc_id long, n_shingles long, one long, two long, sketch binary, signed array<long>, bands array<int>"))
    live = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(live.groupBy("one", "two", "n_shingles").agg(F.min("doc_id").alias("rep")))
    reps = live.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")

    # Documents of a band that share a signature hang on the smallest of them.
    signed = reps.select("doc_id", F.explode(F.arrays_zip("signed", "bands")).alias("s")).select("doc_id", "s.signed", "s.bands")
    first = F.first("doc_id").over(Window.partitionBy("signed").orderBy("doc_id"))
    hung = signed.withColumn("hub", first).where("doc_id != hub").select("bands", "doc_id", "hub").distinct()
    chained = stored(_members(connected_components(hung, "doc_id", "hub", ("bands",)), ("bands",)))

    # First round: pairs that the Hamming bound of bit sketches allows.
    sketches = reps.select("doc_id", F.col("sketch").alias("data"))
    sized = live.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    width = F.ceil(F.col("n_shingles") / F.lit(narrowest_holds(percent)))
    placed = _in_blocks(chained.select(F.xxhash64("bands", "component").alias("grp"), F.col("node").alias("doc_id")).join(
        sized.select("doc_id", width.alias("width")), "doc_id"), "width", BLOCK_SKETCHES)
    allowed = _links(placed.join(sketches, "doc_id").select(*ITEM).distinct(), percent, verify=False)
    near = stored(_members(connected_components(allowed, "a", "b")))

    # Second round: shingle sets.
    placed = _in_blocks(near.select(F.col("component").alias("grp"), F.col("node").alias("doc_id")).join(sized, "doc_id"),
                        "n_shingles", block_shingles)
    items = texts.join(placed, "doc_id").select(*ITEM[:5], "text").mapInArrow(
        _sets(k), "grp long, low int, high int, own int, doc_id long, data binary")
    links = _links(items, percent, verify=True).select("a", "b")

    # Equal sets and verified links make the components; a repeated doc_id with two texts ties both classes.
    copies = live.select("doc_id", "one", "two", "n_shingles").join(classes, ["one", "two", "n_shingles"]).select("doc_id", "rep")
    found = connected_components(links.union(copies.where("doc_id != rep")), "a", "b")
    return rows.select("doc_id", "n_shingles").join(found.toDF("doc_id", "component"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _members(stars: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """All nodes of all components, the smallest included."""
    return stars.union(stars.select(*within, "component", "component").distinct())


def keep_one_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest doc_id stays.

    Rows of one id and different texts are rows of their own; rows that agree in both keep one. Rows with a null doc_id
    stay. Columns stay as they are, whatever their names.
    """
    own, key = free_names(docs, "id", "row_key")
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    there = docs.where(F.col("doc_id").isNotNull())
    groups = stored(jaccard_groups(there.select(row_key(doc, text).alias("doc_id"), "text"), k, percent).select("doc_id", "component_id").distinct())
    named = there.select(doc.alias(own), row_key(doc, text).alias("doc_id")).distinct()
    kept = named.join(groups, "doc_id").groupBy("component_id").agg(F.min(F.struct(own, F.col("doc_id").alias(key))).alias("first")).select("first.*")
    one = there.withColumn(key, row_key(doc, text)).join(kept.select(key), key, "left_semi").dropDuplicates([key])
    return one.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
