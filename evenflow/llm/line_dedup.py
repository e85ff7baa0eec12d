"""Line deduplication: an exact set-similarity join of lines by prefix, positional and length filters.

A line is the set of its distinct words (ASCII letters in lower case). Words are ordered by rarity, from counts over the
whole corpus in 2^20 hashed slots: any order that all lines share is right, a good one makes prefixes rare. Two sets of
sizes n <= m with Jaccard >= t share a word among the first n - ceil(t n) + 1 of each. Sets that share a prefix word
are compared by length, by the most that can still be common after the word's positions, and by a 64-bit parity
sketch; those that pass are tied together, and within the tied groups the Jaccard of sorted word sets decides.
A line goes if an earlier line (by doc_id and line number) matches it, whether or not that one goes itself. Words are
known by 45 bits of their hashes and sets by 64-bit fingerprints.

Equal sets are one class, so copies cost nothing: of the lines of a class that one Arrow batch holds, all but the
earliest go without further work. Buckets of a word and tied groups are cut into blocks of bounded size; a work item
returns a spanning forest or the lines that go, never all pairs. Prefix words travel by ranges of buckets, many in one
row; there are the more ranges the more words the corpus has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evenflow.llm.store import connected_components, free_names, in_batches, row_key, stored
from evenflow.llm.text import Texts, distinct, lowered, mix, pieces, word_hashes

SLOTS = 1 << 20
SLOT_PARTS = 16
BLOCK_LINES, BLOCK_WORDS, HELD_ROWS = 4096, 1_500_000, 200_000
RANGE_ROWS, SENT_ROWS = 100_000, 400_000  # prefix words of a range of buckets, about, and of one batch of them
FILTER_BITS = 1 << 24
PART = 1 << 19  # lines numbered at once in a sort key
ID_BITS = 45  # of a word's hash


def line_sets(texts: Texts, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Lines with ``least`` distinct words or more, in runs: row, line number, word borders, sorted word ids."""
    data = lowered(texts.data)
    starts, ends, rows = texts.words()
    hashes = word_hashes(data, starts, ends) >> np.uint64(64 - ID_BITS)
    feeds = np.flatnonzero(texts.data == 10)
    border = np.searchsorted(feeds, texts.offsets)  # line feeds before each row
    row = np.repeat(np.arange(len(texts)), np.diff(rows))
    before = np.diff(np.searchsorted(starts, feeds), prepend=0, append=len(starts))  # words between line feeds
    line = np.repeat(np.arange(len(feeds) + 1), before) + row  # of the piece: a row starts a line too
    for begin, end in _runs(line):
        low = int(line[begin])
        key = distinct(((line[begin:end] - low).astype(np.uint64) << np.uint64(ID_BITS)) | hashes[begin:end])
        number = (key >> np.uint64(ID_BITS)).astype(np.int64) + low
        at = np.concatenate([[0], np.flatnonzero(number[1:] != number[:-1]) + 1, [len(number)]]) if len(number) else np.zeros(1, dtype=int)
        size = np.diff(at)
        kept = size >= least
        words = key & np.uint64((1 << ID_BITS) - 1)
        words = words if kept.all() else words[np.repeat(kept, size)]
        own = number[at[:-1][kept]]
        own_row = row[begin:end][np.searchsorted(line[begin:end], own)]
        yield own_row, own - own_row - border[own_row], np.concatenate([[0], np.cumsum(size[kept])]), words


def _runs(line: np.ndarray) -> Iterator[tuple[int, int]]:
    begin = 0
    while begin < len(line):
        end = int(np.searchsorted(line, line[begin] + PART, "left"))
        yield begin, end
        begin = end


def class_ids(at: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Fingerprint of every set."""
    if len(at) < 2:
        return np.zeros(0, dtype=np.uint64)
    size = np.diff(at).astype(np.uint64)
    return mix(np.bitwise_xor.reduceat(mix(words), at[:-1]) + mix(np.add.reduceat(mix(words ^ np.uint64(0xABCDEF)), at[:-1]) + size))


def one_of_each(at: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first line of every class."""
    _, first = np.unique(class_ids(at, words), return_index=True)
    size = np.diff(at)
    kept = np.zeros(len(size), dtype=bool)
    kept[first] = True
    return np.concatenate([[0], np.cumsum(size[kept])]), words[np.repeat(kept, size)]


def least_common(n, m, percent: int):
    return -((-percent * (n + m)) // (100 + percent))


LINES = "doc_id long, key long, lines array<int>, sizes array<int>, classes array<long>, gone array<int>, part int, slots binary, counts binary"
LINES_ARROW = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("lines", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())),
                         ("classes", pa.list_(pa.int64())), ("gone", pa.list_(pa.int32())), ("part", pa.int32()),
                         ("slots", pa.binary()), ("counts", pa.binary())])


def earliest(cls: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Which lines have the smallest place of their class here."""
    order = np.lexsort((*place[::-1], cls))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = cls[order][1:] == cls[order][:-1]
    level = same.copy()  # still at the place of the class's first line
    for p in place:
        level[1:] &= p[order][1:] == p[order][:-1]
    run = np.cumsum(~same) - 1  # number of the class
    moved = np.cumsum(same & ~level)
    out = np.empty(len(order), dtype=bool)
    out[order] = moved == moved[np.flatnonzero(~same)][run] if len(order) else moved == 0
    return out


def _survey(least: int):
    """(doc_id, key, text) -> a row of lines per text, and per task ``SLOT_PARTS`` rows of slot counts (in how many lines a slot's words are).

    ``lines`` are the earliest of their classes in the batch, ``gone`` those that another one of the batch precedes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            found = [(np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),)]
            for begin, texts in pieces(batch.column(2)):
                for row, line, at, words in line_sets(texts, least):
                    seen += np.bincount((words % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
                    found.append((row + begin, line, np.diff(at), class_ids(at, words)))
            row, line, size, cls = (np.concatenate(c) for c in zip(*found, strict=True))
            doc, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first = earliest(cls, doc[row], key[row], line)

            def lists(chosen, values, kind, row=row, n=batch.num_rows):
                cut = np.searchsorted(row[chosen], np.arange(n + 1)).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(cut), pa.array(values[chosen].astype(kind)))

            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), lists(first, line, np.int32), lists(first, size, np.int32), lists(first, cls.view(np.int64), np.int64),
                lists(~first, line, np.int32), *(pa.nulls(batch.num_rows, field.type) for field in list(LINES_ARROW)[6:])], schema=LINES_ARROW)
        slots = np.flatnonzero(seen)
        cut = np.searchsorted(slots, np.arange(SLOT_PARTS + 1) * (SLOTS // SLOT_PARTS))
        if len(slots):
            yield pa.RecordBatch.from_arrays([
                *(pa.nulls(SLOT_PARTS, field.type) for field in list(LINES_ARROW)[:6]), pa.array(range(SLOT_PARTS), pa.int32()),
                binaries(slots.astype(np.int32), cut), binaries(seen[slots], cut)], schema=LINES_ARROW)
    return run


def binaries(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """A binary per ``values[cut[i]:cut[i + 1]]``."""
    at = (cut * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def joined(column: pa.Array, kind) -> np.ndarray:
    """What the binaries of a column hold, one after the other."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]].view(kind) if data is not None else np.zeros(0, dtype=kind)


def _slot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, slots, counts) -> per part its sums, a number for each of its slots."""
    sums = {}
    for batch in batches:
        for i, part in enumerate(batch.column(0).to_pylist()):
            own = sums.setdefault(part, np.zeros(SLOTS // SLOT_PARTS, dtype=np.int64))
            slots = joined(batch.column(1).slice(i, 1), np.int32)
            own[slots - part * len(own)] += joined(batch.column(2).slice(i, 1), np.int64)
    for part, own in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), binaries(own, np.array([0, len(own)]))], names=["part", "sums"])


def rarity(counts: np.ndarray) -> np.ndarray:
    """Slot counts on a logarithmic scale of one byte; 0: at most one line."""
    return np.minimum(255, np.where(counts < 2, 0, np.ceil(8 * np.log2(np.maximum(counts, 1))))).astype(np.uint8)


# Sizes from which a sketch has 128, 256, ... bits: wide enough to tell unrelated lines apart with Jaccard 0.8.
WIDER = np.array([54, 160, 400, 900, 2000])


def sketch_words(size: np.ndarray) -> np.ndarray:
    """64-bit numbers that the sketch of a set of this size has."""
    return 1 << np.searchsorted(WIDER, size, "right")


def parity_sketches(at: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A sketch per set, one after the other: every word toggles one bit. Folding a wide sketch gives the narrow one."""
    size = np.diff(at)
    width = sketch_words(size)
    begin, end = np.cumsum(width) - width, int(width.sum())
    bit = (mix(words ^ np.uint64(0x5EED)) & np.repeat((64 * width - 1).astype(np.uint64), size)).astype(np.int64)
    odd = (np.bincount(bit + np.repeat(64 * begin, size), minlength=64 * end) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8")


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``begin[i], begin[i] + 1, ...``, ``size[i]`` of them, one run after the other."""
    return np.arange(int(size.sum())) + np.repeat(begin - np.cumsum(size) + size, size)


class Sketches:
    """Sketches of rows by width, to compare pairs of rows at the narrower width of the two.

    Row i has its sketch at ``begin[i]`` of ``numbers``.
    """

    def __init__(self, size: np.ndarray, begin: np.ndarray, numbers: np.ndarray):
        self.width = sketch_words(size)
        self.row, self.by_width, self.fold = np.zeros(len(size), dtype=np.int64), {}, np.zeros(len(size), dtype=np.uint64)
        for w in np.unique(self.width).tolist():
            rows = np.flatnonzero(self.width == w)
            self.row[rows] = np.arange(len(rows))
            self.by_width[w] = numbers[begin[rows][:, None] + np.arange(w)]
            self.fold[rows] = np.bitwise_xor.reduce(self.by_width[w], axis=1)

    def folded(self, rows: np.ndarray, w: int, to: int) -> np.ndarray:
        return np.bitwise_xor.reduce(self.by_width[w][self.row[rows]].reshape(len(rows), w // to, to), axis=1)

    def distance(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=np.int64)
        for a in self.by_width:
            for b in self.by_width:
                pair = np.flatnonzero((self.width[i] == a) & (self.width[j] == b))
                if len(pair):
                    x, y = self.folded(i[pair], a, min(a, b)), self.folded(j[pair], b, min(a, b))
                    out[pair] = np.bitwise_count(x ^ y).sum(axis=1)
        return out


PREFIX = "range int, bucket binary, cls binary, sketch binary, fit binary"
PREFIX_NAMES = [c.split()[0] for c in PREFIX.split(", ")]
PLACE_BITS, SIDE_BITS = 25, 2  # of ``fit``, which holds size, place and side


def bucket_ranges(words: int, percent: int) -> int:
    """How many ranges the buckets are cut into, a power of two, if the lines have so many words."""
    return 1 << max(0, -(-words * (100 - percent) // (100 * RANGE_ROWS)) - 1).bit_length()


def _prefixes(least: int, percent: int, rank: np.ndarray, ranges: int):
    """(text) -> the prefix words of every line and the buckets they belong to, a row per batch and range of buckets.

    A bucket is a word, or two of the blocks that a common word is cut into; there ``side`` says which of the two is
    the own block, else it is 0. Lines so short that only equal sets match them send nothing.
    """
    least = max(least, -(-percent // (100 - percent)) if percent < 100 else 1 << 62)
    shift = np.uint64(65 - ranges.bit_length())

    def entries(texts: Texts) -> Iterator[tuple[np.ndarray, ...]]:
        for _, _, at, words in line_sets(texts, least):
            if not len(words):
                continue
            at, words = one_of_each(at, words)
            size, cls = np.diff(at), class_ids(at, words)
            line = np.repeat(np.arange(len(size), dtype=np.uint64), size)
            rare = rank[(words % np.uint64(SLOTS)).astype(np.int64)].astype(np.uint64)
            key = np.sort((line << np.uint64(45)) | (rare << np.uint64(37)) | (words >> np.uint64(ID_BITS - 37)))
            position = np.arange(len(key)) - np.repeat(at[:-1], size)
            prefix = size - -((-percent * size) // 100) + 1
            rare = ((key >> np.uint64(37)) & np.uint64(255)).astype(np.int64)
            use = (position < np.repeat(prefix, size)) & (rare > 0)  # a word of one line finds nobody
            owner = np.repeat(np.arange(len(size)), size)[use]
            word, rare = (key & np.uint64((1 << 45) - 1))[use], rare[use]
            blocks = np.maximum(1, np.ceil(2.0 ** (rare / 8) / BLOCK_LINES)).astype(np.int64)
            own = (mix(cls[owner] ^ np.uint64(0xB10C)) % blocks.astype(np.uint64)).astype(np.int64)
            times = np.repeat(np.arange(len(owner)), blocks)
            other = np.arange(len(times)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            mine = own[times]
            pair = (np.minimum(mine, other) << 32) | np.maximum(mine, other)
            bucket = mix(word[times] ^ mix(pair.astype(np.uint64)))
            side = np.where(mine == other, 0, np.where(mine < other, 1, 2))
            fit = (size[owner][times] << PLACE_BITS + SIDE_BITS) | (position[use][times] << SIDE_BITS) | side
            yield bucket, owner[times], fit, cls, parity_sketches(at, words), sketch_words(size)

    def sent(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        lines, numbers = (np.cumsum([0] + [len(h[k]) for h in held]) for k in (3, 4))
        bucket, fit, cls, sketch, width = (np.concatenate([h[k] for h in held]) for k in (0, 2, 3, 4, 5))
        owner = np.concatenate([h[1] + n for h, n in zip(held, lines, strict=False)])
        begin = np.concatenate([np.cumsum(h[5]) - h[5] + n for h, n in zip(held, numbers, strict=False)])
        number = (bucket >> shift).astype(np.int32) if ranges > 1 else np.zeros(len(bucket), dtype=np.int32)
        order = np.argsort(number.astype(np.uint16) if ranges <= 1 << 16 else number, kind="stable")
        number, owner = number[order], owner[order]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]])
        wide = width[owner]
        ends = np.concatenate([[0], np.cumsum(wide)])
        return pa.RecordBatch.from_arrays([
            pa.array(number[cut[:-1]]), binaries(bucket[order], cut), binaries(cls[owner], cut), binaries(sketch[spans(begin[owner], wide)], ends[cut]),
            binaries(fit[order], cut)], names=PREFIX_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for _, texts in pieces(batch.column(0)):
                for found in entries(texts):
                    if len(found[0]):
                        held.append(found)
                        rows += len(found[0])
                    if rows >= SENT_ROWS:
                        yield sent(held)
                        held, rows = [], 0
        if held:
            yield sent(held)
    return run


def whole_groups(batches: Iterator[pa.RecordBatch], columns: int, weigh, limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Sorted batches cut where a group (of equal values in the first ``columns``) ends, each time ``limit`` is reached."""
    held, weight, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy() for i in range(columns)]
        fresh = np.zeros(batch.num_rows, dtype=bool)
        fresh[0] = last is not None and last != [k[0] for k in keys]
        for k in keys:
            fresh[1:] |= k[1:] != k[:-1]
        total, begin = np.concatenate([[0], np.cumsum(weigh(batch))]), 0
        for cut in np.flatnonzero(fresh).tolist():
            if weight + total[cut] - total[begin] >= limit:
                if cut > begin:
                    held.append(batch.slice(begin, cut - begin))
                yield held
                held, weight, begin = [], 0, cut
        held.append(batch.slice(begin))
        weight += total[-1] - total[begin]
        last = [k[-1] for k in keys]
    if held:
        yield held


def eights(name: str):
    """How many 64-bit numbers a binary column holds, by row."""
    return lambda batch: pc.binary_length(batch.column(name)).to_numpy(zero_copy_only=False).astype(np.int64) // 8


def allowed_ties(cols: dict[str, np.ndarray], sketches: Sketches, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Ties between classes that share a prefix word and pass all filters; rows sorted by (bucket, size).

    Neighbours at distance 1, 2, ... inside their buckets are compared for all buckets at once, as far as the longer
    line is not too long; the shorter one only by a shorter prefix, which suffices for it. Pairs that are tied already
    are skipped, so a bucket of m classes gives at most m - 1 ties.
    """
    size, place = cols["size"].astype(np.int64), cols["place"].astype(np.int64)
    bucket = np.concatenate([[0], np.cumsum(cols["bucket"][1:] != cols["bucket"][:-1])])
    last = np.searchsorted(bucket, bucket, "right")  # where the row's bucket ends
    longest = 100 * size // percent
    widest = (size + longest) - 2 * least_common(size, longest, percent) + 1  # most that a linked pair can differ
    parent, ties, fold = np.arange(len(bucket)), [], sketches.fold

    def roots(x: np.ndarray) -> np.ndarray:
        r = parent[x]
        while True:
            higher = parent[r]
            if (higher == r).all():
                parent[x] = r
                return r
            r = higher

    left, step = np.flatnonzero(place <= size - least_common(size, size, percent)), 1
    while len(left):
        left = left[left + step < last[left]]
        left = left[size[left + step] <= longest[left]]
        i = left[np.bitwise_count(fold[left] ^ fold[left + step]) <= widest[left]]
        j = i + step
        step += 1
        apart = roots(i) != roots(j)
        i, j = i[apart], j[apart]
        if not len(i):
            continue
        n, m = size[i], size[j]
        need = least_common(n, m, percent)
        good = (cols["side"][i] == 0) | (cols["side"][i] != cols["side"][j])
        good &= (np.minimum(place[i], place[j]) + np.minimum(n - place[i], m - place[j]) >= need) & (cols["cls"][i] != cols["cls"][j])
        i, j, differ = i[good], j[good], (n + m - 2 * need)[good]
        good = sketches.distance(i, j) <= differ
        i, j = i[good], j[good]
        while len(i):  # join what is still apart; several pairs may name one row
            x, y = roots(i), roots(j)
            a, b = np.minimum(x, y), np.maximum(x, y)
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            _, once = np.unique(b, return_index=True)
            parent[b[once]] = a[once]
            ties.append(np.stack([i[once], j[once]]))
    both = np.concatenate(ties, axis=1) if ties else np.zeros((2, 0), dtype=np.int64)
    return cols["cls"][both[0]], cols["cls"][both[1]]


def _tie(percent: int):
    """Prefix rows sorted by range -> ties (a, b); whole ranges are taken from the stream, some hundred thousand words at a time."""
    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        bucket, cls, fit, sketch = (np.concatenate([joined(p.column(n), k) for p in parts]) for n, k in (
            ("bucket", np.uint64), ("cls", np.int64), ("fit", np.int64), ("sketch", np.uint64)))
        size = fit >> PLACE_BITS + SIDE_BITS
        width = sketch_words(size)
        begin = np.cumsum(width) - width
        order = np.argsort(bucket)
        same = bucket[order][1:] == bucket[order][:-1]
        number = np.concatenate([[0], np.cumsum(~same)])
        shared = np.zeros(len(order), dtype=bool)  # a bucket of one row ties nothing
        shared[1:] = same
        shared[:-1] |= same
        order, number = order[shared], number[shared]
        again = np.lexsort((cls[order], (number << PLACE_BITS + 1) + size[order]))
        order, number = order[again], number[again]
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (np.diff(number) != 0) | (np.diff(cls[order]) != 0)  # a class once per bucket
        order, number = order[fresh], number[fresh]
        size = size[order]
        cols = {"bucket": number, "cls": cls[order], "size": size,
                "place": (fit[order] >> SIDE_BITS) & (1 << PLACE_BITS) - 1, "side": fit[order] & (1 << SIDE_BITS) - 1}
        a, b = allowed_ties(cols, Sketches(size, begin[order], sketch), percent) if len(order) else (np.zeros(0, dtype=np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in whole_groups(batches, 1, eights("cls"), HELD_ROWS):
            yield solve(parts)
    return run


def held_by(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which numbers may be in a filter."""
    slot = x % np.uint64(FILTER_BITS)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def _members(least: int, wanted: np.ndarray, keys: np.ndarray):
    """(doc_id, key, text) -> the word sets of lines whose class may be in the filter of wanted classes, of rows whose key may be in theirs."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        batch = batch.filter(pa.array(held_by(keys, batch.column(1).to_numpy().view(np.uint64))))
        if not batch.num_rows:
            return None
        rows, line, cls, sets = [], [], [], []
        for begin, texts in pieces(batch.column(2)):
            for row, number, at, words in line_sets(texts, least):
                own = class_ids(at, words)
                for i in np.flatnonzero(held_by(wanted, own)).tolist():
                    rows.append(begin + int(row[i]))
                    line.append(int(number[i]))
                    cls.append(int(own[i].view(np.int64)))
                    sets.append(words[at[i]:at[i + 1]].tobytes())
        rows = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([
            batch.column(0).take(rows), batch.column(1).take(rows), pa.array(line, pa.int32()), pa.array(cls, pa.int64()), pa.array(sets, pa.binary())],
            names=["doc_id", "key", "line", "cls", "words"])
    return in_batches(run)


def later_matches(order: list[tuple], sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[int]:
    """Rows that match an earlier row; if both sides occur, only pairs across sides count."""
    rank = sorted(range(len(order)), key=lambda i: order[i])
    size = np.array([len(sets[i]) for i in rank])
    side = side[rank]
    across = side.min() != side.max()
    vocabulary, code = np.unique(np.concatenate([sets[i] for i in rank]), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    mine, gone = np.zeros(len(vocabulary), dtype=np.int64), []
    for i in range(1, len(rank)):
        own = code[at[i]:at[i + 1]]
        mine[own] = 1
        begin, step = 0, 16
        while begin < i:
            end = min(i, begin + step)
            common = np.add.reduceat(mine[code[at[begin]:at[end]]], at[begin:end] - at[begin])
            match = 100 * common >= percent * (size[begin:end] + size[i] - common)
            if across:
                match &= side[begin:end] != side[i]
            if match.any():
                gone.append(rank[i])
                break
            begin, step = end, step * 4
        mine[own] = 0
    return gone


FEW = 24  # lines of a work item that are compared together with those of other items


def pair_matches(a: np.ndarray, b: np.ndarray, at: np.ndarray, words: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets ``a[i]`` and ``b[i]`` match."""
    n, m = np.diff(at)[a], np.diff(at)[b]
    total, out, begin = np.concatenate([[0], np.cumsum(n + m)]), np.zeros(len(a), dtype=bool), 0
    while begin < len(a):
        end = min(begin + (1 << 63 - ID_BITS), max(begin + 1, int(np.searchsorted(total, total[begin] + PART))))
        end = min(end, len(a))
        own = slice(begin, end)
        pair = np.arange(end - begin, dtype=np.uint64) << np.uint64(ID_BITS)
        key = np.sort(np.concatenate([np.repeat(pair, x[own]) | words[spans(at[s[own]], x[own])] for s, x in ((a, n), (b, m))]))
        common = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(ID_BITS)).astype(np.int64), minlength=end - begin)
        out[own] = 100 * common >= percent * (n[own] + m[own] - common)
        begin = end
    return out


def _verify(percent: int):
    """Rows sorted by (grp, low, high) -> lines that an earlier line matches."""
    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        grp, low, high, own, cls, doc, key, line = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in range(8))
        size = np.concatenate([eights("words")(p) for p in parts])
        words, begin = np.concatenate([joined(p.column("words"), np.uint64) for p in parts]), np.cumsum(size) - size
        order = np.lexsort((cls, line, key, doc, high, low, grp))
        fresh = np.zeros((2, len(order)), dtype=bool)  # where a work item begins, and a line of it (a row of the table may be repeated)
        fresh[:, 0] = True
        for k, c in enumerate((grp, low, high, cls)):
            fresh[k // 3:, 1:] |= c[order][1:] != c[order][:-1]
        order, first = order[fresh[1]], np.flatnonzero(fresh[0][fresh[1]])
        at = np.concatenate([[0], np.cumsum(size[order])])
        words, side = words[spans(begin[order], size[order])], (own == high)[order]
        gone, count = np.zeros(len(order), dtype=bool), np.diff(np.append(first, len(order)))
        few = np.repeat(count <= FEW, count)
        after = np.where(few, np.arange(len(order)) - np.repeat(first, count), 0)  # lines of the item before this one
        b = np.repeat(np.arange(len(order)), after)
        a = spans(np.repeat(first, count), after)
        across = np.repeat(np.logical_or.reduceat(side, first) & ~np.logical_and.reduceat(side, first), count)
        chosen = ~across[b] | (side[a] != side[b])
        a, b = a[chosen], b[chosen]
        gone[b[pair_matches(a, b, at, words, percent)]] = True
        for i in np.flatnonzero(count > FEW).tolist():
            rows = range(first[i], first[i] + count[i])
            found = later_matches([(r,) for r in rows], [words[at[r]:at[r + 1]] for r in rows], side[first[i]:first[i] + count[i]].astype(int), percent)
            gone[np.array(found, dtype=np.int64) + first[i]] = True
        order = order[gone]
        return pa.RecordBatch.from_arrays([pa.array(doc[order]), pa.array(key[order]), pa.array(line[order])], names=PLACE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in whole_groups(batches, 3, eights("words"), PART):
            yield solve(parts)
    return run


PLACE = ["doc_id", "key", "line"]


def _gone(docs: DataFrame, percent: int, least: int) -> DataFrame:
    """``doc_id, key, line`` of every line that goes; key is the row key of the row it stands in."""
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    texts = docs.where(F.col("doc_id").isNotNull()).select(doc.alias("doc_id"), row_key(doc, text).alias("key"), text.alias("text"))
    survey = stored(texts.mapInArrow(_survey(least), LINES))
    lines = survey.where("part IS NULL").select("doc_id", "key", F.explode(F.arrays_zip("lines", "classes", "sizes")).alias("x")).select(
        "doc_id", "key", F.col("x.lines").alias("line"), F.col("x.classes").alias("cls"), F.col("x.sizes").alias("size"))
    places = Window.partitionBy("cls").orderBy(*PLACE)
    ranked = lines.select("*", F.row_number().over(places).alias("n"), (F.rank().over(places) > 1).alias("later"))
    ranked = stored(ranked.where("n = 1 OR later").drop("n"))  # of a class the first line, and those that go with any outcome
    firsts = ranked.where("NOT later")

    # At most SLOTS numbers reach the driver, and one byte each goes to the tasks.
    counts = np.zeros(SLOTS, dtype=np.int64)
    slots = survey.where("part IS NOT NULL").select("part", "slots", "counts").repartition("part")
    for row in slots.mapInArrow(_slot_sums, "part int, sums binary").toArrow().to_pylist():
        own = np.frombuffer(row["sums"], dtype=np.int64)
        counts[row["part"] * len(own):(row["part"] + 1) * len(own)] = own
    rank, ranges = rarity(counts), bucket_ranges(int(counts.sum()), percent)

    prefixes = texts.select("text").mapInArrow(_prefixes(least, percent, rank, ranges), PREFIX).repartition("range")
    ties = prefixes.sortWithinPartitions("range").mapInArrow(_tie(percent), "a long, b long")
    stars = connected_components(ties, "a", "b")
    groups = stored(stars.union(stars.select("component", "component").distinct()).toDF("cls", "grp").join(firsts, "cls"))

    # Filters of FILTER_BITS over the tied classes and their rows spare most texts the cutting and most lines the way to the next shuffle.
    slot = groups.select(F.posexplode(F.array("cls", "key")).alias("kind", "x")).select("kind", (F.col("x").bitwiseAND(FILTER_BITS - 1)).cast("int").alias("slot"))
    filled = slot.groupBy("kind", F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, slot % 64)")).alias("bits"))
    wanted = np.zeros((2, FILTER_BITS // 64), dtype=np.uint64)
    for batch in filled.toArrow().to_batches():
        wanted[batch.column(0).to_numpy(), batch.column(1).to_numpy()] = batch.column(2).to_numpy().view(np.uint64)
    sets = texts.mapInArrow(_members(least, *wanted), "doc_id long, key long, line int, cls long, words binary")
    blocks = groups.groupBy("grp").agg(F.ceil(F.sum("size") / F.lit(BLOCK_WORDS)).cast("int").alias("blocks"))
    placed = groups.join(blocks, "grp").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("grp", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "cls", *PLACE)
    items = placed.join(sets, ["cls", *PLACE]).select("grp", "low", "high", "own", "cls", *PLACE, "words")
    gone = items.repartition("grp", "low", "high").sortWithinPartitions("grp", "low", "high").mapInArrow(
        _verify(percent), "doc_id long, key long, line int")

    # The first line of a class goes if its set is matched, the others go anyway.
    sure = survey.where("part IS NULL").select("doc_id", "key", F.explode("gone").alias("line"))
    return gone.union(ranked.where("later").select(*PLACE)).union(sure)


def repeated_lines(docs: DataFrame, percent: int = 80, least: int = 1) -> DataFrame:
    """``doc_id, line`` (number from 0) of every line that matches an earlier one, and so should go.

    Lines end at ``\\n``; only lines with a word are compared, and with ``least`` only those of so many distinct words.
    Null texts have no lines. Rows with a null doc_id take no part. Rows of one id and different texts are rows of
    their own, in a fixed order. Rows that agree in both count once: of their equal lines those with the same number
    stand or fall together. An empty table gives no rows.
    """
    return _gone(docs, percent, least).select("doc_id", "line").distinct()


@F.arrow_udf(StringType())
def _without_lines(text: pa.Array, gone: pa.Array) -> pa.Array:
    out = []
    for t, g in zip(text, gone, strict=True):
        if t.is_valid and g.is_valid:
            lines = t.as_buffer().to_pybytes().split(b"\n")
            for number in g.as_py():
                lines[number] = None
            out.append(b"\n".join([x for x in lines if x is not None]).decode())
        else:
            out.append(t.as_py())
    return pa.array(out, pa.string())


def without_repeated_lines(docs: DataFrame, percent: int = 80, least: int = 1, removed: str | None = None) -> DataFrame:
    """``docs`` with the text of every row rid of ``repeated_lines``; other columns stay, whatever their names.

    ``removed`` names a further column with the numbers of the removed lines (empty array if none).
    """
    own, key, gone = free_names(docs, "id", "row_key", "gone")
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    lines = _gone(docs.select("doc_id", "text"), percent, least).groupBy(F.col("doc_id").alias(own), F.col("key").alias(key)).agg(
        F.sort_array(F.collect_set("line")).alias(gone))
    rows = docs.join(lines, (doc == F.col(own)) & (row_key(doc, text) == F.col(key)), "left")
    # A deterministic function would be copied into a later filter on the text: a second pass, and twice the workers a task.
    cut = _without_lines.asNondeterministic()(text, F.col(gone))
    columns = [cut.alias(c) if c == "text" else F.col(c) for c in docs.columns]
    if removed:
        columns.append(F.coalesce(gone, F.array().cast("array<int>")).alias(removed))
    return rows.select(*columns)
