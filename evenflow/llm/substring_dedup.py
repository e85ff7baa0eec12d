"""Substring deduplication by recompression: word sequences that occur again anywhere in the corpus.

Recompression names a text level by level. First every maximal run of one word becomes a symbol. Then, level by level,
a coin thrown by hashing puts every symbol on the left or the right side, and each left symbol followed by a right one
becomes the name of the pair. Names are hashes of what they name, so all tasks give equal runs and pairs equal names
without a dictionary. Whether a symbol joins a pair depends on its neighbours only, so equal substrings get equal
symbols inside; at their borders one run, and at each level at most one symbol a side, may be named with the outside.

Those border symbols, taken off level by level, and the inside that is left after ``LEVELS`` levels are a signature of
a window: windows are equal when signatures are. A Spark round counts the high-level symbols of the whole corpus. A window
holding one that occurs once is unique. The signatures of the other windows, with a second hash of their words, are
counted in another Spark round, and words under windows found twice go.

A key is hashed with its batch's other rows first: of several equal ones a batch sends one on, and knows by itself
that the others are repeated. So a symbol or passage that a third of all texts share has one row a batch, and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenflow.llm.text import Texts, distinct, mix, pieces, word_hashes

LEVELS = 6  # of pairs: a symbol stands for about six words
ODD, FACTOR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))


class Level:
    """Symbols of many texts: names, and for symbol i of the level below its place here."""

    def __init__(self, names: np.ndarray, head: np.ndarray, place: np.ndarray):
        self.names, self.head, self.place = names, head, place  # head: first symbol of its text


def run_level(words: np.ndarray, head: np.ndarray) -> tuple[Level, np.ndarray]:
    """Maximal runs of equal words, and their lengths; a run of one keeps its name."""
    first = np.ones(len(words), dtype=bool)
    first[1:] = (words[1:] != words[:-1]) | head[1:]
    at = np.flatnonzero(first)
    length = np.diff(np.append(at, len(words)))
    names, long = words[at], length > 1
    names[long] = mix(names[long] + length[long].astype(np.uint64) * ODD)
    return Level(names, head[at], np.cumsum(first) - 1), length


def on_the_left(names: np.ndarray, level: int) -> np.ndarray:
    return mix(names ^ mix(np.array([level + 1], dtype=np.uint64))) >> np.uint64(63) == 0


def pair_level(below: Level, left: np.ndarray) -> Level:
    """Every left symbol followed by a right one of its text becomes a pair."""
    second = np.zeros(len(left), dtype=bool)
    second[1:] = left[:-1] & ~left[1:] & ~below.head[1:]
    at = np.flatnonzero(~second)
    place = np.cumsum(~second) - 1
    names, pair = below.names[at], np.flatnonzero(second)
    names[place[pair]] = mix(mix(below.names[pair - 1] ^ ODD) * FACTOR + below.names[pair])
    return Level(names, below.head[at], place)


class Recompressed:
    """All levels of the texts of a piece. ``rows[i]:rows[i + 1]`` are the words of text i."""

    def __init__(self, texts: Texts, levels: int):
        starts, ends, self.rows = texts.words()
        self.words = word_hashes(texts.data, starts, ends)
        head = np.zeros(len(self.words) + 1, dtype=bool)
        head[self.rows] = True
        level, self.length = run_level(self.words, head[:-1])
        self.levels, self.left = [level], []
        for number in range(levels):
            self.left.append(on_the_left(level.names, number))
            level = pair_level(level, self.left[-1])
            self.levels.append(level)
        self.top = level.names

    def text_of_symbol(self) -> np.ndarray:
        """Number of the text of every top symbol."""
        owner = np.flatnonzero(np.diff(self.rows) > 0)
        return owner[np.cumsum(self.levels[-1].head) - 1] if len(owner) else np.zeros(0, dtype=np.int64)

    def windows(self, size: int, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word in it and two keys of every window of ``size`` words that holds no unrepeated top symbol."""
        count = np.maximum(np.diff(self.rows) - size + 1, 0)
        text = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        start = self.rows[text] + at
        run = self.levels[0].place
        end = np.cumsum(self.length)  # words before the end of a run
        own, last = run[start], run[start + size - 1]
        first_word, last_word = self.words[start], self.words[start + size - 1]
        in_first = np.minimum(end[own] - start, size).astype(np.uint64)
        in_last = np.minimum(start + size - (end[last] - self.length[last]), size).astype(np.uint64)
        front, back = mix(first_word + in_first * ODD), mix(last_word + in_last * FACTOR)
        low, high = own + 1, np.maximum(last, own + 1)  # the inside: symbols low, ..., high - 1
        for number, (below, left) in enumerate(zip(self.levels, self.left, strict=False)):
            names, tag = below.names, np.uint64(number + 1)
            open_ = np.flatnonzero(low < high)
            off = open_[~left[low[open_]]]  # a right symbol in front may be the second of a pair with the outside
            front[off] = mix((front[off] ^ names[low[off]]) * ODD + tag)
            low[off] += 1
            open_ = open_[low[open_] < high[open_]]
            off = open_[left[high[open_] - 1]]
            back[off] = mix((back[off] ^ names[high[off] - 1]) * FACTOR + tag)
            high[off] -= 1
            place = self.levels[number + 1].place
            open_ = np.flatnonzero(low < high)
            shut = np.flatnonzero(low >= high)
            low[open_], high[open_] = place[low[open_]], place[high[open_] - 1] + 1
            low[shut] = high[shut] = 0
        unseen = np.concatenate([[0], np.cumsum(~_among(self.top & np.uint64((1 << 31) - 1), repeated))])
        kept = np.flatnonzero(unseen[high] == unseen[low])
        text, at, start, low, high = text[kept], at[kept], start[kept], low[kept], high[kept]
        inside = _stretch(self.top, low, high)
        one = mix(mix(front[kept] * ODD + inside) ^ back[kept])
        return text, at, one, mix(_stretch(self.words, start, start + size))


def _stretch(names: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of names[low:high] for many stretches: differences of one running polynomial, shifted to power 0."""
    power = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(len(names), FACTOR)]))
    back = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(len(names), INVERSE)]))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(names) * power[:-1], dtype=np.uint64)])
    return (total[high] - total[low]) * back[low] + (high - low).astype(np.uint64)


def _among(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``of``."""
    if not len(of):
        return np.zeros(len(values), dtype=bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


KEY = ["key", "mark"]
# Rows are kept short: ``name`` is null where it equals ``spread``; the last bit of ``sure`` and ``place`` is 1 where the
# batch has seen another one, the rest of ``sure`` is the mark, and ``place`` holds the first word and, from bit 32 on,
# the length of a stretch (0: one window).
SYMBOLS = "spread long, name long, key long, sure long"
WINDOWS = "one long, two int, key long, mark int, place long"


def _first_of_each(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by their keys, whether a row is the first of equal ones, and how many are equal to it."""
    order = np.lexsort(keys[::-1])
    first = np.ones(len(order), dtype=bool)
    for k in keys:
        first[1:] &= k[order][1:] == k[order][:-1]
    first[1:] = ~first[1:]
    begin = np.flatnonzero(first)
    return order, first, np.repeat(np.diff(np.append(begin, len(order))), np.diff(np.append(begin, len(order))))


def _symbols(levels: int):
    """(key, mark, text) -> a row per text and distinct top symbol of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
            for begin, piece in pieces(batch.column(2)):
                found = Recompressed(piece, levels)
                names.append(found.top)
                texts.append(found.text_of_symbol() + begin)
            name, text = np.concatenate(names), np.concatenate(texts)
            if not len(name):
                continue
            order, first, n = _first_of_each(name)
            fresh = first.copy()
            fresh[1:] |= np.diff(text[order]) != 0  # once a text
            order, first, n = order[fresh], first[fresh], n[fresh]
            by_text = np.argsort(order)
            order, first, n = order[by_text], first[by_text], n[by_text]
            name, text = name[order], text[order]
            spread = np.where(first, name, mix(name + (text.astype(np.uint64) + np.uint64(1)) * ODD))
            rows = pa.array(text)
            mark = batch.column(1).take(rows).to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(spread.view(np.int64)), pa.array(name.view(np.int64), mask=first), batch.column(0).take(rows), pa.array(mark * 2 + (n > 1)),
            ], names=["spread", "name", "key", "sure"])
    return run


def _stretches(text: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``size`` words, sorted by text and place -> text, first word and length of what they cover together."""
    if not len(text):
        return text, at, at
    apart = np.ones(len(text), dtype=bool)
    apart[1:] = (text[1:] != text[:-1]) | (at[1:] > at[:-1] + size)
    begin = np.flatnonzero(apart)
    end = np.append(begin[1:], len(text)) - 1
    return text[begin], at[begin], at[end] + size - at[begin]


def _windows(levels: int, size: int):
    """(key, mark, doc_id, text, names of repeated symbols) -> a row per window that may be repeated.

    Windows found twice in a batch come as one row with the window's keys, and as stretches with keys of their own.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, lists = [], batch.column(4)
            for begin, piece in pieces(batch.column(3)):
                repeated = distinct(lists.slice(begin, len(piece)).flatten().to_numpy(zero_copy_only=False).astype(np.uint64))
                text, at, one, two = Recompressed(piece, levels).windows(size, repeated)
                parts.append((text + begin, at, one, two))
            if not parts:
                continue
            text, at, one, two = (np.concatenate(c) for c in zip(*parts, strict=True))
            order, first, n = _first_of_each(one, two)
            again = np.sort(order[~first])
            sure = _stretches(text[again], at[again], size)
            own = np.sort(order[first])
            count = np.empty(len(text), dtype=np.int64)
            count[order] = n
            spread = mix(sure[0].astype(np.uint64) * ODD + sure[1].astype(np.uint64))
            rows = pa.array(np.concatenate([text[own], sure[0]]))
            place = np.concatenate([at[own] << 1 | (count[own] > 1), sure[2] << 32 | sure[1] << 1 | 1])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([one[own], spread]).view(np.int64)),
                pa.array(np.concatenate([(two[own] >> np.uint64(40)).astype(np.int32), np.full(len(sure[0]), -1, dtype=np.int32)])),
                batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place),
            ], names=[c.split()[0] for c in WINDOWS.split(", ")])
    return run


def _cut(size: int):
    """(key, mark, doc_id, text, found) -> the document without the words that are covered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(cut, batches)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, n_words, n_removed, spans = [], [], [], []
        for text, found in zip(batch.column(3), batch.column(4), strict=True):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            covered = _union(found.values, size) if found.is_valid else []
            for a, b in reversed(covered):
                del words[a:b]
            gone = sum(b - a for a, b in covered)
            n_words.append(len(words) + gone)
            n_removed.append(gone)
            spans.append([{"first": a, "stop": b} for a, b in covered])
            kept.append(b" ".join(words).decode())
        return pa.RecordBatch.from_arrays([
            batch.column(2), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, SPANS_ARROW), pa.array(kept, pa.string()),
        ], names=["doc_id", "n_words", "n_removed", "spans", "kept"])
    return run


SPANS_ARROW = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))
CLEANED = "doc_id long, n_words long, n_removed long, spans array<struct<first: long, stop: long>>, kept string"


def _union(found: pa.Array, window: int) -> list[tuple[int, int]]:
    """Spans (first word, end) that the found places cover, in order."""
    place = found.to_numpy()
    at, length = (place & 0xFFFFFFFF) >> 1, place >> 32
    order = np.argsort(at, kind="stable")
    at, length = at[order], length[order]
    stop = np.maximum.accumulate(at + np.where(length > 0, length, window))
    begin = np.flatnonzero(np.concatenate([[True], at[1:] > stop[:-1]]))
    return list(zip(at[begin].tolist(), stop[np.append(begin[1:], len(at)) - 1].tolist(), strict=True))


def without_repeated_passages(docs: DataFrame, window: int = 35, levels: int = LEVELS) -> DataFrame:
    """``doc_id, n_words, n_removed, spans, kept`` of every row of ``docs`` (doc_id, text).

    Words are runs of characters other than ASCII white space, unchanged. A word goes when a run of ``window``
    consecutive words around it also starts at another place, in the same text or in another row; all runs are judged
    on the input. ``spans`` are the word numbers removed (first, stop), ``kept`` is the rest joined by single spaces.

    A null or blank text has no words, and kept is empty. A null doc_id is kept like any other. Repeated rows repeat
    each other's text, so both lose it. Texts shorter than ``window`` stay. Other columns are not read. An empty table
    gives no rows. Equality rests on 64-bit names, and 88 bits of keys for every window. Work and data shuffled grow
    with the number of words; a batch holds no more than its own rows.
    """
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    texts = docs.select(F.xxhash64(doc, text).alias("key"), F.hash(text, doc).alias("mark"), doc.alias("doc_id"), text.alias("text"))
    same_name, same_window = Window.partitionBy("spread"), Window.partitionBy("one", "two")
    symbols = texts.select(*KEY, "text").mapInArrow(_symbols(levels), SYMBOLS)
    symbols = symbols.withColumn("total", F.sum(F.col("sure").bitwiseAND(F.lit(1)) + 1).over(same_name)).where("total > 1")
    named = symbols.groupBy("key", F.shiftright("sure", 1).cast("int").alias("mark")).agg(
        F.collect_list(F.coalesce("name", "spread").bitwiseAND(F.lit((1 << 31) - 1)).cast("int")).alias("names"))  # a filter: part of a name will do
    windows = texts.join(named, KEY, "left").select(*KEY, "doc_id", "text", "names").mapInArrow(_windows(levels, window), WINDOWS)
    windows = windows.withColumn("total", F.sum(F.col("place").bitwiseAND(F.lit(1)) + 1).over(same_window)).where("total > 1")
    found = windows.groupBy(*KEY).agg(F.collect_list("place").alias("found"))
    return texts.join(found, KEY, "left").select(*KEY, "doc_id", "text", "found").mapInArrow(_cut(window), CLEANED)
