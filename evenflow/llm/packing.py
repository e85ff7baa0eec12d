"""Packing token sequences by lexical retrieval.

Documents are laid in an order of their content: a tree of projections of BM25 term weights, fitted on a bounded sample,
gives every document a leaf and a value, and equal or similar documents come to lie together. The ordered documents are
cut into shards of a bounded number of tokens. A shard is an inverted index: a window starts with a seed document, the
postings of all of the seed's terms return its unused neighbours, best BM25 score first, and they fill the window
greedily. The document that reaches the window's end is cut there and its rest is the seed of the next window.

A task fills the shards of a stretch of the order one after the other and goes on with the window that the last shard
left open. The one window that each task leaves open at its end is joined with those of the other tasks.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenflow.llm.store import stored
from evenflow.llm.text import LOWER, SPACE, Texts, mix, pieces

K1, B = 1.2, 0.75
SAMPLE, WIDTH, DEPTH, LEAST_LEAF = 4000, 256, 6, 16  # documents that fit the order, sketch width, tree depth
TASK_SHARDS = 2
DENSE, FIRST = 0.1, 64  # share of documents from which a term is scored densely; neighbours that are sorted at once
CACHE_WORDS = 300_000
MARK = np.isin(np.arange(256), list(b".,;:!?#*$%&|<>()"))
PLAIN = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))


def with_marks_apart(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in lower case with a blank before every run of marks that ends a plain word, and the rows' offsets."""
    data, edge = LOWER[texts.data], texts.edges()
    if not len(data):
        return data, texts.offsets
    mark = MARK[data]
    first = mark.copy()
    first[1:] &= ~mark[:-1] | edge[1:-1]
    last = mark.copy()
    last[:-1] &= ~mark[1:] | edge[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    after = np.concatenate([SPACE[data], [True]])[end] | edge[end]
    before = (begin > 0) & PLAIN[data[begin - 1]] & ~edge[begin]
    at = begin[after & before]
    return np.insert(data, at, 32), texts.offsets + np.searchsorted(at, texts.offsets, "left")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


LETTERS = {ord(chr(b)): c for b, c in byte_letters().items()}
LATIN = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


class WordTokenizer(dict):
    """Token ids of texts by a tokenizer that never joins across white space; itself a cache of words.

    ASCII letters are put in lower case for the cache, as the tokenizer does itself. A run of ASCII marks between a
    plain letter or digit and white space is a token run of its own, so it is set off as a word. Words of Latin letters
    only are one run that normalising leaves alone but for case, so the tokenizer's model gets them directly. Texts
    that spell special tokens are left as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.vocabulary <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"

    def ids(self, texts: Texts) -> list[bytes]:
        """Ids of every text as little-endian bytes."""
        if len(self) > CACHE_WORDS:
            self.clear()
        data, offsets = with_marks_apart(texts)
        plain, at = data.tobytes(), offsets.tolist()
        words = [plain[a:b].split() for a, b in zip(at[:-1], at[1:], strict=True)]
        raw = texts.data.tobytes()
        if b"<|" in raw:
            at = texts.offsets.tolist()
            for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                if b"<|" in raw[a:b]:
                    words[i] = raw[a:b].split()
        known = self.__getitem__
        return [b"".join(map(known, ws)) for ws in words]

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if LATIN.fullmatch(text):
            mapped = text if word.isascii() else text.lower().encode().decode("latin-1").translate(LETTERS)
            ids = [t.id for t in self.model.tokenize(mapped)]
        else:
            ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        own = self[word] = struct.pack(f"<{len(ids)}{self.code}", *ids)
        return own


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def shipped_tokenizer(name: str) -> WordTokenizer:
    """In a task: the tokenizer whose file the driver has added to the application."""
    return tokenizer(SparkFiles.get(name))


def term_counts(docs: list[np.ndarray], vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and count of every distinct term of every document, in order."""
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    key = np.repeat(np.arange(len(docs), dtype=np.int64), sizes)
    key *= vocabulary
    key += np.concatenate(docs)
    key.sort()
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    return key // vocabulary, key % vocabulary, count


class Weights:
    """BM25 weight of terms in documents, from document frequencies."""

    def __init__(self, frequency: np.ndarray, n_docs: int, mean_length: float, end_id: int):
        self.idf = np.log1p((n_docs - frequency + 0.5) / (frequency + 0.5))
        self.idf[end_id] = 0
        self.mean_length, self.end_id = max(mean_length, 1.0), end_id

    def of(self, term: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length / self.mean_length))


class ContentOrder:
    """A binary tree over sketches of term weights; a node parts the sample at the median along its main direction."""

    def __init__(self, weights: Weights, vocabulary: int):
        number = np.arange(vocabulary, dtype=np.uint64)
        self.weights, self.vocabulary = weights, vocabulary
        self.slot = (mix(number + np.uint64(77)) % np.uint64(WIDTH)).astype(np.int64)
        self.sign = np.where(mix(number + np.uint64(991)) >> np.uint64(63), 1.0, -1.0)
        self.nodes: list[tuple[np.ndarray, float, bool]] = []

    def sketches(self, docs: list[np.ndarray]) -> np.ndarray:
        return self._sketches(docs, *term_counts(docs, self.vocabulary))

    def _sketches(self, docs: list[np.ndarray], doc: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        weight = self.weights.of(term, count, np.array([len(d) for d in docs])[doc]) * self.sign[term]
        return np.bincount(doc * WIDTH + self.slot[term], weight, len(docs) * WIDTH).reshape(-1, WIDTH)

    def fit(self, sample: np.ndarray, depth: int = DEPTH) -> None:
        """Node i has the children 2 i + 1 and 2 i + 2."""
        self.nodes, parts = [], {0: sample}
        for i in range((1 << depth) - 1):
            own = parts.pop(i, np.zeros((0, WIDTH)))
            direction = main_direction(own)
            value = own @ direction
            middle = float(np.median(value)) if len(own) else 0.0
            low, high = own[value <= middle], own[value > middle]
            inner = 2 * i + 2 < (1 << depth) - 1 and min(len(low), len(high)) >= LEAST_LEAF
            self.nodes.append((direction, middle, inner))
            if inner:
                parts[2 * i + 1], parts[2 * i + 2] = low, high

    def place(self, docs: list[np.ndarray], *counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf, numbered from left to right, and place along its direction of every document, from its ``term_counts``."""
        counts = counts or term_counts(docs, self.vocabulary)
        x, leaf, value = self._sketches(docs, *counts), np.zeros(len(docs), dtype=np.int64), np.zeros(len(docs))
        todo = [(0, 0, 0, np.arange(len(docs)))]
        while todo:
            node, code, level, rows = todo.pop()
            if not len(rows):
                continue
            direction, middle, inner = self.nodes[node]
            own = x[rows] @ direction
            if inner:
                right = own > middle
                todo += [(2 * node + 1, 2 * code, level + 1, rows[~right]), (2 * node + 2, 2 * code + 1, level + 1, rows[right])]
            else:
                leaf[rows], value[rows] = code << (DEPTH - level), own
        return leaf, value


def main_direction(x: np.ndarray, steps: int = 30) -> np.ndarray:
    """First principal direction by power steps."""
    v = np.full(WIDTH, WIDTH ** -0.5)
    if len(x) > 1:
        x = x - x.mean(axis=0)
        square = x.T @ x
        for _ in range(steps):
            longer = square @ v
            size = np.linalg.norm(longer)
            if size < 1e-12:
                break
            v = longer / size
    return v


TOKENS = "doc_id long, row long, n long, leaf long, value double, ids binary, terms array<int>, counts array<long>"
TOKENS_ARROW = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("leaf", pa.int64()), ("value", pa.float64()),
                          ("ids", pa.binary()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])


def _tokenize(name: str, end_id: int, order: ContentOrder | None):
    """(doc_id, text) -> a row of ids per document with its place in the order, and per task one row of document frequencies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = shipped_tokenizer(name)
        end, seen = np.array([end_id], dtype=tok.dtype).tobytes(), np.zeros(tok.vocabulary, dtype=np.int64)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            doc = batch.column(0)
            for begin, texts in pieces(batch.column(1)):
                ids = [x + end for x in tok.ids(texts)]
                docs = [np.frombuffer(x, dtype=tok.dtype) for x in ids]
                counts = term_counts(docs, tok.vocabulary)
                seen += np.bincount(counts[1], minlength=tok.vocabulary)
                n = len(ids)
                leaf, value = order.place(docs, *counts) if order else (np.zeros(n, dtype=np.int64), np.zeros(n))
                yield pa.RecordBatch.from_arrays([
                    doc.slice(begin, n), pa.array(range(row, row + n), pa.int64()), pa.array([len(d) for d in docs], pa.int64()),
                    pa.array(leaf), pa.array(value), pa.array(ids, pa.binary()),
                    pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64())),
                ], schema=TOKENS_ARROW)
                row += n
        terms = np.flatnonzero(seen)
        if len(terms):
            yield pa.RecordBatch.from_arrays([
                *(pa.nulls(1, field.type) for field in list(TOKENS_ARROW)[:6]),
                pa.array([terms.tolist()], pa.list_(pa.int32())), pa.array([seen[terms].tolist()], pa.list_(pa.int64())),
            ], schema=TOKENS_ARROW)
    return run


def _weights(rows: DataFrame, vocabulary: int, end_id: int) -> tuple[Weights, int]:
    """BM25 weights from a token table, and its number of tokens. The driver gets a row per vocabulary entry at most."""
    frequency = np.zeros(vocabulary)
    counted = rows.where("terms IS NOT NULL").select(F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    for term, count in counted.groupBy("t.terms").agg(F.sum("t.counts")).collect():
        frequency[term] = count
    n_docs, tokens = rows.where("row IS NOT NULL").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return Weights(frequency, n_docs, tokens / max(1, n_docs), end_id), tokens


def _sketch(order: ContentOrder, dtype: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [np.frombuffer(x.as_buffer(), dtype=dtype) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f4").tobytes() for x in order.sketches(docs)], pa.binary())], names=["sketch"])
    return run


def fitted_order(texts: DataFrame, name: str, tok: WordTokenizer, end_id: int, sample: int = SAMPLE) -> ContentOrder:
    """The order of the ``sample`` documents with the smallest hashes; the driver gets a sketch of each."""
    few = texts.orderBy(F.xxhash64("doc_id", "text"), F.hash("text", "doc_id")).limit(sample).repartition(8)
    rows = stored(few.mapInArrow(_tokenize(name, end_id, None), TOKENS))
    order = ContentOrder(_weights(rows, tok.vocabulary, end_id)[0], tok.vocabulary)
    found = rows.where("row IS NOT NULL").orderBy("row").select("ids").mapInArrow(_sketch(order, tok.dtype), "sketch binary").toArrow()
    order.fit(np.frombuffer(b"".join(found.column(0).to_pylist()), dtype="<f4").reshape(-1, WIDTH).astype(float))
    return order


class Shard:
    """Inverted BM25 index over the documents of a shard.

    Terms that ``DENSE`` of the documents hold have a row of weights for all documents, the others a posting list.
    """

    def __init__(self, docs: list[np.ndarray], weights: Weights):
        self.docs, vocabulary = docs, len(weights.idf)
        sizes = np.array([len(d) for d in docs])
        doc, term, count = term_counts(docs, vocabulary)
        held = np.bincount(term, minlength=vocabulary)
        use = (held[term] > 1) & (term != weights.end_id)  # the rest finds nobody else
        doc, term, count = doc[use], term[use], count[use]
        weight = weights.of(term, count, sizes[doc]).astype(np.float32)
        self.own_terms, self.own_rows = term, np.searchsorted(doc, np.arange(len(docs) + 1))
        self.dense_row = np.full(vocabulary, -1)
        often = np.flatnonzero((held > DENSE * len(docs)) & (held > 1))
        self.dense_row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), len(docs)), dtype=np.float32)
        row = self.dense_row[term]
        self.dense[row[row >= 0], doc[row >= 0]] = weight[row >= 0]
        doc, term, weight = doc[row < 0], term[row < 0], weight[row < 0]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.rows = np.searchsorted(term[order], np.arange(vocabulary + 1))

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """All unused documents that share a term with the seed, best BM25 score for all of the seed's terms first."""
        terms = self.own_terms[self.own_rows[seed]:self.own_rows[seed + 1]]
        row = self.dense_row[terms]
        low = self.rows[terms]
        count = self.rows[terms + 1] - low
        at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        score = np.bincount(self.doc[at], self.weight[at], len(self.docs)) + self.dense[row[row >= 0]].sum(axis=0)
        found = np.flatnonzero((score > 0) & unused)
        if len(found) > FIRST:
            best = found[np.argpartition(-score[found], FIRST)]
            floor = score[best[FIRST]]
            best = found[score[found] > floor]  # ties with the rest are left to it
            yield from best[np.lexsort((best, -score[best]))].tolist()
            found = found[score[found] <= floor]
        yield from found[np.lexsort((found, -score[found]))].tolist()


def fill_windows(shard: Shard, size: int, filled: int = 0) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, window, offset) in order; windows are full but the last.

    ``filled`` tokens of window 0 are taken already. A window takes another seed only when no unused document has a
    positive score for its seed.
    """
    lengths = [len(d) for d in shard.docs]
    unused, first = np.ones(len(lengths), dtype=bool), 0
    window, queue = 0, iter(())
    while True:
        doc = next(queue, None)  # a queue's documents are used by its own window only
        seed = doc is None
        while doc is None and first < len(lengths):
            doc = first if unused[first] else None
            first += 1
        if doc is None:
            return
        unused[doc] = False
        start = 0
        while start < lengths[doc]:
            take = min(size - filled, lengths[doc] - start)
            yield doc, start, take, window, filled
            start, filled = start + take, filled + take
            if filled == size:
                window, filled, queue = window + 1, 0, iter(())
                seed = start < lengths[doc]
        if seed:
            queue = shard.neighbours(doc, unused.copy())


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open_in long, ids binary"
PIECES_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")[:-1]] + [("ids", pa.binary())])


def _fill(dtype: np.dtype, weights: Weights, size: int, shard_tokens: int):
    """Documents in order -> pieces. Those of the task's last window, if it is not full, bring their ids and the task's number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _TOKENIZERS.clear()  # of an earlier stage in this worker
        part = TaskContext.get().partitionId()
        window, filled, open_ = 0, 0, []
        ids, docs, held = [], [], 0

        def shard() -> pa.RecordBatch | None:
            nonlocal window, filled, open_
            out, base = [], window
            for doc, start, length, own, offset in fill_windows(Shard(docs, weights), size, filled):
                data = docs[doc][start:start + length].astype("<u4").tobytes()
                open_.append((ids[doc], start, length, zlib.crc32(data), len(docs[doc]), (part << 32) + base + own, offset, None, data))
                window, filled = base + own, offset + length
                if filled == size:
                    out += [(*p[:8], None) for p in open_]
                    window, filled, open_ = window + 1, 0, []
            # What stays open must not keep the shard's arrays alive; its bytes are copies.
            return _pieces(out) if out else None

        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(data.as_py(), dtype=dtype)
                ids.append(doc_id)
                docs.append(own)
                held += len(own)
                while held > 3 * shard_tokens // 2 and len(docs) > 1:  # so no shard is much smaller than the others
                    ends = np.cumsum([len(d) for d in docs])
                    cut = min(max(1, int(np.searchsorted(ends, shard_tokens, "right"))), len(docs) - 1)
                    rest = ids[cut:], docs[cut:]
                    del ids[cut:], docs[cut:]
                    full = shard()
                    if full is not None:
                        yield full
                    ids, docs = rest
                    held = sum(len(d) for d in docs)
        if docs:
            full = shard()
            if full is not None:
                yield full
        if open_:
            yield _pieces([(*p[:7], part, p[8]) for p in open_])
    return run


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES_ARROW, strict=True)], schema=PIECES_ARROW)


RESULT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _joined(opened: DataFrame, size: int, first_sequence: int) -> DataFrame:
    """Pieces of the tasks' open windows, laid end to end and cut into full windows and a last one.

    The running total is over one row per task; everything else is by row.
    """
    filled = opened.groupBy("open_in").agg(F.sum("length").alias("filled"))
    before = F.sum("filled").over(Window.orderBy("open_in")) - F.col("filled")
    rows = opened.join(F.broadcast(filled.select("open_in", before.alias("before"))), "open_in").withColumn("at", F.col("before") + F.col("offset"))
    window = F.explode(F.expr(f"sequence(at div {size}, (at + length - 1) div {size})"))
    rows = rows.withColumn("window", window).withColumn("low", F.greatest("at", F.col("window") * size)).withColumn(
        "high", F.least(F.col("at") + F.col("length"), (F.col("window") + 1) * size))
    skip, length = F.col("low") - F.col("at"), F.col("high") - F.col("low")
    ids = F.substring("ids", (4 * skip + 1).cast("int"), (4 * length).cast("int"))
    return rows.select("doc_id", (F.col("start") + skip).alias("start"), length.alias("length"), F.crc32(ids).alias("ids_crc32"), "doc_tokens",
                       (F.lit(first_sequence) + F.col("window")).alias("sequence_id"), (F.col("low") - F.col("window") * size).alias("offset"))


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 2, shard_tokens: int = 2_000_000, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece of every row of ``docs``.

    A document is its text's ids (null: none) and ``end_id``; every id lies in exactly one piece. Sequences hold
    ``size`` tokens but the last one. Repeated rows are packed one by one; a null doc_id is kept; an empty table gives
    no rows. Other columns are not read. The tokenizer must not join across white space; its file is sent to the tasks.

    ``sample`` documents fit the content order and every document is laid in it. A seed is scored by all of its terms
    against all unused documents of its shard, which holds about ``shard_tokens`` tokens (half to one and a half, or
    one longer document) at every size of the table, so work grows with the table and a task holds one shard.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(tokenizer_path)
    name, tok = os.path.basename(tokenizer_path), tokenizer(tokenizer_path)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = fitted_order(texts, name, tok, end_id, sample)
    rows = stored(texts.mapInArrow(_tokenize(name, end_id, order), TOKENS))
    weights, tokens = _weights(rows, tok.vocabulary, end_id)
    parts = max(1, -(-tokens // (TASK_SHARDS * shard_tokens)))
    ordered = rows.where("row IS NOT NULL").select("leaf", "value", "row", "doc_id", "ids").repartitionByRange(int(parts), "leaf", "value", "row")
    placed = stored(ordered.sortWithinPartitions("leaf", "value", "row").select("doc_id", "ids").mapInArrow(
        _fill(tok.dtype, weights, size, shard_tokens), PIECES))
    return placed.where("open_in IS NULL").select(*RESULT).union(_joined(placed.where("open_in IS NOT NULL"), size, 1 << 62).select(*RESULT))
