"""Counts of whole texts, made in one pass over the bytes of Arrow batches.

Columns (all long): n_words; word_chars (code points in words); n_symbols (``# * $ % & | < >``); n_lines (with a word);
n_dup_lines (equal to an earlier line of the text); n_repeat_words (words in windows of ``WINDOW`` words that occur
twice or more); n_distinct_words; n_upper, n_lower, n_digits (ASCII); n_marks (``. , ; : ! ?``); n_exclaim; n_bars
(``|``); n_wide (code points beyond ASCII); n_stops (words that end in ``. ! ?``); max_word (bytes).
A null or empty text has 0 everywhere.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from evenflow.llm.text import SPACE, Texts, chain_hashes, pieces, word_hashes

WINDOW = 8
STATS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper",
         "n_lower", "n_digits", "n_marks", "n_exclaim", "n_bars", "n_wide", "n_stops", "max_word"]
BYTE_CLASSES = {
    "n_symbols": b"#*$%&|<>", "n_upper": bytes(range(65, 91)), "n_lower": bytes(range(97, 123)), "n_digits": b"0123456789",
    "n_marks": b".,;:!?", "n_exclaim": b"!", "n_bars": b"|",
}
STOPS = np.isin(np.arange(256), list(b".!?"))


def repeated_words(chains: np.ndarray, n_words: int, window: int = WINDOW) -> int:
    """Words of a text covered by windows whose hash occurs more than once."""
    ranked = np.sort(chains)
    if len(ranked) < 2 or not (ranked[1:] == ranked[:-1]).any():
        return 0
    twice = np.isin(chains, ranked[1:][ranked[1:] == ranked[:-1]])
    step = np.zeros(n_words + 1, dtype=np.int64)
    step[:len(chains)] += twice
    step[window:window + len(chains)] -= twice
    return int((np.cumsum(step) > 0).sum())


def line_counts(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those equal to an earlier one."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def statistics(texts: Texts) -> dict[str, np.ndarray]:
    at, data = texts.offsets, texts.data
    starts, ends, rows = texts.words()

    def per_row(flags: np.ndarray, borders: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[borders])

    out = {"n_words": np.diff(rows)}
    first = (data & 0xC0) != 0x80
    out["word_chars"] = per_row(first & ~SPACE[data], at)
    out["n_wide"] = per_row(data >= 0xC0, at)
    for name, members in BYTE_CLASSES.items():
        out[name] = per_row(np.isin(np.arange(256), list(members))[data], at)
    out["n_stops"] = per_row(STOPS[data[ends - 1]] if len(ends) else np.zeros(0), rows)
    words = word_hashes(data, starts, ends)
    chains = chain_hashes(words, WINDOW)
    length = ends - starts
    more = {name: np.zeros(len(texts), dtype=np.int64) for name in ("n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "max_word")}
    raw = data.tobytes()
    for i, (begin, end) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
        if begin == end:
            continue
        more["n_lines"][i], more["n_dup_lines"][i] = line_counts(raw[at[i]:at[i + 1]])
        own = np.sort(words[begin:end])
        more["n_distinct_words"][i] = 1 + int((own[1:] != own[:-1]).sum())
        more["max_word"][i] = length[begin:end].max()
        if end - begin > WINDOW:
            more["n_repeat_words"][i] = repeated_words(chains[begin:end - WINDOW + 1], end - begin)
    return out | more


@F.arrow_udf(StructType([StructField(name, LongType()) for name in STATS]))
def _counts(column: pa.Array) -> pa.Array:
    parts = [statistics(texts) for _, texts in pieces(column)]
    return pa.StructArray.from_arrays(
        [pa.array(np.concatenate([p[name] for p in parts] or [np.zeros(0)]).astype(np.int64)) for name in STATS], names=STATS)


def with_statistics(docs: DataFrame, text: str = "text", into: str = "__counts") -> DataFrame:
    """``docs`` with a struct column of the counts of every row's text."""
    return docs.withColumn(into, _counts(F.col(text).cast("string")))


def _features(share, log) -> dict:
    """The features by name; ``share(part, whole)`` and ``log(count)`` take names of counts."""
    return {
        "words": log("n_words"), "word_length": share("word_chars", "n_words"), "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"),
        "distinct": share("n_distinct_words", "n_words"), "upper": share("n_upper", "word_chars"),
        "lower": share("n_lower", "word_chars"), "digits": share("n_digits", "word_chars"), "marks": share("n_marks", "n_words"),
        "exclaims": share("n_exclaim", "n_words"), "bars": share("n_bars", "n_words"), "wide": share("n_wide", "word_chars"),
        "stops": share("n_stops", "n_words"), "line_words": share("n_words", "n_lines"), "longest": log("max_word"),
    }


def ratios(counts: str = "__counts") -> dict[str, Column]:
    """Size-free features of a struct of counts, as Spark expressions; 0 where the denominator is 0."""
    c = {name: F.col(counts)[name] for name in STATS}

    def share(part, whole):
        return F.when(c[whole] > 0, c[part] / c[whole]).otherwise(F.lit(0.0))

    return _features(share, lambda name: F.log1p(c[name]))


def feature_rows(column: pa.Array) -> np.ndarray:
    """The features of whole texts, one row a text in the order of ``FEATURES``: ``ratios`` inside a task."""
    rows = []
    for _, texts in pieces(column):
        c = statistics(texts)

        def share(part, whole, c=c):
            return np.divide(c[part], c[whole], out=np.zeros(len(c[whole])), where=c[whole] > 0)

        found = _features(share, lambda name, c=c: np.array([math.log1p(n) for n in c[name].tolist()]))
        rows.append(np.column_stack([found[name] for name in FEATURES]))
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


FEATURES = ["words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "lower", "digits", "marks",
            "exclaims", "bars", "wide", "stops", "line_words", "longest"]
