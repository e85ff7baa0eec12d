"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A run of three symbols is *bound*: the letters' vectors, permuted
by their place (a rotation), are multiplied. A text is the *bundle* (sum) of its bound runs. A language's prototype is
the sum of the normalised bundles of its training texts. A text gets the language whose prototype has the largest
cosine with the text's bundle, after the mean of all prototypes is taken off both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenflow.llm.labelled import held_out
from evenflow.llm.text import Texts, pieces

SYMBOLS = 64  # 0: not a letter, 1-26: a-z, the rest shared by all other letters
SEED = 20240229
MAX_LANGUAGES = 4096  # bounds the prototypes, which every task receives
TRAIN_PER_LANGUAGE = 4000


def _symbol_table() -> np.ndarray:
    out = np.zeros(0x110000, dtype=np.uint8)
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalpha():
            low = ord(letter.lower()[0])
            out[code] = low - 96 if 97 <= low <= 122 else 27 + low % (SYMBOLS - 27)
    return out


class Encoder:
    """Bundles of texts; bound runs are made once per process and kept."""

    def __init__(self, dimension: int):
        rng = np.random.default_rng(SEED)
        self.letters = rng.choice(np.array([-1, 1], dtype=np.int8), size=(SYMBOLS, dimension))
        self.table = _symbol_table()
        self.row_of = np.full(SYMBOLS ** 3, -1, dtype=np.int32)
        self.bound = np.zeros((1024, dimension), dtype=np.int8)
        self.used = 0

    def rows(self, runs: np.ndarray) -> np.ndarray:
        new = runs[self.row_of[runs] < 0]
        if len(new):
            while self.used + len(new) > len(self.bound):
                self.bound = np.concatenate([self.bound, np.zeros_like(self.bound)])
            a, b, c = new // SYMBOLS ** 2, new // SYMBOLS % SYMBOLS, new % SYMBOLS
            vectors = np.roll(self.letters[a], 2, axis=1) * np.roll(self.letters[b], 1, axis=1) * self.letters[c]
            self.bound[self.used:self.used + len(new)] = vectors
            self.row_of[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
        return self.row_of[runs]

    def bundles(self, texts: Texts) -> Iterator[np.ndarray | None]:
        """The bundle of every text, None without letters."""
        n = len(texts)
        data = np.insert(texts.data, texts.offsets, 10)  # a border before every text and at the end
        borders = texts.offsets + np.arange(n + 1)
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        borders = np.cumsum((data & 0xC0) != 0x80)[borders] - 1  # in characters
        symbol = self.table[codes]
        keep = symbol > 0
        keep[1:] |= symbol[:-1] > 0  # of other characters, the first after a letter
        keep[borders] = True
        s = symbol[keep].astype(np.int64)
        at = np.cumsum(keep)[borders] - 1
        runs = s[:-2] * SYMBOLS ** 2 + s[1:-1] * SYMBOLS + s[2:] if len(s) > 2 else np.zeros(0, dtype=np.int64)
        letters = np.concatenate([[0], np.cumsum(s > 0)])
        for begin, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if letters[end] == letters[begin]:
                yield None
                continue
            own = np.sort(runs[begin:end - 1].astype(np.int32))
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            own, count = own[first], np.diff(np.append(first, len(own)))
            rows = self.rows(own)
            yield count.astype(np.float32) @ self.bound[rows].astype(np.float32)


_ENCODERS: dict[int, Encoder] = {}


def encoder(dimension: int) -> Encoder:
    if dimension not in _ENCODERS:
        _ENCODERS[dimension] = Encoder(dimension)
    return _ENCODERS[dimension]


def _sums(dimension: int):
    """Per task: the sum of normalised bundles of each language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for begin, texts in pieces(batch.column(1)):
                for i, v in enumerate(encoder(dimension).bundles(texts)):
                    length = 0.0 if v is None else float(np.linalg.norm(v))
                    if length > 0:
                        sums[langs[begin + i]] = sums.get(langs[begin + i], 0) + v / length
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.astype(np.float64) for v in sums.values()], pa.list_(pa.float64()))],
                names=["lang", "bundle"])
    return run


class Prototypes:
    """Languages and their centred unit prototypes."""

    def __init__(self, langs: list[str], sums: np.ndarray):
        self.langs, self.dimension = langs, sums.shape[1]
        unit = sums / np.linalg.norm(sums, axis=1, keepdims=True)
        self.mean = unit.mean(axis=0) if len(langs) > 1 else np.zeros(self.dimension)
        centred = unit - self.mean
        self.unit = centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)

    def predict(self, bundle: np.ndarray) -> tuple[str, float]:
        own = bundle / max(float(np.linalg.norm(bundle)), 1e-12) - self.mean
        cosine = self.unit @ (own / max(float(np.linalg.norm(own)), 1e-12))
        best = int(np.argmax(cosine))
        return self.langs[best], float(min(1.0, max(0.0, (1 + cosine[best]) / 2)))


def fit_prototypes(
    rows: DataFrame, text: str = "text", lang: str = "lang", dimension: int = 512, per_language: int = TRAIN_PER_LANGUAGE,
    sample_by: str = "doc_id", max_languages: int = MAX_LANGUAGES,
) -> Prototypes:
    """Prototypes learned from ``rows`` with a language and a text.

    Of a language with more than ``per_language`` rows about that many are used, chosen by a hash of ``sample_by``;
    this bounds the training work. More than ``max_languages`` languages are refused. Without any row that can be
    learned from there are no languages, and every text is ``und``.
    """
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = rows.groupBy(lang).count().limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return Prototypes([], np.zeros((0, dimension)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(1.0, per_language / r[1]))])
    chosen = F.pmod(F.xxhash64(F.col(sample_by)), F.lit(1_000_000)) < 1_000_000 * F.element_at(share, F.col(lang))
    sums = rows.where(chosen).select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(
        _sums(dimension), "lang string, bundle array<double>")
    total = sums.select("lang", F.posexplode("bundle")).groupBy("lang", "pos").agg(F.sum("col").alias("v")).groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("v")).orderBy("lang").collect()
    return Prototypes([r[0] for r in total], np.array([r[1] for r in total]).reshape(len(total), dimension))


def predict_language(rows: DataFrame, prototypes: Prototypes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score`` of every row. Null texts and texts without a letter are ``und`` with score 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, texts in pieces(batch.column(1)):
                for v in encoder(prototypes.dimension).bundles(texts):
                    found.append(("und", 0.0) if v is None or not prototypes.langs else prototypes.predict(v))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                names=[key, "lang_pred", "score"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def identify_languages(docs: DataFrame, parts: int = 4, part: int = 2, dimension: int = 512) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; languages are learned from the rows not held out.

    Repeated rows give repeated results; an empty table gives none. A text with letters but in a table without any
    known language is ``und``.
    """
    known = docs.where(~held_out(F.col("doc_id"), parts, part)).select("doc_id", "text", "lang")
    found = predict_language(docs.select("doc_id", "text"), fit_prototypes(known, dimension=dimension))
    return found.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "lang_pred", "score")


