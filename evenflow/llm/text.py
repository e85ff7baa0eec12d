"""Words of whole Arrow batches of texts, as NumPy offsets and 64-bit hashes.

A word is a maximal run of characters other than space and ``\\t \\n \\v \\f \\r``. All functions work on the UTF-8
bytes of many texts at once; a batch is cut into runs of rows of about ``MAX_BYTES`` so that memory stays bounded by
that or by the longest single text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MAX_BYTES = 2 << 20
LONG_WORD = 48  # bytes; longer words are hashed one by one

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
HEAD = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)  # the first n bytes of a little-endian word


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case; arithmetic on bytes is far quicker than a look-up."""
    return data | (((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is far quicker here than the hashing of ``np.unique``."""
    x = np.sort(x)
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def _offsets(column: pa.Array) -> np.ndarray:
    """Where the rows of a string column begin in its data, and where the last one ends; nothing is copied but these."""
    if not len(column):
        return np.zeros(1, dtype=np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], dtype=kind)
    return at[column.offset:column.offset + len(column) + 1].astype(np.int64)


class Texts:
    """The bytes of some rows of a text column: ``data`` and, for row i, ``offsets[i]:offsets[i + 1]``."""

    def __init__(self, column: pa.Array):
        column = column.fill_null("") if column.null_count else column
        at, data = _offsets(column), column.buffers()[2]
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        self.data, self.offsets = whole[at[0]:at[-1]], at - at[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def edges(self) -> np.ndarray:
        """True at the first byte of every row that has bytes."""
        edge = np.zeros(len(self.data) + 1, dtype=bool)
        edge[self.offsets] = True
        return edge

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte and end of every word, and for row i its words ``rows[i]:rows[i + 1]``."""
        word, edge = (self.data != 32) & ((self.data - np.uint8(9)) > 4), self.edges()
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:-1]
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, self.offsets)


def pieces(column: pa.Array) -> Iterator[tuple[int, Texts]]:
    """Runs of rows of a text column with about ``MAX_BYTES`` each: number of the first row, texts."""
    column = column.fill_null("") if column.null_count else column
    at, begin = _offsets(column), 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + MAX_BYTES, "right")) - 1)
        yield begin, Texts(column.slice(begin, end - begin))
        begin = end


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, read eight bytes at a time."""
    length = ends - starts
    h = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    alive, state = np.arange(len(starts)), h
    for j in range(0, min(LONG_WORD, int(length.max(initial=0))), 8):
        if j:
            alive = alive[length[alive] > j]
            state = h[alive]
        state = mix(state ^ (eights[starts[alive] + j] & HEAD[np.minimum(length[alive] - j, 8)]))
        if j:
            h[alive] = state
        else:
            h = state
    for i in np.flatnonzero(length > LONG_WORD):
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        h[i] = np.frombuffer(digest, dtype=np.uint64)[0]
    return h


def chain_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes (the caller cuts at row borders)."""
    if len(words) < k:
        return np.zeros(0, dtype=np.uint64)
    odd = (mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)).tolist()
    out = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for j, factor in enumerate(odd):
        out += words[j:len(words) - k + 1 + j] * np.uint64(factor)
    return mix(out)


def few_words_hash(words: np.ndarray) -> int:
    """Hash of a whole short word sequence, distinct from the hashes of full runs."""
    h = np.uint64(len(words) + 1)
    with np.errstate(over="ignore"):
        for w in words:
            h = mix(np.array([h * np.uint64(0x9E3779B97F4A7C15) + w], dtype=np.uint64))[0]
    return int(h)
