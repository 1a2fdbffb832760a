"""Words of a batch of texts as arrays: boundaries, owners and 64-bit hashes, without a Python loop.

A word is a run of bytes other than space and \\x09-\\x0D; A-Z count as a-z.  Texts come as Arrow
columns, so a batch is one byte buffer with offsets; a null text is an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_U = np.uint64
_LOW_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``h`` (uint64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an Arrow column and the offset of each text (one more than texts)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 22):
    """Index ranges of consecutive texts of about ``limit`` bytes each; a longer text is alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


@dataclass
class Words:
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # behind its last byte
    first: np.ndarray  # index of the first word of each text, one more than texts
    hash: np.ndarray  # uint64 of the lower-cased word

    @property
    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``."""
    n = len(data)
    low = np.zeros(n + 16, np.uint8)
    np.take(LOWER, data, out=low[:n])
    inside = ~SPACE[data]
    cut = np.zeros(n + 1, bool)  # a text begins here
    cut[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    if n:
        opens[1:] &= ~inside[:-1] | cut[1:n]
        closes[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    size = end - start
    eight = np.ndarray((n + 8,), "<u8", buffer=low, strides=(1,))
    h = mix(size.astype(np.uint64) * _U(0x9E3779B97F4A7C15) ^ (eight[start] & _LOW_BYTES[np.minimum(size, 8)]))
    more, done = np.flatnonzero(size > 8), 8
    while len(more):
        part = eight[start[more] + done] & _LOW_BYTES[np.minimum(size[more] - done, 8)]
        h[more] = mix((h[more] + _U(0x9E3779B97F4A7C15)) ^ part)
        done += 8
        more = more[size[more] > done]
    return Words(start, end, np.searchsorted(start, offsets), h)


def pairs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each two neighbouring words of a text, and the index of the first of them."""
    if len(words.hash) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    same = np.ones(len(words.hash) - 1, bool)
    inner = words.first[1:-1]
    same[inner[(inner > 0) & (inner < len(words.hash))] - 1] = False
    left = np.flatnonzero(same)
    return mix(words.hash[left] * _U(0xD6E8FEB86659FD93) + words.hash[left + 1]), left


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and owner of every run of ``size`` words; a shorter text with words is one shingle."""
    count = np.diff(words.first)
    runs = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(count)), runs)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(words.first[:-1], runs)
    width = np.minimum(count, size)[owner]
    h = width.astype(np.uint64)
    for k in range(size):
        more = slice(None) if k == 0 or (len(width) and width.min() > k) else np.flatnonzero(width > k)
        h[more] = mix(h[more] * _U(0xD6E8FEB86659FD93) + words.hash[at[more] + k])
    return h, owner


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
