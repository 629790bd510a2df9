"""64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of a column of texts, and of stretches of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 19  # bytes of texts hashed at a time, one text at least

_U = np.uint64
_BYTE = np.random.default_rng(20240611).integers(1, 2 ** 63, 256, dtype=np.uint64) | _U(1)
_BASE, STEP = _U(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers = np.ones(1, dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    """The first n powers of the base, at least."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 2 * len(_powers)), _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


@dataclass
class Words:
    """The words of the rows ``low`` to ``high`` of a column, one row after the other."""

    low: int
    high: int
    hashes: np.ndarray   # of each word
    counts: np.ndarray   # words of each row

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.low, self.high), self.counts)

    @property
    def place(self) -> np.ndarray:
        """Of each word in its row."""
        return np.arange(len(self.hashes)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)

    @property
    def left(self) -> np.ndarray:
        """Words of the row from each word on."""
        return np.repeat(self.counts, self.counts) - self.place


def words_of(texts: pa.Array) -> Iterator[Words]:
    """The words of all rows (null: none) in pieces."""
    if not len(texts):
        return
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    cut = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(cut, cut[low] + PIECE, side="right")) - 1)
        yield _hashed(raw[cut[low]:cut[high]], cut[low:high + 1] - cut[low], low)
        low = high


def _hashed(raw: np.ndarray, cut: np.ndarray, low: int) -> Words:
    word = ~_BLANK[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    rows = cut[:-1][cut[:-1] < len(raw)]
    begins[rows] = word[rows]  # a word never goes on in the next row
    first = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(first, cut))
    if not len(first):
        return Words(low, low + len(counts), np.zeros(0, dtype=np.uint64), counts)
    at = np.flatnonzero(word)
    rank = np.cumsum(word)[first] - 1  # of each word's first byte among the bytes of words
    size = np.diff(np.append(rank, len(at)))
    inside = np.arange(len(at)) - np.repeat(rank, size)
    sums = np.add.reduceat(_BYTE[raw[at]] * _power(int(size.max()))[inside], rank)
    return Words(low, low + len(counts), mix(sums + size.astype(np.uint64)), counts)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries, as many as entries: the last k - 1 are 0."""
    n = len(hashes)
    out = np.zeros(n, dtype=np.uint64)
    if n < k:
        return out
    have, size, total, length = hashes, 1, None, 0
    while size <= k:
        if k & size:
            if total is None:
                total, length = have, size
            else:
                m = n - length - size + 1
                total, length = total[:m] * _U(pow(STEP, size, 1 << 64)) + have[length:length + m], length + size
        size *= 2
        if size <= k:
            m = n - size + 1
            have = have[:m] * _U(pow(STEP, size // 2, 1 << 64)) + have[size // 2:size // 2 + m]
    out[:n - k + 1] = mix(total)
    return out


def row_digests(words: Words, salt: int) -> np.ndarray:
    """A hash of each row's sequence of words (no words: 0)."""
    out = np.zeros(len(words.counts), dtype=np.uint64)
    if len(words.hashes):
        x = mix(words.hashes + (words.place.astype(np.uint64) + _U(salt)) * _U(STEP))
        some = words.counts > 0
        out[some] = mix(np.add.reduceat(x, (np.cumsum(words.counts) - words.counts)[some]) + words.counts[some].astype(np.uint64))
    return out
