"""Modified Kneser-Ney model of symbol n-grams, counted by Spark and kept in sorted key arrays.

Texts are read as symbols, which pack into keys without collisions. In the whole alphabet (``WHOLE``
classes) a letter of any script stands for itself: code points below 3584 (all scripts before Thai) are
a symbol each, those above two, by their upper and lower bits; only blanks, digits, the punctuation and
the signs of ASCII are folded. Five symbols of 12 bits fill a key. The model has an entry for each
distinct n-gram of the corpus (12 bytes, and as many for its context): it grows with the corpus's
vocabulary, without a fixed bound. The small alphabet (64 classes; accented and other letters by
classes) bounds a model by 64 ** order entries. Every text is counted whole; each task adds up its keys
before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = 5
CLASSES = 64
WHOLE = 4096
_SINGLE = 3584      # code points below are one symbol of the whole alphabet, those from here on two
_FLUSH = 2_000_000  # symbols gathered in a task before their keys are added up


def _alphabet() -> np.ndarray:
    table = np.full(0x10000, 63, dtype=np.uint8)  # other scripts
    table[0xC0:0x250] = 58 + np.arange(0xC0, 0x250) % 5
    for c in "!\"'()-/:;?@[\\]^_`{}~+=":
        table[ord(c)] = 56
    for c in "#*$%&|<>":
        table[ord(c)] = 57
    table[ord(".")], table[ord(",")] = 54, 55
    table[48:58] = 53
    table[97:123] = np.arange(1, 27)
    table[65:91] = np.arange(27, 53)
    table[[9, 10, 11, 12, 13, 32]] = 0
    return table


_TABLE = _alphabet()


def _whole_alphabet() -> np.ndarray:
    table = np.arange(_SINGLE, dtype=np.int64)
    for one in ([9, 10, 11, 12, 13, 32], range(48, 58), map(ord, "!\"'()-/:;?@[\\]^_`{}~+="), map(ord, "#*$%&|<>")):
        group = list(one)
        table[group] = group[0]
    table[[9, 10, 11, 12, 13, 32]] = 0
    return table


_LETTERS = _whole_alphabet()


def symbols(points: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """The symbols of a text: in the small alphabet one a code point, in the whole one two from _SINGLE on."""
    if classes != WHOLE:
        return _TABLE[np.minimum(points, 0xFFFF)]
    out = _LETTERS[np.minimum(points, _SINGLE - 1)]
    wide = points >= _SINGLE
    if wide.any():
        at = np.flatnonzero(wide)
        out[at] = _SINGLE + (points[at] >> 12)
        out = np.insert(out, at + 1, points[at] & 4095)
    return out


def ngram_keys(points: np.ndarray, order: int = ORDER, classes: int = CLASSES) -> np.ndarray:
    """Key of the n-gram that ends at each symbol; blanks stand before the text."""
    found = symbols(points, classes)
    s = np.zeros(len(found) + order - 1, dtype=np.int64)
    s[order - 1:] = found
    keys = np.zeros(len(found), dtype=np.int64)
    for k in range(order):
        keys = keys * classes + s[k:k + len(found)]
    return keys


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def count(docs: DataFrame, order: int = ORDER, classes: int = CLASSES) -> DataFrame:
    """key and n of every n-gram in all texts."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        waiting: list[np.ndarray] = []
        size = 0

        def merge():
            nonlocal keys, counts, size
            new, n = np.unique(np.concatenate(waiting), return_counts=True)
            both, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, n]), len(both)).astype(np.int64)
            keys, size = both, 0
            waiting.clear()

        for batch in batches:
            for text in batch.column("text"):
                if text.is_valid:
                    waiting.append(ngram_keys(code_points(text.as_py()), order, classes))
                    size += len(waiting[-1])
                    if size >= _FLUSH:
                        merge()
        if waiting:
            merge()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])

    return (docs.select("text").mapInArrow(add_up, "key long, n long")
            .groupBy("key").agg(F.sum("n").alias("n")))


@dataclass
class Level:
    """One order: sorted n-gram keys with their log probabilities, sorted contexts with their log weights."""

    keys: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray


def _discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and from 3 on, by the counts of counts."""
    of = [int(np.count_nonzero(n == k)) for k in (1, 2, 3, 4)]
    y = of[0] / (of[0] + 2 * of[1]) if of[0] else 0.0
    d = [0.0] + [k - (k + 1) * y * of[k] / of[k - 1] if of[k - 1] else 0.0 for k in (1, 2, 3)]
    return np.clip(d, 0.0, [0.0, 1.0, 2.0, 3.0])


class Model:
    def __init__(self, keys: np.ndarray, n: np.ndarray, order: int = ORDER, classes: int = CLASSES):
        self.classes = classes
        by_key = np.argsort(keys)
        tables = [(keys[by_key], n[by_key])]
        for k in range(order - 1, 0, -1):  # below the top: in how many contexts an n-gram continues
            tables.append(np.unique(tables[-1][0] % classes ** k, return_counts=True))
        self.levels: list[Level] = []
        for at, (ks, ns) in enumerate(reversed(tables)):
            contexts, place = np.unique(ks // classes, return_inverse=True)
            cut = _discounts(ns)[np.minimum(ns, 3)]
            total = np.bincount(place, ns, len(contexts))
            left = np.bincount(place, cut, len(contexts)) / np.maximum(total, 1)
            below = np.exp(self._logp(ks % classes ** at, at)) if at else 1.0 / classes
            p = (ns - cut) / total[place] + left[place] * below if len(ks) else np.zeros(0)
            with np.errstate(divide="ignore"):
                self.levels.append(Level(ks, np.log(np.maximum(p, 1e-300)).astype(np.float32), contexts,
                                         np.log(np.maximum(left, 1e-300)).astype(np.float32)))

    def _logp(self, keys: np.ndarray, upto: int) -> np.ndarray:
        """Log probability of the last symbol of each key by the lowest ``upto`` orders."""
        if upto == 0 or not len(self.levels[upto - 1].keys):
            return np.full(len(keys), -np.log(self.classes), dtype=np.float32)
        level = self.levels[upto - 1]
        at = np.minimum(np.searchsorted(level.keys, keys), len(level.keys) - 1)
        out = level.logp[at]
        missing = np.flatnonzero(level.keys[at] != keys)
        if len(missing):
            rest = keys[missing]
            c = np.minimum(np.searchsorted(level.contexts, rest // self.classes), len(level.contexts) - 1)
            weight = np.where(level.contexts[c] == rest // self.classes, level.weight[c], 0.0)
            out[missing] = weight + self._logp(rest % self.classes ** (upto - 1), upto - 1)
        return out

    def log_perplexities(self, points: np.ndarray) -> tuple[float | None, float | None]:
        """Mean negative log probability of a text's symbols, by all orders and without the highest; None for an
        empty text."""
        if not len(points):
            return None, None
        order = len(self.levels)
        keys = ngram_keys(points, order, self.classes)
        short = self._logp(keys % self.classes ** (order - 1), order - 1)
        return (float(-self._logp(keys, order).mean(dtype=np.float64)), float(-short.mean(dtype=np.float64)))


def train(docs: DataFrame, order: int = ORDER, classes: int = CLASSES) -> Model:
    """Counts in Spark; the table of distinct n-grams comes to the driver to be sorted."""
    table = count(docs, order, classes).toArrow()
    return Model(table["key"].to_numpy(), table["n"].to_numpy(), order, classes)
