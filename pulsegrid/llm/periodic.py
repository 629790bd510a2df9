"""Periodic runs of words: harmonic grids of longest common extensions over a difference-cover sample.

A run is a stretch of words with smallest period q that is at least max(MIN_LENGTH, MIN_POWER * q)
long and that no neighbouring word extends. Words q apart agree along all of it but its last q words,
so one multiple of max(MIN_LENGTH, MIN_POWER * q) - q at least lies where they agree: for each q only
these grid positions g are tried, n * log(n) in all, and the extensions of (g, g + q) to both sides
give the run. Of stretches that agree in start and length the smallest period is the run's.

Longest common extensions: a difference cover modulo PERIOD holds, for every two positions, an offset
below PERIOD that brings both into the sample. Only sampled suffixes are sorted (names of PERIOD
words, doubled until they differ). A query compares the few words up to that offset, then takes the
minimum of the neighbours' common prefixes between the two ranks from a sparse table. Most queries end
at the compared words; suffixes are sorted for the texts that have queries left. Backward extensions
use the reversed words.

Texts are read in chunks of about CHUNK words, one text at least, with a separator of its own around
each: no extension passes one. Memory grows with the chunk or the longest text, work with
n * log(n) of it; no row is moved. The sweep over a chunk tries pairs across texts too, which are
never long enough to be a run.

Defined results: a null text has no words and no runs; null ids change no words; repeated rows are
read one by one; an empty table gives no rows; other columns than the two named are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

MIN_LENGTH = 6
MIN_POWER = 4
CHUNK = 1 << 17
PAIRS = 1 << 20  # grid positions tried at a time

# A perfect difference set (fixed values): every difference modulo 31 occurs between two of them.
PERIOD = 31
COVER = np.array([1, 5, 11, 24, 25, 27])
_PLACE = np.full(PERIOD, -1)
_PLACE[COVER] = np.arange(len(COVER))
#: for a difference d of two positions, a residue x of the first that puts x and x + d into the cover
_MEET = np.array([next(x for x in COVER if (x + d) % PERIOD in COVER) for d in range(PERIOD)])


def _named(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


def _matched(w: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray | int, step: int = 1) -> np.ndarray:
    """Equal words from i and j on (to the left with step -1), ``most`` at most; a separator stops both."""
    found = np.zeros(len(i), dtype=np.int64)
    most = np.broadcast_to(most, len(i))
    active = np.flatnonzero(most > 0)
    at = 0
    while len(active):
        active = active[w[i[active] + step * at] == w[j[active] + step * at]]
        at += 1
        found[active] = at
        active = active[most[active] > at]
    return found


class CommonPrefixes:
    """Longest common prefixes of the suffixes of ``words``, which end with a word that occurs once."""

    def __init__(self, words: np.ndarray):
        blocks = len(words) // PERIOD + 2  # room for an offset behind the last word
        self.w = np.full(blocks * PERIOD, -1, dtype=np.int64)
        self.w[:len(words)] = words
        name, size = _named(self.w), 1
        while size < 16:
            later = np.zeros_like(name)
            later[:-size] = name[size:] + 1
            name, size = _named(name * (len(name) + 1) + later), 2 * size
        self.at = (np.arange(blocks)[:, None] * PERIOD + COVER).ravel()  # sampled positions
        n, step = len(self.at), len(COVER)  # a block further on is ``step`` entries further on
        rest = np.minimum(self.at + PERIOD - size, len(name) - 1)
        levels = [_named(name[self.at] * (len(name) + 1) + name[rest])]
        while levels[-1].max() + 1 < n and step < n:
            later = np.zeros(n, dtype=np.int64)
            later[:-step] = levels[-1][step:] + 1
            levels.append(_named(levels[-1] * (n + 1) + later))
            step *= 2
        self.rank = levels[-1]
        self._sparse(levels)

    def _sparse(self, levels: list[np.ndarray]) -> None:
        """Common prefixes of neighbours in suffix order, and their minima over powers of two."""
        n = len(self.at)
        order = np.empty(n, dtype=np.int64)
        order[self.rank] = np.arange(n)
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            step = len(COVER) << k
            inside = np.flatnonzero(np.maximum(a, b) < n)
            same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
            a[same] += step
            b[same] += step
            common[same] += PERIOD << k
        inside = np.flatnonzero(np.maximum(a, b) < n)
        pa_, pb = self.at[a[inside]], self.at[b[inside]]
        common[inside] += _matched(self.w, pa_, pb, np.minimum(PERIOD - 1, len(self.w) - 1 - np.maximum(pa_, pb)))
        self.least = [common.astype(np.int32)]
        while 2 << (len(self.least) - 1) <= n - 1:
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def _ranks(self, p: np.ndarray) -> np.ndarray:
        return self.rank[p // PERIOD * len(COVER) + _PLACE[p % PERIOD]]

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefixes of the suffixes at i and j (i < j)."""
        offset = (_MEET[(j - i) % PERIOD] - i) % PERIOD
        found = _matched(self.w, i, j, offset)
        rest = np.flatnonzero(found == offset)  # synchronised: both are sampled now
        x, y = self._ranks(i[rest] + offset[rest]), self._ranks(j[rest] + offset[rest])
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1  # of the largest power of two in the range
        for k in np.unique(level):
            mine = level == k
            found[rest[mine]] += np.minimum(self.least[k][low[mine]], self.least[k][high[mine] - (1 << int(k))])
        return found


def _grids(total: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid positions g and periods q, PAIRS at a time or those of one period."""
    q = np.arange(1, longest // MIN_POWER + 1)
    step = np.maximum(MIN_LENGTH, MIN_POWER * q) - q
    each = np.maximum(0, -(-(total - q) // step))  # multiples of step below total - q
    ends = np.cumsum(each)
    low = 0
    while low < len(q):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, side="right")))
        part = slice(low, high)
        first = np.repeat(ends[part] - each[part], each[part])
        number = np.arange(len(first)) + (ends[low] - each[low]) - first
        yield number * np.repeat(step[part], each[part]), np.repeat(q[part], each[part])
        low = high


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All words with a separator of its own before each text and after the last; where the texts begin."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    marks = np.cumsum(sizes) - sizes
    w = np.empty(int(sizes.sum()) + 1, dtype=np.int64)
    for mark, text in zip(marks, texts, strict=True):
        w[mark + 1:mark + 1 + len(text)] = text
    w[marks] = -2 - np.arange(len(texts))
    w[-1] = -2 - len(texts)
    return w, marks + 1


def runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """start, length and period of the runs of each text (arrays of word numbers), by start, then period."""
    if not texts:
        return []
    w, begin = _joined(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    found: list[np.ndarray] = []  # columns: start, length, period
    open_: list[np.ndarray] = []  # columns: grid position, period
    for g, q in _grids(len(w), int(sizes.max())):
        met = w[g] == w[g + q]
        g, q = g[met], q[met]
        text = np.searchsorted(begin, g, side="right") - 1
        fits = (g + q < begin[text] + sizes[text]) & (np.maximum(MIN_LENGTH, MIN_POWER * q) <= sizes[text])
        g, q = g[fits], q[fits]
        right, left = _matched(w, g, g + q, PERIOD), _matched(w, g - 1, g + q - 1, PERIOD, -1)
        known = (right < PERIOD) & (left < PERIOD)
        long = known & (right + left + q >= np.maximum(MIN_LENGTH, MIN_POWER * q))
        found.append(np.stack([g[long] - left[long], (right + left + q)[long], q[long]], axis=1))
        open_.append(np.stack([g[~known], q[~known]], axis=1))
    left_over = np.concatenate(open_) if open_ else np.zeros((0, 2), dtype=np.int64)
    if len(left_over):
        found.append(_extended(texts, begin, left_over))
    table = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
    table = table[np.lexsort((table[:, 2], table[:, 1], table[:, 0]))]
    fresh = np.ones(len(table), dtype=bool)
    fresh[1:] = (table[1:, :2] != table[:-1, :2]).any(axis=1)  # the smallest period of each stretch
    table = table[fresh]
    table = table[np.lexsort((table[:, 2], table[:, 0]))]
    cut = np.searchsorted(table[:, 0], begin)
    table[:, 0] -= np.repeat(begin, np.diff([*cut, len(table)]))
    return np.split(table, cut[1:])


def _extended(texts: list[np.ndarray], begin: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """start (in the joined words), length and period for the grid positions that few words don't settle."""
    text = np.searchsorted(begin, queries[:, 0], side="right") - 1
    used, own = np.unique(text, return_inverse=True)
    w, at = _joined([texts[t] for t in used])
    q, shift = queries[:, 1], begin[used][own] - at[own]
    g = queries[:, 0] - shift
    right = CommonPrefixes(w)(g, g + q)
    back = len(w) - 1
    left = CommonPrefixes(w[::-1])(back - (g + q - 1), back - (g - 1))
    long = right + left + q >= np.maximum(MIN_LENGTH, MIN_POWER * q)
    return np.stack([g - left + shift, right + left + q, q], axis=1)[long]


def strongest(table: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest length / period (exact; ties: smallest start, then period)."""
    best = None
    for start, length, period in table.tolist():  # by start, then period: the first of equals stays
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def kept_words(n: int, table: np.ndarray) -> np.ndarray:
    """Whether a word lies in no run behind the run's first period."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, table[:, 0] + table[:, 2], 1)
    np.add.at(steps, table[:, 0] + table[:, 1], -1)
    return np.cumsum(steps[:n]) == 0


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """First word and period that the report's rule repeats in a document of n words, if it does."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _chunks(texts: pa.Array) -> Iterator[list[int]]:
    """Row numbers in chunks of about CHUNK words, texts of like length together."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    order = np.argsort(size, kind="stable")
    chunk = (np.cumsum(size[order].astype(np.int64)) // (6 * CHUNK)).tolist()
    rows: list[int] = []
    for at, row in enumerate(order.tolist()):
        if rows and chunk[at] != chunk[at - 1]:
            yield rows
            rows = []
        rows.append(row)
    if rows:
        yield rows


def _numbered(words: list[list[bytes]]) -> list[np.ndarray]:
    number = defaultdict(count().__next__)
    return [np.fromiter(map(number.__getitem__, w), dtype=np.int64, count=len(w)) for w in words]


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id and, for each document as it is, its runs (structs of start, length and period) and collapsed text."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _chunks(batch.column("text")):
                texts = batch.column("text").take(pa.array(rows))
                words = [(t.as_py() or "").encode("utf-8", "surrogatepass").split() for t in texts]
                tables = runs(_numbered(words))
                lists = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in t.tolist()] for t in tables]
                left = [b" ".join(compress(w, kept_words(len(w), t).tolist())).decode("utf-8", "surrogatepass")
                        for w, t in zip(words, tables, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(lists, type=kind),
                                                  pa.array(left)], names=["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
             "runs array<struct<start: long, length: long, period: long>>, collapsed string")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256 and collapsed_sha256 of every
    document, after the rule of ``planted`` has repeated words in a tenth of them."""
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def digest(words: list[bytes], table: np.ndarray) -> tuple:
        listed = "".join([f"{s},{n},{q}\n" for s, n, q in table.tolist()]).encode()
        left = compress(words, kept_words(len(words), table).tolist()) if len(table) else words
        best = strongest(table)
        told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        return (len(table), *told, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _chunks(batch.column("text")):
                words, texts = [], batch.column("text").take(pa.array(rows))
                ids = batch.column("doc_id").take(pa.array(rows))
                for doc_id, text in zip(ids.to_pylist(), texts, strict=True):
                    w = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                    rule = planted(doc_id, len(w))
                    if rule:
                        a, p = rule
                        w = w[:a] + [w[a + i % p] for i in range(len(w) - a)]
                    words.append(w)
                told = list(zip(*map(digest, words, runs(_numbered(words))), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(c, type=pa.string() if n.endswith("256") else pa.int64())
                            for n, c in zip(names, told, strict=True))], names=["doc_id", *names])

    kinds = ", ".join(f"{n} {'string' if n.endswith('256') else 'long'}" for n in names)
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {kinds}")
