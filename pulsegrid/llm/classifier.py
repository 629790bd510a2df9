"""Quality classifier: boosted trees over statistics of a document's text.

Statistics use the text alone (never labels, language, source or id) and are computed per document
in the scan. Labels are learned from a bounded sample: of the labelled ids whose
crc32(id as text) mod 5 is not 0, the MAX_LABELS with the smallest hash. The fitted arrays (a few
KB) go to all tasks, which score every text whole.

Defined results: null and empty texts have all statistics 0 and get their score; an id with several
labels counts as 1 if half of them or more are; null labels are left out; repeated rows are scored
one by one; without any labels every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boosting

MAX_LABELS = 20_000
THRESHOLD = 0.3
FOLDS = 5

_BYTES = np.arange(256)
_CLASSES = [np.flatnonzero(m) for m in (
    (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122), (_BYTES >= 48) & (_BYTES <= 57),
    _BYTES >= 128, np.isin(_BYTES, [ord(c) for c in "#*$%&|<>"]), np.isin(_BYTES, [ord(c) for c in "!?"]),
    np.isin(_BYTES, [ord(c) for c in ".,;:"]), _BYTES == 124, np.isin(_BYTES, [ord(c) for c in "@/\\_="]),
    _BYTES == 10, _BYTES == 32)]
N_STATISTICS = len(_CLASSES) + 14


def statistics(text: str | None) -> np.ndarray:
    out = np.zeros(N_STATISTICS)
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    histogram = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = histogram / len(raw)
    k = len(_CLASSES)
    out[:k] = [share[c].sum() for c in _CLASSES]
    used = share[share > 0]
    words, lines = raw.split(), raw.split(b"\n")
    n = len(words)
    out[k:k + 3] = np.log1p(len(raw)), -(used * np.log(used)).sum(), np.log1p(n)
    if not n:
        return out
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    filled = [x for x in lines if x.strip()]
    joined = b" ".join(filled)
    out[k + 3:] = (sizes.mean(), sizes.std(), sizes.max(), len(seen) / n, max(seen.values()) / n,
                   sum(map(eq, words, words[1:])) / n, pairs / max(1, n - 1), len(set(filled)) / len(filled),
                   np.log1p(len(joined) / len(filled)), sum(map(bytes.isupper, words)) / n,
                   sum(map(bytes.isalpha, words)) / n)
    return out


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in texts]).reshape(len(texts), N_STATISTICS)


def held_out(doc_id) -> Column:
    """Whether an id belongs to the fold that is never learned from (null: it does)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> boosting.Trees:
    """Fits the trees on at most ``max_labels`` labelled documents."""
    picked = (labels.where(F.col("quality").isNotNull() & ~held_out("doc_id"))
              .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
              .select(F.col("doc_id").alias("_id"), F.col("quality").alias("_y")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("_y"), pa.array(list(x), type=pa.list_(pa.float64()))],
                                             names=["y", "x"])

    rows = (docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
            .select("_y", "text").mapInArrow(run, "y int, x array<double>")
            .limit(2 * max_labels)  # only repeated ids can give more rows than labels
            .toArrow())
    x = np.array(rows["x"].to_pylist()).reshape(rows.num_rows, N_STATISTICS)
    y = rows["y"].to_numpy().astype(float)
    order = np.lexsort([*x.T, y])  # tasks finish in any order: the sums below must not
    return boosting.fit(x[order], y[order])


def score(docs: DataFrame, trees: boosting.Trees, carry: list[str], name: str = "_score") -> DataFrame:
    """The columns ``carry`` of each row with the score of its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # trees x 2 ** depth numbers
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score(_matrix(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(scores)],
                                             names=[*carry, name])

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = docs.select("doc_id", "text")
    return score(docs, learn(docs, labels), ["doc_id"]).select(
        "doc_id", held_out("doc_id").alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier takes for good, with their own columns."""
    scored = score(docs, learn(docs, labels), docs.columns)
    return scored.where(F.col("_score") >= THRESHOLD).select(*docs.columns)
