"""Concatenate and cut: all documents as one token stream, cut into fixed windows.

Pass 1 encodes each document once, keeps its ids and its place in its partition's stream, and
writes them to the shared checkpoint folder. Prefix sums over the partitions' totals (one row per
partition) then give every document a global offset. Pass 2 cuts the documents at the multiples of
the window: each cut is a boundary record, no row is moved and only the last window is short.

Defined results: a null or empty text is the end id alone; repeated rows (also of one doc_id) are
packed one by one; an empty table gives no rows; other columns than the two named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytepairs import encoder
from .common import keep

END_ID = 1
WINDOW = 2048

_STREAM = "part int, at long, doc_id long, n long, ids binary"
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def token_stream(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Ids of each document with the end id, and where they lie in their partition's stream."""
    tail = np.array([end_id], dtype="<u2").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [enc.packed(t.as_py()) + tail for t in batch.column("text")]
            n = np.fromiter((len(x) >> 1 for x in ids), dtype=np.int64, count=len(ids))
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(ends - n),
                 batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(ids, type=pa.binary())],
                names=["part", "at", "doc_id", "n", "ids"])
            at = int(ends[-1]) if len(ends) else at

    return docs.select("doc_id", "text").mapInArrow(encode, _STREAM)


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents in windows of ``window`` ids; ``ids`` holds a piece's ids, 4 bytes each.

    Sequence ``s`` is the pieces with that sequence_id in the order of ``offset``.
    """
    stream = keep(token_stream(docs, vocabulary, end_id), "token-stream")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (stream.groupBy("part").agg(F.sum("n").alias("total"))
             .select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            cols = (batch.column(c).to_pylist() for c in ("doc_id", "first", "n", "ids"))
            for doc_id, first, n, ids in zip(*cols, strict=True):
                wide = np.frombuffer(ids, dtype="<u2").astype("<u4")
                start = 0
                while start < n:
                    seq, off = divmod(first + start, window)
                    length = min(window - off, n - start)
                    rows.append((doc_id, start, length, wide[start:start + length].tobytes(), n, seq, off))
                    start += length
            if rows:
                names = [c.split()[0] for c in _PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(col, type=pa.binary() if name == "ids" else pa.int64())
                     for name, col in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    # one row per partition of the stream: the bound of this broadcast
    placed = stream.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("at")).alias("first"), "n", "ids")
    return placed.mapInArrow(cut, _PIECES)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def crc32(ids: list[int]) -> int:
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())
