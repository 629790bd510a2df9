"""Substring dedup by fixed-block anchors.

A window is WINDOW consecutive words of a document; a word goes if a window that covers it also
starts earlier, by (doc_id, word number), as the documents were given. Every window holds a whole
block of BLOCK words whose first word number is a multiple of BLOCK, so an earlier occurrence has
such a reference block, and a later one holds the same words at some offset.

1. Texts are written once, in pieces of about PIECE words (one text at least), each under a label of
   its own, in a table with one bucket a scan task. What a shuffle finds out goes back to a piece's
   texts by that label; the texts never move.
2. Of documents with the same sequence of words the smallest doc_id goes on; the others are repeats
   as a whole.
3. Anchors: a piece sends the hashes of all its rolling stretches of BLOCK words, each once, and marks
   those that are reference blocks. A stretch that is a reference block and occurs twice is a hit.
4. Extension: the windows around a piece's hits are sent with their places, each content once a piece
   (other places of it in the piece are known to be later). The first place of each content stays;
   the others go back, and overlapping ones are the maximal repeats.

Hits are found by 46 bits of hash, which may only add windows to step 4; that compares 96 bits. Hashes
are dealt by their value into buckets of about BUCKET, whose number is taken from the counted words.
A piece sends a content once, so a passage that very many documents share is one entry for each piece
and bucket, and no pairs of documents are made. A Python worker holds a piece or a bucket at a time,
however large the scan tasks and the input are.

Defined results: null, empty and wordless texts have no words and nothing to remove; a null doc_id
comes first in order; documents of one doc_id with other words come one after the other, in the order
of a hash of their words; rows that agree in doc_id and words are one document and lose the same
words; a document of any length is read whole, as one row of a piece; an empty table gives no rows;
other columns pass through ``dedup`` and are not read by ``report``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.session import checkpoint_dir

from . import wordhash
from .common import drop, keep, spread

WINDOW = 20
BLOCK = (WINDOW + 1) // 2
BITS = 46            # of an anchor's hash
BUCKET = 1 << 21     # hashes that meet in one group, about
SENT = 1 << 20       # words of a piece whose anchors are sorted together
PIECE = 1 << 20      # words of the texts that a worker holds, about
PIECES = 64          # labels of a task; the pieces of larger ones share them
SLICE = 1 << 18      # windows of a bucket that are sorted together, about
MOST_BUCKETS = 50_000
NULL_ID = -(1 << 63)

_U = np.uint64
_FULL = 0xFFFFFFFF


# ---- small codecs -------------------------------------------------------------------------------

def pack_sorted(values: np.ndarray) -> bytes:
    """Rising whole numbers as differences of 4 bytes; a full one says that the next adds to it."""
    steps = np.diff(values, prepend=_U(0))
    more = (steps // _U(_FULL)).astype(np.int64)
    out = np.full(len(steps) + int(more.sum()), _FULL, dtype=np.uint32)
    out[np.cumsum(more + 1) - 1] = steps % _U(_FULL)
    return out.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, dtype=np.uint32)
    return np.cumsum(steps, dtype=np.uint64)[steps != _FULL]


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of numbers, compressed byte by byte."""
    head = np.array([len(columns), *(x for c in columns for x in (len(c), c.itemsize))], dtype=np.int64).tobytes()
    body = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)
    return head + pa.compress(body, codec="zstd", asbytes=True)


def unsqueeze(data: bytes, *kinds: type) -> list[np.ndarray]:
    n = 1 + 2 * len(kinds)
    sizes = np.frombuffer(data[:8 * n], dtype=np.int64)[1:].reshape(-1, 2)
    body = pa.decompress(data[8 * n:], decompressed_size=int(sizes.prod(axis=1).sum()), codec="zstd", asbytes=True)
    out, at = [], 0
    for kind, (length, width) in zip(kinds, sizes.tolist(), strict=True):
        plane = np.frombuffer(body, dtype=np.uint8, count=length * width, offset=at).reshape(width, length)
        out.append(np.ascontiguousarray(plane.T).view(kind).reshape(length))
        at += length * width
    return out


# ---- the table of texts -------------------------------------------------------------------------

def labels(spark: SparkSession, tasks: int, buckets: int) -> list[list[int]]:
    """Labels of each task's pieces: different whole numbers that fall into the task's bucket."""
    turns = -(-tasks // buckets)
    rows = (spark.range(buckets * (2 * turns * PIECES + 40)).select("id", F.pmod(F.hash("id"), F.lit(buckets)).alias("bucket"))
            .groupBy("bucket").agg(F.slice(F.sort_array(F.collect_list("id")), 1, turns * PIECES).alias("ids")).collect())
    ids = {r.bucket: r.ids for r in rows}
    return [ids[t % buckets][t // buckets::turns] for t in range(tasks)]


class Texts:
    """The documents with words as one table, in buckets by the label of their piece, ``_task``."""

    def __init__(self, docs: DataFrame, carry: list[str]):
        spark, self.carry = docs.sparkSession, carry
        tasks = max(1, spread(docs))
        buckets = min(tasks, MOST_BUCKETS)
        known = spark.sparkContext.broadcast(labels(spark, tasks, buckets))
        schema = T.StructType([*(docs.schema[c] for c in carry), *T.StructType.fromDDL(
            "_task long, _row long, _doc long, _n long, _d1 long, _d2 long, _text string").fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            own, at, cost = np.array(known.value[part % len(known.value)]), part << 33, 0
            for batch in batches:
                counts, one, two = [], [], []
                for w in wordhash.words_of(batch.column("_text")):
                    counts.append(w.counts)
                    one.append(wordhash.row_digests(w, 1).view(np.int64))
                    two.append(wordhash.row_digests(w, 7).view(np.int64))
                n = batch.num_rows
                if n:
                    counts = np.concatenate(counts)
                    size = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False)
                    ends = cost + np.cumsum(np.maximum(counts, size // 8) + 8)  # long words and many rows count as well
                    piece, cost = np.append(cost, ends[:-1]) // PIECE % len(own), int(ends[-1])
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c) for c in carry), pa.array(own[piece]),
                         pa.array(np.arange(at, at + n)), batch.column("_doc"), pa.array(counts),
                         pa.array(np.concatenate(one)), pa.array(np.concatenate(two)), batch.column("_text")],
                        names=schema.names)
                    at += n

        rows = docs.select(*carry, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_doc"),
                           F.col("text").alias("_text"))
        name = f"substring_texts_{uuid.uuid4().hex}"
        (rows.mapInArrow(run, schema).write.bucketBy(buckets, "_task")
         .option("path", f"{checkpoint_dir(spark)}/{name}").format("parquet").saveAsTable(name))
        self.name, self.table = name, spark.table(name)

    def meet(self, notes: DataFrame, work, schema) -> DataFrame:
        """``work`` on each piece's texts and the notes with its label."""
        return self.table.groupBy("_task").cogroup(notes.groupBy("_task")).applyInArrow(work, schema)

    def drop(self) -> None:
        self.table.sparkSession.sql(f"DROP TABLE {self.name}")
        drop(self.table)


# ---- the steps ----------------------------------------------------------------------------------

def _roles(texts: Texts) -> DataFrame:
    """_task, _row, _copy and _tie of one row of each document that holds a window.

    _copy: a smaller doc_id has the same words. _tie: order among documents of the same doc_id.
    """
    rows = texts.table.where(F.col("_n") >= WINDOW)
    docs = keep(rows.groupBy("_doc", "_d1", "_d2").agg(F.min(F.struct("_task", "_row")).alias("_place")), "substring-docs")
    # written before they are joined: Spark can then split the rows of a large group of copies
    first = keep(docs.groupBy("_d1", "_d2").agg(F.min("_doc").alias("_first"), F.count(F.lit(1)).alias("_ids"))
                 .where("_ids > 1"), "substring-copies")
    several = keep(docs.groupBy("_doc").agg(F.count(F.lit(1)).alias("_texts")).where("_texts > 1"), "substring-ids")
    roles = keep(docs.join(first, ["_d1", "_d2"], "left").join(several, "_doc", "left").select(
        F.col("_place._task").alias("_task"), F.col("_place._row").alias("_row"),
        F.coalesce(F.col("_doc") != F.col("_first"), F.lit(False)).alias("_copy"),
        F.when(F.col("_texts") > 1, F.col("_d1")).otherwise(0).alias("_tie")), "substring-roles")
    for table in (docs, first, several):
        drop(table)
    return roles


_NOTES = "_task long, _row long, _copy boolean, _tie long, _data binary"


def _notes(roles: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    told = roles.select("_task", "_row", "_copy", "_tie", F.lit(None).cast("binary").alias("_data"))
    return told if answers is None else told.unionByName(answers, allowMissingColumns=True)


class _Group:
    """A piece's texts with what is known of them."""

    def __init__(self, rows: pa.Table, notes: pa.Table):
        self.rows = rows.sort_by("_row")
        self.ids = self.rows["_row"].to_numpy()
        told = notes.filter(notes["_row"].is_valid())
        at = np.searchsorted(self.ids, told["_row"].to_numpy())
        self.role = np.zeros(len(self.ids), dtype=np.int8)  # 0: none, 1: its windows count, 2: copy
        self.role[at] = 1 + told["_copy"].to_numpy(zero_copy_only=False).astype(np.int8)
        self.tie = np.zeros(len(self.ids), dtype=np.int64)
        self.tie[at] = told["_tie"].to_numpy()
        self.answers = [x.as_py() for x in notes["_data"] if x.is_valid]

    def words(self) -> Iterator[tuple[np.ndarray, wordhash.Words]]:
        """Group rows and words of the texts whose windows count, in pieces."""
        mine = np.flatnonzero(self.role == 1)
        low = 0
        for chunk in self.rows["_text"].take(pa.array(mine)).chunks:
            for w in wordhash.words_of(chunk):
                yield mine[low + w.low:low + w.high], w
            low += len(chunk)


def _anchor(w: wordhash.Words) -> np.ndarray:
    return wordhash.rolling(w.hashes, BLOCK) >> _U(64 - BITS)


def split(values: np.ndarray, bits: int, width: int) -> Iterator[tuple[int, slice]]:
    """Buckets by the top bits of ``width``, and their slices of the rising values."""
    edges = np.searchsorted(values, np.arange(1, 1 << bits, dtype=np.uint64) << _U(width - bits))
    edges = np.concatenate([[0], edges, [len(values)]])
    for bucket in np.flatnonzero(np.diff(edges)):
        yield int(bucket), slice(int(edges[bucket]), int(edges[bucket + 1]))


def _probe(bits: int):
    """The anchors of a piece: each hash once with two bits (a reference block; found twice or more)."""

    def work(rows: pa.Table, notes: pa.Table) -> pa.Table:
        group = _Group(rows, notes)
        out: dict[str, list] = {"_bucket": [], "_task": [], "_data": []}
        waiting: list[np.ndarray] = []

        def send():
            found = np.sort(np.concatenate(waiting))
            waiting.clear()
            last = np.append(found[1:] >> _U(1) != found[:-1] >> _U(1), True)  # of a hash: a reference block if any is
            twice = np.diff(np.flatnonzero(last), prepend=-1) > 1
            values = found[last] << _U(1) | twice.astype(np.uint64)
            for bucket, part in split(values, bits, BITS + 2):
                out["_bucket"].append(bucket)
                out["_task"].append(label)
                out["_data"].append(pack_sorted(values[part] - (_U(bucket) << _U(BITS + 2 - bits))))

        label, size = rows["_task"][0].as_py(), 0
        for _, w in group.words():
            whole = w.left >= BLOCK
            waiting.append((_anchor(w) << _U(1) | (w.place % BLOCK == 0).astype(np.uint64))[whole])
            size += len(waiting[-1])
            if size >= SENT:
                send()
                size = 0
        if size:
            send()
        return pa.table(out, schema=pa.schema([("_bucket", pa.int32()), ("_task", pa.int64()), ("_data", pa.binary())]))

    return work, "_bucket int, _task long, _data binary"


def _hits(bits: int):
    """For each piece its stretches that are a reference block and occur twice, in one bucket of hashes."""

    def work(table: pa.Table) -> pa.Table:
        tasks, width = table["_task"].to_pylist(), BITS - bits
        room = (len(tasks) - 1).bit_length()  # of a sender's number, below the hash and its two bits
        assert width + 2 + room <= 64, "too many senders in a bucket"
        keys, n = np.empty(sum(len(x.as_buffer()) // 4 for x in table["_data"]), dtype=np.uint64), 0
        for k, x in enumerate(table["_data"]):
            values = unpack_sorted(x.as_buffer())
            keys[n:n + len(values)] = values << _U(room) | _U(k)
            n += len(values)
        keys = keys[:n]
        keys.sort()
        # only one sender's: a hit if both bits are set; the others are looked at together
        same = keys[1:] >> _U(room + 2) == keys[:-1] >> _U(room + 2)
        left = (keys >> _U(room)).astype(np.uint8) & 3 == 3
        left[1:] |= same
        left[:-1] |= same
        del same
        keys = keys[left]
        first = np.flatnonzero(np.append(len(keys) > 0, keys[1:] >> _U(room + 2) != keys[:-1] >> _U(room + 2)))
        times = np.diff(np.append(first, len(keys)))
        flags = np.bitwise_or.reduceat((keys >> _U(room)).astype(np.uint8) & 3, first) if len(first) else np.zeros(0, np.uint8)
        keys = keys[np.repeat((flags >= 2) & ((times > 1) | (flags == 3)), times)]
        del left, first, times, flags
        keys = (keys & _U((1 << room) - 1)) << _U(width) | keys >> _U(room + 2)  # by sender, then hash
        keys.sort()
        cut = np.searchsorted(keys, np.arange(len(tasks) + 1, dtype=np.uint64) << _U(width))
        base = _U(table["_bucket"][0].as_py()) << _U(width)
        told = [(t, pack_sorted((keys[a:b] & _U((1 << width) - 1)) + base))
                for t, a, b in zip(tasks, cut[:-1].tolist(), cut[1:].tolist(), strict=True) if b > a]
        return pa.table({"_task": pa.array([t for t, _ in told], type=pa.int64()),
                         "_data": pa.array([d for _, d in told], type=pa.binary())})

    return work, "_task long, _data binary"


def _extend(bits: int):
    """The windows around a piece's hits: content and place of the first in the piece, places of the others."""
    kinds = pa.schema([("_bucket", pa.int32()), ("_task", pa.int64()), ("_content", pa.binary()), ("_places", pa.binary()),
                       ("_later", pa.binary())])

    def work(rows: pa.Table, notes: pa.Table) -> pa.Table:
        group = _Group(rows, notes)
        out: dict[str, list] = {name: [] for name in kinds.names}
        if not group.answers:
            return pa.table(out, schema=kinds)
        hits = np.unique(np.concatenate([unpack_sorted(x) for x in group.answers]))
        label, doc = rows["_task"][0].as_py(), group.rows["_doc"].to_numpy()
        rank = np.empty(len(doc), dtype=np.int64)
        rank[np.lexsort((group.tie, doc))] = np.arange(len(doc))  # one row a document: no ties are left
        waiting: list[tuple[np.ndarray, ...]] = []

        def send():
            a, b, row, place = (np.concatenate([w[k] for w in waiting]) for k in range(4))
            waiting.clear()
            order = np.lexsort((place, rank[row], b, a))
            a, b, row, place = a[order], b[order], row[order], place[order]
            first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            for bucket, part in split(a, bits, 64):
                f = first[part]
                x, y, r, p = (c[part][f] for c in (a, b, row, place))
                by = np.lexsort((p, r))  # places in order are told in fewer bytes
                x, y, r, p = x[by], y[by], r[by], p[by]
                of, at = np.unique(r, return_inverse=True)
                out["_bucket"].append(bucket)
                out["_task"].append(label)
                out["_content"].append(x.tobytes() + y.tobytes())
                out["_places"].append(squeeze(group.ids[of], doc[of], group.tie[of], np.diff(at, prepend=0).astype(np.int32),
                                              p.astype(np.int32)))
                r, p = row[part][~f], place[part][~f]
                by = np.lexsort((p, r))
                out["_later"].append(squeeze(group.ids[r[by]], p[by].astype(np.int32)) if len(by) else None)

        size = 0
        for own, w in group.words():
            found = _anchor(w)
            at = np.minimum(np.searchsorted(hits, found), len(hits) - 1)
            hit = np.append(0, np.cumsum((hits[at] == found) & (w.left >= BLOCK)))
            upto = np.minimum(np.arange(len(found)) + WINDOW - BLOCK + 1, len(found))
            start = np.flatnonzero((hit[upto] > hit[:-1]) & (w.left >= WINDOW))
            if not len(start):
                continue
            a = wordhash.rolling(w.hashes, WINDOW)[start]
            b = (wordhash.rolling(wordhash.mix(w.hashes ^ _U(wordhash.STEP)), WINDOW)[start] >> _U(32)).astype(np.uint32)
            waiting.append((a, b, own[w.row[start] - w.low].astype(np.int32), w.place[start].astype(np.int32)))
            size += len(start)
            if size >= BUCKET:
                send()
                size = 0
        if size:
            send()
        return pa.table(out, schema=kinds)

    return work, "_bucket int, _task long, _content binary, _places binary, _later binary"


def _later(table: pa.Table) -> pa.Table:
    """For each piece the places of windows whose content has an earlier place, in one bucket of contents."""
    tasks = table["_task"].to_pylist()
    cut = np.cumsum([0, *(len(x.as_buffer()) // 12 for x in table["_content"])])
    n = int(cut[-1])
    a, b = np.empty(n, dtype=np.uint64), np.empty(n, dtype=np.uint32)
    seat, place = np.empty(n, dtype=np.int32), np.empty(n, dtype=np.int32)  # seat: number of a sender's document
    rows, docs, ties, seats = [], [], [], 0
    for x, y, content, places in zip(cut[:-1].tolist(), cut[1:].tolist(), table["_content"], table["_places"], strict=True):
        raw = content.as_buffer()
        a[x:y] = np.frombuffer(raw, dtype=np.uint64, count=y - x)
        b[x:y] = np.frombuffer(raw, dtype=np.uint32, offset=8 * (y - x))
        row, doc, tie, at, place[x:y] = unsqueeze(places.as_buffer(), np.int64, np.int64, np.int64, np.int32, np.int32)
        seat[x:y] = seats + np.cumsum(at)
        seats += len(row)
        for column, told in zip((rows, docs, ties), (row, doc, tie), strict=True):
            column.append(told)
    rows, docs, ties = (np.concatenate(c) for c in (rows, docs, ties))
    order = np.lexsort((ties, docs))
    fresh = np.append(False, (docs[order][1:] != docs[order][:-1]) | (ties[order][1:] != ties[order][:-1]))
    rank = np.empty(seats, dtype=np.int32)
    rank[order] = np.cumsum(fresh)
    del docs, ties, order, fresh

    gone = np.zeros(n, dtype=bool)
    edges = np.linspace(float(a.min()), float(a.max()), n // SLICE + 2).astype(np.uint64)[1:-1]
    part = np.searchsorted(edges, a, side="right").astype(np.int32)  # equal contents lie in one slice
    for k in range(len(edges) + 1):
        mine = np.flatnonzero(part == k).astype(np.int32)
        x, y = a[mine], b[mine]
        order = np.lexsort((place[mine], rank[seat[mine]], y, x))
        x, y = x[order], y[order]
        gone[mine[order[1:]][(x[1:] == x[:-1]) & (y[1:] == y[:-1])]] = True
    told = [(t, known.as_py()) for t, known in zip(tasks, table["_later"], strict=True) if known.is_valid]
    for t, x, y in zip(tasks, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        late = x + np.flatnonzero(gone[x:y])  # by row and place, as they were sent
        if len(late):
            told.append((t, squeeze(rows[seat[late]], place[late])))
    return pa.table({"_task": pa.array([t for t, _ in told], type=pa.int64()),
                     "_data": pa.array([d for _, d in told], type=pa.binary())})


def _finish(carry: list[str], kinds: pa.Schema, digest: bool):
    """The documents of a piece with their words that stay, or the digest of these."""

    def work(rows: pa.Table, notes: pa.Table) -> pa.Table:
        group = _Group(rows, notes)
        parts = [unsqueeze(x, np.int64, np.int32) for x in group.answers]
        row = np.searchsorted(group.ids, np.concatenate([p[0] for p in parts])) if parts else np.zeros(0, dtype=np.int64)
        start = np.concatenate([p[1] for p in parts]) if parts else row
        order = np.lexsort((start, row))
        row, start = row[order], start[order]
        cut = np.searchsorted(row, np.arange(len(group.ids) + 1)).tolist()
        n, role = group.rows["_n"].to_pylist(), group.role.tolist()
        shown = [i for i in range(len(n)) if role[i] or n[i] < WINDOW]
        removed, left = [], []
        for i in shown:
            words = (group.rows["_text"][i].as_py() or "").encode("utf-8", "surrogatepass").split() if role[i] < 2 else []
            gone = n[i] if role[i] == 2 else 0
            if cut[i] < cut[i + 1]:
                steps = np.zeros(n[i] + 1, dtype=np.int64)
                steps[start[cut[i]:cut[i + 1]]] = 1  # a window begins once
                stays = np.cumsum(steps[:-1])
                stays[WINDOW:] -= stays[:-WINDOW].copy()
                words = list(compress(words, (stays == 0).tolist()))
                gone = n[i] - len(words)
            text = b" ".join(words)
            removed.append(gone)
            left.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "surrogatepass"))
        rest = group.rows.take(pa.array(shown, type=pa.int64()))
        return pa.table([*(rest[c].combine_chunks().cast(kinds.field(c).type) for c in carry),
                         *(rest[c] for c in ("_doc", "_d1", "_d2", "_n")),
                         pa.array(removed, type=pa.int64()), pa.array(left, type=pa.string())],
                        names=[*carry, "_doc", "_d1", "_d2", "_n", "_removed", "_left"])

    return work


def _results(docs: DataFrame, carry: list[str], digest: bool) -> DataFrame:
    """The columns ``carry``, _n, _removed and _left of every row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    texts = Texts(docs, carry)
    roles = _roles(texts)
    total = texts.table.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET, 1)
    bits = (wanted - 1).bit_length()

    work, schema = _probe(bits)
    anchors = texts.meet(_notes(roles), work, schema)
    work, schema = _hits(bits)
    hits = anchors.groupBy("_bucket").applyInArrow(work, schema)
    work, schema = _extend(bits)
    windows = texts.meet(_notes(roles, hits), work, schema)
    later = windows.groupBy("_bucket").applyInArrow(_later, "_task long, _data binary")
    own = T.StructType([docs.schema[c] for c in carry])
    schema = T.StructType([*own.fields, *T.StructType.fromDDL(
        "_doc long, _d1 long, _d2 long, _n long, _removed long, _left string").fields])
    found = keep(texts.meet(_notes(roles, later), _finish(carry, to_arrow_schema(own), digest), schema), "substring-dedup")

    # further rows of a document whose row above went through the steps
    twins = keep(texts.table.where(F.col("_n") >= WINDOW).join(roles.select("_task", "_row"), ["_task", "_row"], "left_anti")
                 .select(*carry, "_doc", "_d1", "_d2"), "substring-twins")
    texts.drop()
    drop(roles)
    of = found.where(F.col("_n") >= WINDOW).select("_doc", "_d1", "_d2", "_n", "_removed", "_left")
    columns = [*carry, "_n", "_removed", "_left"]
    return found.select(*columns).unionByName(twins.join(of, ["_doc", "_d1", "_d2"]).select(*columns))


def dedup(docs: DataFrame) -> DataFrame:
    """All rows with their columns; text is the words that stay, joined by one space, and ``_removed`` their loss.

    A text that loses nothing is returned as it was.
    """
    others = [c for c in docs.columns if c != "text"]
    kept = _results(docs.withColumn("_was", F.col("text")), [*others, "_was"], digest=False)
    text = F.when(F.col("_removed") == 0, F.col("_was")).otherwise(F.col("_left"))
    return kept.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], "_removed")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    return _results(docs.select("doc_id", "text"), ["doc_id"], digest=True).select(
        "doc_id", F.col("_n").alias("n_words"), F.col("_removed").alias("n_removed"), F.col("_left").alias("kept_sha256"))
