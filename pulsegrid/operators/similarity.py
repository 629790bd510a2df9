"""Vector similarity: exact blocked top-k, recurrence decisions, action matching.

Exact top-k by inner product is a block nested-loop join. Per partition key
(e.g. org and service, or none) the query side is cut into ``QB`` hash blocks
and the index side into ``IB`` hash blocks. A block holds an ``SPLIT``-th of its
side, but ``block_rows`` at least and ``BLOCK_VALUES`` components at most, so
rows are copied about ``SPLIT`` times however many there are, until blocks have
reached their bound. Query rows are copied to each index block and index rows to
each query block; each (key, qb, ib) cell is one cogroup where numpy multiplies
tiles of the two blocks and keeps only each query's best k: after the first tile
only scores above a query's k-th so far are looked at. A ``row_number() <= k``
merge (planned as a partial group limit before the shuffle) then picks the global
best k per query. Nothing passes whole through the driver, one task or one
group, and no all-pairs rows are emitted; the cost is the inherent
``|Q| x |I|`` dot products, spread over ``QB x IB`` tasks per key. An index of
one small block (a catalog) is broadcast instead, and no query row is moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import DEDUP_TOP_K, SIMILARITY_THRESHOLD

DEFAULT_BLOCK_ROWS = 2048
# Sums of products differ in the last bits with the block's shape: scores count to this many
# decimals, so equal vectors tie in every block.
SCORE_DIGITS = 9
SMALL_INDEX = 2048       # rows of an index that is broadcast, at most
SPLIT = 8                # blocks a side is cut into, while they are neither too small nor too large
BLOCK_VALUES = 1 << 22   # components of a block at most
_TILE_QUERIES, _TILE_INDEX = 512, 2048


def _block_counts(queries: DataFrame, index: DataFrame, keys, vec: str, block_rows: int) -> DataFrame:
    def sized(side: DataFrame, name: str) -> DataFrame:
        n = F.count(F.lit(1))
        most = F.greatest(F.lit(block_rows), F.floor(F.lit(BLOCK_VALUES) / F.greatest(F.max(F.size(vec)), F.lit(1))))
        rows = F.least(most, F.greatest(F.lit(block_rows), F.ceil(n / SPLIT)))
        return side.groupBy(*keys).agg(F.ceil(n / rows).cast("int").alias(name))

    return sized(queries, "_qb_n").join(sized(index, "_ib_n"), keys, "inner")


def _matrix(table: pa.Table, column: str = "_v") -> np.ndarray:
    lists = table.column(column).combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _ids(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids (0 for null) and which of them are not null."""
    ids = table.column(column).combine_chunks()
    return ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)


def _best(qm: np.ndarray, qids: np.ndarray, im: np.ndarray, iids: np.ndarray, k: int,
          exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query place, index place and score of each query's best ``k``; index rows are in id order."""
    found = []
    width = max(_TILE_INDEX, k)
    for q0 in range(0, len(qm), _TILE_QUERIES):
        q, ids = qm[q0:q0 + _TILE_QUERIES], qids[q0:q0 + _TILE_QUERIES]
        rows = at = np.zeros(0, dtype=np.int64)
        score = np.zeros(0)
        low = np.full(len(q), -np.inf)
        for i0 in range(0, len(im), width):
            tile = im[i0:i0 + width]
            scores = q @ tile.T
            if exclude_self:
                first, end = (np.searchsorted(iids[i0:i0 + width], ids, side) for side in ("left", "right"))
                for more in range(int((end - first).max(initial=0))):
                    own = np.flatnonzero(first + more < end)
                    scores[own, first[own] + more] = -np.inf
            if i0 == 0:
                # all above the k-th score, then of those at it the lowest ids (columns are in id order)
                scores[~np.isfinite(scores)] = -np.inf
                judged = np.round(scores, SCORE_DIGITS)
                kk = min(k, judged.shape[1])
                kth = np.partition(judged, judged.shape[1] - kk, axis=1)[:, [judged.shape[1] - kk]]
                above, level = judged > kth, judged == kth
                level &= level.cumsum(axis=1) <= kk - above.sum(axis=1, keepdims=True)
                rows, at = np.nonzero(above | level)
                score = scores[rows, at]
                if kk == k:
                    low = kth[:, 0]
                continue
            # ids are higher from tile to tile: only a score above the k-th so far changes anything
            new, col = np.nonzero(scores > (low + 0.4 * 10.0 ** -SCORE_DIGITS)[:, None])
            value = scores[new, col]
            real = np.isfinite(value) & (np.round(value, SCORE_DIGITS) > low[new])
            if not real.any():
                continue
            rows, at = np.concatenate([rows, new[real]]), np.concatenate([at, col[real] + i0])
            score = np.concatenate([score, value[real]])
            judged = np.round(score, SCORE_DIGITS)
            order = np.lexsort((at, -judged, rows))
            start = np.searchsorted(rows[order], np.arange(len(q)))
            rank = np.arange(len(order)) - start[rows[order]]
            order, rank = order[rank < k], rank[rank < k]
            rows, at, score = rows[order], at[order], score[order]
            low[rows[rank == k - 1]] = judged[order[rank == k - 1]]
        real = np.isfinite(score)
        found.append((rows[real] + q0, at[real], score[real]))
    return tuple(np.concatenate([f[c] for f in found]) if found else np.zeros(0, dtype=t)
                 for c, t in enumerate((np.int64, np.int64, np.float64)))


def _in_id_order(index: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    ids, known = _ids(index, "_iid")
    by_id = np.lexsort((ids, ~known))  # null ids last
    return index.take(pa.array(by_id)), ids[by_id], known[by_id]


def _pairs(queries: pa.Table, index: pa.Table, k: int, exclude_self: bool) -> pa.Table:
    """The query columns but the vector, with _iid and score of each query's best ``k``."""
    rest = queries.drop_columns(["_v"])
    index, iids, known = _in_id_order(index)
    parts = []
    # null ids equal nothing: they are searched for, and found, as themselves by nobody
    qids, q_known = _ids(queries, "_qid")
    ends = iids[known]
    places = np.concatenate([ends, np.full(len(iids) - len(ends), np.iinfo(np.int64).max)])
    own = exclude_self and bool(q_known.any())
    if not len(queries) or not len(index):
        taken = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        parts.append(taken)
    else:
        qm, im = _matrix(queries), _matrix(index)
        for which, excluded in ((np.flatnonzero(q_known), own), (np.flatnonzero(~q_known), False)):
            if len(which):
                rows, at, score = _best(qm[which], qids[which], im, places, k, excluded)
                parts.append((which[rows], at, score))
    rows, at, score = (np.concatenate([p[c] for p in parts]) for c in range(3))
    out = rest.take(pa.array(rows))
    return (out.append_column("_iid", index.column("_iid").take(pa.array(at)))
            .append_column("score", pa.array(score, type=pa.float64())))


def exact_topk(queries: DataFrame, index: DataFrame, k: int, q_id: str = "id", i_id: str = "id",
               vec: str = "vector", keys=(), exclude_self: bool = False,
               block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Best ``k`` index rows per query by inner product.

    Returns (keys..., query_id, match_id, score, rank). ``exclude_self`` drops
    pairs with equal ids (self-search over one table). Scores are float64 sums
    of products; scores equal to SCORE_DIGITS are ties and go to the lower index id.
    """
    keys = list(keys)
    if not keys:  # one global partition key; keeps every step an equi-join
        queries, index, keys, drop = queries.withColumn("_all", F.lit(0)), index.withColumn("_all", F.lit(0)), \
            ["_all"], True
    else:
        drop = False
    q = queries.select(*keys, F.col(q_id).cast("bigint").alias("_qid"), F.col(vec).alias("_v")).where("_v IS NOT NULL")
    # index-side keys get their own names: both sides may come from one table,
    # and a cogroup on identically named self-join columns is ambiguous
    i_keys = [f"_ik{j}" for j in range(len(keys))]
    key_types = {f.name: f.dataType.simpleString() for f in queries.schema.fields if f.name in keys}
    schema_str = ", ".join([f"{kname} {key_types[kname]}" for kname in keys]
                           + ["_qid bigint", "_iid bigint", "score double"])
    i = (index.select(*[F.col(c).alias(f"_ik{j}") for j, c in enumerate(keys)], F.col(i_id).cast("bigint").alias("_iid"),
                      F.col(vec).alias("_v")).where("_v IS NOT NULL"))
    small = i.select("_iid", "_v").limit(SMALL_INDEX + 1).toArrow() if drop else None
    if small is not None and len(small) <= min(SMALL_INDEX, block_rows):
        shared = queries.sparkSession.sparkContext.broadcast(small)  # at most SMALL_INDEX rows

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _pairs(pa.Table.from_batches([batch]), shared.value, k, exclude_self).to_batches()

        cells = q.mapInArrow(scan, schema_str)
    else:
        counts = _block_counts(q.withColumnRenamed("_v", vec), i.select(*[F.col(f"_ik{j}").alias(c) for j, c in enumerate(keys)],
                                                                        F.col("_v").alias(vec)), keys, vec, block_rows)
        q = (q.join(counts, keys, "inner")
             .select(*keys, "_qid", "_v",
                     F.pmod(F.xxhash64("_qid"), F.col("_qb_n")).cast("int").alias("_qb"),
                     F.explode(F.sequence(F.lit(0), F.col("_ib_n") - 1)).alias("_ib")))
        i = (i.join(counts.select(*[F.col(c).alias(f"_ik{j}") for j, c in enumerate(keys)], "_qb_n", "_ib_n"), i_keys, "inner")
             .select(*i_keys, "_iid", "_v",
                     F.pmod(F.xxhash64("_iid"), F.col("_ib_n")).cast("int").alias("_ib"),
                     F.explode(F.sequence(F.lit(0), F.col("_qb_n") - 1)).alias("_qb")))

        def cell(qt: pa.Table, it: pa.Table) -> pa.Table:
            return _pairs(qt.select([*keys, "_qid", "_v"]), it.select(["_iid", "_v"]), k, exclude_self)

        cells = (q.groupBy(*keys, "_qb", "_ib")
                 .cogroup(i.groupBy(*i_keys, "_qb", "_ib"))
                 .applyInArrow(cell, schema_str))
    w = Window.partitionBy(*keys, "_qid").orderBy(F.round("score", SCORE_DIGITS).desc(), F.col("_iid").asc())
    ranked = cells.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    out = ranked.select(*keys, F.col("_qid").alias("query_id"), F.col("_iid").alias("match_id"), "score", "rank")
    return out.drop("_all") if drop else out


def dedup_post_filter(queries: DataFrame, index: DataFrame, keys=("org_id", "service"),
                      q_id: str = "case_id", threshold: float = SIMILARITY_THRESHOLD,
                      k: int = DEDUP_TOP_K, exclude_self: bool = False, recent=None,
                      block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Reference-parity decision: top ``k`` over ALL vectors, first hit that is a candidate.

    A hit is a candidate when it has the query's ``keys`` (org, service) and,
    if ``recent(q, i)`` is given, satisfies it (e.g. updated within the
    lookback). Only the k hits per query are checked, so nearer vectors of
    other services can hide a true match (use ``dedup_pre_filter`` to avoid
    that). Duplicate iff the hit's score >= threshold; the score is kept when
    below, NULL when no hit is a candidate.
    """
    keys = list(keys)
    qq = queries.select(F.col(q_id).alias("_q"), "vector")
    ii = index.select(F.col(q_id).alias("_i"), "vector")
    top = (exact_topk(qq, ii, k, q_id="_q", i_id="_i", exclude_self=exclude_self, block_rows=block_rows)
           .withColumnRenamed("query_id", "_q").withColumnRenamed("match_id", "_i"))
    qk = queries.select(F.col(q_id).alias("_q"), *[F.col(c).alias(f"_q_{c}") for c in queries.columns
                                                   if c not in ("vector", q_id)])
    ik = index.select(F.col(q_id).alias("_i"), *[F.col(c).alias(f"_i_{c}") for c in index.columns
                                                 if c not in ("vector", q_id)])
    hits = top.join(qk, "_q").join(ik, "_i")
    for c in keys:
        hits = hits.where(F.col(f"_q_{c}") == F.col(f"_i_{c}"))
    if recent is not None:
        hits = hits.where(recent(lambda c: F.col(f"_q_{c}"), lambda c: F.col(f"_i_{c}")))
    best = hits.groupBy("_q").agg(F.min_by(F.struct("_i", "score"), F.col("rank")).alias("h"))
    out = queries.select(F.col(q_id).alias("_q")).join(best, "_q", "left")
    dup = F.coalesce(F.col("h.score") >= threshold, F.lit(False))
    return out.select(F.col("_q").alias(q_id),
                      F.when(dup, F.col("h._i")).alias("matched_case_id"),
                      F.col("h.score").alias("score"), dup.alias("is_duplicate"))


def dedup_pre_filter(queries: DataFrame, index: DataFrame, keys=("org_id", "service"),
                     q_id: str = "case_id", threshold: float = SIMILARITY_THRESHOLD,
                     exclude_self: bool = False, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Exact best candidate within the same keys (org, service): blocks by key first."""
    keys = list(keys)
    qq = queries.select(*keys, F.col(q_id).alias("_q"), "vector")
    ii = index.select(*keys, F.col(q_id).alias("_i"), "vector")
    top = (exact_topk(qq, ii, 1, q_id="_q", i_id="_i", keys=keys, exclude_self=exclude_self,
                      block_rows=block_rows)
           .withColumnRenamed("query_id", "_q").withColumnRenamed("match_id", "_i"))
    base = queries.select(*[F.col(c).alias(f"_k{j}") for j, c in enumerate(keys)], F.col(q_id).alias("_q"))
    top = top.select(*[F.col(c).alias(f"_k{j}") for j, c in enumerate(keys)], "_q", "_i", "score")
    out = base.join(top, [*[f"_k{j}" for j in range(len(keys))], "_q"], "left")
    dup = F.coalesce(F.col("score") >= threshold, F.lit(False))
    return out.select(F.col("_q").alias(q_id), F.when(dup, F.col("_i")).alias("matched_case_id"),
                      F.col("score"), dup.alias("is_duplicate"))


def normalized_centroids(vectors: DataFrame, label_col: str = "label", vec: str = "vector") -> DataFrame:
    """Unit-length mean vector per label (a small catalog derived from the data)."""
    comp = (vectors.select(label_col, F.posexplode(vec).alias("pos", "x"))
            .groupBy(label_col, "pos").agg(F.avg("x").alias("m")))
    norm = comp.groupBy(label_col).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    unit = comp.join(norm, label_col).withColumn("u", F.col("m") / F.col("norm"))
    return unit.groupBy(label_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "u"))), lambda s: s["u"]).alias(vec))
