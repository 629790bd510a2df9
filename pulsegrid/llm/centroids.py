"""Centroid clustering: rounds of nearest centroids over integer vectors, filtered in PCA coordinates.

Each component x becomes the integer floor(SCALE * x). The vectors are rotated once to the principal
axes of all of them (sums of products added up by Spark); what is stored of the rotation is the
leading coordinates and the norm of the rest. For a vector and a centroid the squared distance of
the leading coordinates plus the squared difference of the two norms is a lower bound of their
squared distance. A vector is compared in integers with the centroid of the lowest bound first, then
with those whose bound, less an allowance for rounding, does not exceed the distance found. The
result is that of comparing with all centroids in integers, whatever the rotation.

The driver holds the centroids and, a round, one sum per cluster and component; vectors stay where
their file is and nothing is shuffled but these sums, added up in each task.

Defined results: kept are vectors of exactly the given number of components, none of them null,
non-finite or, as an integer, of LIMIT or more (its square would not fit); the others, null and
empty vectors included, get no row. Repeated rows are vectors of their own. Initial centroids are
taken by the hash of their id, then id, then components; null ids come last. With fewer vectors
than centroids every vector starts one. Equal centroids: the smaller number gets the vectors, the
others stay as they are. Sums that do not fit a long are null. An empty table gives no rows; other
columns than the two named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, keep

CENTROIDS = 40
ROUNDS = 5
COMPONENTS = 64
SCALE = 256
SEED = "2"
LEADING = 16          # stored rotated coordinates
LIMIT = 1 << 27       # 64 squared differences of such integers fit a long
_ROUNDING = 1e-9      # of the squared norms: far above the error of 64 products


def integers(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id and x, the integer components, of the vectors that are kept."""
    e = F.col("embedding")
    sound = (F.size(e) == components) & F.forall(
        e, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < LIMIT / scale))  # NaN is above any number
    return (vectors.where(F.coalesce(sound, F.lit(False)))
            .select("vec_id", F.transform(e, lambda v: F.floor(v.cast("double") * scale).cast("int")).alias("x")))


def _matrix(column: pa.Array, components: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, components).astype(np.int64)


def initial(rows: DataFrame, centroids: int, seed: str) -> np.ndarray:
    """The components of the vectors with the smallest sha256 of seed:id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(digest.asc_nulls_last(), F.col("vec_id").asc_nulls_last(), "x").limit(centroids)
    return np.array([r.x for r in first.select("x").collect()], dtype=np.int64)


def principal_axes(rows: DataFrame, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of all vectors, and the axes by falling variance as columns of an orthogonal matrix."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((components + 1, components + 1))
        for batch in batches:
            x = _matrix(batch.column("x"), components).astype(np.float64)
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "s"])

    cells = rows.select("x").mapInArrow(add_up, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).toArrow()
    total = np.zeros((components + 1) ** 2)
    total[cells["cell"].to_numpy()] = cells["s"].to_numpy()
    total = total.reshape(components + 1, components + 1)
    n = max(total[-1, -1], 1.0)
    mean = total[-1, :-1] / n
    _, axes = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    return mean, axes[:, ::-1]


class Rotation:
    """Leading coordinates and the norm of the others."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray, leading: int):
        self.mean, self.axes, self.leading = mean, axes, leading

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (x - self.mean) @ self.axes
        return z[:, :self.leading], np.linalg.norm(z[:, self.leading:], axis=1)


def rotated(rows: DataFrame, turn: Rotation, components: int) -> DataFrame:
    """The vectors with their leading coordinates y and the norm r of the rest, kept in the shared folder."""
    shared = rows.sparkSession.sparkContext.broadcast(turn)  # components ** 2 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, r = shared.value(_matrix(batch.column("x"), components))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(y), type=pa.list_(pa.float64())), pa.array(r)],
                                             names=["vec_id", "x", "y", "r"])

    schema = T.StructType([*rows.schema.fields, T.StructField("y", T.ArrayType(T.DoubleType())),
                           T.StructField("r", T.DoubleType())])
    return keep(rows.mapInArrow(run, schema), "rotated-vectors")


def nearest(x: np.ndarray, y: np.ndarray, r: np.ndarray, centroids: np.ndarray, cy: np.ndarray,
            cr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and exact squared distance of the nearest centroid of each vector (ties: smaller number)."""
    own, other = (y * y).sum(axis=1) + r * r, (cy * cy).sum(axis=1) + cr * cr
    squares = own[:, None] + other[None, :]
    bound = squares - 2 * (y @ cy.T + np.outer(r, cr)) - _ROUNDING * (squares + 1)
    best = bound.argmin(axis=1)
    distance = ((x - centroids[best]) ** 2).sum(axis=1)
    tried = best.copy()
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= distance) & (tried != c))
        d = ((x[rows] - centroids[c]) ** 2).sum(axis=1)
        closer = (d < distance[rows]) | ((d == distance[rows]) & (c < best[rows]))
        best[rows[closer]], distance[rows[closer]] = c, d[closer]
    return best, distance


def _assigner(rows: DataFrame, turn: Rotation, centroids: np.ndarray):
    """A function from a batch of ``rows`` to x, cluster and distance."""
    shared = rows.sparkSession.sparkContext.broadcast((centroids, *turn(centroids)))
    components, leading = centroids.shape[1], min(turn.leading, centroids.shape[1])

    def of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = _matrix(batch.column("x"), components)
        y = batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(-1, leading)
        return x, *nearest(x, y, batch.column("r").to_numpy(zero_copy_only=False), *shared.value)

    return of


def moved(rows: DataFrame, turn: Rotation, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor of the mean of their vectors; empty ones stay."""
    assign, (k, components) = _assigner(rows, turn, centroids), centroids.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, components + 1), dtype=np.int64)  # the last column counts
        for batch in batches:
            x, cluster, _ = assign(batch)
            np.add.at(sums, cluster, np.concatenate([x, np.ones((len(x), 1), dtype=np.int64)], axis=1))
        used = np.flatnonzero(np.repeat(sums[:, -1] > 0, components + 1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums.ravel()[used])], names=["cell", "s"])

    cells = (rows.mapInArrow(add_up, "cell long, s long")
             .groupBy("cell").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    total = [[0] * (components + 1) for _ in range(k)]
    for cell, s in cells:
        total[cell // (components + 1)][cell % (components + 1)] = int(s)
    return np.array([[s // t[-1] for s in t[:-1]] if t[-1] else list(c) for t, c in zip(total, centroids.tolist(), strict=True)],
                    dtype=np.int64)


def assigned(rows: DataFrame, turn: Rotation, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""
    assign = _assigner(rows, turn, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, cluster, distance = assign(batch)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                                             names=["vec_id", "cluster", "distance"])

    schema = T.StructType([rows.schema["vec_id"], T.StructField("cluster", T.IntegerType()),
                           T.StructField("distance", T.LongType())])
    return rows.mapInArrow(run, schema)


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS,
            scale: int = SCALE, seed: str = SEED, leading: int = LEADING) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance of every kept vector (a kept table), and the final centroids."""
    rows = integers(vectors, components, scale)
    places = initial(rows, centroids, seed).reshape(-1, components)
    if not len(places):
        schema = T.StructType([rows.schema["vec_id"], T.StructField("cluster", T.IntegerType()),
                               T.StructField("distance", T.LongType())])
        return rows.sparkSession.createDataFrame([], schema), places
    turn = Rotation(*principal_axes(rows, components), leading)
    stored = rotated(rows, turn, components)
    for _ in range(rounds):
        places = moved(stored, turn, places)
    found = keep(assigned(stored, turn, places), "clusters")
    drop(stored)
    return found, places


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    found, places = cluster(vectors)
    spark = found.sparkSession
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row per centroid

    def fitting(n: int) -> int | None:
        return n if n < 1 << 63 else None

    whole = fitting(sum(sums.values()))
    told = [(c, fitting(sums.get(c, 0)), whole, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest())
            for c, x in enumerate(places.tolist())]
    of = spark.createDataFrame(told, "of int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), F.col("cluster") == F.col("of")).drop("of")  # as many rows as centroids
