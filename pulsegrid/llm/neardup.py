"""Embedding near-dedup by an inverted multi-index.

The two halves of the unit vectors get a codebook each; a vector's home is the cell of its nearest
codewords in the grid of both. From every vector the multi-sequence traversal visits cells in order
of the distance to their codewords, as many as a sample needs to reach the target recall. All
vectors are indexed; the codebooks and the number of visits are fitted on a bounded sample. Pairs
met in a cell are verified by cosine in double precision, in blocks of bounded size: a block returns
counts and a spanning forest of its links, never pairs.

Equal vectors are one class and take part once. The grid grows with the number of classes, so a cell
holds about CELL of them; a cell with more is dealt into parts, and all parts meet.

Defined results: vectors that are null or empty, are all zero, hold null or non-finite components,
or have a null id link with nothing (n_links 0, component their own id); vectors of different
lengths don't link, and lengths other than the most frequent are compared without an index; repeated
rows are returned as often as they come and count as other vectors; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .components import components, local_labels

COSINE = 0.95
SAMPLE = 20_000        # vectors that the codebooks are fitted on, at most
QUERIES = 512          # of them, compared with all vectors to set the number of visits
TARGET_RECALL = 0.999
LEAST_VISITS = 4
CELL = 256             # classes in a cell, on average
MOST_CODEWORDS = 256   # of each half
PART = 768             # classes of a cell that meet in one block

_ROUNDS = 12


def _valid(vector: str):
    v = F.col(vector)
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) <= F.lit(1.7976931348623157e308), F.lit(False)))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))


def unit(rows: list) -> np.ndarray:
    """The vectors at length 1, in double precision."""
    x = np.array(rows, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Grid:
    """Codebooks of the two halves; cells are numbered row by row."""

    def __init__(self, sample: np.ndarray, codewords: int):
        self.half = sample.shape[1] // 2
        self.books = [_codebook(part, codewords) for part in (sample[:, :self.half], sample[:, self.half:])]
        self.width = len(self.books[1])
        self.cells = len(self.books[0]) * self.width

    def _distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [(p ** 2).sum(axis=1)[:, None] - 2 * p @ c.T + (c ** 2).sum(axis=1)
                for p, c in zip((x[:, :self.half], x[:, self.half:]), self.books, strict=True)]

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self._distances(x)
        return a.argmin(axis=1) * self.width + b.argmin(axis=1)

    def visits(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each vector: the first n of the two sorted sequences' product hold them."""
        a, b = self._distances(x)
        n = min(n, self.cells)
        ia, ib = np.argsort(a, axis=1, kind="stable")[:, :n], np.argsort(b, axis=1, kind="stable")[:, :n]
        # the cell (i, j) of the sorted sequences is among the n nearest only if (i + 1) * (j + 1) <= n
        i, j = (k.ravel() for k in np.meshgrid(np.arange(ia.shape[1]), np.arange(ib.shape[1]), indexing="ij"))
        inside = (i + 1) * (j + 1) <= n
        i, j = i[inside], j[inside]
        rows = np.arange(len(x))[:, None]
        far = a[rows, ia][:, i] + b[rows, ib][:, j]
        best = np.argsort(far, axis=1, kind="stable")[:, :n]
        return ia[rows, i[best]] * self.width + ib[rows, j[best]]

    def rank(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many cells a vector visits before the given one."""
        a, b = self._distances(x)
        rows = np.arange(len(x))
        own = a[rows, cell // self.width] + b[rows, cell % self.width]
        return np.array([(a[r][:, None] + b[r][None, :] < own[r] - 1e-12).sum() for r in rows], dtype=np.int64)


def _codebook(x: np.ndarray, n: int) -> np.ndarray:
    """k-means from evenly spaced rows of the sample."""
    book = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)].copy()
    for _ in range(_ROUNDS):
        near = ((x ** 2).sum(axis=1)[:, None] - 2 * x @ book.T + (book ** 2).sum(axis=1)).argmin(axis=1)
        count = np.bincount(near, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, near, x)
        book[count > 0] = total[count > 0] / count[count > 0, None]
    return book


def fit(classes: DataFrame, size: int, total: int, cosine: float) -> tuple[Grid, int]:
    """Grid and number of visits for vectors of the given length."""
    own = classes.where(F.size("vec") == size)
    sample = unit([r["vec"] for r in own.orderBy("key").limit(SAMPLE).select("vec").toLocalIterator()])
    grid = Grid(sample, min(MOST_CODEWORDS, max(2, int(np.ceil(np.sqrt(total / CELL))))))
    queries = sample[np.linspace(0, len(sample) - 1, min(QUERIES, len(sample))).astype(int)]
    shared = classes.sparkSession.sparkContext.broadcast((grid, queries))  # a few hundred rows each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, q = shared.value
        home = g.home(q)
        found = np.zeros(g.cells, dtype=np.int64)
        for batch in batches:
            x = unit(batch.column("vec").to_pylist()) if batch.num_rows else np.zeros((0, q.shape[1]))
            for low in range(0, len(x), 2048):
                y = x[low:low + 2048]
                cos = y @ q.T
                i, j = np.nonzero((cos >= cosine) & (cos < 1.0 - 1e-12))
                if len(i):
                    theirs = g.home(y)
                    np.add.at(found, np.minimum(g.rank(y[i], home[j]), g.rank(q[j], theirs[i])), 1)
        ranks = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(ranks), pa.array(found[ranks])], names=["rank", "n"])

    ranks = (own.select("vec").mapInArrow(run, "rank long, n long")
             .groupBy("rank").agg(F.sum("n").alias("n")).orderBy("rank").toArrow().to_pydict())
    visits, met, wanted = LEAST_VISITS, 0, TARGET_RECALL * sum(ranks["n"])
    for rank, n in zip(ranks["rank"], ranks["n"], strict=True):
        if met >= wanted:
            break
        met, visits = met + n, max(LEAST_VISITS, rank + 1)
    return grid, min(visits, grid.cells)


def _indexed(classes: DataFrame, size: int, grid: Grid, visits: int) -> DataFrame:
    """key, n, unit vector as bytes, home cell and the cells visited; other lengths have one cell each."""
    shared = classes.sparkSession.sparkContext.broadcast(grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("vec").to_pylist()
            packed, homes, cells = [b""] * len(vectors), [0] * len(vectors), [[]] * len(vectors)
            main = [i for i, v in enumerate(vectors) if len(v) == size]
            for i, v in enumerate(vectors):
                if len(v) != size:
                    packed[i], homes[i], cells[i] = unit([v])[0].tobytes(), -len(v), [-len(v)]
            if main:
                x = unit([vectors[i] for i in main])
                home, seen = shared.value.home(x), shared.value.visits(x, visits)
                for i, v, h, c in zip(main, x, home, seen, strict=True):
                    packed[i], homes[i], cells[i] = v.tobytes(), int(h), c.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("n"), pa.array(packed, type=pa.binary()),
                 pa.array(homes, type=pa.int64()), pa.array(cells, type=pa.list_(pa.int64()))],
                names=["key", "n", "unit", "home", "visits"])

    return classes.select("key", "n", "vec").mapInArrow(
        run, "key long, n long, unit binary, home long, visits array<long>")


def _met(indexed: DataFrame, cosine: float) -> DataFrame:
    """Rows (a, null, n): n vectors linked with class a; rows (a, b, null): links of a forest."""
    probes = indexed.withColumn("cell", F.explode("visits"))
    members = indexed.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    visitors = probes.groupBy(F.col("cell").alias("of")).agg(F.ceil(F.count(F.lit(1)) / PART).alias("turns"))
    cells = keep(members.join(visitors, F.col("cell") == F.col("of")).select(F.col("cell").alias("at"), "parts", "turns"),
                 "cells")

    def dealt(rows: DataFrame, cell: str, probe: bool) -> DataFrame:
        own, every = ("turns", "parts") if probe else ("parts", "turns")
        fixed = F.pmod(F.xxhash64("key", F.lit(probe)), F.col(own))
        placed = (rows.join(cells, F.col(cell) == F.col("at"))
                  .withColumns({"own": fixed, "each": F.explode(F.sequence(F.lit(0).cast("long"), F.col(every) - 1))}))
        part, turn = ("each", "own") if probe else ("own", "each")
        return placed.select("at", F.col(part).alias("part"), F.col(turn).alias("turn"), F.lit(probe).alias("probe"),
                             "key", "n", "unit", "home", "visits")

    units = dealt(indexed, "home", False).unionByName(dealt(probes, "cell", True))

    def run(table: pa.Table) -> pa.Table:
        probe = table["probe"].to_numpy()
        key, n, home = (table[c].to_numpy() for c in ("key", "n", "home"))
        x = np.frombuffer(b"".join(table["unit"].to_pylist()), dtype=np.float64).reshape(len(key), -1)
        p, m = np.flatnonzero(probe), np.flatnonzero(~probe)
        i, j = np.nonzero(x[p] @ x[m].T >= cosine)
        i, j = p[i], m[j]
        other = key[i] != key[j]
        i, j = i[other], j[other]
        count = np.zeros(len(key), dtype=np.int64)
        np.add.at(count, i, n[j])
        # a member that doesn't visit the probe's home learns of the pair here
        seen = table["visits"].to_pylist()
        lists = {k: set(seen[k]) for k in np.unique(j).tolist()}
        unseen = np.fromiter((h not in lists[k] for h, k in zip(home[i].tolist(), j.tolist(), strict=True)),
                             dtype=bool, count=len(i))
        np.add.at(count, j[unseen], n[i[unseen]])
        index = {k: at for at, k in enumerate(dict.fromkeys(key.tolist()))}  # a class can be probe and member
        node = np.array([index[k] for k in key.tolist()], dtype=np.int64)
        names = list(index)
        label = local_labels(len(names), node[i], node[j])
        moved = np.flatnonzero(label != np.arange(len(names)))
        told = np.flatnonzero(count)
        return pa.table({
            "a": pa.array([*key[told].tolist(), *(names[k] for k in moved)], type=pa.int64()),
            "b": pa.array([None] * len(told) + [names[label[k]] for k in moved], type=pa.int64()),
            "n": pa.array([*count[told].tolist(), *[None] * len(moved)], type=pa.int64())})

    return units.groupBy("at", "part", "turn").applyInArrow(run, "a long, b long, n long")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"))
    rows = rows.withColumn("key", F.when(_valid("vec"), F.xxhash64("vec")))
    classes = keep(rows.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.first("vec").alias("vec"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("smallest")), "vector-classes")
    sizes = classes.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    ids = rows.select("vec_id", "key")
    if not sizes:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                          F.lit(True).alias("kept"))
    grid, visits = fit(classes, sizes[0]["size"], sizes[0]["count"], cosine)
    met = keep(_met(keep(_indexed(classes, sizes[0]["size"], grid, visits), "vector-index"), cosine), "met")
    found = components(met.where(F.col("b").isNotNull()).select("a", "b"))
    linked = met.where(F.col("b").isNull()).groupBy("a").agg(F.sum("n").alias("others"))
    told = keep(classes.select("key", "n", "smallest").join(found, F.col("key") == F.col("node"), "left")
                .join(linked, F.col("key") == F.col("a"), "left")
                .select(F.col("key").alias("of"), F.coalesce("label", "key").alias("label"), "smallest",
                        (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")), "vector-links")
    lowest = told.groupBy(F.col("label").alias("root")).agg(F.min("smallest").alias("component_id"))
    named = told.join(lowest, F.col("label") == F.col("root")).select("of", "n_links", "component_id")
    return (ids.join(named, F.col("key") == F.col("of"), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
