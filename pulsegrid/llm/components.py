"""Connected components of a link table by repeated contraction.

Every round draws a new order of the nodes by hash and moves each node to the first one among itself
and its neighbours: a minimum that is added up before the shuffle, so a node with very many links is
one row per task and not one task. Links are renamed by joins, whose hot keys Spark splits; loops and
repeats go. The last node of a component in the round's order is never moved to, so each round has
fewer nodes, by a constant factor in expectation, whatever the partitions and the shape: the rounds
grow with the logarithm of the links. Links are written to the shared checkpoint folder each round
and never come to the driver, only their number.

numpy sees pieces of at most PIECE links: a piece of a task's links is replaced by stars, which have
the same components and no more links, and the last PIECE links of all are settled as one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

PIECE = 1 << 17  # links that are in memory together, at most


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links, and of each the smallest that it reaches."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = local_labels(len(nodes), place[:len(a)], place[len(a):])
    return nodes, nodes[label]


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a task in pieces of at most the given size."""
    waiting: list[np.ndarray] = []
    size = 0
    for batch in batches:
        links = np.stack([batch.column("a").to_numpy(), batch.column("b").to_numpy()])
        while size + links.shape[1] >= most:
            yield tuple(np.concatenate([*waiting, links[:, :most - size]], axis=1))
            links, waiting, size = links[:, most - size:], [], 0
        if links.shape[1]:
            waiting.append(links)
            size += links.shape[1]
    if waiting:
        yield tuple(np.concatenate(waiting, axis=1))


def _thinned(links: DataFrame) -> DataFrame:
    """Stars with the components of each piece of the links, where the links happen to be."""
    most = PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _pieces(batches, most):
            nodes, roots = _stars(a, b)
            moved = nodes != roots
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(roots[moved])], names=["a", "b"])

    return links.mapInArrow(run, "a long, b long")


def _settled(links: DataFrame) -> DataFrame:
    """node and label of at most PIECE links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([x.column("a").to_numpy(), x.column("b").to_numpy()]) for x in batches if x.num_rows]
        if parts:
            nodes, roots = _stars(*np.concatenate(parts, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "label"])

    return links.coalesce(1).mapInArrow(run, "node long, label long")


def _moves(links: DataFrame, turn: int) -> DataFrame:
    """node and goal: the first among a node and its neighbours in the order of this round."""
    def place(c: str):  # xxhash64 maps no two longs to the same value
        return F.xxhash64(c, F.lit(turn))

    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    return (both.groupBy("node").agg(F.min(place("other")).alias("first"), F.min_by("other", place("other")).alias("other"))
            .select("node", F.when(F.col("first") < place("node"), F.col("other")).otherwise(F.col("node")).alias("goal")))


def _renamed(links: DataFrame, moves: DataFrame) -> DataFrame:
    """The links between the goals of their ends, each once."""
    x, y = (moves.select(F.col("node").alias(f"from_{e}"), F.col("goal").alias(f"to_{e}")) for e in "ab")
    return (links.join(x, F.col("a") == F.col("from_a")).join(y, F.col("b") == F.col("from_b")).where("to_a <> to_b")
            .select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b")).distinct())


def components(links: DataFrame) -> DataFrame:
    """node and label (smallest node reachable) for links with long columns a and b, in any order."""
    links = keep(_thinned(links.where("a <> b").select("a", "b")), "links")
    rounds: list[DataFrame] = []
    while links.count() > PIECE:
        rounds.append(keep(_moves(links, len(rounds)), "moves"))
        links = keep(_thinned(_renamed(links, rounds[-1])), "links")
    found = keep(_settled(links), "labels")
    for moves in reversed(rounds):
        later = found.select(F.col("node").alias("of"), F.col("label").alias("end"))
        found = keep(moves.join(later, F.col("goal") == F.col("of"), "left")
                     .select("node", F.coalesce("end", "goal").alias("label")), "labels")
    if not rounds:
        return found
    smallest = found.groupBy(F.col("label").alias("of")).agg(F.min("node").alias("smallest"))
    return keep(found.join(smallest, F.col("label") == F.col("of")).select("node", F.col("smallest").alias("label")),
                "labels")


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes by the links a[i] - b[i], within one block."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)  # roots too: regions merge as wholes
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
