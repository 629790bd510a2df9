"""Centroid clustering against a comparison with all centroids in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import centroids

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, k=centroids.CENTROIDS, rounds=centroids.ROUNDS, dim=centroids.COMPONENTS):
    kept = []
    for vec_id, e, *_ in rows:
        if e is not None and len(e) == dim and all(v is not None and abs(v) < centroids.LIMIT / centroids.SCALE for v in e):
            kept.append((vec_id, [math.floor(centroids.SCALE * float(np.float32(v))) for v in e]))
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] is not None and hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(),
                                        r[0] or 0, r[1]))
    places = [x for _, x in order[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, p)), c) for c, p in enumerate(places))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(near(x)[1], []).append(x)
        places = [[sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else p for i, p in enumerate(places)]
    found = [(i, near(x)) for i, x in kept]
    sums = {}
    for _, (d, c) in found:
        sums[c] = sums.get(c, 0) + d
    return sorted(((i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, places[c])).encode()).hexdigest())
                   for i, (d, c) in found), key=str)


def vector(seed, spread=1.0):
    r = random.Random(seed)
    return [r.gauss(0, spread) for _ in range(centroids.COMPONENTS)]


def hard_vectors():
    rows = [(i, vector(i % 70)) for i in range(160)]                       # ties: copies under other ids
    rows += [rows[3], rows[3], (None, vector(1000)), (None, vector(1000)), (None, vector(5))]
    rows += [(200, None), (201, []), (202, vector(1)[:-1]), (203, [*vector(1), 0.0]), (204, [float("nan"), *vector(1)[1:]]),
             (205, [float("inf"), *vector(2)[1:]]), (206, [None, *vector(3)[1:]]), (207, [0.0] * 64), (208, [-0.001] * 64),
             (209, [1e30, *vector(4)[1:]]), (210, [500_000.0] * 64), (211, [-500_000.0] * 64), (None, None)]
    return [(i, e, None if j % 5 == 0 else j) for j, (i, e) in enumerate(rows)]


def test_clusters_of_hard_vectors(spark):
    rows = hard_vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    clashing = df.withColumns({c: F.lit("x") for c in "x y r cluster cell s of distance inertia".split()})
    want = brute(rows)
    for table in (df, clashing):
        got = centroids.report(table)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(i, vector(i), 0) for i in range(7)] + [(7, vector(1), 0)]
    assert sorted((tuple(r) for r in centroids.report(spark.createDataFrame(rows, VECTORS)).collect()), key=str) == brute(rows)
    assert centroids.report(spark.createDataFrame([], VECTORS)).count() == 0
    assert centroids.report(spark.createDataFrame([(1, None, 1), (2, [], 1)], VECTORS)).count() == 0


@pytest.mark.parametrize("leading", [1, 16, 64])
@pytest.mark.parametrize("offset", [0, 100_000_000])
def test_filter_never_changes_the_nearest_centroid(leading, offset):
    rng = np.random.default_rng(leading)
    x = rng.integers(-300, 300, (500, 64)) + offset
    places = np.concatenate([x[:20], x[:5], x[20:30] + rng.integers(-2, 3, (10, 64))])
    axes = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    turn = centroids.Rotation(x.mean(axis=0), axes, leading)
    got = centroids.nearest(x, *turn(x), places, *turn(places))
    d = ((x[:, None, :] - places[None, :, :]) ** 2).sum(axis=2)
    assert (got[0] == d.argmin(axis=1)).all() and (got[1] == d.min(axis=1)).all()


def test_clusters_of_the_driver_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = sorted((tuple(r) for r in centroids.report(df).collect()), key=str)
    assert got == brute([(r.vec_id, r.embedding) for r in df.collect()])
