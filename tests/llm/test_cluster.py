import hashlib
import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from tabularlab.llm import cluster

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=40, rounds=5, dims=64, scale=256):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [max(-(1 << 27), min(1 << 27, math.floor(scale * x))) for x in e]))
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in kept[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, vs in groups.items():
            centroids[n] = [sum(x) // len(vs) for x in zip(*vs)]
    final = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in final)
    return sorted(((i, n, d, sum(e for _, e, m in final if m == n), total,
                    hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in final), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def vectors(n, seed=1, spread=0.05, centres=7):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, 64))
    return [(i, [float(np.float32(x)) for x in middle[i % centres] + spread * rng.normal(size=64)], i) for i in range(n)]


def test_hilbert_neighbours_differ_by_one_step():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = cluster.hilbert_keys(cells, bits)
        assert len(set(keys)) == len(keys)
        walk = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_awkward_vectors_equal_brute_force(spark):
    rows = vectors(150)
    sound = rows[0][1]
    rows += [rows[3], rows[3], (None, sound, 0), (900, None, 0), (901, [], 0), (902, sound[:-1], 0), (903, [*sound, 1.0], 0),
             (904, [None, *sound[1:]], 0), (905, [float("nan"), *sound[1:]], 0), (906, [float("inf"), *sound[1:]], 0),
             (907, [1e30, -1e30, 20_000.0, *sound[3:]], 0), (908, [0.0] * 64, None)] + [(i, sound, 0) for i in range(1000, 1100)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute([(r[0], r[1]) for r in rows])
    assert got(cluster.cluster_report(df)) == want
    crowded = df.select("*", *(F.lit(1).alias(c) for c in ("id", "v", "key", "ids", "x", "low", "high", "cluster", "distance")))
    assert got(cluster.cluster_report(crowded)) == want


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = vectors(9)
    assert got(cluster.cluster_report(spark.createDataFrame(rows, SCHEMA))) == brute([(r[0], r[1]) for r in rows])
    none = cluster.cluster_report(spark.createDataFrame([(1, [1.0], 0)], SCHEMA))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert cluster.cluster_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_boxes_prune_clustered_vectors_and_change_nothing(spark):
    df = spark.createDataFrame(vectors(1400, spread=0.02), SCHEMA)
    shares = []
    small = got(cluster.cluster_vectors(df, k=14, block_rows=16, compared=shares))
    assert max(shares) < 0.5
    assert small == got(cluster.cluster_vectors(df, k=14, block_rows=4096))


def test_candidates_hold_every_nearest():
    rng = np.random.default_rng(5)
    for _ in range(200):
        x = rng.integers(-20, 20, (30, 5))
        c = rng.integers(-20, 20, (8, 5))
        open_to = cluster.candidates(x.min(axis=0)[None], x.max(axis=0)[None], c)[0]
        best, d = cluster.nearest(x, c)
        assert open_to[best].all()
        large, _ = cluster.nearest(x * (1 << 22), c * (1 << 22))         # the path in 64-bit integers
        assert (large == best).all()
        assert (d == ((x - c[best]) ** 2).sum(axis=1)).all()
