import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularlab.operators import forests as FO

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def binned(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 4)).round(1)
    y = ((x[:, 0] + x[:, 1] > 0) ^ (rng.random(240) < 0.1)).astype(float)
    rows = [(i, float(y[i]), i % 3 if i < 200 else FO.OTHER_ROWS, *map(float, x[i])) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, y double, fold int, a double, b double, c double, d double")
    return FO.bin_features(df, NAMES, "y", "fold", "id", ["id"], bins=8)


def brute_tree(x, y, weight, variant, tree, depth, seed):
    """{node: (feature, cut or None, counts)} of one tree, node by node."""
    out = {}

    def gini(c):
        n = sum(c)
        return n - sum(v * v for v in c) / n if n else 0.0

    def grow(node, level, rows):
        counts = [float(sum(weight[r] for r in rows if y[r] == k)) for k in (0, 1)]
        best = None
        if level < depth and sum(counts):
            local = node - ((1 << level) - 1)
            for f in FO.drawn_features(tree + 1, level, x.shape[1], variant.features, seed)[tree, local]:
                for cut in range(7):
                    left = [sum(weight[r] for r in rows if y[r] == k and x[r, f] <= cut) for k in (0, 1)]
                    right = [c - v for c, v in zip(counts, left)]
                    if min(sum(left), sum(right)) < variant.min_rows:
                        continue
                    gain = round((gini(counts) - gini(left) - gini(right)) / sum(counts), 12)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = gain, int(f), cut
        out[node] = (best[1:] if best else None, counts)
        if best:
            _, f, cut = best
            grow(2 * node + 1, level + 1, [r for r in rows if x[r, f] <= cut])
            grow(2 * node + 2, level + 1, [r for r in rows if x[r, f] > cut])

    grow(0, 0, list(range(len(x))))
    return out


def test_trees_equal_those_grown_one_by_one(spark, binned, monkeypatch):
    monkeypatch.setattr(FO, "COUNT_BYTES", 1 << 14)        # several passes per level
    variants = [FO.Variant(2, 1, True), FO.Variant(3, 10, False)]
    got = FO.grow_forests(binned, variants, [0, FO.ALL_ROWS], 3, 3, 4, bins=8, seed=5)
    rows = binned.orderBy("id").collect()
    x = np.array([list(r.x) for r in rows])
    y, fold, key = (np.array([r[c] for r in rows]) for c in ("y", "fold", "key"))
    weights = FO.bootstrap_weights(key, 3, 5)
    assert abs(weights.mean() - 1) < 0.15
    for g, (v, out) in enumerate(got.groups):
        use = (fold >= 0) & (fold != out)
        for t in range(3):
            w = weights[t, use] if v.bootstrap else np.ones(use.sum(), int)
            want = brute_tree(x[use], y[use], w, v, t, 3, 5)
            for node, (split, counts) in want.items():
                assert got.counts[g, t, node].tolist() == counts
                assert (got.feature[g, t, node] == -1) == (split is None)
                if split:
                    assert (got.feature[g, t, node], got.cut[g, t, node]) == split
            assert (got.feature[g, t] >= 0).sum() == sum(s is not None for s, _ in want.values())


def test_scores_and_predictions_follow_from_the_trees(spark, binned):
    v = FO.Variant(2, 1, True)
    grown = FO.grow_forests(binned, [v], [0, 1, 2, FO.ALL_ROWS], 6, 4, 4, bins=8)
    scores = FO.fold_scores(binned, grown, [0, 2, 4], [3, 6], 4)
    share = FO.class_shares(grown)

    def chosen(g, x, depth, trees):
        total = np.zeros(2)
        for t in range(trees):
            node = 0
            for _ in range(depth):
                f = grown.feature[g, t, node]
                if f >= 0:
                    node = 2 * node + 1 + (x[f] > grown.cut[g, t, node])
            total += share[g, t, node]
        return int(total.argmax())

    rows = binned.collect()
    for (_, d, n), score in scores.items():
        right = [np.mean([chosen(f, r.x, d, n) == r.y for r in rows if r.fold == f]) for f in range(3)]
        assert score == pytest.approx(np.mean(right))
    assert scores[v, 4, 6] > 0.65          # about half the rows are of each class
    other = FO.predict_rows(binned.where(F.col("fold") == FO.OTHER_ROWS), grown, {"p": (v, 4, 6)}, 4, ["id"]).collect()
    known = {r.id: r for r in rows}
    assert len(other) == 40 and all(r.p == chosen(3, known[r.id].x, 4, 6) for r in other)


def test_growth_does_not_depend_on_partitions(spark, binned):
    v = [FO.Variant(2, 3, True)]
    a = FO.grow_forests(binned.coalesce(1), v, [1], 4, 3, 4, bins=8)
    b = FO.grow_forests(binned.repartition(7), v, [1], 4, 3, 4, bins=8)
    assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and (a.counts == b.counts).all()


def test_blocks_are_bounded_for_batches_of_any_size(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(FO, "BLOCK_ROWS", 100)

    def batch(start, n):
        ids = np.arange(start, start + n)
        return pa.RecordBatch.from_arrays([pa.array([bytes([i % 7, 1]) for i in ids], pa.binary()), pa.array(ids % 2), pa.array(ids % 5), pa.array(ids)],
                                          names=["x", "y", "fold", "key"])

    got = list(FO.blocks(iter([batch(0, 30), batch(30, 0), batch(30, 1050), batch(1080, 5)]), 2))
    assert max(len(b[0]) for b in got) < 200 and min(len(b[0]) for b in got[:-1]) >= 100
    assert np.concatenate([b[3] for b in got]).tolist() == list(range(1085))
    assert np.concatenate([b[0][:, 0] for b in got]).tolist() == [i % 7 for i in range(1085)]
