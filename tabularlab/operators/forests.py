"""Many random forests grown together, for grid searches with folds.

Features are binned once and written as a narrow table.  All forests of a grid then grow
level by level in the same passes: each task counts classes by (forest, tree, node,
feature, bin) over its rows, the counts are summed after an exchange by tree, and the best
split of every node comes back.  A forest of fewer trees is the beginning of a larger one,
and a shallower tree the top of a deeper one, so a grid over depth and number of trees
grows each tree once, to the largest depth.  A fold is a forest of its own that gives the
fold's rows no weight; one more per variant takes all rows.  The bootstrap gives a row a Poisson(1)
weight hashed from its key and the tree's number, and a node's features are drawn by a
hash of tree and node, so results do not depend on partitions or retries.

The driver and the broadcasts hold trees only: their size follows from the grid
(variants x folds x trees x nodes), never from the rows.  A task's counts are limited to
``COUNT_BYTES``; forests beyond that go in further passes of the same level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularlab.session import materialize

BINS = 32
COUNT_BYTES = 128 << 20
BLOCK_ROWS = 1 << 12         # rows that a task works on at once, in every tree of a forest
ALL_ROWS = -1                # the fold that leaves nothing out
OTHER_ROWS = -2              # fold of rows that no forest learns from


@dataclass(frozen=True)
class Variant:
    """What makes trees differ apart from their depth and number."""
    features: int            # drawn per node
    min_rows: int            # per child
    bootstrap: bool


@dataclass
class Forests:
    """Trees of all groups (variant, fold) as heaps: root 0, children 2i + 1 and 2i + 2."""
    groups: list[tuple[Variant, int]]
    feature: np.ndarray      # (group, tree, node): split feature, -1 none
    cut: np.ndarray          # bins up to this one go left
    counts: np.ndarray       # (group, tree, node, class)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: spreads the bits of its input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(*parts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.uint64(0x9E3779B97F4A7C15)
        for p in parts:
            h = mixed(np.asarray(p).astype(np.uint64) + h * np.uint64(0x9E3779B97F4A7C15))
    return h


POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])


def bootstrap_weights(keys: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """(tree, row): how often the tree draws the row."""
    u = (hashed(np.uint64(seed), np.arange(trees)[:, None], keys.view(np.uint64)[None]) >> np.uint64(11)) / 2.0 ** 53
    return np.searchsorted(POISSON, u, side="right").astype(np.int64)


def drawn_features(trees: int, level: int, width: int, k: int, seed: int) -> np.ndarray:
    """(tree, node of the level, k): the features each node may split on, ascending."""
    nodes = np.arange((1 << level) - 1, (1 << (level + 1)) - 1)
    order = hashed(np.uint64(seed + 1), np.arange(trees)[:, None, None], nodes[None, :, None], np.arange(width)[None, None])
    return np.sort(np.argsort(order, axis=2, kind="stable")[:, :, :k], axis=2)


def bin_features(data: DataFrame, names: Sequence[str], label: str, fold: str, key: str, carry: Sequence[str] = (),
                 bins: int = BINS) -> DataFrame:
    """(carry..., key, y, fold, x): ``x`` holds one bin number per feature, cut at quantiles of the rows with a fold."""
    cuts = [sorted(set(c)) for c in data.where(F.col(fold) >= 0).approxQuantile(
        list(names), [i / bins for i in range(1, bins)], 0.001)]
    edges = [np.array(c) for c in cuts]
    rows = data.select(*carry, F.xxhash64(key).alias("key"), F.coalesce(F.col(label), F.lit(0.0)).cast("int").alias("y"),
                       F.col(fold).cast("int").alias("fold"), F.array(*(F.col(f"`{n}`").cast("double") for n in names)).alias("values"))
    at = len(rows.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(edges))
            x = np.stack([np.searchsorted(e, v[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array([r.tobytes() for r in x], pa.binary())],
                                             names=[*b.schema.names[:at], "x"])

    out = rows.drop("values").schema.add("x", "binary")
    n = data.sparkSession.sparkContext.defaultParallelism
    return materialize(rows.mapInArrow(run, out).repartition(n), "binned")


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """(x, y, fold, key, batch rows) in blocks of at least ``BLOCK_ROWS`` rows, but for the last, and of less than twice as many."""
    held: list[pa.RecordBatch] = []

    def block():
        t = pa.Table.from_batches(held).combine_chunks()
        x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.uint8).reshape(-1, width)
        return x, t.column("y").to_numpy(), t.column("fold").to_numpy(), t.column("key").to_numpy(), t

    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            held.append(batch.slice(at, BLOCK_ROWS))
            if sum(h.num_rows for h in held) >= BLOCK_ROWS:
                yield block()
                held = []
    if held:
        yield block()


def step_down(feature: np.ndarray, cut: np.ndarray, x: np.ndarray, node: np.ndarray) -> np.ndarray:
    """(tree, row): the next node of each row in each tree; the same one where the tree ends."""
    tree = np.arange(len(feature))[:, None]
    f = feature[tree, node]
    right = x[np.arange(len(x))[None], np.maximum(f, 0)] > cut[tree, node]
    return np.where(f >= 0, 2 * node + 1 + right, node)


def count_level(rows: DataFrame, forests: Forests, chosen: list[int], level: int, width: int, classes: int, bins: int, seed: int) -> DataFrame:
    """(g, t, at, n): class counts of the level's nodes by drawn feature and bin, where not zero."""
    trees, nodes = forests.feature.shape[1], 1 << level
    groups = [(g, *forests.groups[g]) for g in chosen]
    shared = rows.sparkSession.sparkContext.broadcast((forests.feature[chosen], forests.cut[chosen]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, cut = shared.value
        drawn = {k: drawn_features(trees, level, width, k, seed) for k in {v.features for _, v, _ in groups}}
        counts: dict[int, np.ndarray] = {}
        for x, y, fold, key, _ in blocks(batches, width):
            weights = bootstrap_weights(key, trees, seed)
            for i, (g, v, out) in enumerate(groups):
                use = np.flatnonzero((fold >= 0) & (fold != out))
                node = np.zeros((trees, len(use)), np.int64)
                for _ in range(level):
                    node = step_down(feature[i], cut[i], x[use], node)
                t, r = np.nonzero(node >= nodes - 1)       # rows that reach this level
                local = node[t, r] - (nodes - 1)
                w = weights[t, use[r]] if v.bootstrap else np.ones(len(t), np.int64)
                value = x[use[r][:, None], drawn[v.features][t, local]]
                at = (((t * nodes + local)[:, None] * v.features + np.arange(v.features)) * bins + value) * classes + y[use[r]][:, None]
                made = np.bincount(at.ravel(), np.repeat(w, v.features), trees * nodes * v.features * bins * classes)
                if g in counts:
                    counts[g] += made.astype(np.int64)
                else:
                    counts[g] = made.astype(np.int64)
        for g, c in counts.items():
            found = [(t, np.flatnonzero(row), row) for t, row in enumerate(c.reshape(trees, -1))]
            found = [(t, a, row) for t, a, row in found if len(a)]          # other trees have ended
            yield pa.RecordBatch.from_arrays([
                pa.array([g] * len(found), pa.int32()), pa.array([t for t, _, _ in found], pa.int32()),
                pa.array([a.astype(np.int32).tobytes() for _, a, _ in found], pa.binary()),
                pa.array([row[a].tobytes() for _, a, row in found], pa.binary())], names=["g", "t", "at", "n"])

    return rows.mapInArrow(run, "g int, t int, at binary, n binary")


def best_splits(hist: np.ndarray, min_rows: int) -> tuple[np.ndarray, ...]:
    """For counts (node, feature, bin, class): whether the node splits, at which drawn feature
    and bin, and the classes left and right.  Ties go to the first feature, then the lowest bin."""
    total = hist.sum(axis=2)
    left = hist.cumsum(axis=2)[:, :, :-1]
    right = total[:, :, None] - left

    def impure(c):               # rows times Gini impurity
        n = c.sum(axis=-1)
        return n - (c * c).sum(axis=-1) / np.maximum(n, 1)

    n = np.maximum(total[:, 0].sum(axis=-1), 1)
    gain = (impure(total)[:, :, None] - impure(left) - impure(right)) / n[:, None, None]
    few = (left.sum(axis=-1) < min_rows) | (right.sum(axis=-1) < min_rows)
    gain = np.where(few, -1.0, np.round(gain, 12)).reshape(len(hist), -1)
    best = gain.argmax(axis=1)
    row = np.arange(len(hist))
    f, cut = np.divmod(best, left.shape[2])
    return gain[row, best] > 0, f, cut, left[row, f, cut], right[row, f, cut]


def split_level(counted: DataFrame, forests: Forests, level: int, width: int, classes: int, bins: int, seed: int) -> DataFrame:
    """(g, t, node, feature, cut, counts, own): the split nodes of each tree's level, with their
    children's classes; ``own`` are all nodes' classes."""
    trees, nodes = forests.feature.shape[1], 1 << level
    variants = [v for v, _ in forests.groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = {k: drawn_features(trees, level, width, k, seed) for k in {v.features for v in variants}}

        def done(g, t, hist):
            v = variants[g]
            h = hist.reshape(nodes, v.features, bins, classes)
            live = np.flatnonzero(h[:, 0].any(axis=(1, 2)))
            ok, f, cut, left, right = best_splits(h[live].astype(np.float64), v.min_rows)
            at = live[ok]
            return (g, t, at.astype(np.int32).tobytes(), drawn[v.features][t, at, f[ok]].astype(np.int8).tobytes(),
                    cut[ok].astype(np.uint8).tobytes(), np.stack([left[ok], right[ok]], axis=1).astype(np.float64).tobytes(),
                    h[:, 0].sum(axis=1).astype(np.float64).tobytes() if level == 0 else b"")

        def trees_done():
            current, hist = None, None
            for b in batches:
                for g, t, at, n in zip(*(c.to_pylist() for c in b.columns)):
                    if (g, t) != current:
                        if current is not None:
                            yield done(*current, hist)
                        current, hist = (g, t), np.zeros(nodes * variants[g].features * bins * classes, np.int64)
                    hist[np.frombuffer(at, np.int32)] += np.frombuffer(n, np.int64)
            if current is not None:
                yield done(*current, hist)

        rows = list(trees_done())      # as many as there are trees
        if rows:
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                             names=["g", "t", "node", "feature", "cut", "counts", "own"])

    n = counted.sparkSession.sparkContext.defaultParallelism
    return counted.repartition(n, "g", "t").sortWithinPartitions("g", "t").mapInArrow(
        run, "g int, t int, node binary, feature binary, cut binary, counts binary, own binary")


def grow_forests(rows: DataFrame, variants: Sequence[Variant], folds: Sequence[int], trees: int, depth: int, width: int,
                 classes: int = 2, bins: int = BINS, seed: int = 1) -> Forests:
    """All trees of all (variant, fold) groups over the binned rows."""
    groups = [(v, f) for v in variants for f in folds]
    size = (1 << (depth + 1)) - 1
    shape = (len(groups), trees, size)
    forests = Forests(groups, np.full(shape, -1, np.int8), np.zeros(shape, np.uint8), np.zeros((*shape, classes)))
    for level in range(max(depth, 1)):
        each = trees * (1 << level) * max(v.features for v in variants) * bins * classes * 8
        at_once = max(1, COUNT_BYTES // each)
        for at in range(0, len(groups), at_once):
            chosen = list(range(at, min(at + at_once, len(groups))))
            counted = count_level(rows, forests, chosen, level, width, classes, bins, seed)
            first = (1 << level) - 1
            for r in split_level(counted, forests, level, width, classes, bins, seed).collect():      # one row per tree
                if level == 0:
                    forests.counts[r.g, r.t, 0] = np.frombuffer(r.own)
                if level < depth:
                    node = np.frombuffer(r.node, np.int32) + first
                    forests.feature[r.g, r.t, node] = np.frombuffer(r.feature, np.int8)
                    forests.cut[r.g, r.t, node] = np.frombuffer(r.cut, np.uint8)
                    below = np.frombuffer(r.counts).reshape(len(node), 2, classes)
                    forests.counts[r.g, r.t, 2 * node + 1] = below[:, 0]
                    forests.counts[r.g, r.t, 2 * node + 2] = below[:, 1]
    return forests


def votes(feature: np.ndarray, cut: np.ndarray, share: np.ndarray, x: np.ndarray, depths: Sequence[int], sizes: Sequence[int]) -> dict:
    """{(depth, trees): (row, class) summed class shares} of one group's trees."""
    node, out = np.zeros((len(feature), len(x)), np.int64), {}
    tree = np.arange(len(feature))[:, None]
    for d in range(max(depths) + 1):
        if d in depths:
            summed = share[tree, node].cumsum(axis=0)
            out.update({(d, n): summed[n - 1] for n in sizes})
        node = step_down(feature, cut, x, node)
    return out


def class_shares(forests: Forests) -> np.ndarray:
    return forests.counts / np.maximum(forests.counts.sum(axis=-1, keepdims=True), 1)


def fold_scores(rows: DataFrame, forests: Forests, depths: Sequence[int], sizes: Sequence[int], width: int) -> dict:
    """{(variant, depth, trees): mean accuracy over the folds}, each fold scored by the forest that left it out."""
    shared = rows.sparkSession.sparkContext.broadcast((forests.feature, forests.cut, class_shares(forests)))
    groups = forests.groups
    variants = list(dict.fromkeys(v for v, _ in groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, cut, share = shared.value
        right: dict[tuple, list[int]] = {}
        for x, y, fold, _, _ in blocks(batches, width):
            for g, (v, f) in enumerate(groups):
                mine = fold == f
                if f < 0 or not mine.any():
                    continue
                for (d, n), s in votes(feature[g], cut[g], share[g], x[mine], depths, sizes).items():
                    c = right.setdefault((variants.index(v), f, d, n), [0, 0])
                    c[0] += int((s.argmax(axis=1) == y[mine]).sum())
                    c[1] += int(mine.sum())
        if right:
            cols = list(zip(*(k + tuple(c) for k, c in right.items())))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["v", "f", "d", "n", "hit", "rows"])

    found = rows.mapInArrow(run, "v long, f long, d long, n long, hit long, rows long") \
        .groupBy("v", "f", "d", "n").agg(F.sum("hit").alias("hit"), F.sum("rows").alias("rows")).collect()   # one per fold and setting
    scores: dict[tuple, list[float]] = {}
    for r in sorted(found):
        scores.setdefault((variants[r.v], r.d, r.n), []).append(r.hit / r.rows)
    return {k: sum(v) / len(v) for k, v in scores.items()}


def predict_rows(rows: DataFrame, forests: Forests, settings: dict[str, tuple[Variant, int, int]], width: int,
                 carry: Sequence[str]) -> DataFrame:
    """``carry`` and per entry of ``settings`` (variant, depth, trees) the class that the forest
    over all rows predicts."""
    picked = {name: (forests.groups.index((v, ALL_ROWS)), d, n) for name, (v, d, n) in settings.items()}
    share = class_shares(forests)
    parts = {name: (forests.feature[g], forests.cut[g], share[g], d, n) for name, (g, d, n) in picked.items()}
    shared = rows.sparkSession.sparkContext.broadcast(parts)
    schema = rows.select(*carry).schema
    for name in settings:
        schema = schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _, _, _, t in blocks(batches, width):
            made = [pa.array(votes(f, c, s, x, [d], [n])[d, n].argmax(axis=1).astype(np.float64)) for f, c, s, d, n in shared.value.values()]
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in carry), *made], names=[*carry, *shared.value])

    return rows.mapInArrow(run, schema)
