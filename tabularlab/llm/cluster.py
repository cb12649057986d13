"""Centroid clustering over Hilbert-ordered blocks with min/max boxes (zone maps).

Vectors become integers, are put in Hilbert order and written once as blocks: a row holds up
to ``block_rows`` neighbouring vectors and the least and largest value of each
component.  In every round a block first takes bounds from its box: no
vector in it is nearer to centroid c than the box is, nor farther than the box's far
corner.  Centroids whose least distance exceeds another's largest can be nobody's nearest
there; the others are compared with every vector, exactly.  Ties are kept by the bounds
and go to the smaller number.

A round returns one row of sums per task and centroid; the driver holds the
centroids only (``k`` times the dimension).  Sums and distances are exact whole numbers:
in double precision where all of them stay below 2**53, else in 64-bit integers.

Equal vectors tie on the curve and are dealt over tasks by a hash of their id, so a value that
a third of the rows share does not land in one task.

Defined cases: vectors that are null, have another length, or hold a null or
non-finite component are left out.  Scaled components are cut at plus and minus 2**27,
beyond which a squared distance would not fit in 64 bits; a sum of distances that
does not fit is null.  A null id counts as the empty text when first centroids are chosen; repeated
rows are vectors of their own, ordered by their components where ids tie.  With fewer vectors
than ``k`` every one is a first centroid; with none the result is empty.  Only the id and the
vector are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularlab.llm.common import Scratch, need

CENTROIDS = 40
ROUNDS = 5
DIMENSIONS = 64
SCALE = 256
SALT = 2
BLOCK_ROWS = 64
LARGEST = 1 << 27
CURVE_BITS = 3               # bits per component on the curve
TASK_BYTES = 64 << 20        # of vectors that one task holds in a round


def whole_vectors(rows: DataFrame, vector: Column, dims: int, scale: float) -> DataFrame:
    """``rows`` with ``v``, the scaled vector in whole numbers; rows without a sound vector go."""
    sound = (F.size(vector) == dims) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    cut = F.transform(vector, lambda x: F.floor(
        F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x.cast("double") * float(scale)))).cast("int"))
    return rows.where(sound).withColumn("v", cut)


def hilbert_keys(cells: np.ndarray, bits: int = CURVE_BITS) -> list[bytes]:
    """Position on the Hilbert curve of each row of cells (non-negative, below 2**bits), as
    big-endian bytes: J. Skilling's transform of axes to transposed bits, whole columns at a time."""
    x = cells.astype(np.int64).T.copy()
    for p in reversed(range(1, bits)):
        q = 1 << p
        for i in range(len(x)):
            flip = (x[i] & q) > 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(flip, q - 1, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    odd = np.zeros_like(x[0])
    for p in reversed(range(1, bits)):
        odd ^= np.where(x[-1] & (1 << p), (1 << p) - 1, 0)
    x ^= odd
    planes = np.stack([(x >> p) & 1 for p in reversed(range(bits))])       # bit, axis, row
    packed = np.packbits(planes.reshape(bits * len(x), -1).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def write_blocks(vectors: DataFrame, low: list[int], high: list[int], n: int, block_rows: int, scratch: Scratch) -> DataFrame:
    """The blocks in Hilbert order: ids, vectors (32-bit, row by row), low and high corner."""
    dims = len(low)
    floor, width = np.array(low, np.int64), np.maximum(1, -(-(np.array(high, np.int64) - low + 1) // (1 << CURVE_BITS)))

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = hilbert_keys((matrix(b.column(1), dims) - floor) // width)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], names=["id", "v", "key"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1), dims).astype(np.int32)
            starts = np.arange(0, len(x), block_rows)
            ends = [*starts[1:].tolist(), len(x)]
            yield pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array([*starts.tolist(), len(x)], pa.int32()), b.column(0)),
                pa.array([x[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary()),
                pa.array(np.minimum.reduceat(x, starts).tolist(), pa.list_(pa.int32())),
                pa.array(np.maximum.reduceat(x, starts).tolist(), pa.list_(pa.int32()))], names=["ids", "x", "low", "high"])

    id_type = vectors.schema["id"].dataType
    keyed = vectors.mapInArrow(with_key, T.StructType([*vectors.schema.fields, T.StructField("key", T.BinaryType())]))
    spark = vectors.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(n * dims * 4 / TASK_BYTES))
    order = ["key", F.xxhash64("id")]
    dealt = keyed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("id", "v")
    ints = T.ArrayType(T.IntegerType())
    return scratch.table(dealt.mapInArrow(pack, T.StructType([
        T.StructField("ids", T.ArrayType(id_type)), T.StructField("x", T.BinaryType()),
        T.StructField("low", ints), T.StructField("high", ints)])), "blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(block, centroid): whether the centroid can be the nearest of a vector in the block's box."""
    found = np.zeros((len(low), len(centroids)), bool)
    for at in range(0, len(low), 256):             # bounds the working memory
        lo, hi = low[at:at + 256, None], high[at:at + 256, None]
        near = np.maximum(np.maximum(lo - centroids, centroids - hi), 0)
        far = np.maximum(np.abs(centroids - lo), np.abs(hi - centroids))
        limit = (far * far).sum(axis=2).min(axis=1)
        found[at:at + 256] = (near * near).sum(axis=2) <= limit[:, None]
    return found


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the nearest centroid of each row (ties: the first) and the squared distance."""
    dims = x.shape[1]
    reach = max(1, int(np.abs(x).max()), int(np.abs(centroids).max()))
    if 4 * dims * reach * reach < 1 << 53:         # every sum below is a whole number that doubles hold
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        d = (c * c).sum(axis=1) - 2 * (a @ c.T) + (a * a).sum(axis=1)[:, None]
    else:
        d = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best].astype(np.int64)


def assigned(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(ids, vectors, cluster, distance, compared centroids) of each block."""
    dims = centroids.shape[1]
    ids, data = batch.column(0), batch.column(1)
    open_to = candidates(matrix(batch.column(2), dims).astype(np.int64), matrix(batch.column(3), dims).astype(np.int64), centroids)
    for i in range(batch.num_rows):
        x = np.frombuffer(data[i].as_buffer(), np.int32).reshape(-1, dims).astype(np.int64)
        chosen = np.flatnonzero(open_to[i])
        best, distance = nearest(x, centroids[chosen])
        yield ids[i].values, x, chosen[best], distance, len(chosen)


def round_sums(blocks: DataFrame, centroids: np.ndarray) -> tuple[dict[int, tuple[int, list[int]]], int]:
    """({cluster: (count, component sums)}, compared pairs) of one round."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, pairs = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), 0
        for b in batches:
            for _, x, cluster, _, compared in assigned(b, centroids):
                np.add.at(total, cluster, x)
                count += np.bincount(cluster, minlength=k)
                pairs += len(x) * compared
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([
            pa.array(used.astype(np.int32)), pa.array(count[used]),
            pa.array(total[used].tolist(), pa.list_(pa.int64())),
            pa.array([pairs if i == 0 else 0 for i in range(len(used))], pa.int64())], names=["cluster", "n", "s", "pairs"])

    parts = blocks.mapInArrow(run, "cluster int, n long, s array<long>, pairs long")
    rows = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.sum("pairs").alias("pairs"),
        F.array(*(F.sum(F.get("s", F.lit(i)).cast("decimal(38,0)")) for i in range(dims))).alias("s")).collect()   # at most k rows
    return {r.cluster: (r.n, [int(x) for x in r.s]) for r in rows}, sum(r.pairs for r in rows)


def first_centroids(vectors: DataFrame, k: int, salt: int) -> np.ndarray:
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()      # k rows
    return np.array([r.v for r in rows], np.int64)


def moved(centroids: np.ndarray, sums: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    out = centroids.copy()
    for cluster, (n, total) in sums.items():
        out[cluster] = [x // n for x in total]
    return out


def cluster_vectors(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS,
                    dims: int = DIMENSIONS, scale: float = SCALE, salt: int = SALT, block_rows: int = BLOCK_ROWS,
                    compared: list | None = None) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid): ``centroid`` is the final
    centroid's components.  ``compared`` takes each round's share of compared pairs."""
    need(rows, id_col, vector)
    spark = rows.sparkSession
    vectors = whole_vectors(rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").alias("e")),
                            F.col("e"), dims, scale).select("id", "v")
    id_type = vectors.schema["id"].dataType
    value = [F.get("v", F.lit(i)) for i in range(dims)]
    with Scratch(spark, "cluster") as scratch:
        n, low, high = vectors.agg(F.count("*"), F.array(*map(F.min, value)), F.array(*map(F.max, value))).first()
        if not n:
            return spark.createDataFrame([], T.StructType([T.StructField(id_col, id_type)])).selectExpr(
                f"`{id_col}`", "cast(null as int) as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia",
                "array(0L) as centroid")
        centroids = first_centroids(vectors, k, salt)
        blocks = write_blocks(vectors, low, high, n, block_rows, scratch)
        for _ in range(rounds):
            sums, pairs = round_sums(blocks, centroids)
            if compared is not None:
                compared.append(pairs / (n * len(centroids)))
            centroids = moved(centroids, sums)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for ids, _, cluster, distance, _ in assigned(b, centroids):
                    yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)],
                                                     names=["id", "cluster", "distance"])

        final = scratch.table(blocks.mapInArrow(run, T.StructType([
            T.StructField("id", id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])),
            "clusters", keep=True)
    wide = final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()   # at most k rows
    fits = [int(r.d) if r.d < 1 << 63 else None for r in wide]
    total = sum(int(r.d) for r in wide)
    known = spark.createDataFrame(
        [(r.cluster, f, total if total < 1 << 63 else None, centroids[r.cluster].tolist()) for r, f in zip(wide, fits)],
        "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return final.join(F.broadcast(known), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def cluster_report(rows: DataFrame) -> DataFrame:
    """The digest of ``op11_centroid_clusters``."""
    found = cluster_vectors(rows)
    text = F.concat_ws(",", F.transform("centroid", lambda x: x.cast("string")))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                        F.sha2(text.cast("binary"), 256).alias("centroid_sha256"))


def _cluster_sql() -> str:
    """The rounds one after another: every vector against every centroid."""
    steps = [f"""
k as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
      from embeddings where len(embedding) = {DIMENSIONS} and list_aggregate(list_transform(embedding,
        lambda x: case when x is null or not isfinite(x) then 1 else 0 end), 'sum') = 0),
c0 as (select row_number() over (order by h, v) - 1 as c, v from
       (select v, sha256('{SALT}:' || coalesce(cast(vec_id as varchar), '')) as h from k order by h, v limit {CENTROIDS}))"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""
d{i} as (select r, c, list_sum(list_transform(list_zip(k.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from k, c{i}),
a{i} as materialized (select r, first(c order by d, c) as c, min(d) as d from d{i} group by r)""")
        if i < ROUNDS:
            steps.append(f"""
e{i} as (select a.c, k.v[j] as x, j from a{i} a join k using (r), (select unnest(range(1, {DIMENSIONS + 1})) as j)),
s{i} as (select c, j, sum(x) as s, count(*) as n from e{i} group by c, j),
m{i} as (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by j) as v from s{i} group by c),
c{i + 1} as materialized (select c{i}.c, coalesce(m.v, c{i}.v) as v from c{i} left join m{i} m using (c))""")
    last = ROUNDS
    return "with " + ",".join(steps) + f"""
select vec_id, cast(a.c as int) as cluster, cast(a.d as bigint) as distance,
       cast(sum(a.d) over (partition by a.c) as bigint) as cluster_inertia, cast(sum(a.d) over () as bigint) as inertia,
       sha256(array_to_string(list_transform(z.v, lambda x: cast(x as varchar)), ',')) as centroid_sha256
from a{last} a join k using (r) join c{last} z on z.c = a.c
"""


CLUSTER_SQL = _cluster_sql()
