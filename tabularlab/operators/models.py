"""Models (ML8-ML21) on Spark ML.

Fits are distributed; the driver only sees parameters (p x p matrices, tree
ensembles).  Feature vectors are assembled once and cached before repeated
fits (cross-validation, grid search, feature elimination).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabularlab.session import materialize, one_row_batches, scratch_path, track

# ---------------------------------------------------------------- ML8 exact k-NN


MAX_CELLS = 1024             # bounds the table of centres that every task holds
QUERY_BYTES = 1 << 20        # of packed vectors that travel as one group of queries
CANDIDATE_BYTES = 16 << 20   # and as one group of candidates


def _distances(a, c):
    """Centre distances (row, centre), never below zero."""
    import numpy as np
    d2 = (a * a).sum(1)[:, None] + (c * c).sum(1) - 2.0 * (a @ c.T)
    return np.sqrt(np.maximum(d2, 0.0))


def _top_of_block(qa, ca, pid, k: int, reach=None):
    """(query row, candidate row, squared distance) of each query's k nearest candidates, ties to the
    smaller id; with ``reach`` only those within it."""
    import numpy as np
    kk = min(k, len(ca))
    qq, cc = (qa * qa).sum(1), (ca * ca).sum(1)
    near = qq[:, None] + cc - 2.0 * (qa @ ca.T)
    limit = np.partition(near, kk - 1, axis=1)[:, kk - 1]
    if reach is not None:
        limit = np.minimum(limit, reach)
    # the product form rounds: take all within its error, then measure those exactly
    slack = 1e-9 * (qq.max() + cc.max() + 1.0)
    row, col = np.nonzero(near <= limit[:, None] + slack)
    diff = qa[row] - ca[col]
    d2 = np.einsum("ij,ij->i", diff, diff)
    order = np.lexsort((pid[col], d2, row))
    row, col, d2 = row[order], col[order], d2[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < kk
    return row[keep], col[keep], d2[keep]


def _vectors(column, rows: int):
    import numpy as np
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _nearest(q, kth, x, cc, pid, k: int):
    """(query row, candidate row, squared distance) of each query's k nearest candidates within ``kth``, ties to the
    smaller id.  The candidates pass in chunks that grow, so later chunks meet limits that the earlier ones have set."""
    import numpy as np
    q = q.astype(np.float64)
    qq, limit = np.einsum("ij,ij->i", q, q), kth.copy()
    # single precision finds what to measure, unless its range could overflow; the measures are doubles
    kind = np.float32 if qq.max() + cc.max() < 1e30 else np.float64
    slack = max((q.shape[1] + 8) * float(np.finfo(kind).eps), 1e-9) * (qq + cc.max() + 1.0)
    left, norm = (-2.0 * q).astype(kind), cc.astype(kind)
    row, col, d2 = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    at, size = 0, 1024
    while at < len(x):
        near = left @ x[at:at + size].astype(kind, copy=False).T
        near += norm[at:at + size]
        r, c = np.nonzero(near <= (limit - qq + slack).astype(kind)[:, None])
        c += at
        diff = q[r] - x[c]
        row, col, d2 = np.concatenate([row, r]), np.concatenate([col, c]), np.concatenate([d2, np.einsum("ij,ij->i", diff, diff)])
        order = np.lexsort((pid[col], d2, row))
        row, col, d2 = row[order], col[order], d2[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        last = rank == k - 1
        limit[row[last]] = np.minimum(limit[row[last]], d2[last])
        row, col, d2 = row[rank < k], col[rank < k], d2[rank < k]
        at, size = at + size, min(4 * size, 16_384)
    return row, col, d2


def _groups(rows, parts, most: int):
    """(first group, blocks a group) of each cell: consecutive cells share a group of at most ``most`` rows; a cell of more is split."""
    import numpy as np
    first, per, group, held = [], [], 0, 0
    for n, p in zip(rows, parts):
        if held and held + n > most:
            group, held = group + 1, 0
        each = max(1, most * p // n)
        first.append(group)
        per.append(each)
        if p > each:
            group, held = group + -(-p // each), 0
        else:
            held += n
    return np.array(first), np.array(per)


def knn_classify(df: DataFrame, id_col: str, vec_col: str, label_col: str, k: int = 5, block_rows: int = 256,
                 compared: list | None = None) -> DataFrame:
    """Exact k-nearest-neighbour majority vote (every row is also a query and
    counts as its own neighbour; ties in distance -> smaller id; ties in the
    vote -> smaller label).

    Rows go to the nearest of about sqrt(n) centres (rows picked by a hash, at most ``MAX_CELLS``);
    a cell has a centre, a radius and one or more blocks of about ``block_rows`` rows, dealt by
    row number, so equal vectors do not fill one block.  A block is one row of packed vectors.
    Each block first finds every query's k-th distance t among its own rows.  By the triangle
    inequality a cell whose centre is further than t + radius holds no better neighbour, so a block meets only
    the cells that one of its queries can reach.  Blocks travel in groups of neighbouring cells (``QUERY_BYTES``,
    ``CANDIDATE_BYTES``): an equi-join on the group number, so what is exchanged grows with the groups met, not with
    the pairs of blocks; within a pair of groups only the cells met are compared.  Only candidates within t travel on.
    ``compared`` takes the share of block pairs compared: small on clustered data, near 1 on isotropic data.
    """
    import numpy as np
    import pyarrow as pa
    data = df.select(F.col(id_col).cast("long").alias("_id"), F.transform(vec_col, lambda x: x.cast("double")).alias("_v"),
                     F.col(label_col).cast("long").alias("_label"))
    kind = df.schema[label_col].dataType
    single = df.schema[vec_col].dataType.elementType.typeName() == "float"       # kept as narrow as it comes
    n = data.count()
    if not n:
        return df.select(id_col, label_col, F.lit(None).cast(kind).alias("pred"))
    cells = min(MAX_CELLS, int(np.ceil(np.sqrt(n))))
    picked = data.select("_v").orderBy(F.xxhash64("_id"), "_id").limit(cells).collect()      # at most MAX_CELLS rows
    centres = np.array([r._v for r in picked])

    def assign(batches):
        for b in batches:
            d = _distances(_vectors(b.column(1), b.num_rows), centres)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])],
                                             names=["_id", "_v", "_label", "_cell", "_far"])

    placed = materialize(data.mapInArrow(assign, "_id long, _v array<double>, _label long, _cell int, _far double")
                         .withColumn("_row", F.monotonically_increasing_id()), "knn-rows")
    known = {r._cell: r for r in placed.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_far").alias("far")).collect()}   # a row per cell
    used = sorted(known)
    parts = np.array([-(-known[c].n // block_rows) for c in used])
    first = np.concatenate([[0], np.cumsum(parts)])          # a cell's blocks are first[i] ... first[i + 1] - 1
    width = centres.shape[1] * (4 if single else 8)
    rows = [known[c].n for c in used]
    asks, ask_per = _groups(rows, parts, max(block_rows, QUERY_BYTES // max(width, 1)))
    group, per = _groups(rows, parts, max(block_rows, CANDIDATE_BYTES // max(width, 1)))
    spark = df.sparkSession
    table = spark.createDataFrame([(c, i, *(int(a[i]) for a in (first, parts, asks, ask_per, group, per))) for i, c in enumerate(used)],
                                  "_cell int, _at int, _first int, _parts int, _asks int, _askper int, _group int, _per int")
    part = F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int")
    dealt = placed.join(F.broadcast(table), "_cell").withColumn("_p", part).select(
        (F.col("_first") + F.col("_p")).alias("_b"), "_at", (F.col("_asks") + F.expr("_p div _askper")).cast("int").alias("_ask"),
        (F.col("_group") + F.expr("_p div _per")).cast("int").alias("_group"), F.struct("_id", "_label", "_v").alias("r"))
    packed = F.flatten(F.col("r._v")).cast(f"array<{'float' if single else 'double'}>")
    blocks = materialize(dealt.groupBy("_b", "_at", "_ask", "_group").agg(F.collect_list("r").alias("r")).select(
        "_b", "_at", "_ask", "_group", F.col("r._id").alias("_id"), F.col("r._label").alias("_label"), packed.alias("_x")), "knn-blocks")
    centre, radius = centres[used], np.array([known[c].far for c in used])
    ends = group + (parts - 1) // per                        # a cell's last group

    def reach(batches):
        """The query side: each block's vectors, k-th squared distances, the cells it has to meet and their groups."""
        for b in batches:
            for i in range(b.num_rows):
                ids = b.column(1)[i].values.to_numpy(zero_copy_only=False)
                packed = b.column(2)[i].values
                x = packed.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
                row, _, d2 = _top_of_block(x, x, ids, k)
                kth = np.full(len(x), np.inf)
                full = np.bincount(row, minlength=len(x)) >= k
                np.maximum.at(held := np.zeros(len(x)), row, d2)
                kth[full] = held[full]
                away = _distances(x, centre)
                slack = 1e-6 * (1.0 + away.max() + radius)
                met = np.flatnonzero((away - radius - slack <= np.sqrt(kth)[:, None]).any(axis=0))
                to = np.unique(np.concatenate([np.empty(0, np.int64), *(np.arange(group[c], ends[c] + 1) for c in met)]))
                one = lambda v, t: pa.array([v], pa.list_(t))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, 1), one(ids, pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(packed)], pa.int32()), packed),
                    one(kth, pa.float64()), one(met.astype(np.int32), pa.int32()), one(to.astype(np.int32), pa.int32()),
                    pa.array([int(parts[met].sum())], pa.int64())],
                    names=["_ask", "_qid", "_qx", "_kth", "_met", "_to", "_n"])

    kept = "float" if single else "double"
    with one_row_batches(spark):
        asked = materialize(blocks.select("_ask", "_id", "_x").mapInArrow(
            reach, f"_ask int, _qid array<long>, _qx array<{kept}>, _kth array<double>, _met array<int>, _to array<int>, _n long"), "knn-asked")
    if compared is not None:
        compared.append(asked.agg(F.sum("_n")).first()[0] / int(first[-1]) ** 2)
    # a group of candidates comes in as many copies as let all cores share its work
    tasks = 8 * spark.sparkContext.defaultParallelism
    copies = max(1, -(-tasks // int(ends.max() + 1)))
    queries = asked.groupBy("_ask").agg(F.collect_list(F.struct("_qid", "_qx", "_kth", "_met")).alias("_q"),
                                        F.array_distinct(F.flatten(F.collect_list("_to"))).alias("_to")) \
        .select("_q", F.explode("_to").alias("_group"), F.pmod("_ask", F.lit(copies)).alias("_copy")).repartition(tasks, "_group", "_copy")
    candidates = blocks.groupBy("_group").agg(F.collect_list(F.struct("_at", "_id", "_label", "_x")).alias("_c")) \
        .select("_group", "_c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_copy")).repartition(tasks, "_group", "_copy")
    pairs = queries.join(candidates, ["_group", "_copy"]).select("_q", "_c")

    def compare(batches):
        for b in batches:
            for i in range(b.num_rows):
                asks, c = b.column(0)[i].values, b.column(1)[i].values
                flat = lambda a: a.flatten().to_numpy(zero_copy_only=False)
                pid, label = flat(c.field("_id")), flat(c.field("_label"))
                cell = np.repeat(c.field("_at").to_numpy(zero_copy_only=False), c.field("_id").value_lengths().to_numpy(zero_copy_only=False))
                x = flat(c.field("_x")).reshape(len(pid), -1)
                cc = np.einsum("ij,ij->i", x, x, dtype=np.float64)
                for j in range(len(asks)):
                    qid, qx, kth, met = (asks.field(f)[j].values.to_numpy(zero_copy_only=False) for f in ("_qid", "_qx", "_kth", "_met"))
                    use = np.zeros(len(used), bool)
                    use[met] = True
                    at = np.flatnonzero(use[cell])
                    if not len(at):
                        continue
                    mine = (x, cc, pid) if len(at) == len(x) else (x[at], cc[at], pid[at])
                    row, col, d2 = _nearest(qx.reshape(len(qid), -1), kth, *mine, k)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(pid[at[col]]), pa.array(label[at[col]]), pa.array(d2)],
                                                     names=["_id", "_pid", "_plabel", "_d2"])

    with one_row_batches(spark):         # a row is a pair of groups
        found = materialize(pairs.mapInArrow(compare, "_id long, _pid long, _plabel long, _d2 double"), "knn-found")
    w = Window.partitionBy("_id").orderBy("_d2", "_pid")
    near = found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    votes = near.groupBy("_id", "_plabel").agg(F.count(F.lit(1)).alias("_votes"))
    best = votes.groupBy("_id").agg(F.min_by("_plabel", F.struct(-F.col("_votes"), F.col("_plabel"))).alias("pred"))
    return df.select(F.col(id_col), F.col(label_col)).join(
        best.select(F.col("_id").alias(id_col), F.col("pred").cast(kind).alias("pred")), id_col)


# ---------------------------------------------------------------- feature tables for the classifiers


def document_features(documents: DataFrame, labels: DataFrame, langs: Sequence[str]) -> DataFrame:
    """Passenger-like entity: labelled documents with numeric and indicator features."""
    from tabularlab.operators.text import word_count
    d = documents.join(labels, "doc_id")
    feats = d.select(
        "doc_id", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"),
        F.col("n_chars").cast("double").alias("n_chars"),
        word_count(F.col("text")).cast("double").alias("n_words"),
        (F.size(F.split("text", "\n")) - 1).cast("double").alias("n_lines"),
        F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("double"), F.lit(-1.0)).alias("source_no"),
        (F.regexp_count("text", F.lit("[0-9]")) / F.greatest(F.col("n_chars"), F.lit(1))).alias("digit_share"),
        *[F.coalesce((F.col("lang") == v).cast("double"), F.lit(0.0)).alias(f"lang_{v}") for v in langs])
    return feats


FEATURES = ["n_chars", "n_words", "n_lines", "source_no", "digit_share"]


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def log_loss_col(label: str, prob) -> F.Column:
    p = F.least(F.greatest(prob, F.lit(1e-15)), F.lit(1 - 1e-15))
    return -(F.col(label) * F.log(p) + (1 - F.col(label)) * F.log(1 - p))


def positive_probability(col: str = "probability") -> F.Column:
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col(col))[1]


def gbt_classifier(train: DataFrame, test: DataFrame, label: str, max_iter: int = 20, step: float = 0.1,
                   seed: int = 1):
    """ML10: gradient-boosted trees; returns (model, scored test)."""
    from pyspark.ml.classification import GBTClassifier
    m = GBTClassifier(labelCol=label, featuresCol="features", maxIter=max_iter, stepSize=step, maxDepth=3,
                      seed=seed).fit(train)
    return m, m.transform(test)


def importances(model, names: Sequence[str]) -> list[tuple[str, float]]:
    imp = model.featureImportances.toArray()
    return [(n, float(v)) for n, v in zip(names, imp)]


def tree_arrays(spark, model) -> tuple:
    """The trees of a fitted ensemble as arrays (tree, node): feature (-1: leaf), threshold, left, right,
    prediction; and the trees' weights.  They are read from the model's own saved form, one row per node."""
    import numpy as np
    path = scratch_path(spark, f"trees-{uuid.uuid4().hex[:12]}")
    model.write().save(path)
    track(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()      # the model's size
    n = max(r.id for r in nodes) + 1
    shape = (model.getNumTrees, n)
    feature, left, right = (np.full(shape, -1, np.int64) for _ in range(3))
    threshold, value = np.zeros(shape), np.zeros(shape)
    for r in nodes:
        value[r.treeID, r.id] = r.prediction
        if r.leftChild >= 0:
            if r.split.numCategories != -1:
                raise ValueError("trees with categorical splits are not staged")
            feature[r.treeID, r.id], left[r.treeID, r.id], right[r.treeID, r.id] = r.split.featureIndex, r.leftChild, r.rightChild
            threshold[r.treeID, r.id] = r.split.leftCategoriesOrThreshold[0]
    return feature, threshold, left, right, value, np.array(model.treeWeights)


def staged_losses(rows: DataFrame, models: dict, label: str, part: str, features: str = "features") -> DataFrame:
    """(model, part, iteration, log_loss): the loss of every boosted ensemble after each of its
    iterations, in each part of ``rows``.

    One scan serves all of them: a task descends every tree for its rows, adds up the weighted
    predictions along the trees (the running margins), and returns one sum per model, part and
    iteration; those are summed in one aggregation.  Spark's boosting loss is
    2 log(1 + exp(-2 y F)) with y in {-1, 1}; halved it is the log-loss of p = sigmoid(2F)."""
    import numpy as np
    import pyarrow as pa
    from pyspark.ml.functions import vector_to_array
    spark = rows.sparkSession
    names = list(models)
    shared = spark.sparkContext.broadcast([tree_arrays(spark, models[m]) for m in names])
    slim = rows.select(F.col(part).cast("string").alias("part"), F.col(label).cast("double").alias("y"), vector_to_array(features).alias("x"))

    def run(batches):
        sums: dict = {}
        for b in batches:
            for at in range(0, b.num_rows, 2048):        # bounds trees x rows
                c = b.slice(at, 2048)
                parts, y = np.array(c.column(0).to_pylist(), object), 2 * c.column(1).to_numpy() - 1
                x = c.column(2).flatten().to_numpy(zero_copy_only=False).reshape(c.num_rows, -1)
                row = np.arange(len(x))[None]
                for m, (feature, threshold, left, right, value, weights) in enumerate(shared.value):
                    tree, node = np.arange(len(feature))[:, None], np.zeros((len(feature), len(x)), np.int64)
                    while (inner := feature[tree, node] >= 0).any():
                        f = np.maximum(feature[tree, node], 0)
                        down = np.where(x[row, f] <= threshold[tree, node], left[tree, node], right[tree, node])
                        node = np.where(inner, down, node)
                    margin = (weights[:, None] * value[tree, node]).cumsum(axis=0)
                    loss = np.logaddexp(0.0, -2.0 * y[None] * margin)
                    for p in dict.fromkeys(parts.tolist()):
                        mine = parts == p
                        held = sums.setdefault((m, p), [0, np.zeros(len(feature))])
                        held[0] += int(mine.sum())
                        held[1] += loss[:, mine].sum(axis=1)
        for (m, p), (n, loss) in sums.items():
            k = len(loss)
            yield pa.RecordBatch.from_arrays([
                pa.array([m] * k, pa.int32()), pa.array([p] * k, pa.string()), pa.array(np.arange(1, k + 1, dtype=np.int32)),
                pa.array([n] * k, pa.int64()), pa.array(loss)], names=["m", "part", "iteration", "n", "loss"])

    summed = slim.mapInArrow(run, "m int, part string, iteration int, n long, loss double") \
        .groupBy("m", "part", "iteration").agg((F.sum("loss") / F.sum("n")).alias("log_loss"))
    named = F.element_at(F.array(*(F.lit(n) for n in names)), F.col("m") + 1)
    return summed.select(named.alias("model"), "part", "iteration", "log_loss")


def boosted(train: DataFrame, label: str, rates: Sequence[float], max_iter: int, seed: int = 1) -> dict:
    """{rate: boosted trees}; the fits are independent, so their many small jobs are submitted side by side."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target
    from pyspark.ml.classification import GBTClassifier

    def fit(rate):
        return GBTClassifier(labelCol=label, featuresCol="features", maxIter=max_iter, stepSize=rate, maxDepth=3, seed=seed).fit(train)

    with ThreadPoolExecutor(len(rates)) as pool:
        return dict(zip(rates, pool.map(inheritable_thread_target(train.sparkSession)(fit), rates)))


def gbt_loss_curve(train: DataFrame, test: DataFrame, label: str, rates: Sequence[float], max_iter: int,
                   seed: int = 1) -> list[tuple]:
    """ML11: log-loss after each boosting iteration on train and test for each learning rate."""
    models = boosted(train, label, [float(r) for r in rates], max_iter, seed)
    both = train.select(label, "features", F.lit("train").alias("part")) \
        .unionByName(test.select(label, "features", F.lit("test").alias("part")))
    losses = {(r.model, r.iteration, r.part): r.log_loss for r in staged_losses(both, models, label, "part").collect()}
    return [(rate, i, losses[rate, i, "train"], losses.get((rate, i, "test")))
            for rate in models for i in range(1, models[rate].getNumTrees + 1)]
