"""Model queries (ML8-ML21, TX11 lives with the text queries).

Except for k-NN (exact, with a brute-force SQL oracle) these are checked on
rows and invariants: Spark's learners differ from other libraries'.
"""

from __future__ import annotations

import hashlib
import itertools
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabularlab.operators import models as MD
from tabularlab.operators.features import hash_split
from tabularlab.operators.order import contiguous_folds
from tabularlab.operators.reshape import distinct_values
from tabularlab.plans.catalog import register
from tabularlab.plans.facts import MONTHLY_SALES_SQL, TRAIN_END_SQL
from tabularlab.session import materialize
from tabularlab.sources.tables import Tables

KNN_SQL = """
with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
d as (select a.vec_id as qid, b.vec_id as pid, b.label as plabel,
             list_sum(list_transform(list_zip(a.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) as d2
      from e a, e b),
top as (select * from (select *, row_number() over (partition by qid order by d2, pid) as r from d) where r <= 5),
votes as (select qid, plabel, count(*) as n from top group by qid, plabel),
best as (select qid, arg_min(plabel, -n * 1000000 + plabel) as pred from votes group by qid)
select e.vec_id, e.label, best.pred from e join best on e.vec_id = best.qid"""


@register("ml8_knn", KNN_SQL)
def ml8(spark, sf):
    return MD.knn_classify(Tables(spark, sf).embeddings, "vec_id", "embedding", "label", 5)


@register("ml8_knn_disagreements", f"select vec_id, label, pred from ({KNN_SQL}) where pred <> label")
def ml8d(spark, sf):
    return ml8(spark, sf).where(F.col("pred") != F.col("label"))


def _pca(spark, sf, k=20):
    """Centred vectors and their PCA (Spark's own transform does not centre)."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector
    e = Tables(spark, sf).embeddings.select("vec_id", array_to_vector("embedding").alias("v"))
    centred = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(e).transform(e)
    return PCA(k=k, inputCol="c", outputCol="pcs").fit(centred), centred


@register("ml9_pca")
def ml9(spark, sf):
    model, _ = _pca(spark, sf)
    ev = [(i + 1, float(x)) for i, x in enumerate(model.explainedVariance.toArray())]
    return spark.createDataFrame(ev, "component int, explained_variance double")


@register("ml9_pca_scores")
def ml9s(spark, sf):
    from pyspark.ml.functions import vector_to_array
    model, centred = _pca(spark, sf)
    return model.transform(centred).select("vec_id", vector_to_array("pcs").alias("scores"))


def _doc_data(spark, sf):
    t = Tables(spark, sf)
    langs = distinct_values(t.documents, "lang")
    feats = MD.document_features(t.documents, t.labels, langs)
    names = MD.FEATURES + [f"lang_{v}" for v in langs]
    # read many times by the fits: written once, in as many files as its size asks for
    return materialize(hash_split(MD.assemble(feats, names), "doc_id", 0.25, seed=3).hint("rebalance"), "doc-features"), names


@register("ml10_gbt_importances")
def ml10(spark, sf):
    data, names = _doc_data(spark, sf)
    train, test = data.where(F.col("split") == "train"), data.where(F.col("split") == "test")
    model, scored = MD.gbt_classifier(train, test, "quality")
    acc = scored.agg(F.avg((F.col("prediction") == F.col("quality")).cast("double"))).first()[0]
    rows = [(n, v, float(acc)) for n, v in MD.importances(model, names)]
    return spark.createDataFrame(rows, "feature string, importance double, test_accuracy double")


@register("ml11_gbt_loss_curve")
def ml11(spark, sf):
    data, _ = _doc_data(spark, sf)
    train, test = data.where(F.col("split") == "train"), data.where(F.col("split") == "test")
    rows = MD.gbt_loss_curve(train, test, "quality", [1.0, 0.5, 0.3, 0.2, 0.1], max_iter=250)
    df = spark.createDataFrame(rows, "learning_rate double, iteration int, train_log_loss double, test_log_loss double")
    best = df.groupBy("learning_rate").agg(F.min_by("iteration", F.struct("test_log_loss", "iteration")).alias("best_iteration"))
    return df.join(best, "learning_rate")


@register("ml12_random_forest")
def ml12(spark, sf):
    from pyspark.ml.classification import RandomForestClassifier
    data, _ = _doc_data(spark, sf)
    train, test = data.where(F.col("split") == "train"), data.where(F.col("split") == "test")
    m = RandomForestClassifier(labelCol="quality", featuresCol="features", numTrees=100, seed=1).fit(train)
    s = m.transform(test).withColumn("p1", MD.positive_probability())
    return s.select("doc_id", "quality", "p1", MD.log_loss_col("quality", F.col("p1")).alias("log_loss"))


@register("ml13_logistic_l2")
def ml13(spark, sf):
    from pyspark.ml.classification import LogisticRegression
    data, names = _doc_data(spark, sf)
    train = data.where(F.col("split") == "train")
    n, c = train.count(), 1.0
    m = LogisticRegression(labelCol="quality", featuresCol="features", regParam=1.0 / (c * n), elasticNetParam=0.0,
                           standardization=False, maxIter=200).fit(train)
    rows = [(nm, float(v)) for nm, v in zip(names, m.coefficients.toArray())] + [("intercept", float(m.intercept))]
    return spark.createDataFrame(rows, "feature string, coef double")


TEXT_WIDTH = 1 << 18      # columns that tokens are hashed into


@register("ml14_multilabel_text")
def ml14(spark, sf):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer
    t = Tables(spark, sf)
    d = t.documents.join(t.labels, "doc_id").select("doc_id", "text", F.col("quality").cast("double"),
                                                    F.col("toxic").cast("double"))
    d = hash_split(d, "doc_id", 0.25, seed=3)
    tok = RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False, toLowercase=True)
    # every token counts: hashed into a fixed width, so no vocabulary is cut or collected
    tf = HashingTF(inputCol="tokens", outputCol="features", numFeatures=TEXT_WIDTH)
    out = materialize(tf.transform(tok.transform(d)).select("doc_id", "split", "quality", "toxic", "features"), "bow")
    train = out.where(F.col("split") == "train")
    for label in ("quality", "toxic"):
        m = LogisticRegression(labelCol=label, featuresCol="features", regParam=0.01, maxIter=50,
                               rawPredictionCol=f"raw_{label}", probabilityCol=f"prob_{label}",
                               predictionCol=f"pred_{label}").fit(train)
        out = m.transform(out).withColumn(f"p_{label}", MD.positive_probability(f"prob_{label}"))
    return out.select("doc_id", "split", "p_quality", "p_toxic")


def _folded(spark, sf, k=5):
    data, names = _doc_data(spark, sf)
    return materialize(contiguous_folds(data, ["doc_id"], k, "fold").withColumn("fold", F.col("fold") - 1).hint("rebalance"), "folds"), names


@register("ml15_cross_validation")
def ml15(spark, sf):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    data, _ = _folded(spark, sf)
    est = GBTClassifier(labelCol="quality", featuresCol="features", maxIter=10, maxDepth=3, seed=1)
    ev = MulticlassClassificationEvaluator(labelCol="quality", metricName="accuracy")
    cv = CrossValidator(estimator=est, estimatorParamMaps=ParamGridBuilder().build(), evaluator=ev, foldCol="fold",
                        numFolds=5, collectSubModels=True).fit(data)
    rows = []
    for i, sub in enumerate(cv.subModels):
        acc = ev.evaluate(sub[0].transform(data.where(F.col("fold") == i)))
        rows.append((i, float(acc)))
    rows.append((-1, float(cv.avgMetrics[0])))
    return spark.createDataFrame(rows, "fold int, accuracy double")


# The settings of the grid search.  Its fourth parameter, the least rows to split a
# node (2, 3, 10), has no counterpart in Spark's trees; "auto" and "sqrt" are the same there.
GRID = {"maxDepth": [2, 3, 4, 6, 8], "numTrees": [50, 10], "featureSubsetStrategy": ["sqrt", "auto", "log2"],
        "minInstancesPerNode": [1, 3, 10], "bootstrap": [True, False]}


def grid_search(data, names, grid, folds=5):
    """ML16: mean accuracy of each setting over stratified folds, with the forests of the best and
    the worst setting over all of ``data`` (column ``split`` = train) to predict the other rows.
    All settings and folds grow in the same passes (``operators/forests.py``)."""
    from tabularlab.operators import forests as FO
    from tabularlab.operators.order import folds_within_groups
    spark = data.sparkSession
    plain = data.drop("features")
    train = folds_within_groups(plain.where(F.col("split") == "train"), ["quality"], ["doc_id"], folds) \
        .withColumn("fold", F.col("fold") - 1)
    other = plain.where(F.col("split") != "train").withColumn("fold", F.lit(FO.OTHER_ROWS))
    rows = FO.bin_features(train.unionByName(other, allowMissingColumns=True), names, "quality", "fold", "doc_id", ["doc_id", "quality"])

    def drawn(strategy):       # "auto" means "sqrt" for a classifier's forest: such settings are grown once
        return max(1, math.ceil(math.log2(len(names)) if strategy == "log2" else math.sqrt(len(names))))

    settings = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    asked = [(FO.Variant(drawn(s.get("featureSubsetStrategy", "auto")), s.get("minInstancesPerNode", 1), s.get("bootstrap", True)),
              s.get("maxDepth", 5), s.get("numTrees", 20)) for s in settings]
    grown = FO.grow_forests(rows, list(dict.fromkeys(v for v, _, _ in asked)), [*range(folds), FO.ALL_ROWS],
                            max(n for _, _, n in asked), max(d for _, d, _ in asked), len(names))
    score_of = FO.fold_scores(rows, grown, sorted({d for _, d, _ in asked}), sorted({n for _, _, n in asked}), len(names))
    scores = [score_of[a] for a in asked]
    desc = [",".join(f"{k}={v}" for k, v in sorted(s.items())) for s in settings]
    best, worst = scores.index(max(scores)), scores.index(min(scores))    # the first of equals
    table = spark.createDataFrame([(d, s, i == best, i == worst) for i, (d, s) in enumerate(zip(desc, scores))],
                                  "params string, mean_accuracy double, is_best boolean, is_worst boolean")
    predicted = FO.predict_rows(rows.where(F.col("fold") == FO.OTHER_ROWS), grown, {"best": asked[best], "worst": asked[worst]},
                                len(names), ["doc_id", "quality"])
    return table, predicted


def _searched(spark, sf, part):
    """The grid's scores or predictions; both are written once per application, input and grid."""
    from tabularlab.session import scratch_path, track
    from tabularlab.sources.files import path_exists
    name = hashlib.md5(repr((spark.sparkContext.applicationId, sf, GRID)).encode()).hexdigest()[:12]
    base = scratch_path(spark, f"grid-{name}")
    if not path_exists(spark, f"{base}/scores/_SUCCESS"):       # written last
        scores, predicted = grid_search(*_doc_data(spark, sf), GRID)
        predicted.write.mode("overwrite").parquet(f"{base}/predictions")
        scores.coalesce(1).write.mode("overwrite").parquet(f"{base}/scores")
        track(base)
    return spark.read.parquet(f"{base}/{part}")


@register("ml16_grid_search")
def ml16(spark, sf):
    return _searched(spark, sf, "scores")


@register("ml16_refit_predictions")
def ml16p(spark, sf):
    return _searched(spark, sf, "predictions")


@register("ml17_embedded_selection")
def ml17(spark, sf):
    coefs = ml13(spark, sf).where(F.col("feature") != "intercept")
    thr = coefs.agg(F.avg(F.abs("coef"))).scalar()
    rank = F.row_number().over(Window.orderBy(F.abs("coef").desc(), "feature"))     # one row per feature
    ranked = coefs.withColumn("abs_coef", F.abs("coef")).withColumn("rank", rank)
    return ranked.withColumn("selected", (F.col("abs_coef") >= thr) & (F.col("rank") <= 5))


@register("ml18_recursive_elimination")
def ml18(spark, sf):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorSlicer
    data, names = _doc_data(spark, sf)
    train = data.where(F.col("split") == "train")
    active = list(range(len(names)))
    order = []
    while len(active) > 5:
        sl = VectorSlicer(inputCol="features", outputCol="sub", indices=active).transform(train)
        m = LogisticRegression(labelCol="quality", featuresCol="sub", regParam=0.01, maxIter=100).fit(sl)
        weakest = min(zip(active, m.coefficients.toArray()), key=lambda kv: (abs(kv[1]), kv[0]))[0]
        order.append((names[weakest], len(order) + 1))
        active.remove(weakest)
    order += [(names[i], None) for i in active]
    return spark.createDataFrame(order, "feature string, eliminated_at int")


@register("ml19_importance_sanity")
def ml19(spark, sf):
    from tabularlab.operators.features import noise_columns
    data, names = _doc_data(spark, sf)
    noisy = materialize(noise_columns(data.drop("features"), "doc_id", seed=5, like="n_chars").hint("rebalance"), "noisy")
    cols = names + ["noise_value"]
    full = MD.assemble(noisy, cols)
    rows = []
    for target in ("quality", "noise_label"):
        model, _ = MD.gbt_classifier(full, full, target, max_iter=10)
        rows += [(target, n, v) for n, v in MD.importances(model, cols)]
    return spark.createDataFrame(rows, "target string, feature string, importance double")


HIDDEN_LAYERS = [[16, 8, 4], [16, 16, 8, 8, 8, 4, 4, 4]]     # three and eight hidden layers


@register("ml20_mlp")
def ml20(spark, sf):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler
    data, names = _doc_data(spark, sf)
    sc = StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True).fit(
        data.where(F.col("split") == "train"))
    z = sc.transform(data)
    train, test = z.where(F.col("split") == "train"), z.where(F.col("split") == "test")
    out = None
    for hidden in HIDDEN_LAYERS:
        m = MultilayerPerceptronClassifier(labelCol="quality", featuresCol="z", layers=[len(names), *hidden, 2], maxIter=100,
                                           seed=1).fit(train)
        s = m.transform(test).select("doc_id", "quality", F.lit(len(hidden)).alias("hidden_layers"), "prediction",
                                     MD.positive_probability().alias("p1"))
        out = s if out is None else out.unionByName(s)
    return out


SALES_IDS = {"by_series": ["item_id", "store_id"], "by_item": ["item_id"], "by_store": ["store_id"], "by_state": ["state_id"],
             "by_dept": ["dept_id"], "by_cat": ["cat_id"]}
PROMO = 0.9            # a price below this share of the item's usual price counts as a promotion


def sales_features(t, train_end=None):
    """(features, train_end): the monthly sales with ordered target means of the ids, and price and
    promotion from the weekly price table; months behind ``train_end`` (default: the last six) are held out."""
    from tabularlab.operators.features import ordered_target_means
    from tabularlab.plans.facts import HORIZON, item_dim, monthly_sales
    from tabularlab.plans.q_aggs import weekly_price
    facts = monthly_sales(t).withColumn("dollars", F.col("dollars").cast("double"))
    if train_end is None:
        train_end = facts.agg(F.max("m")).first()[0] - HORIZON
    month = ((F.year("wp_week") - 1995) * 12 + F.month("wp_week")).cast("bigint")
    weekly = weekly_price(t).join(item_dim(t.part), F.col("wp_partkey") == F.col("p_partkey"))
    monthly = weekly.groupBy("item_id", month.alias("m")).agg(F.avg("sell_price").alias("price"), F.count("*").alias("_n"))
    # the item's usual price: its mean over the months before, one row per item and month
    before = Window.partitionBy("item_id").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    usual = F.sum(F.col("price") * F.col("_n")).over(before) / F.sum("_n").over(before)
    prices = monthly.select("item_id", "m", "price", F.coalesce(F.col("price") / usual, F.lit(1.0)).alias("price_ratio"))
    rows = ordered_target_means(facts, SALES_IDS, "m", "dollars", train_end).join(prices, ["item_id", "m"], "left")
    rows = rows.withColumn("promo", (F.col("price_ratio") < PROMO).cast("double")) \
        .withColumn("month_of_year", (F.pmod(F.col("m") - 1, F.lit(12)) + 1).cast("double"))
    # a month without a price of its own (its week began in the month before): no ratio, no promotion
    return rows.fillna({"price_ratio": 1.0, "promo": 0.0}).withColumn("price", F.coalesce("price", F.lit(-1.0))), train_end


SALES_INPUTS = [*SALES_IDS, "price", "price_ratio", "promo", "month_of_year"]


def sales_regressor(rows, train_end, inputs, max_iter=20):
    """Boosted trees on ``inputs``; predictions of the held-out months, kept within the observed range."""
    from pyspark.ml.regression import GBTRegressor
    data = materialize(MD.assemble(rows, inputs).hint("rebalance"), "sales-features")
    train = data.where(F.col("m") <= train_end)
    lo, hi = train.agg(F.min("dollars"), F.max("dollars")).first()
    m = GBTRegressor(labelCol="dollars", featuresCol="features", maxIter=max_iter, maxDepth=5, seed=1).fit(train)
    return m.transform(data.where(F.col("m") > train_end)) \
        .withColumn("prediction", F.least(F.greatest("prediction", F.lit(lo)), F.lit(hi)))


@register("ml21_sales_regressor")
def ml21(spark, sf):
    rows, train_end = sales_features(Tables(spark, sf))
    pred = sales_regressor(rows, train_end, SALES_INPUTS)
    return pred.select("item_id", "store_id", "state_id", "cat_id", "m", "dollars", "prediction")


@register("ml21_earlier_totals", f"""
with f as ({MONTHLY_SALES_SQL}), h as (select * from f where m <= {TRAIN_END_SQL}),
i as (select k.item_id, k.m, coalesce(sum(h.dollars), 0) as total, count(h.dollars) as n from (select distinct item_id, m from f) k
      left join h on h.item_id = k.item_id and h.m < k.m group by all),
s as (select k.item_id, k.store_id, k.m, coalesce(sum(h.dollars), 0) as total, count(h.dollars) as n from f k
      left join h on h.item_id = k.item_id and h.store_id = k.store_id and h.m < k.m group by all)
select f.item_id, f.store_id, f.m, cast(i.total as double) as item_total, i.n as item_n, cast(s.total as double) as series_total, s.n as series_n
from f join i using (item_id, m) join s using (item_id, store_id, m)""")
def ml21m(spark, sf):
    from tabularlab.operators.features import earlier_totals
    from tabularlab.plans.facts import HORIZON, monthly_sales
    facts = monthly_sales(Tables(spark, sf))
    train_end = facts.agg(F.max("m")).first()[0] - HORIZON
    out = facts.select("item_id", "store_id", "m")
    for name, keys in (("item", ["item_id"]), ("series", ["item_id", "store_id"])):
        totals = earlier_totals(facts, keys, "m", "dollars", train_end)
        out = out.join(totals.select(*keys, "m", F.col("total").cast("double").alias(f"{name}_total"), F.col("n").alias(f"{name}_n")), [*keys, "m"])
    return out
