"""Learners and other queries without SQL: invariants that can fail."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from tabularlab.operators import features as FT
from tabularlab.operators import models as MD
from tabularlab.operators import stats as ST
from tabularlab.operators import text as TX
from tabularlab.operators.quantiles import exact_quantiles
from tabularlab.plans import q_models as Q
from tabularlab.sources.tables import Tables

QUERIES = E.queries()


@pytest.fixture(scope="module")
def doc_data(spark):
    return Q._doc_data(spark, SF_SMALL)


def rows(spark, name):
    return QUERIES[name](spark, SF_SMALL).collect()


def test_noise_is_independent_and_unimportant(spark):
    noisy = FT.noise_columns(spark.range(4000), "id", seed=5, lo=10.0, hi=20.0)
    corr, low, high = noisy.agg(F.corr("noise_label", "noise_value"), F.min("noise_value"), F.max("noise_value")).first()
    assert abs(corr) < 0.06 and 10 <= low < 10.1 and 19.9 < high < 20
    got = {(r.target, r.feature): r.importance for r in rows(spark, "ml19_importance_sanity")}
    assert got["noise_label", "noise_value"] < 0.5
    assert got["quality", "noise_value"] < 0.3
    for target in ("quality", "noise_label"):
        assert sum(v for (t, _), v in got.items() if t == target) == pytest.approx(1.0)


def test_pca_scores_are_centred_uncorrelated_and_explain_the_variance(spark):
    x = np.array([list(r.embedding) for r in Tables(spark, SF_SMALL).embeddings.orderBy("vec_id").collect()], float)
    x -= x.mean(0)
    want = np.linalg.svd(x, compute_uv=False) ** 2
    got = [r.explained_variance for r in sorted(rows(spark, "ml9_pca"))]
    assert len(got) == 20 and np.allclose(got, (want / want.sum())[:20])
    s = np.array([list(r.scores) for r in sorted(rows(spark, "ml9_pca_scores"))])
    assert np.allclose(s.mean(0), 0, atol=1e-8) and np.allclose(np.sort(s.var(0))[::-1], s.var(0))
    c = np.corrcoef(s.T)
    assert np.abs(c - np.eye(20)).max() < 1e-6


def test_boosting_curve(spark, doc_data):
    data, _ = doc_data
    curve = MD.gbt_loss_curve(data, data, "quality", [0.5, 0.1], 12)
    assert len(curve) == 24
    for rate in (0.5, 0.1):
        loss = [r[2] for r in curve if r[0] == rate]
        assert loss[-1] < loss[0] < 0.75
    at = {(r[0], r[1]): r[2] for r in curve}
    assert at[0.5, 12] < at[0.1, 12]      # a faster rate fits the training rows sooner


def test_staged_losses_equal_sparks_own_and_take_one_scan(spark, doc_data):
    data, _ = doc_data
    models = MD.boosted(data, "quality", [0.5, 0.1], 8)
    rows = data.withColumn("part", F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b"))
    staged = MD.staged_losses(rows, models, "quality", "part")
    plan = staged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1
    got = {(r.model, r.part, r.iteration): r.log_loss for r in staged.collect()}
    for rate, m in models.items():
        for part in "ab":
            want = m.evaluateEachIteration(rows.where(F.col("part") == part))
            assert [got[rate, part, i + 1] for i in range(8)] == pytest.approx([w / 2 for w in want], rel=1e-9)


def test_forest_beats_the_base_rate_and_losses_follow_from_probabilities(spark):
    got = rows(spark, "ml12_random_forest")
    assert all(0 <= r.p1 <= 1 for r in got)
    for r in got:
        p = min(max(r.p1, 1e-15), 1 - 1e-15)
        assert r.log_loss == pytest.approx(-np.log(p if r.quality == 1 else 1 - p))


def test_logistic_gradient_vanishes(spark, doc_data):
    data, names = doc_data
    coef = {r.feature: r.coef for r in rows(spark, "ml13_logistic_l2")}
    train = data.where("split = 'train'").collect()
    x = np.array([r.features.toArray() for r in train])
    y = np.array([r.quality for r in train])
    beta = np.array([coef[n] for n in names])
    p = 1 / (1 + np.exp(-(x @ beta + coef["intercept"])))
    assert abs((p - y).sum()) < 0.05 * len(y)
    got = rows(spark, "ml17_embedded_selection")
    assert len(got) == len(names) and sum(r.selected for r in got) <= 5
    assert [r.feature for r in sorted(got, key=lambda r: r["rank"])] == sorted(names, key=lambda n: (-abs(coef[n]), n))


def test_text_classifier_learns_its_training_rows(spark):
    got = rows(spark, "ml14_multilabel_text")
    truth = {r.doc_id: r for r in Tables(spark, SF_SMALL).labels.collect()}
    train = [r for r in got if r.split == "train"]
    right = np.mean([(r.p_quality > 0.5) == bool(truth[r.doc_id].quality) for r in train])
    assert right > 0.95 and len({r.doc_id for r in got}) == len(got) == len(truth)


def test_cross_validation_mean(spark):
    got = {r.fold: r.accuracy for r in rows(spark, "ml15_cross_validation")}
    assert got[-1] == pytest.approx(np.mean([got[i] for i in range(5)])) and got[-1] > 0.6


def test_grid_search_best_worst_and_refit(spark, doc_data):
    table, predicted = Q.grid_search(*doc_data, {"maxDepth": [2, 6], "numTrees": [2, 10]}, folds=5)
    got = table.collect()
    assert len(got) == 4 and sum(r.is_best for r in got) == sum(r.is_worst for r in got) == 1
    best = next(r for r in got if r.is_best)
    assert best.mean_accuracy == max(r.mean_accuracy for r in got)
    assert next(r for r in got if r.is_worst).mean_accuracy == min(r.mean_accuracy for r in got)
    held = predicted.collect()
    assert {r.doc_id for r in held} == {r.doc_id for r in doc_data[0].where("split <> 'train'").collect()}
    n = 1
    for values in Q.GRID.values():
        n *= len(values)
    assert n == 180     # 540 settings less the factor that Spark's trees lack


def test_refit_predictions_come_from_the_whole_grid(spark, monkeypatch):
    # trees of depth 0 know one class only: any other prediction comes from settings outside the grid
    data = MD.assemble(spark.range(120).select(
        F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("double").alias("quality"), (F.col("id") % 3).cast("double").alias("x"),
        F.when(F.col("id") < 90, "train").otherwise("test").alias("split")), ["x"])
    monkeypatch.setattr(Q, "_doc_data", lambda *_: (data, ["x"]))
    monkeypatch.setattr(Q, "GRID", {"maxDepth": [0], "numTrees": [5]})
    got = rows(spark, "ml16_refit_predictions")
    assert len(got) == 30 and {(r.best, r.worst) for r in got} == {(0.0, 0.0)}


def test_elimination_order(spark, doc_data):
    got = rows(spark, "ml18_recursive_elimination")
    assert sorted(r.feature for r in got) == sorted(doc_data[1])
    assert sorted(r.eliminated_at for r in got if r.eliminated_at) == list(range(1, len(got) - 4))


def test_networks_predict_every_test_row(spark, doc_data):
    got = rows(spark, "ml20_mlp")
    test = {r.doc_id for r in doc_data[0].where("split = 'test'").collect()}
    for layers in (3, 8):
        mine = [r for r in got if r.hidden_layers == layers]
        assert {r.doc_id for r in mine} == test and all(0 <= r.p1 <= 1 and r.prediction == float(r.p1 > 0.5) for r in mine)


def test_sales_predictions_stay_in_the_observed_range(spark):
    from tabularlab.plans.facts import HORIZON, monthly_sales
    f = monthly_sales(Tables(spark, SF_SMALL))
    end = f.agg(F.max("m")).first()[0] - HORIZON
    lo, hi, mean = f.where(F.col("m") <= end).agg(F.min("dollars"), F.max("dollars"), F.avg("dollars")).first()
    got = rows(spark, "ml21_sales_regressor")
    assert len(got) == f.where(F.col("m") > end).count() and all(float(lo) <= r.prediction <= float(hi) for r in got)


def test_price_and_promotions_beat_the_ids_alone(spark):
    from tabularlab.sources.tables import Tables
    data, train_end = Q.sales_features(Tables(spark, SF_SMALL))
    data = data.cache()

    def error(inputs):
        p = Q.sales_regressor(data, train_end, inputs)
        return p.agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("dollars"), 2)))).first()[0]

    assert error(Q.SALES_INPUTS) < error([*Q.SALES_IDS, "month_of_year"])


def test_target_means_see_earlier_training_periods_only(spark):
    from tabularlab.operators.features import ordered_target_means
    facts = spark.createDataFrame([("a", 1, 10.0), ("a", 1, 20.0), ("a", 2, 50.0), ("b", 2, 8.0), ("a", 3, 1e6), ("b", 4, 1e6), ("c", 4, 1e6)],
                                  "id string, m long, y double")
    got = {(r.id, r.m, r.y): r.t for r in ordered_target_means(facts, {"t": ["id"]}, "m", "y", 2, weight=2.0).collect()}
    first, second, later = 0.0, 15.0, 22.0          # overall means of the earlier training months
    assert got["a", 1, 10.0] == got["a", 1, 20.0] == first
    assert got["a", 2, 50.0] == pytest.approx((30 + 2 * second) / 4) and got["b", 2, 8.0] == second
    assert got["a", 3, 1e6] == pytest.approx((80 + 2 * later) / 5) and got["c", 4, 1e6] == later


def test_word_vectors(spark):
    got = rows(spark, "tx11_word2vec")
    words = [w for r in Tables(spark, SF_SMALL).documents.select(TX.words(F.col("text")).alias("w")).collect() for w in r.w]
    from collections import Counter
    assert {r.word for r in got} == {w for w, n in Counter(words).items() if n >= 5}
    assert all(len(r.vector) == 100 and np.isfinite(r.vector.toArray()).all() for r in got)


def test_vector_lookup_keeps_known_vectors(spark):
    got = {r.token: r for r in rows(spark, "tx10_vector_lookup")}
    e = {r.vec_id: list(r.embedding) for r in Tables(spark, SF_SMALL).embeddings.collect()}
    index = {r.token: r.idx for r in rows(spark, "tx6_token_index")}
    assert set(got) == set(index)
    for token, r in got.items():
        assert r.random == (index[token] - 1 not in e)
        assert list(r.vector) == e[index[token] - 1] if not r.random else all(-0.5 <= v <= 0.5 for v in r.vector)


def test_approximate_distinct_counts_are_near(spark):
    exact = QUERIES["ag4_distinct_counts"](spark, SF_SMALL).first().asDict()
    near = QUERIES["ag4_approx_distinct"](spark, SF_SMALL).first().asDict()
    for k, v in near.items():
        if k in exact:
            assert abs(v - exact[k]) <= max(2, 0.05 * exact[k])


def test_stored_sketches_merge_to_the_direct_estimate(spark):
    from tabularlab.operators import aggs as A
    df = spark.range(60_000).select((F.col("id") % 20_000).alias("v"), (F.col("id") % 7).alias("g"))
    stored = A.distinct_sketches(df, ["g"], ["v"])
    merged, direct = A.merged_distinct(stored, ["v"]).first().v, A.merged_distinct(A.distinct_sketches(df, [], ["v"]), ["v"]).first().v
    assert abs(merged - 20_000) < 3 * 0.0081 * 20_000 and abs(merged - direct) < 0.02 * 20_000
    got = {r.since: r for r in rows(spark, "ag4_stored_sketches")}
    li = Tables(spark, SF_SMALL).lineitem.withColumn("since", F.year("l_shipdate") - F.year("l_shipdate") % 5)
    for r in li.groupBy("since").agg(F.countDistinct("l_orderkey").alias("o"), F.countDistinct("l_partkey").alias("p")).collect():
        assert got[r.since].l_orderkey == pytest.approx(r.o, rel=0.03) and got[r.since].l_partkey == pytest.approx(r.p, rel=0.03)


def test_joint_fit_and_dfbetas_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=60)
    y[5] += 6
    df = spark.createDataFrame([(i, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(60)], "i int, y double, a double, b double")
    full = np.column_stack([np.ones(60), x])
    beta = np.linalg.lstsq(full, y, rcond=None)[0]
    assert np.allclose(ST.ols(df, "y", ["a", "b"]).coef, beta)
    inv = np.linalg.inv(full.T @ full)
    got = {r.i: r for r in ST.influence(df, "y", ["a", "b"], ["i"]).collect()}
    for i in (0, 5, 31):
        keep = np.arange(60) != i
        b, res = np.linalg.lstsq(full[keep], y[keep], rcond=None)[:2]
        s = np.sqrt(res[0] / (59 - 3))
        want = (beta - b) / (s * np.sqrt(np.diag(inv)))
        assert np.allclose([got[i].dfbetas_Intercept, got[i].dfbetas_a, got[i].dfbetas_b], want)


def test_f_test_p_value_equals_the_squared_t_test(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=40)
    y = 0.3 * x + rng.normal(size=40)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    r = ST.univariate_f_test(df, "y", ["x"]).first()
    p = ST.ols(df, "y", ["x"]).p[1]
    assert r.p_value == pytest.approx(p, abs=1e-6)


def test_quantiles_with_a_value_that_holds_half_the_rows(spark):
    values = [5.0] * 5000 + [float(i) for i in range(5000)]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double").repartition(8)
    got = exact_quantiles(df, ["k"], "v", [0.1, 0.25, 0.5, 0.9]).first()
    assert [got[f"q_{i}"] for i in range(4)] == pytest.approx(list(np.quantile(values, [0.1, 0.25, 0.5, 0.9])))
    # counted first: equal values are one row before anything is sorted or range-partitioned
    counted = df.groupBy("k", "v").count().repartitionByRange(8, "k", "v").withColumn("p", F.spark_partition_id())
    sizes = [r["count"] for r in counted.groupBy("p").count().collect()]
    assert max(sizes) <= 2 * 5000 / 8


def test_encoding_never_broadcasts_the_tokens(spark, monkeypatch):
    for bound in (10 ** 6, 0):
        monkeypatch.setattr(TX, "INDEX_BROADCAST_ROWS", bound)
        docs = Tables(spark, SF_SMALL).documents
        tokens = TX.tokenised(docs, "doc_id", TX.words(F.col("text")))
        seqs = TX.encode_sequences(tokens, "doc_id", TX.fit_vocabulary(TX.counts_of(tokens)))
        seqs.collect()
        final = seqs._jdf.queryExecution().executedPlan().toString()      # the plan that ran
        assert "isFinalPlan=true" in final
        final = final.split("Initial Plan")[0]
        assert ("BroadcastHashJoin [token" in final) == (bound > 0) and ("SortMergeJoin [token" in final) == (bound == 0)
        assert "BuildLeft" not in final


def test_pruned_knn_rounds(spark):
    """Many small cells along one direction: most blocks are never compared."""
    rng = np.random.default_rng(4)
    x = np.column_stack([np.arange(300) * 1.0, rng.normal(size=300) * 0.1])
    y = rng.integers(0, 3, size=300)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(300)], "id long, v array<double>, label int")
    shares = []
    got = {r.id: r.pred for r in MD.knn_classify(df, "id", "v", "label", 5, block_rows=10, compared=shares).collect()}
    assert shares[0] < 0.5
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    for i in range(300):
        nn = sorted(range(300), key=lambda j: (d[i, j], j))[:5]
        assert got[i] == int(np.argmax(np.bincount(y[nn], minlength=3)))
