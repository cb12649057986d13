"""Scoring operators: WRMSSE (ML23) and row metrics (ML22)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularlab.operators.aggs import correlation
from tabularlab.operators.hierarchy import level_sums
from tabularlab.operators.series import first_difference
from tabularlab.session import materialize


def wrmsse(train: DataFrame, valid: DataFrame, pred: DataFrame,
           levels: Mapping[int, Sequence[str]], day: str = "day",
           sales: str = "sales", dollars: str = "dollars",
           zero_scale: str = "null", per_series: bool = False) -> DataFrame:
    """Weighted root mean squared scaled error over a hierarchy of levels.

    ``train``/``valid`` hold leaf rows (level keys, day, sales, dollars);
    ``pred`` holds leaf rows (level keys, day, sales) whose days are already
    aligned with ``valid``.  Per level series:

    * sse = sum over days present in both valid and pred of (valid - pred)^2,
      dollars = valid dollars; weight = dollars / level total;
    * scale = sum of squared successive train differences (ordered by day),
      n = number of train days;
    * rmsse = sqrt((n - 1) * sse / (h * scale)), 0 where dollars = 0;
    * result = sum(rmsse * weight) / number of levels.

    ``zero_scale='null'`` makes a zero scale contribute nothing (nullif);
    ``'inf'`` applies the literal float rule: x/0 = inf, 0/0 = NaN (skipped).

    All levels come out of one GROUPING SETS pass over the tagged union of the
    three inputs; the only other shuffles are keyed by series id, and the
    per-level totals are a <= #levels row table.
    """
    keys = []
    for cols in levels.values():
        keys += [c for c in cols if c not in keys]
    tagged = (train.select(*keys, day, sales, dollars, F.lit("t").alias("_part"))
              .unionByName(valid.select(*keys, day, sales, dollars, F.lit("v").alias("_part")))
              .unionByName(pred.select(*keys, day, sales, F.lit(None).cast(train.schema[dollars].dataType).alias(dollars),
                                       F.lit("p").alias("_part"))))
    return wrmsse_tagged(tagged, levels, day, sales, dollars, zero_scale, per_series)


def tag_naive_split(dense: DataFrame, day: str, last_train: int, horizon: int, sales: str = "sales",
                    dollars: str = "dollars") -> DataFrame:
    """Train / valid / naive-prediction rows from ONE pass over a dense series
    table: each row is emitted as train (day <= last_train), valid (the next
    ``horizon`` days) and/or as the prediction of day + horizon (the last
    ``horizon`` train days), tagged ``_part`` in {t, v, p}."""
    d = F.col(day)
    tags = F.array(
        F.struct(F.lit("t").alias("part"), d.alias("d"), (d <= last_train).alias("keep")),
        F.struct(F.lit("v").alias("part"), d.alias("d"), ((d > last_train) & (d <= last_train + horizon)).alias("keep")),
        F.struct(F.lit("p").alias("part"), (d + horizon).alias("d"),
                 ((d > last_train - horizon) & (d <= last_train)).alias("keep")))
    ex = dense.select("*", F.explode(F.filter(tags, lambda x: x["keep"])).alias("_tag"))
    return ex.withColumn(day, F.col("_tag.d")).withColumn("_part", F.col("_tag.part")) \
        .withColumn(dollars, F.when(F.col("_part") != "p", F.col(dollars))).drop("_tag")


def wrmsse_tagged(tagged: DataFrame, levels: Mapping[int, Sequence[str]], day: str = "day",
                  sales: str = "sales", dollars: str = "dollars", zero_scale: str = "null",
                  per_series: bool = False) -> DataFrame:
    """WRMSSE from leaf rows tagged ``_part`` = t (train) / v (valid) / p (prediction)."""
    # one row per (level series, part, day): read by three branches below, so it
    # is checkpointed once instead of re-deriving it from the leaf rows each time
    leaf = tagged.withColumn("_s", F.col(sales)).withColumn("_usd", F.col(dollars).cast("double"))
    lv = materialize(level_sums(leaf, levels, ["_s", "_usd"], by=["_part", day]))

    tr = first_difference(lv.where(F.col("_part") == "t"), ["id"], day, "_s", "_d")
    scale = tr.groupBy("level", "id").agg(
        F.sum(F.col("_d").cast("double") * F.col("_d")).alias("scale"),
        F.count("_s").alias("n"))

    vp = lv.where(F.col("_part") != "t").groupBy("level", "id", day).agg(
        F.sum(F.when(F.col("_part") == "v", F.col("_s"))).alias("_sv"),
        F.sum(F.when(F.col("_part") == "p", F.col("_s"))).alias("_sp"),
        F.sum(F.when(F.col("_part") == "v", F.col("_usd"))).alias("_usd"),
        F.count_if(F.col("_part") == "v").alias("_nv"),
        F.count_if(F.col("_part") == "p").alias("_np"))
    matched = vp.where((F.col("_nv") > 0) & (F.col("_np") > 0))
    err = matched.groupBy("level", "id").agg(
        F.sum(F.pow(F.col("_sv").cast("double") - F.col("_sp"), 2)).alias("sse"),
        F.coalesce(F.sum(F.col("_usd").cast("double")), F.lit(0.0)).alias("dollars"))
    h = vp.where(F.col("_nv") > 0).agg(F.countDistinct(day).alias("h"))

    totals = err.groupBy("level").agg(F.sum("dollars").alias("_level_usd"))
    # totals and h have one row per level / one row: bounded broadcasts.
    s = (err.join(scale, ["level", "id"], "left")
            .join(F.broadcast(totals), "level")
            .withColumn("h", h.scalar())
            .withColumn("weight", F.try_divide(F.col("dollars"), F.col("_level_usd"))))
    num = (F.col("n") - 1) * F.col("sse")
    if zero_scale == "inf":
        den = F.col("h") * F.col("scale")
        ratio = (F.when(den != 0, num / den)
                 .when(num > 0, F.lit(float("inf")))
                 .when(num < 0, F.lit(float("-inf")))
                 .otherwise(F.lit(None)))
    else:
        ratio = F.try_divide(num, F.col("h") * F.nullif(F.col("scale"), F.lit(0.0)))
    rmsse = F.when(F.col("dollars") == 0, F.lit(0.0)).otherwise(F.sqrt(ratio))
    s = s.withColumn("rmsse", rmsse)
    if per_series:
        return s.select("level", "id", "sse", "dollars", "weight", "scale", "n", "rmsse")
    return s.groupBy().agg(
        (F.sum(F.col("rmsse") * F.col("weight")) / F.countDistinct("level")).alias("wrmsse"),
        F.count_if((F.col("scale") == 0) & (F.col("dollars") > 0)).alias("zero_scale_series"))


# ---------------------------------------------------------------- row metrics (ML22) and blends (ML24-26)

EPS = 1e-15


def binary_metrics(pred: DataFrame, group: str, label: str, prob: str, threshold: float = 0.5,
                   digits: int = 6) -> DataFrame:
    """ML22: accuracy, log-loss (probabilities clipped to [eps, 1 - eps]) and RMSE per group."""
    p = F.least(F.greatest(F.col(prob), F.lit(EPS)), F.lit(1 - EPS))
    y = F.col(label).cast("double")
    ll = y * F.log(p) + (1 - y) * F.log(1 - p)
    hit = ((F.col(prob) > threshold) == (F.col(label) == 1)).cast("double")
    return pred.groupBy(group).agg(F.round(F.avg(hit), digits).alias("accuracy"),
                                   F.round(-F.avg(ll), digits).alias("log_loss"),
                                   F.round(F.sqrt(F.avg((F.col(prob) - y) ** 2)), digits).alias("rmse"))


def disagreement(pred: DataFrame, key: str, model: str, prob: str, a: str, b: str, threshold: float = 0.5,
                 digits: int = 6) -> DataFrame:
    """ML22: share of rows on which two models' decisions differ."""
    w = pred.groupBy(key).agg((F.max(F.when(F.col(model) == a, F.col(prob))) > threshold).alias("_a"),
                              (F.max(F.when(F.col(model) == b, F.col(prob))) > threshold).alias("_b"))
    return w.agg(F.round(F.avg((F.col("_a") != F.col("_b")).cast("double")), digits).alias("disagreement_rate"),
                 F.count_if(F.col("_a") != F.col("_b")).alias("n_disagree"))


def blend(pred: DataFrame, key: str, prob: str, threshold: float) -> DataFrame:
    """ML24: mean of the model columns of the long prediction table, thresholded."""
    return pred.groupBy(key).agg(F.avg(prob).alias("mean_prob")) \
        .withColumn("pred", (F.col("mean_prob") > threshold).cast("int"))


def screen_models(pred: DataFrame, key: str, model: str, prob: str, train_rate, max_rate_distance: float,
                  max_mean_corr: float, threshold: float = 0.5, digits: int = 6) -> DataFrame:
    """ML25: per model, distance of its positive rate from the train rate and
    mean correlation with the other models; ``keep`` when both are acceptable.
    Model pairs are joined on the row key, so each row pairs only the (few)
    models' predictions of that row."""
    rates = pred.groupBy(model).agg(F.avg((F.col(prob) > threshold).cast("double")).alias("_pos"))
    a = pred.select(key, F.col(model).alias("m1"), F.col(prob).alias("p1"))
    b = pred.select(key, F.col(model).alias("m2"), F.col(prob).alias("p2"))
    pairs = a.join(b, key).where(F.col("m1") != F.col("m2")).groupBy("m1", "m2").agg(correlation("p1", "p2").alias("_c"))
    mc = pairs.groupBy(F.col("m1").alias(model)).agg(F.avg("_c").alias("_mc"))
    dist = F.abs(F.col("_pos") - train_rate)
    return rates.join(mc, model).select(model, F.round(dist, digits).alias("rate_distance"),
                                        F.round("_mc", digits).alias("mean_corr"),
                                        ((dist <= max_rate_distance) & (F.col("_mc") < max_mean_corr)).alias("keep"))


def majority_vote(pred: DataFrame, key: str, prob: str, threshold: float = 0.5) -> DataFrame:
    """ML25: 1 when more than half of the models predict positive."""
    return pred.groupBy(key).agg(
        (F.sum((F.col(prob) > threshold).cast("int")) * 2 > F.count(F.lit(1))).cast("int").alias("vote"))


def prediction_balance(pred: DataFrame, model: str, decision, digits: int = 6) -> DataFrame:
    """ML26: predicted values per model, count and share."""
    c = pred.groupBy(model, decision.alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    tot = pred.groupBy(model).agg(F.count(F.lit(1)).alias("_t"))
    return c.join(tot, model).select(model, "pred", "n", F.round(F.col("n") / F.col("_t"), digits).alias("share"))


def drop_one_blends(pred: DataFrame, key: str, model: str, prob: str, label: str, threshold: float,
                    digits: int = 6) -> DataFrame:
    """ML25: for each model, the blend of all the others: accuracy and share
    positive.  Per row the blend without model m is (sum - p_m) / (n - 1), so
    one aggregation per row plus one pass over the long table suffices (no
    self join of the predictions)."""
    per_row = pred.groupBy(key).agg(F.sum(prob).alias("_sum"), F.count(prob).alias("_n"),
                                    F.first(label).alias("_y"))
    j = pred.select(key, model, prob).join(per_row, key)
    mean = (F.col("_sum") - F.col(prob)) / (F.col("_n") - 1)
    hit = ((mean > threshold) == (F.col("_y") == 1)).cast("double")
    return j.groupBy(F.col(model).alias("dropped")).agg(
        F.round(F.avg(hit), digits).alias("accuracy"),
        F.round(F.avg((mean > threshold).cast("double")), digits).alias("share_positive"))
