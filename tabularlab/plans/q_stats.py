"""Regression-inference and metric queries (ML1-ML7, ML22, ML24-ML26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularlab.operators import metrics as M
from tabularlab.operators import stats as ST
from tabularlab.plans.catalog import register
from tabularlab.sources.tables import Tables

Y, X = "l_extendedprice", "l_quantity"
XS = ["l_quantity", "l_discount", "l_tax"]


@register("ml1_ols_simple", f"""
select round(regr_slope({Y}, {X}), 6) as slope, round(regr_intercept({Y}, {X}), 6) as intercept,
       round(regr_r2({Y}, {X}), 6) as r2,
       round(sqrt((regr_syy({Y}, {X}) - regr_slope({Y}, {X}) * regr_sxy({Y}, {X})) / (regr_count({Y}, {X}) - 2)
                  / regr_sxx({Y}, {X})), 6) as se_slope
from lineitem""")
def ml1(spark, sf):
    fit = ST.ols(Tables(spark, sf).lineitem, Y, [X])
    return spark.createDataFrame([(round(float(fit.coef[1]), 6), round(float(fit.coef[0]), 6), round(fit.r2, 6),
                                   round(float(fit.std_err[1]), 6))],
                                 "slope double, intercept double, r2 double, se_slope double")


@register("ml1_ols_inference")
def ml1i(spark, sf):
    fit = ST.ols(Tables(spark, sf).lineitem, Y, XS)
    s = fit.summary(spark).first()
    return fit.table(spark).withColumns({"r2": F.lit(s["r2"]), "adj_r2": F.lit(s["adj_r2"]),
                                         "f_stat": F.lit(s["f_stat"]), "f_p_value": F.lit(s["f_p_value"])})


@register("ml2_ols_no_intercept", f"""
select round(sum({X} * {Y}) / sum({X} * {X}), 6) as slope,
       round(sum({X} * {Y}) * sum({X} * {Y}) / (sum({X} * {X}) * sum({Y} * {Y})), 6) as r2_uncentred
from lineitem where {X} is not null and {Y} is not null""")
def ml2(spark, sf):
    fit = ST.ols(Tables(spark, sf).lineitem, Y, [X], intercept=False)
    return spark.createDataFrame([(round(float(fit.coef[0]), 6), round(fit.r2, 6))], "slope double, r2_uncentred double")


@register("ml3_interactions")
def ml3(spark, sf):
    terms = [X, (X, X), "l_discount", (X, "l_discount")]
    return ST.ols(Tables(spark, sf).lineitem, Y, terms).table(spark)


@register("ml4_single_predictor_scan", " union all ".join(
    f"select '{x}' as predictor, round(regr_slope({Y}, {x}), 6) as slope, round(regr_intercept({Y}, {x}), 6) as intercept, "
    f"round(regr_r2({Y}, {x}), 6) as r2 from lineitem" for x in XS))
def ml4(spark, sf):
    return ST.single_predictor_scan(Tables(spark, sf).lineitem, Y, XS)


@register("ml4_scan_no_constant", " union all ".join(
    f"select '{x}' as predictor, round(sum({x} * {Y}) / sum({x} * {x}), 6) as slope, cast(0 as double) as intercept, "
    f"round(sum({x} * {Y}) * sum({x} * {Y}) / (sum({x} * {x}) * sum({Y} * {Y})), 6) as r2 from lineitem" for x in XS))
def ml4n(spark, sf):
    return ST.single_predictor_scan(Tables(spark, sf).lineitem, Y, XS, intercept=False)


@register("ml4_scan_vs_joint")
def ml4j(spark, sf):
    """Predictors whose single fit has R^2 > 0.2, beside their coefficient in the joint fit."""
    li = Tables(spark, sf).lineitem
    scan = ST.single_predictor_scan(li, Y, XS)
    joint = ST.ols(li, Y, XS).table(spark).select(F.col("term").alias("predictor"), F.col("coef").alias("joint_slope"))
    return scan.join(joint, "predictor").withColumn("kept", F.col("r2") > 0.2)


@register("ml5_f_test", " union all ".join(
    f"select '{x}' as feature, round(corr({x}, {Y}) * corr({x}, {Y}) / (1 - corr({x}, {Y}) * corr({x}, {Y})) "
    f"* (count(*) - 2), 6) as f_stat from lineitem" for x in XS))
def ml5(spark, sf):
    return ST.univariate_f_test(Tables(spark, sf).lineitem, Y, XS).select("feature", "f_stat")


@register("ml5_f_test_p_values")
def ml5p(spark, sf):
    return ST.univariate_f_test(Tables(spark, sf).lineitem, Y, XS)


@register("ml6_anova_type2")
def ml6(spark, sf):
    return ST.anova_type2(Tables(spark, sf).lineitem, Y, [X, "l_discount", (X, "l_discount")])


@register("ml7_influence")
def ml7(spark, sf):
    li = Tables(spark, sf).lineitem
    return ST.influence(li, Y, [X, "l_discount"], ["l_orderkey", "l_linenumber"])


# ---------------------------------------------------------------- metrics and blends
# Rule "models" over the labelled documents give a long prediction table
# (doc_id, model, prob); rules are SQL-expressible so the oracle can follow.

RULES = {
    "long_text": "1 / (1 + exp(-(n_chars - 2000) / 1e3))",
    "english": "case when lang = 'en' then 0.8 else 0.3 end",
    "low_source": "case when cast(substr(source, 4) as int) < 10 then 0.7 else 0.4 end",
    "short_text": "1 / (1 + exp((n_chars - 3000) / 1.5e3))",
}


def predictions(t: Tables):
    """Long prediction table from one pass over documents x labels: every row
    is exploded into one (model, prob) pair per rule."""
    d = t.documents.select("doc_id", "n_chars", "lang", "source").join(t.labels.select("doc_id", "quality"), "doc_id")
    per_model = F.array(*[F.struct(F.lit(name).alias("model"), F.expr(expr).cast("double").alias("prob"))
                          for name, expr in RULES.items()])
    return d.select("doc_id", "quality", F.explode(per_model).alias("_m")).select("doc_id", "quality", "_m.*")


PRED_SQL = " union all ".join(
    f"select d.doc_id, l.quality, '{name}' as model, cast({expr} as double) as prob "
    f"from documents d join labels l on d.doc_id = l.doc_id" for name, expr in RULES.items())


@register("ml22_metrics", f"""
with p as ({PRED_SQL})
select model, round(avg(cast((prob > 0.5) = (quality = 1) as double)), 6) as accuracy,
       round(-avg(quality * ln(least(greatest(prob, 1e-15), 1 - 1e-15))
                  + (1 - quality) * ln(1 - least(greatest(prob, 1e-15), 1 - 1e-15))), 6) as log_loss,
       round(sqrt(avg((prob - quality) * (prob - quality))), 6) as rmse
from p group by model""")
def ml22(spark, sf):
    return M.binary_metrics(predictions(Tables(spark, sf)), "model", "quality", "prob")


@register("ml22_disagreement", f"""
with p as ({PRED_SQL}),
w as (select doc_id, max(case when model = 'long_text' then prob end) > 0.5 as a,
             max(case when model = 'english' then prob end) > 0.5 as b from p group by doc_id)
select round(avg(cast(a <> b as double)), 6) as disagreement_rate, count(*) filter (where a <> b) as n_disagree from w""")
def ml22d(spark, sf):
    return M.disagreement(predictions(Tables(spark, sf)), "doc_id", "model", "prob", "long_text", "english")


@register("ml24_blend", f"""
with p as ({PRED_SQL}),
b as (select doc_id, avg(prob) as mean_prob from p group by doc_id)
select doc_id, round(mean_prob, 6) as mean_prob, cast(mean_prob > 0.47 as int) as pred from b""")
def ml24(spark, sf):
    b = M.blend(predictions(Tables(spark, sf)), "doc_id", "prob", 0.47)
    return b.select("doc_id", F.round("mean_prob", 6).alias("mean_prob"), "pred")


@register("ml24_blend_share", f"""
with p as ({PRED_SQL}),
b as (select doc_id, avg(prob) as mean_prob from p group by doc_id)
select round(avg(cast(mean_prob > 0.47 as double)), 6) as share_positive, count(*) as n from b""")
def ml24s(spark, sf):
    b = M.blend(predictions(Tables(spark, sf)), "doc_id", "prob", 0.47)
    return b.agg(F.round(F.avg(F.col("pred").cast("double")), 6).alias("share_positive"), F.count(F.lit(1)).alias("n"))


@register("ml25_model_screening", f"""
with p as ({PRED_SQL}),
rate as (select avg(quality) as r from labels),
m as (select model, avg(cast(prob > 0.5 as double)) as pos_rate from p group by model),
pairs as (select a.model as m1, b.model as m2, corr(a.prob, b.prob) as c from p a join p b on a.doc_id = b.doc_id
          where a.model <> b.model group by a.model, b.model),
mc as (select m1 as model, avg(c) as mean_corr from pairs group by m1)
select m.model, round(abs(m.pos_rate - rate.r), 6) as rate_distance, round(mc.mean_corr, 6) as mean_corr,
       abs(m.pos_rate - rate.r) <= 0.3 and mc.mean_corr < 0.99 as keep
from m, rate, mc where m.model = mc.model""")
def ml25(spark, sf):
    t = Tables(spark, sf)
    return M.screen_models(predictions(t), "doc_id", "model", "prob", t.labels.agg(F.avg("quality")).scalar(),
                           max_rate_distance=0.3, max_mean_corr=0.99)


@register("ml25_drop_one", f"""
with p as ({PRED_SQL}),
m as (select distinct model from p),
b as (select m.model as dropped, p.doc_id, avg(p.prob) as mean_prob, any_value(p.quality) as quality
      from m join p on p.model <> m.model group by m.model, p.doc_id)
select dropped, round(avg(cast((mean_prob > 0.47) = (quality = 1) as double)), 6) as accuracy,
       round(avg(cast(mean_prob > 0.47 as double)), 6) as share_positive from b group by dropped""")
def ml25d(spark, sf):
    return M.drop_one_blends(predictions(Tables(spark, sf)), "doc_id", "model", "prob", "quality", 0.47)


@register("ml25_majority_vote", f"""
with p as ({PRED_SQL})
select doc_id, cast(sum(cast(prob > 0.5 as int)) * 2 > count(*) as int) as vote from p group by doc_id""")
def ml25v(spark, sf):
    return M.majority_vote(predictions(Tables(spark, sf)), "doc_id", "prob")


@register("ml26_prediction_balance", f"""
with p as ({PRED_SQL})
select model, cast(prob > 0.5 as int) as pred, count(*) as n,
       round(count(*) / sum(count(*)) over (partition by model), 6) as share
from p group by model, cast(prob > 0.5 as int)""")
def ml26(spark, sf):
    return M.prediction_balance(predictions(Tables(spark, sf)), "model", (F.col("prob") > 0.5).cast("int"))
