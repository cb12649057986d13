"""Regression inference (ML1-ML7).

Every fit reads the data once: a single aggregation returns the cross-product
sums (X'X, X'y, y'y, n) - p(p+1)/2 + p + 2 numbers - and the p x p algebra runs
on the driver.  Row-level outputs (fitted values, leverage, residuals) are
column expressions with the small inverse matrix inlined as literals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularlab.functions.distributions import f_sf, t_quantile, t_two_sided_p
from tabularlab.operators.aggs import correlation


def term_column(term: Sequence[str] | str) -> Column:
    """A model term: a column name, or a tuple of names multiplied together
    (``("a", "b")`` is the interaction a:b, ``("x", "x")`` is x squared)."""
    if isinstance(term, str):
        return F.col(term).cast("double")
    out = None
    for c in term:
        out = F.col(c).cast("double") if out is None else out * F.col(c).cast("double")
    return out


def term_name(term) -> str:
    return term if isinstance(term, str) else ":".join(term)


def expand_star(a: str, b: str) -> list:
    """``a*b`` = a + b + a:b."""
    return [a, b, (a, b)]


@dataclass
class Gram:
    names: list[str]
    xtx: np.ndarray      # uncentred, including the constant column when fitted
    xty: np.ndarray
    yty: float
    sum_y: float
    n: int
    sxx: np.ndarray | None = None   # centred cross products of the non-constant terms
    sxy: np.ndarray | None = None
    syy: float | None = None
    means: np.ndarray | None = None
    mean_y: float | None = None


def gram(df: DataFrame, y: str, terms: Sequence, intercept: bool = True) -> Gram:
    """Normal-equation sums over complete rows.  With a constant, a first
    aggregation gets the means and a second the centred cross products (no
    catastrophic cancellation when values are large); without, one pass of raw
    cross products."""
    cols = [term_column(t).alias(f"_x{i}") for i, t in enumerate(terms)]
    names = [term_name(t) for t in terms]
    data = df.select(F.col(y).cast("double").alias("_y"), *cols).dropna()
    xs = [f"_x{i}" for i in range(len(terms))]
    k = len(xs)
    if intercept:
        m = data.agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("my"), *[F.avg(x).alias(x) for x in xs]).first()
        n, my = m["n"], m["my"] or 0.0
        means = np.array([m[x] or 0.0 for x in xs])
        centred = data.select((F.col("_y") - my).alias("_y"),
                              *[(F.col(x) - float(means[i])).alias(x) for i, x in enumerate(xs)])
    else:
        centred = data
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(F.col("_y") * F.col("_y")).alias("yy")]
    for i in range(k):
        aggs.append(F.sum(F.col(xs[i]) * F.col("_y")).alias(f"xy{i}"))
        for j in range(i, k):
            aggs.append(F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"xx{i}_{j}"))
    r = centred.agg(*aggs).first()
    sxx = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            sxx[i, j] = sxx[j, i] = r[f"xx{i}_{j}"] or 0.0
    sxy = np.array([r[f"xy{i}"] or 0.0 for i in range(k)])
    syy = r["yy"] or 0.0
    if not intercept:
        return Gram(names, sxx, sxy, syy, 0.0, r["n"])
    # rebuild the uncentred system with the constant column (used for standard errors)
    p = k + 1
    xtx = np.zeros((p, p))
    xtx[0, 0] = n
    xtx[0, 1:] = xtx[1:, 0] = n * means
    xtx[1:, 1:] = sxx + n * np.outer(means, means)
    xty = np.concatenate([[n * my], sxy + n * means * my])
    return Gram(["Intercept", *names], xtx, xty, syy + n * my * my, n * my, n, sxx, sxy, syy, means, my)


@dataclass
class OLSResult:
    names: list[str]
    coef: np.ndarray
    std_err: np.ndarray
    t: np.ndarray
    p: np.ndarray
    ci_low: np.ndarray
    ci_high: np.ndarray
    r2: float
    adj_r2: float
    f_stat: float
    f_p: float
    sse: float
    df_resid: int
    n: int
    xtx_inv: np.ndarray
    intercept: bool

    def table(self, spark) -> DataFrame:
        rows = [(n, float(c), float(s), float(t), float(p), float(lo), float(hi))
                for n, c, s, t, p, lo, hi in zip(self.names, self.coef, self.std_err, self.t, self.p,
                                                   self.ci_low, self.ci_high)]
        return spark.createDataFrame(rows, "term string, coef double, std_err double, t double, p_value double, "
                                           "ci_low double, ci_high double")

    def summary(self, spark) -> DataFrame:
        return spark.createDataFrame([(self.n, self.df_resid, self.r2, self.adj_r2, self.f_stat, self.f_p, self.sse)],
                                     "n long, df_resid long, r2 double, adj_r2 double, f_stat double, f_p_value double, "
                                     "sse double")


def ols_from_gram(g: Gram, intercept: bool = True) -> OLSResult:
    p = len(g.names)
    inv = np.linalg.pinv(g.xtx)
    if intercept and g.sxx is not None:
        slopes = np.linalg.pinv(g.sxx) @ g.sxy if len(g.sxy) else np.zeros(0)
        beta = np.concatenate([[g.mean_y - slopes @ g.means], slopes])
        sse = float(g.syy - slopes @ g.sxy)
    else:
        beta = inv @ g.xty
        sse = float(g.yty - 2 * beta @ g.xty + beta @ g.xtx @ beta)
    sse = max(sse, 0.0)
    df_resid = g.n - p
    sigma2 = sse / df_resid if df_resid > 0 else float("nan")
    se = np.sqrt(np.maximum(np.diag(inv) * sigma2, 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = beta / se
    pv = np.array([t_two_sided_p(float(x), df_resid) for x in t])
    q = t_quantile(0.975, df_resid) if df_resid > 0 else float("nan")
    if intercept:
        sst = g.syy                              # centred
        k = p - 1
    else:
        sst = g.yty                              # uncentred R^2 without a constant (ML2)
        k = p
    r2 = 1 - sse / sst if sst > 0 else float("nan")
    adj = 1 - (1 - r2) * (g.n - (1 if intercept else 0)) / df_resid if df_resid > 0 else float("nan")
    f_stat = ((sst - sse) / k) / sigma2 if k > 0 and sigma2 > 0 else float("nan")
    return OLSResult(g.names, beta, se, t, pv, beta - q * se, beta + q * se, r2, adj, f_stat,
                     f_sf(f_stat, k, df_resid), sse, df_resid, g.n, inv, intercept)


def ols(df: DataFrame, y: str, terms: Sequence, intercept: bool = True) -> OLSResult:
    """ML1/ML2/ML3: ordinary least squares with inference."""
    return ols_from_gram(gram(df, y, terms, intercept), intercept)


def ols_spark_ml(df: DataFrame, y: str, xs: Sequence[str], intercept: bool = True):
    """The same fit through Spark ML's normal-equation solver (its summary
    carries standard errors, t and p values)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    data = VectorAssembler(inputCols=list(xs), outputCol="_features").transform(
        df.select(*[F.col(c).cast("double") for c in [y, *xs]]).dropna())
    return LinearRegression(featuresCol="_features", labelCol=y, solver="normal", fitIntercept=intercept,
                            regParam=0.0).fit(data)


def single_predictor_scan(df: DataFrame, y: str, xs: Sequence[str], intercept: bool = True,
                          digits: int = 6) -> DataFrame:
    """ML4: each predictor alone, all in one aggregation: slope, (intercept), R^2.
    Without a constant the slope is sum(xy)/sum(x^2) and R^2 is uncentred."""
    aggs = []
    for x in xs:
        xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
        ok = xc.isNotNull() & yc.isNotNull()
        if intercept:
            aggs += [F.regr_slope(yc, xc).alias(f"{x}__b"), F.regr_intercept(yc, xc).alias(f"{x}__a"),
                     F.regr_r2(yc, xc).alias(f"{x}__r2")]
        else:
            sxy = F.sum(F.when(ok, xc * yc))
            sxx = F.sum(F.when(ok, xc * xc))
            syy = F.sum(F.when(ok, yc * yc))
            aggs += [(sxy / sxx).alias(f"{x}__b"), F.lit(0.0).alias(f"{x}__a"),
                     (sxy * sxy / (sxx * syy)).alias(f"{x}__r2")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(x).alias("predictor"), F.round(F.col(f"{x}__b"), digits).alias("slope"),
                     F.round(F.col(f"{x}__a"), digits).alias("intercept"),
                     F.round(F.col(f"{x}__r2"), digits).alias("r2")) for x in xs]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def univariate_f_test(df: DataFrame, y: str, xs: Sequence[str], digits: int = 6) -> DataFrame:
    """ML5: per feature F = r^2 / (1 - r^2) * (n - 2) from the correlation, and its p-value."""
    aggs = []
    for x in xs:
        ok = F.col(x).isNotNull() & F.col(y).isNotNull()
        aggs += [correlation(F.col(x).cast("double"), F.col(y).cast("double")).alias(f"{x}__r"),
                 F.count_if(ok).alias(f"{x}__n")]
    r = df.agg(*aggs).first()
    rows = []
    for x in xs:
        rr, n = r[f"{x}__r"], r[f"{x}__n"]
        if rr is not None and math.isnan(rr):            # a value that never varies
            rows.append((x, rr, rr))
            continue
        f = rr * rr / (1 - rr * rr) * (n - 2) if rr is not None and abs(rr) < 1 else float("inf")
        rows.append((x, round(f, digits), f_sf(f, 1, n - 2)))
    return df.sparkSession.createDataFrame(rows, "feature string, f_stat double, p_value double")


def anova_type2(df: DataFrame, y: str, terms: Sequence, digits: int = 6) -> DataFrame:
    """ML6: type-II sums of squares: for each term, SSE of the model without the
    term (and without the interactions that contain it) minus the full SSE.
    One Gram matrix; the reduced fits are sub-matrix solves on the driver."""
    g = gram(df, y, terms, True)
    full = ols_from_gram(g, True)
    names = [term_name(t) for t in terms]
    rows = []
    for i, t in enumerate(terms):
        parts = {t} if isinstance(t, str) else set(t)
        drop = {i}
        for j, u in enumerate(terms):
            if j != i and not isinstance(u, str) and parts <= set(u) and len(set(u)) > len(parts):
                drop.add(j)
        keep = [0] + [j + 1 for j in range(len(terms)) if j not in drop]
        keep_wo = [0] + [j + 1 for j in range(len(terms)) if j not in drop or j == i]
        sse_red = _sse(g, keep)
        sse_with = _sse(g, keep_wo)
        ss = sse_red - sse_with
        f = (ss / 1) / (full.sse / full.df_resid)
        rows.append((names[i], round(ss, digits), 1, round(f, digits), f_sf(f, 1, full.df_resid)))
    rows.append(("Residual", round(full.sse, digits), full.df_resid, None, None))
    return df.sparkSession.createDataFrame(rows, "term string, sum_sq double, df long, f_stat double, p_value double")


def _sse(g: Gram, idx: Sequence[int]) -> float:
    """SSE of the sub-model with the constant and the terms ``idx`` (1-based
    positions in the full model), from the centred system."""
    k = [i - 1 for i in idx if i > 0]
    if not k:
        return float(g.syy)
    a = g.sxx[np.ix_(k, k)]
    b = g.sxy[k]
    return float(g.syy - (np.linalg.pinv(a) @ b) @ b)


def influence(df: DataFrame, y: str, terms: Sequence, key: Sequence[str], fit: OLSResult | None = None) -> DataFrame:
    """ML7: fitted value, residual, leverage h = x'(X'X)^-1 x, internally and
    externally studentised residuals and Cook's distance, per row, with the
    p x p inverse inlined as literals (no join, no collect of rows)."""
    fit = fit or ols(df, y, terms, True)
    xs = [F.lit(1.0)] + [term_column(t) for t in terms]
    beta = [float(b) for b in fit.coef]
    inv = fit.xtx_inv
    p = len(xs)
    yhat = sum(F.lit(beta[i]) * xs[i] for i in range(p))
    lev = sum(F.lit(float(inv[i, j])) * xs[i] * xs[j] for i in range(p) for j in range(p))
    s2 = fit.sse / fit.df_resid
    resid = F.col(y).cast("double") - yhat
    r_int = F.col("resid") / F.sqrt(F.lit(s2) * (1 - F.col("leverage")))
    dfr = fit.df_resid
    s2_i = (F.lit(fit.sse) - F.col("resid") ** 2 / (1 - F.col("leverage"))) / (dfr - 1)
    r_ext = F.col("resid") / F.sqrt(s2_i * (1 - F.col("leverage")))
    cooks = r_int ** 2 / p * F.col("leverage") / (1 - F.col("leverage"))
    names = ["Intercept", *[term_name(t) for t in terms]]
    # change of each coefficient, in its standard errors, when the row is left out
    moved = {f"dfbetas_{n}": sum(F.lit(float(inv[j, i])) * xs[i] for i in range(p)) / F.lit(float(np.sqrt(inv[j, j])))
             for j, n in enumerate(names)}
    out = df.select(*key, yhat.alias("fitted"), resid.alias("resid"), lev.alias("leverage"),
                    *[v.alias(n) for n, v in moved.items()])
    out = out.withColumn("student_resid", r_int).withColumn("extern_student_resid", r_ext).withColumn("cooks_d", cooks)
    scale = F.col("extern_student_resid") / F.sqrt(1 - F.col("leverage"))
    return out.withColumns({n: F.col(n) * scale for n in moved})
