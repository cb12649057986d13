"""Closed-form checks of the regression operators against numpy and Spark ML."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularlab.operators import stats as ST


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 300
    x1, x2 = rng.normal(size=n) * 10 + 1000, rng.normal(size=n)
    y = 3 + 2 * x1 - 5 * x2 + 0.5 * x1 * x2 + rng.normal(size=n) * 3
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(x1, x2, y)]
    return spark.createDataFrame(rows, "x1 double, x2 double, y double"), x1, x2, y


def test_ols_matches_numpy_and_spark(spark, data):
    df, x1, x2, y = data
    fit = ST.ols(df, "y", ["x1", "x2"])
    X = np.column_stack([np.ones_like(x1), x1, x2])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    assert fit.coef == pytest.approx(beta, rel=1e-8)
    resid = y - X @ beta
    s2 = resid @ resid / (len(y) - 3)
    se = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * s2)
    assert fit.std_err == pytest.approx(se, rel=1e-6)
    lr = ST.ols_spark_ml(df, "y", ["x1", "x2"])
    s = lr.summary
    assert fit.r2 == pytest.approx(s.r2, rel=1e-8)
    # Spark lists coefficients first, intercept last
    assert list(fit.p) == pytest.approx(list(s.pValues[-1:]) + list(s.pValues[:-1]), abs=1e-8)


def test_no_intercept_uses_uncentred_r2(spark, data):
    df, x1, x2, y = data
    fit = ST.ols(df, "y", ["x1"], intercept=False)
    b = (x1 @ y) / (x1 @ x1)
    assert fit.coef[0] == pytest.approx(b)
    assert fit.r2 == pytest.approx(1 - ((y - b * x1) ** 2).sum() / (y ** 2).sum())


def test_interaction_terms_and_anova(spark, data):
    df, x1, x2, y = data
    fit = ST.ols(df, "y", ["x1", "x2", ("x1", "x2")])
    X = np.column_stack([np.ones_like(x1), x1, x2, x1 * x2])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    assert fit.coef == pytest.approx(beta, rel=1e-6)
    an = {r["term"]: r["sum_sq"] for r in ST.anova_type2(df, "y", ["x1", "x2", ("x1", "x2")]).collect()}

    def sse(cols):
        Z = np.column_stack([np.ones_like(x1)] + cols)
        b, *_ = np.linalg.lstsq(Z, y, rcond=None)
        return ((y - Z @ b) ** 2).sum()
    assert an["x1:x2"] == pytest.approx(sse([x1, x2]) - sse([x1, x2, x1 * x2]), rel=1e-5)
    assert an["x1"] == pytest.approx(sse([x2]) - sse([x1, x2]), rel=1e-5)


def test_influence_leverage(spark, data):
    df, x1, x2, y = data
    inf = ST.influence(df.withColumn("i", F.monotonically_increasing_id()), "y", ["x1", "x2"], ["x1", "x2"])
    got = sorted((r["x1"], r["leverage"]) for r in inf.collect())
    X = np.column_stack([np.ones_like(x1), x1, x2])
    h = np.diag(X @ np.linalg.inv(X.T @ X) @ X.T)
    assert [g[1] for g in got] == pytest.approx([v for _, v in sorted(zip(x1, h))], rel=1e-6)
    assert sum(g[1] for g in got) == pytest.approx(3.0, rel=1e-6)   # trace of the hat matrix


def test_f_test(spark, data):
    df, x1, x2, y = data
    r = {x["feature"]: x for x in ST.univariate_f_test(df, "y", ["x1"]).collect()}
    c = np.corrcoef(x1, y)[0, 1]
    assert r["x1"]["f_stat"] == pytest.approx(c * c / (1 - c * c) * (len(y) - 2), rel=1e-6)
