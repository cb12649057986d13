"""Every registered query with an oracle equals its DuckDB SQL on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from tabularlab.sources.tables import TABLES

from conftest import SF_SMALL

sys_path_tools = __import__("os").path.join(__import__("os").path.dirname(__file__), "..", "tools")
__import__("sys").path.insert(0, sys_path_tools)
from oracle_check import rows_of, type_mismatches  # noqa: E402

from tabularlab.plans import catalog  # noqa: E402

E.queries()      # loads the query modules
QUERIES, ORACLE = dict(catalog.QUERIES), dict(catalog.ORACLE)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF_SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    assert type_mismatches(sdf, con, ORACLE[name]) == []
    got = sdf.toPandas()
    want = con.execute(ORACLE[name]).fetchdf()
    assert rows_of(got) == rows_of(want)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["wrmsse", "zero_scale_series"]
    r = df.first()
    want = duckdb.connect()
    for t in TABLES:
        want.execute(f"create view {t} as select * from '{SF_SMALL}/{t}.parquet'")
    wrmsse, zero = want.execute(ORACLE["ml23_wrmsse_naive"]).fetchone()
    assert r["wrmsse"] == pytest.approx(wrmsse, abs=2e-6) and r["zero_scale_series"] == zero


def test_queries_without_sql_are_known():
    """Learners and sketches; each has a test of its own in test_models.py or beside its operator."""
    assert sorted(set(QUERIES) - set(ORACLE)) == sorted([
        "ag4_approx_distinct", "ag4_stored_sketches", "ml1_ols_inference", "ml3_interactions", "ml4_scan_vs_joint", "ml5_f_test_p_values",
        "ml6_anova_type2", "ml7_influence", "ml9_pca", "ml9_pca_scores", "ml10_gbt_importances", "ml11_gbt_loss_curve",
        "ml12_random_forest", "ml13_logistic_l2", "ml14_multilabel_text", "ml15_cross_validation", "ml16_grid_search",
        "ml16_refit_predictions", "ml17_embedded_selection", "ml18_recursive_elimination", "ml19_importance_sanity", "ml20_mlp",
        "ml21_sales_regressor", "tx10_vector_lookup", "tx11_factor_vectors", "tx11_word2vec", "tx13_main_text"])
