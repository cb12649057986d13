"""Plan checks for scale-critical operators (read from explain output)."""

import contextlib
import io

from pyspark.sql import functions as F

from tabularlab.operators.hierarchy import SALES_LEVELS, level_aggregate
from tabularlab.operators.series import top_n_per_group
from tabularlab.plans.facts import monthly_sales
from tabularlab.sources.tables import Tables

from conftest import SF_SMALL


def plan(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_filter_and_projection_reach_the_scan(spark):
    import __spark_entry__ as E
    p = plan(E.queries()["prj2_filter"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(l_quantity), IsNotNull(l_shipdate), GreaterThanOrEqual(l_quantity,10.0)" in p
    read = [ln for ln in p.splitlines() if ln.strip().startswith("ReadSchema")][0]
    assert "l_tax" not in read and "l_extendedprice" not in read


def test_fixed_size_dimensions_are_broadcast(spark):
    p = plan(monthly_sales(Tables(spark, SF_SMALL), materialized=False))
    assert "BroadcastExchange" in p and "BroadcastHashJoin" in p


def test_hierarchy_is_one_expand_one_aggregation(spark):
    f = monthly_sales(Tables(spark, SF_SMALL), materialized=False)
    p = plan(level_aggregate(f, SALES_LEVELS, [F.sum("sales").alias("s")], by=["m"]), "simple")
    assert p.count("Expand") == 1
    assert p.count("partial_sum(sales") == 1


def test_top_n_uses_group_limit_before_shuffle(spark):
    o = Tables(spark, SF_SMALL).orders
    p = plan(top_n_per_group(o, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 2), "simple")
    assert "WindowGroupLimit" in p and "Partial" in p


def test_no_cross_join_in_knn(spark):
    from tabularlab.operators.models import knn_classify
    e = Tables(spark, SF_SMALL).embeddings
    p = plan(knn_classify(e, "vec_id", "embedding", "label", 5), "simple")
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
