"""Bindings from the driver tables to the series facts used by the series,
forecast and scoring operators.

``monthly_sales`` stands in for the retail sales fact: one row per
(item, store, month) with units and dollars.  Mapping: category = part type,
department = type + (brand number mod 3), item = type + brand, store = the
supplier's nation, state = the supplier's region, month index m = 1 for
January 1995.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularlab.session import materialize
from tabularlab.sources.tables import Tables

SERIES_KEYS = ["item_id", "dept_id", "cat_id", "store_id", "state_id"]
HORIZON = 6            # months held out for validation: the last ones in the data


def month_index(ts_col: str) -> F.Column:
    return ((F.year(ts_col) - 1995) * 12 + F.month(ts_col)).cast("bigint")


def item_dim(part: DataFrame) -> DataFrame:
    brand_no = F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)).try_cast("int")
    return part.select(
        "p_partkey",
        F.concat_ws("_", "p_type", "p_brand").alias("item_id"),
        F.concat_ws("_", F.col("p_type"), F.pmod(brand_no, F.lit(3)).cast("string")).alias("dept_id"),
        F.col("p_type").alias("cat_id"))


def store_dim(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    # nation and region have a fixed size (25 / 5 rows): broadcasting them is bounded.
    geo = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey) \
        .select("n_nationkey", F.col("n_name").alias("store_id"), F.col("r_name").alias("state_id"))
    return supplier.select("s_suppkey", "s_nationkey") \
        .join(F.broadcast(geo), F.col("s_nationkey") == F.col("n_nationkey")) \
        .select("s_suppkey", "store_id", "state_id")


def monthly_sales(t: Tables, materialized: bool = True) -> DataFrame:
    """(item_id, dept_id, cat_id, store_id, state_id, m, sales, dollars): observed rows only.

    The result (one row per series and month, far smaller than lineitem) is
    checkpointed by default so that plans using it several times scan
    lineitem once."""
    li = t.lineitem.select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", month_index("l_shipdate").alias("m"))
    # part and supplier grow with the data: no hint, AQE broadcasts them only
    # when the measured size is under the threshold, else it shuffles.
    joined = li.join(item_dim(t.part), F.col("l_partkey") == F.col("p_partkey")) \
               .join(store_dim(t.supplier, t.nation, t.region), F.col("l_suppkey") == F.col("s_suppkey"))
    # money is summed as whole cents in a long (exact, and far cheaper than a
    # wide-decimal sum, which Spark runs through BigDecimal), then shown as decimal
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    facts = joined.groupBy(*SERIES_KEYS, "m").agg(
        F.sum("l_quantity").cast("bigint").alias("sales"),
        (F.sum(cents).cast("decimal(20,0)") / F.lit(100)).cast("decimal(20,2)").alias("dollars"))
    return materialize(facts) if materialized else facts


def dense_monthly_sales(t: Tables) -> tuple[DataFrame, int]:
    """Every observed series x months 1..last month in the data, absent months = 0
    (WN15), and the last training month (the last month less the horizon)."""
    from tabularlab.operators.series import densify
    facts = monthly_sales(t)
    last = facts.agg(F.max("m")).first()[0] or 0
    series = facts.select(*SERIES_KEYS).distinct()
    dense = densify(facts, series, SERIES_KEYS, "m", 1, last, fill={"sales": 0, "dollars": 0}) if last else facts
    return dense, last - HORIZON


# The same bindings in DuckDB SQL, for the oracle queries.
MONTHLY_SALES_SQL = """
select p_type || '_' || p_brand as item_id,
       p_type || '_' || cast(cast(split_part(p_brand, '#', 2) as int) % 3 as varchar) as dept_id,
       p_type as cat_id, n_name as store_id, r_name as state_id,
       (year(l_shipdate) - 1995) * 12 + month(l_shipdate) as m,
       cast(sum(l_quantity) as bigint) as sales,
       sum(cast(l_extendedprice as decimal(18,2))) as dollars
from lineitem join part on l_partkey = p_partkey
     join supplier on l_suppkey = s_suppkey
     join nation on s_nationkey = n_nationkey
     join region on n_regionkey = r_regionkey
group by all
"""

DENSE_SALES_SQL = f"""
select s.item_id, s.dept_id, s.cat_id, s.store_id, s.state_id, g.m,
       coalesce(f.sales, 0) as sales, coalesce(f.dollars, 0) as dollars
from (select distinct item_id, dept_id, cat_id, store_id, state_id from ({MONTHLY_SALES_SQL})) s
cross join (select unnest(range(1, (select max(m) + 1 from ({MONTHLY_SALES_SQL})))) as m) g
left join ({MONTHLY_SALES_SQL}) f
  on f.item_id = s.item_id and f.store_id = s.store_id and f.m = g.m
"""

TRAIN_END_SQL = f"(select max(m) - {HORIZON} from ({MONTHLY_SALES_SQL}))"
