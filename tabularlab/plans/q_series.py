"""Queries over the monthly series facts: hierarchy, windows, forecast, WRMSSE."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularlab.operators.hierarchy import SALES_LEVELS, level_aggregate, level_cardinality
from tabularlab.operators.metrics import tag_naive_split, wrmsse_tagged
from tabularlab.operators import series as S
from tabularlab.plans.catalog import register
from tabularlab.plans.facts import (DENSE_SALES_SQL, HORIZON, MONTHLY_SALES_SQL, TRAIN_END_SQL, dense_monthly_sales,
                                    monthly_sales)
from tabularlab.sources.tables import Tables


def _levels_sql(src: str, extra: list[str], measures: str) -> str:
    """UNION ALL of one GROUP BY per level (oracle form of GROUPING SETS)."""
    parts = []
    for level, cols in SALES_LEVELS.items():
        ident = "concat_ws(':', " + ", ".join([f"'{level}'", *cols]) + ")"
        grp = ", ".join([*extra, *cols]) or "()"
        sel_extra = "".join(f"{c}, " for c in extra)
        parts.append(f"select {level} as level, {ident} as id, {sel_extra}{measures} from {src} group by {grp}")
    return "\nunion all\n".join(parts)


# --- AG8: all 12 levels x month, units and dollars --------------------------------
@register("ag8_hierarchy_levels", f"""
with f as ({MONTHLY_SALES_SQL})
select level, id, m, sales, cast(dollars as double) as dollars from (
{_levels_sql('f', ['m'], 'cast(sum(sales) as bigint) as sales, sum(dollars) as dollars')}
) x
""")
def ag8_hierarchy_levels(spark, sf):
    f = monthly_sales(Tables(spark, sf))
    lv = level_aggregate(f, SALES_LEVELS, [F.sum("sales").cast("bigint").alias("sales"),
                                            F.sum("dollars").alias("dollars")], by=["m"])
    return lv.select("level", "id", "m", "sales", F.col("dollars").cast("double").alias("dollars"))


# --- AG9: series per level --------------------------------------------------------
@register("ag9_level_cardinality", f"""
with f as ({MONTHLY_SALES_SQL})
select level, count(*) as n_series from (
{_levels_sql('f', [], 'count(*) as n')}
) x group by level
""")
def ag9_level_cardinality(spark, sf):
    return level_cardinality(monthly_sales(Tables(spark, sf)), SALES_LEVELS)


# --- ML23: WRMSSE of the naive forecast (flagship) ---------------------------------
WRMSSE_SQL = f"""
with d as ({DENSE_SALES_SQL}),
tagged as (
  select item_id, dept_id, cat_id, store_id, state_id, m, sales, dollars, 't' as part from d where m <= {TRAIN_END_SQL}
  union all
  select item_id, dept_id, cat_id, store_id, state_id, m, sales, dollars, 'v' as part from d where m > {TRAIN_END_SQL} and m <= {TRAIN_END_SQL} + {HORIZON}
  union all
  select item_id, dept_id, cat_id, store_id, state_id, m + {HORIZON} as m, sales, null as dollars, 'p' as part
  from d where m > {TRAIN_END_SQL} - {HORIZON} and m <= {TRAIN_END_SQL}
),
lv as (
{_levels_sql('tagged', ['part', 'm'], 'sum(sales) as s, sum(dollars) as usd')}
),
sc as (
  select level, id, sum(cast(dd as double) * dd) as scale, count(s) as n
  from (select level, id, s, s - lag(s) over (partition by level, id order by m) as dd from lv where part = 't') x
  group by level, id
),
vp as (
  select level, id, m,
         sum(case when part = 'v' then s end) as sv, sum(case when part = 'p' then s end) as sp,
         sum(case when part = 'v' then usd end) as usd,
         count(case when part = 'v' then 1 end) as nv, count(case when part = 'p' then 1 end) as np
  from lv where part <> 't' group by level, id, m
),
err as (
  select level, id, sum(power(cast(sv as double) - sp, 2)) as sse,
         coalesce(sum(cast(usd as double)), 0) as dollars
  from vp where nv > 0 and np > 0 group by level, id
),
hh as (select count(distinct m) as h from vp where nv > 0),
tot as (select level, sum(dollars) as tot from err group by level),
s as (
  select e.level, e.dollars, c.scale, e.dollars / t.tot as weight,
         case when e.dollars = 0 then 0.0
              else sqrt((c.n - 1) * e.sse / ((select h from hh) * nullif(c.scale, 0))) end as rmsse
  from err e left join sc c on e.level = c.level and e.id = c.id join tot t on e.level = t.level
)
select round(sum(rmsse * weight) / count(distinct level), 6) as wrmsse,
       count(case when scale = 0 and dollars > 0 then 1 end) as zero_scale_series
from s
"""


def naive_forecast_wrmsse(spark, sf):
    dense, train_end = dense_monthly_sales(Tables(spark, sf))
    tagged = tag_naive_split(dense, "m", train_end, HORIZON)
    r = wrmsse_tagged(tagged, SALES_LEVELS, day="m")
    return r.select(F.round("wrmsse", 6).alias("wrmsse"), "zero_scale_series")


register("ml23_wrmsse_naive", WRMSSE_SQL)(naive_forecast_wrmsse)


# ================================================================ windows on facts

from tabularlab.operators import reshape as R  # noqa: E402
from tabularlab.operators.features import dollars_to_units  # noqa: E402
from tabularlab.plans.q_aggs import UNIT_CENTS_SQL, WEEKLY_PRICE_SQL, weekly_price  # noqa: E402

LEAF = ["item_id", "store_id"]


@register("wn1_neighbour_difference", """
select c_custkey, c_nationkey,
  round(abs(lead(c_acctbal) over w - c_acctbal) + abs(lag(c_acctbal) over w - c_acctbal), 6) as nbr_diff
from customer window w as (partition by c_nationkey order by c_acctbal, c_custkey)""")
def wn1(spark, sf):
    from tabularlab.operators.order import neighbour_values
    c = Tables(spark, sf).customer.select("c_custkey", "c_nationkey", "c_acctbal")
    # 25 nations: a per-nation window would sort each nation's customers in one task
    nb = neighbour_values(c, ["c_nationkey"], ["c_acctbal", "c_custkey"], "c_acctbal")
    d = F.abs(F.col("next_value") - F.col("c_acctbal")) + F.abs(F.col("prev_value") - F.col("c_acctbal"))
    return nb.select("c_custkey", "c_nationkey", F.round(d, 6).alias("nbr_diff"))


@register("wn2_first_difference", f"""
select item_id, store_id, m, sales - lag(sales) over (partition by item_id, store_id order by m) as diff
from ({DENSE_SALES_SQL})""")
def wn2(spark, sf):
    d, _ = dense_monthly_sales(Tables(spark, sf))
    return S.first_difference(d, LEAF, "m", "sales").select(*LEAF, "m", "diff")


@register("wn3_rows_at_group_max", """
select s_suppkey, s_nationkey, s_acctbal from supplier s
where s_acctbal = (select max(s_acctbal) from supplier x where x.s_nationkey = s.s_nationkey)""")
def wn3(spark, sf):
    s = Tables(spark, sf).supplier.select("s_suppkey", "s_nationkey", "s_acctbal")
    return S.rows_at_group_extreme(s, ["s_nationkey"], "s_acctbal", "max")


@register("wn4_last_n_per_group", """
select o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as o_date from (
  select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders)
where rn <= 2""")
def wn4(spark, sf):
    o = Tables(spark, sf).orders
    top = S.top_n_per_group(o, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 2)
    return top.select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_date"))


@register("wn5_group_broadcast", """
select s_suppkey, s_nationkey, round(avg(s_acctbal) over (partition by s_nationkey), 6) as nation_avg,
       max(s_acctbal) over (partition by s_nationkey) as nation_max from supplier""")
def wn5(spark, sf):
    s = Tables(spark, sf).supplier.select("s_suppkey", "s_nationkey", "s_acctbal")
    j = S.group_broadcast(s, ["s_nationkey"], {"nation_avg": F.avg("s_acctbal"), "nation_max": F.max("s_acctbal")})
    return j.select("s_suppkey", "s_nationkey", F.round("nation_avg", 6).alias("nation_avg"), "nation_max")


@register("wn6_launch_zero_months", f"""
with d as ({DENSE_SALES_SQL}),
l as (select item_id, store_id, min(case when sales > 0 then m end) as launch_period from d group by item_id, store_id)
select d.item_id, d.store_id, l.launch_period,
       count(*) filter (where d.m > l.launch_period and d.sales = 0) as zero_periods_after_launch
from d join l on d.item_id = l.item_id and d.store_id = l.store_id group by d.item_id, d.store_id, l.launch_period""")
def wn6(spark, sf):
    d = dense_monthly_sales(Tables(spark, sf))[0].select(*LEAF, "m", "sales")
    return S.launch_and_zero_periods(d, LEAF, "m", "sales")


@register("wn7_sporadic_series", f"""
with f as ({MONTHLY_SALES_SQL}),
a as (select item_id, store_id, sum(sales) / (max(m) - min(m) + 1) as avg_month from f group by item_id, store_id)
select f.item_id, f.store_id, count(*) filter (where f.sales > a.avg_month) as n_events
from f join a on f.item_id = a.item_id and f.store_id = a.store_id group by f.item_id, f.store_id""")
def wn7(spark, sf):
    f = monthly_sales(Tables(spark, sf)).select(*LEAF, "m", "sales")
    avg = S.lifetime_averages(f, LEAF, "m", "sales").select(*LEAF, "daily_avg")
    j = f.join(avg, LEAF)
    return j.groupBy(*LEAF).agg(F.count_if(F.col("sales") > F.col("daily_avg")).alias("n_events"))


@register("wn8_on_off_changes", f"""
with d as (select item_id, store_id, m, least(greatest(coalesce(cast(sales as double), 0), 0), 1) as ind from ({DENSE_SALES_SQL})),
x as (select item_id, store_id, ind - lag(ind) over (partition by item_id, store_id order by m) as dd from d)
select item_id, store_id, coalesce(sum(dd), 0) as net_change, coalesce(sum(abs(dd)), 0) as flips from x group by item_id, store_id""")
def wn8(spark, sf):
    d, _ = dense_monthly_sales(Tables(spark, sf))
    return S.on_off_changes(d, LEAF, "m", "sales")


@register("wn9_relative_index", f"""
select item_id, store_id, m, m - (select min(m) from ({MONTHLY_SALES_SQL})) as rel_m from ({MONTHLY_SALES_SQL})""")
def wn9(spark, sf):
    f = monthly_sales(Tables(spark, sf)).select(*LEAF, "m")
    return S.relative_index(f, "m", "rel_m")


@register("wn10_date_steps", """
with d as (select distinct cast(l_shipdate as date) as d from lineitem where l_shipdate is not null),
s as (select datediff('day', lag(d) over (order by d), d) as step_days from d)
select step_days, count(*) as n from s where step_days is not null group by step_days""")
def wn10(spark, sf):
    return S.step_distribution(Tables(spark, sf).lineitem, "l_shipdate")


@register("wn11_naive_forecast", f"""
select item_id, store_id, m + {HORIZON} as m, sales from ({DENSE_SALES_SQL})
where m > {TRAIN_END_SQL} - {HORIZON} and m <= {TRAIN_END_SQL}""")
def wn11(spark, sf):
    d, train_end = dense_monthly_sales(Tables(spark, sf))
    return S.naive_forecast(d, LEAF, "m", "sales", train_end, HORIZON)


@register("wn12_time_split", f"""
select case when m <= {TRAIN_END_SQL} then 'train' else 'valid' end as split, count(*) as n_rows, sum(sales)::bigint as units
from ({DENSE_SALES_SQL}) group by 1""")
def wn12(spark, sf):
    d, train_end = dense_monthly_sales(Tables(spark, sf))
    return d.groupBy(F.when(F.col("m") <= train_end, "train").otherwise("valid").alias("split")) \
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("sales").cast("bigint").alias("units"))


@register("wn12_last_n_rows", f"""
select item_id, store_id, m, sales from (
  select *, row_number() over (partition by item_id, store_id order by m desc) as r from ({DENSE_SALES_SQL}))
where r <= 3""")
def wn12n(spark, sf):
    d, _ = dense_monthly_sales(Tables(spark, sf))
    return S.top_n_per_group(d, LEAF, [F.col("m").desc()], 3).select(*LEAF, "m", "sales")


@register("wn13_lifetime_averages", f"""
select item_id, store_id, min(m) as first_day, max(m) as last_day, sum(sales)::bigint as total,
       max(m) - min(m) + 1 as days, round(sum(sales) / (max(m) - min(m) + 1), 6) as daily_avg,
       round(30 * sum(sales) / (max(m) - min(m) + 1), 6) as monthly_avg
from ({MONTHLY_SALES_SQL}) group by item_id, store_id""")
def wn13(spark, sf):
    f = monthly_sales(Tables(spark, sf)).select(*LEAF, "m", "sales")
    a = S.lifetime_averages(f, LEAF, "m", "sales")
    return a.select(*LEAF, "first_day", "last_day", F.col("total").cast("bigint").alias("total"), "days",
                    F.round("daily_avg", 6).alias("daily_avg"),
                    F.round(30 * F.col("total") / F.col("days"), 6).alias("monthly_avg"))


@register("wn15_densify", f"""
select item_id, store_id, m, sales, cast(dollars as double) as dollars from ({DENSE_SALES_SQL})""")
def wn15(spark, sf):
    d, _ = dense_monthly_sales(Tables(spark, sf))
    return d.select(*LEAF, "m", "sales", F.col("dollars").cast("double").alias("dollars"))


@register("wn16_last_price", f"""
with wp as ({WEEKLY_PRICE_SQL})
select wp_partkey, strftime(max(wp_week), '%Y-%m-%d') as last_week, arg_max(sell_price, wp_week) as last_price
from wp group by wp_partkey""")
def wn16(spark, sf):
    wp = weekly_price(Tables(spark, sf))
    return wp.groupBy("wp_partkey").agg(F.date_format(F.max("wp_week"), "yyyy-MM-dd").alias("last_week"),
                                        F.max_by("sell_price", "wp_week").alias("last_price"))


@register("ag26_successive_differences", f"""
with x as (select item_id, store_id, sales, sales - lag(sales) over (partition by item_id, store_id order by m) as dd
           from ({DENSE_SALES_SQL}))
select item_id, store_id, sum(dd * dd)::bigint as sum_sq_diff, sum(abs(dd))::bigint as sum_abs_diff, count(sales) as n
from x group by item_id, store_id""")
def ag26(spark, sf):
    d, _ = dense_monthly_sales(Tables(spark, sf))
    r = S.successive_difference_sums(d, LEAF, "m", "sales")
    return r.select(*LEAF, F.col("sum_sq_diff").cast("bigint").alias("sum_sq_diff"),
                    F.col("sum_abs_diff").cast("bigint").alias("sum_abs_diff"), "n")


@register("ag28_price_coverage", f"""
with wp as ({WEEKLY_PRICE_SQL}),
c as (select wp_partkey, count(distinct wp_week) as n_weeks, min(wp_week) as first_week, max(wp_week) as last_week
      from wp group by wp_partkey)
select wp_partkey, n_weeks, strftime(first_week, '%Y-%m-%d') as first_week, strftime(last_week, '%Y-%m-%d') as last_week,
       datediff('day', first_week, last_week) // 7 + 1 as span_weeks,
       n_weeks < datediff('day', first_week, last_week) // 7 + 1 as incomplete from c""")
def ag28(spark, sf):
    wp = weekly_price(Tables(spark, sf))
    c = wp.groupBy("wp_partkey").agg(F.countDistinct("wp_week").alias("n_weeks"), F.min("wp_week").alias("fw"),
                                     F.max("wp_week").alias("lw"))
    span = (F.datediff("lw", "fw") / 7).cast("bigint") + 1
    return c.select("wp_partkey", "n_weeks", F.date_format("fw", "yyyy-MM-dd").alias("first_week"),
                    F.date_format("lw", "yyyy-MM-dd").alias("last_week"), span.alias("span_weeks"),
                    (F.col("n_weeks") < span).alias("incomplete"))


@register("ag28_incomplete_coverage_share", f"""
with wp as ({WEEKLY_PRICE_SQL}),
c as (select wp_partkey, count(distinct wp_week) as n_weeks,
             datediff('day', min(wp_week), max(wp_week)) // 7 + 1 as span from wp group by wp_partkey)
select count(*) as n_parts, count(*) filter (where n_weeks < span) as n_incomplete,
       round(count(*) filter (where n_weeks < span) / count(*), 6) as incomplete_share from c""")
def ag28s(spark, sf):
    c = ag28(spark, sf)
    return c.agg(F.count(F.lit(1)).alias("n_parts"), F.count_if("incomplete").alias("n_incomplete"),
                 F.round(F.avg(F.col("incomplete").cast("double")), 6).alias("incomplete_share"))


# ================================================================ reshape

def yearly_wide(t: Tables):
    """Dollars per customer, one column per year between the first and the last order."""
    o = t.orders.withColumn("yr", F.year("o_orderdate"))
    low, high = o.agg(F.min("yr"), F.max("yr")).first()
    years = list(range(low, high + 1)) if low is not None else []
    p = o.groupBy("o_custkey").pivot("yr", years).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")))
    return p.select("o_custkey", *[F.col(str(y)).cast("double").alias(f"y{y}") for y in years]), years


YEARLY_SQL = """
with y as (select unnest(range(min(year(o_orderdate)), max(year(o_orderdate)) + 1)) as yr from orders),
c as (select distinct o_custkey from orders),
s as (select o_custkey, year(o_orderdate) as yr, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as value
      from orders where o_orderdate is not null group by all)
select c.o_custkey, y.yr, s.value from c cross join y left join s on s.o_custkey = c.o_custkey and s.yr = y.yr"""


@register("rs1_melt", f"select o_custkey, 'y' || yr as variable, value from ({YEARLY_SQL})")
def rs1(spark, sf):
    wide, years = yearly_wide(Tables(spark, sf))
    return R.melt(wide, ["o_custkey"], [f"y{y}" for y in years])


@register("rs2_melt_flags", f"select o_custkey, cast(value is not null as int) as flag, cast(yr as varchar) as state from ({YEARLY_SQL})")
def rs2(spark, sf):
    w, years = yearly_wide(Tables(spark, sf))
    flags = w.select("o_custkey", *[F.col(f"y{y}").isNotNull().cast("int").alias(f"active_{y}") for y in years])
    return R.melt_flags(flags, ["o_custkey"], [f"active_{y}" for y in years], "_", 2, "state", "flag")


VALID_STEPS = range(1, HORIZON + 1)


@register("rs3_pivot_wide", f"""
with d as ({DENSE_SALES_SQL}), x as (select {TRAIN_END_SQL} as train_end)
select item_id, store_id, """ + ", ".join(f"max(case when m = train_end + {i} then sales end) as F{i}" for i in VALID_STEPS) + """
from d, x where m > train_end group by item_id, store_id""")
def rs3(spark, sf):
    return valid_wide(Tables(spark, sf))[0]


def valid_wide(t: Tables):
    """Validation months as columns F1.., and the month each column stands for."""
    d, train_end = dense_monthly_sales(t)
    months = {train_end + i: f"F{i}" for i in VALID_STEPS}
    return R.pivot_wide(d.where(F.col("m") > train_end), LEAF, "m", "sales", months), months


def month_label(m: int) -> str:
    y, mo = divmod(m - 1, 12)
    return f"{1995 + y}-{mo + 1:02d}"


@register("rs4_relabel_round_trip", f"""
select item_id, store_id, strftime(make_date(1995 + (m - 1) // 12, (m - 1) % 12 + 1, 1), '%Y-%m') as month_label, sales
from ({DENSE_SALES_SQL}) where m > {TRAIN_END_SQL}""")
def rs4(spark, sf):
    wide, months = valid_wide(Tables(spark, sf))
    dated = R.relabel_columns(wide, {n: month_label(m) for m, n in months.items()})
    return R.melt(dated, LEAF, [month_label(m) for m in months], "month_label", "sales")


@register("rs5_name_lists", """
select name, count(*) as count from (
  select user_id, unnest(list_distinct(list(event_type)) || ['It''s ' || (user_id % 7), 'a "b"']) as name
  from events where event_type is not null group by user_id) group by name""")
def rs5(spark, sf):
    ev = Tables(spark, sf).events.where(F.col("event_type").isNotNull())
    # per user a Python-literal list of dicts, as the text column arrives in the source data:
    # either kind of quotes, apostrophes, None, True and entries without a name
    per_user = ev.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("_types"))
    entry = lambda x: F.concat(F.lit("{'id': None, 'name': '"), x, F.lit("', 'ok': True}"))
    own = F.concat(F.lit("{'name': \"It's "), F.col("user_id") % 7, F.lit("\"}, {'name': 'a \"b\"'}, {'id': 3}"))
    text = F.concat(F.lit("["), F.array_join(F.transform("_types", entry), ", "), F.lit(", "), own, F.lit("]"))
    parsed = per_user.select("user_id", R.parse_name_list(text).alias("names"))
    return R.explode_counts(parsed, "names")


@register("rs6_explode_mean", """
select name, round(avg(p_retailprice), 6) as mean_p_retailprice, count(*) as n from
  (select unnest(string_split(p_name, ' ')) as name, p_retailprice from part) group by name""")
def rs6(spark, sf):
    p = Tables(spark, sf).part.select(F.split("p_name", " ").alias("names"), "p_retailprice")
    return R.explode_mean(p, "names", "p_retailprice")


@register("rs7_one_hot", """
select o_orderkey, coalesce(cast(o_orderstatus = 'F' as int), 0) as o_orderstatus_F,
       coalesce(cast(o_orderstatus = 'O' as int), 0) as o_orderstatus_O,
       coalesce(cast(o_orderstatus = 'P' as int), 0) as o_orderstatus_P from orders""")
def rs7(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_orderstatus")
    return R.one_hot(o, "o_orderstatus", R.distinct_values(o, "o_orderstatus")).drop("o_orderstatus")


@register("rs7_one_hot_vector", """
select o_custkey, cast(dense_rank() over (order by o_custkey) - 1 as int) as position, cast(count(*) as double) as n
from orders group by o_custkey""")
def rs7v(spark, sf):
    """Customers as sparse indicator vectors, summed over all orders."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer
    rows, codes = R.one_hot_vector(Tables(spark, sf).orders.select("o_orderkey", "o_custkey"), "o_custkey", "v")
    total = rows.agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("s")).select(F.posexplode("s").alias("position", "n"))
    return total.join(codes, F.col("position") == F.col("code")).select(F.col("value").alias("o_custkey"), "position", "n")


@register("fe9_series_features", f"""
select item_id, store_id, m, ((m - 1) % 12) + 1 as month_of_year, cast(((m - 1) % 12) + 1 >= 10 as int) as q4_flag,
       cast(sales = 0 as int) as zero_flag,
       case when sales > 0 then ((2 * cast(dollars * 100 as bigint) + sales) // (2 * sales)) / 100.0 end as avg_price
from ({DENSE_SALES_SQL})""")
def fe9(spark, sf):
    d, _ = dense_monthly_sales(Tables(spark, sf))
    moy = F.pmod(F.col("m") - 1, F.lit(12)) + 1
    return d.select(*LEAF, "m", moy.alias("month_of_year"), (moy >= 10).cast("int").alias("q4_flag"),
                    (F.col("sales") == 0).cast("int").alias("zero_flag"),
                    F.when(F.col("sales") > 0, F.expr("(2 * cast(dollars * 100 as bigint) + sales) div (2 * sales)")
                           / 100.0).alias("avg_price"))


@register("fe10_dollars_to_units", f"""
with wp as ({WEEKLY_PRICE_SQL})
select l_orderkey, l_linenumber, coalesce(cast(trunc(l_extendedprice / wp.sell_price) as bigint), 0) as units
from lineitem left join wp on l_partkey = wp.wp_partkey
  and cast(date_trunc('week', l_shipdate) as date) - interval 7 day = wp.wp_week""")
def fe10(spark, sf):
    t = Tables(spark, sf)
    li = t.lineitem.withColumn("_prev_week", F.date_sub(F.to_date(F.date_trunc("week", "l_shipdate")), 7))
    wp = weekly_price(t)
    j = li.join(wp, (F.col("l_partkey") == F.col("wp_partkey")) & (F.col("_prev_week") == F.col("wp_week")), "left")
    return j.select("l_orderkey", "l_linenumber", dollars_to_units(F.col("l_extendedprice"), F.col("sell_price")).alias("units"))
