"""Aggregation queries (AG1-AG31) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularlab.plans.catalog import register
from tabularlab.sources.tables import Tables


def unit_price_cents(price: str, qty: str):
    """price / qty rounded half-up to whole cents, in exact integer arithmetic
    (rounding the double quotient would depend on its binary representation)."""
    q = F.col(qty).cast("bigint")
    return F.when(q > 0, F.expr(f"(2 * cast(round({price} * 100) as bigint) + cast({qty} as bigint)) "
                                f"div (2 * cast({qty} as bigint))"))


def weekly_price(t: Tables):
    """Weekly price table: per (part, week of ship date) the max unit price, rounded to cents."""
    return t.lineitem.groupBy(F.col("l_partkey").alias("wp_partkey"),
                              F.to_date(F.date_trunc("week", "l_shipdate")).alias("wp_week")) \
        .agg((F.max(unit_price_cents("l_extendedprice", "l_quantity")) / 100.0).alias("sell_price"))


# unit price in cents, DuckDB form
UNIT_CENTS_SQL = ("((2 * cast(round(l_extendedprice * 100) as bigint) + cast(l_quantity as bigint)) "
                  "// (2 * cast(l_quantity as bigint)))")


WEEKLY_PRICE_SQL = f"""
select l_partkey as wp_partkey, cast(date_trunc('week', l_shipdate) as date) as wp_week,
       max({UNIT_CENTS_SQL}) / 100.0 as sell_price from lineitem group by all"""


from tabularlab.operators import aggs as A  # noqa: E402
from tabularlab.operators import order as O  # noqa: E402
from tabularlab.operators.quantiles import exact_median  # noqa: E402

PRIORITIES = {"1-URGENT": "p_urgent", "2-HIGH": "p_high", "3-MEDIUM": "p_medium",
              "4-NOT SPECIFIED": "p_not_specified", "5-LOW": "p_low"}


@register("ag1_global_stats", """
select round(avg(c_acctbal), 6) as mean, round(stddev_samp(c_acctbal), 6) as std,
       min(c_acctbal) as min, max(c_acctbal) as max from customer""")
def ag1(spark, sf):
    return A.summary_stats(Tables(spark, sf).customer, "c_acctbal")


@register("ag2_group_stats", """
select o_orderstatus, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total,
       round(avg(o_totalprice), 6) as mean, max(o_totalprice) as max, min(o_totalprice) as min
from orders group by o_orderstatus""")
def ag2(spark, sf):
    o = Tables(spark, sf).orders
    return o.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"),
        F.round(F.avg("o_totalprice"), 6).alias("mean"), F.max("o_totalprice").alias("max"),
        F.min("o_totalprice").alias("min"))


@register("ag3_multi_agg", """
select l_returnflag, l_linestatus, cast(sum(l_quantity) as bigint) as sum_qty,
       cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as sum_price,
       round(avg(l_quantity), 6) as avg_qty, round(avg(l_discount), 6) as avg_disc,
       count(*) as count_order, max(l_shipdate) as last_ship, count(distinct l_suppkey) as n_suppliers
from lineitem group by l_returnflag, l_linestatus""")
def ag3(spark, sf):
    li = Tables(spark, sf).lineitem
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").cast("bigint").alias("sum_qty"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("sum_price"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count(F.lit(1)).alias("count_order"), F.max("l_shipdate").alias("last_ship"),
        F.countDistinct("l_suppkey").alias("n_suppliers"))


@register("ag4_distinct_counts", """
select count(distinct l_partkey) as n_parts, count(distinct l_suppkey) as n_suppliers,
       count(distinct l_orderkey) as n_orders, count(distinct (l_orderkey, l_linenumber)) as n_line_keys from lineitem""")
def ag4(spark, sf):
    li = Tables(spark, sf).lineitem
    return li.agg(F.countDistinct("l_partkey").alias("n_parts"), F.countDistinct("l_suppkey").alias("n_suppliers"),
                  F.countDistinct("l_orderkey").alias("n_orders"),
                  F.countDistinct("l_orderkey", "l_linenumber").alias("n_line_keys"))


@register("ag5_value_counts", """
select o_orderpriority, count(*) as count, round(count(*) / (select count(*) from orders where o_orderpriority is not null), 6) as share
from orders where o_orderpriority is not null group by o_orderpriority""")
def ag5(spark, sf):
    return A.value_counts(Tables(spark, sf).orders, "o_orderpriority")


@register("ag5_value_counts_top", """
select o_custkey, count(*) as count, round(count(*) / (select count(*) from orders), 6) as share
from orders group by o_custkey order by count desc, o_custkey limit 5""")
def ag5t(spark, sf):
    return A.value_counts(Tables(spark, sf).orders, "o_custkey", top=5)


@register("ag6_stacked_value_counts", """
select value, count(*) as count from (select l_returnflag as value from lineitem union all select l_linestatus from lineitem)
where value is not null group by value""")
def ag6(spark, sf):
    return A.stacked_value_counts(Tables(spark, sf).lineitem, ["l_returnflag", "l_linestatus"])


@register("ag7_count_of_counts", """
select group_size, count(*) as n_groups from (select l_orderkey, count(*) as group_size from lineitem group by l_orderkey)
group by group_size""")
def ag7(spark, sf):
    return A.count_of_counts(Tables(spark, sf).lineitem, ["l_orderkey"])


@register("ag7_min_group_size", """
select min(n) as min_group_size, max(n) as max_group_size, count(*) as n_groups
from (select l_orderkey, count(*) as n from lineitem group by l_orderkey)""")
def ag7m(spark, sf):
    c = A.count_of_counts(Tables(spark, sf).lineitem, ["l_orderkey"])
    return c.agg(F.min("group_size").alias("min_group_size"), F.max("group_size").alias("max_group_size"),
                 F.sum("n_groups").alias("n_groups"))


_DL = "documents d join labels l on d.doc_id = l.doc_id"


@register("ag10_pivot_summary", f"""
select lang, stat, value from (
  select lang, 'mean' as stat, round(avg(quality), 6) as value from {_DL} group by lang
  union all select lang, 'count', cast(count(quality) as double) from {_DL} group by lang
  union all select lang, 'sum', cast(sum(quality) as double) from {_DL} group by lang)""")
def ag10(spark, sf):
    t = Tables(spark, sf)
    j = t.documents.join(t.labels, "doc_id")
    return A.pivot_summary(j, "lang", "quality")


@register("ag11_crosstab", """
select o_orderstatus, """ + ", ".join(f"count(*) filter (where o_orderpriority = '{v}') as {n}" for v, n in PRIORITIES.items()) + """
from orders group by o_orderstatus
having count(*) filter (where o_orderpriority = '1-URGENT') > 0 and count(*) filter (where o_orderpriority = '5-LOW') > 0""")
def ag11(spark, sf):
    orders = Tables(spark, sf).orders
    named = orders.withColumn("p", F.replace(F.lower(F.substring_index("o_orderpriority", "-", -1)), F.lit(" "), F.lit("_")))
    ct = A.crosstab(named, "o_orderstatus", "p")          # the priorities that occur
    return ct.where((F.col("p_urgent") > 0) & (F.col("p_low") > 0))


@register("ag12_group_median", """
select o_orderstatus, round(median(o_totalprice), 6) as median from orders group by o_orderstatus""")
def ag12(spark, sf):
    m = exact_median(Tables(spark, sf).orders, ["o_orderstatus"], "o_totalprice")
    return m.withColumn("median", F.round("median", 6))


@register("ag13_describe", """
select * from (""" + " union all ".join(f"""
  select '{c}' as column, count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std,
         min({c})::double as min, round(quantile_cont({c}, 0.25), 6) as p25, round(quantile_cont({c}, 0.5), 6) as p50,
         round(quantile_cont({c}, 0.75), 6) as p75, max({c})::double as max from lineitem"""
                                        for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]) + ")")
def ag13(spark, sf):
    return A.describe_numeric(Tables(spark, sf).lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@register("ag14_describe_categorical", """
with c as (select p_brand, count(*) as n from part where p_brand is not null group by p_brand)
select (select sum(n) from c)::bigint as count, (select count(*) from c) as unique,
       (select p_brand from c order by n desc, p_brand limit 1) as top, (select max(n) from c) as freq""")
def ag14(spark, sf):
    return A.describe_categorical(Tables(spark, sf).part, "p_brand")


@register("ag15_minmax_table", """
select 'p_size' as column, min(p_size)::double as min, max(p_size)::double as max from part
union all select 'p_retailprice', min(p_retailprice), max(p_retailprice) from part""")
def ag15(spark, sf):
    return A.minmax_table(Tables(spark, sf).part, ["p_size", "p_retailprice"])


@register("ag16_extreme_row", """
(select 'largest' as kind, s_suppkey, s_name, s_acctbal from supplier order by s_acctbal desc, s_suppkey limit 1)
union all
(select 'smallest', s_suppkey, s_name, s_acctbal from supplier order by s_acctbal, s_suppkey limit 1)""")
def ag16(spark, sf):
    return A.extreme_rows(Tables(spark, sf).supplier, "s_acctbal", "s_suppkey", ["s_suppkey", "s_name", "s_acctbal"])


CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CORR_SQL = " union all ".join(
    f"select '{a}' as col_a, '{b}' as col_b, round(corr({a}, {b}), 6) as corr from lineitem"
    for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i:])


@register("ag17_correlation_matrix", CORR_SQL)
def ag17(spark, sf):
    return A.correlation_matrix(Tables(spark, sf).lineitem, CORR_COLS)


@register("ag18_target_correlation", """
select 'all' as subset, round(corr(p_size, p_retailprice), 6) as corr from part
union all select 'top100', round(corr(p_size, p_retailprice), 6) from
  (select * from part order by p_retailprice desc, p_partkey limit 100)
union all select 'bottom100', round(corr(p_size, p_retailprice), 6) from
  (select * from part order by p_retailprice, p_partkey limit 100)
union all select 'top_minus_bottom', round(
  (select corr(p_size, p_retailprice) from (select * from part order by p_retailprice desc, p_partkey limit 100))
  - (select corr(p_size, p_retailprice) from (select * from part order by p_retailprice, p_partkey limit 100)), 6)""")
def ag18(spark, sf):
    p = Tables(spark, sf).part
    corr = lambda df: df.agg(A.correlation("p_size", "p_retailprice").alias("c"))
    top = corr(O.top_k(p, [F.col("p_retailprice").desc(), "p_partkey"], 100)).scalar()
    bottom = corr(O.top_k(p, ["p_retailprice", "p_partkey"], 100)).scalar()
    one = corr(p).select(F.col("c").alias("all"), top.alias("top100"), bottom.alias("bottom100"), (top - bottom).alias("top_minus_bottom"))
    return one.unpivot([], one.columns, "subset", "c").select("subset", F.round("c", 6).alias("corr"))


@register("ag19_strongest_pairs", f"""
with c as ({CORR_SQL})
(select col_a, col_b, corr, 'positive' as kind from c where col_a < col_b order by corr desc, col_a, col_b limit 1)
union all
(select col_a, col_b, corr, 'negative' from c where col_a < col_b order by corr asc, col_a, col_b limit 1)""")
def ag19(spark, sf):
    return A.strongest_pairs(A.correlation_matrix(Tables(spark, sf).lineitem, CORR_COLS))


HIST_SQL = """
with mm as (select min(o_totalprice) as mn, max(o_totalprice) as mx from orders),
b as (select least(floor((o_totalprice - mn) / ((mx - mn) / 10)) + 1, 10)::int as bin from orders, mm where o_totalprice is not null)
select bin, round(mn + (bin - 1) * ((mx - mn) / 10), 6) as lo, round(mn + bin * ((mx - mn) / 10), 6) as hi, count(*) as count
from b, mm group by bin, mn, mx"""


@register("ag20_histogram", HIST_SQL)
def ag20(spark, sf):
    h = A.histogram(Tables(spark, sf).orders, "o_totalprice", 10)
    return h.withColumn("lo", F.round("lo", 6)).withColumn("hi", F.round("hi", 6))


@register("ag21_tallest_bin", f"""
with h as ({HIST_SQL})
select bin, count, (select cast(floor(100.0 * sum(count) filter (where bin <= 3) / sum(count) / 5) * 5 as int) from h) as low_share_pct5
from h order by count desc, bin limit 1""")
def ag21(spark, sf):
    h = A.histogram(Tables(spark, sf).orders, "o_totalprice", 10)
    low = F.floor(100.0 * F.sum(F.when(F.col("bin") <= 3, F.col("count"))) / F.sum("count") / 5) * 5
    top = F.min_by(F.struct("bin", "count"), F.struct(-F.col("count"), F.col("bin")))
    return h.agg(top.alias("top"), low.cast("int").alias("low_share_pct5")).select("top.bin", "top.count", "low_share_pct5")


@register("ag22_conditional_ratio", """
select count(*) filter (where l_discount > 0.05) as n_true, count(*) as n_rows,
       round(avg(cast(l_discount > 0.05 as double)), 6) as ratio from lineitem""")
def ag22(spark, sf):
    return A.conditional_count(Tables(spark, sf).lineitem, F.col("l_discount") > 0.05)


@register("ag23_two_sample_categories", """
with s as (select case when o_orderkey % 5 = 0 then 'test' else 'train' end as src, o_orderpriority from orders),
f as (select src, o_orderpriority, count(*) / sum(count(*)) over (partition by src) as freq from s group by src, o_orderpriority)
select coalesce(a.o_orderpriority, b.o_orderpriority) as o_orderpriority, round(a.freq, 6) as train_freq, round(b.freq, 6) as test_freq
from (select * from f where src = 'train') a full outer join (select * from f where src = 'test') b
  on a.o_orderpriority = b.o_orderpriority""")
def ag23(spark, sf):
    o = Tables(spark, sf).orders.withColumn("src", F.when(F.col("o_orderkey") % 5 == 0, "test").otherwise("train"))
    return two_sample_categories(o, "src", "o_orderpriority", "train", "test")


def two_sample_categories(df, src, col, a, b):
    """AG23: relative frequency of each category in two samples, side by side.
    One pass counts both samples per category; that table (one row per
    category) is written once and also yields the two sample sizes."""
    from tabularlab.session import materialize
    counts = materialize(df.groupBy(col).agg(F.count_if(F.col(src) == a).alias("_na"),
                                             F.count_if(F.col(src) == b).alias("_nb")), "two-sample")
    tot_a = counts.agg(F.sum("_na")).scalar()
    tot_b = counts.agg(F.sum("_nb")).scalar()
    # a category absent from one sample has no frequency there (full outer join semantics)
    return counts.select(col, F.when(F.col("_na") > 0, F.round(F.col("_na") / tot_a, 6)).alias(f"{a}_freq"),
                         F.when(F.col("_nb") > 0, F.round(F.col("_nb") / tot_b, 6)).alias(f"{b}_freq"))


@register("ag24_two_sample_qbins", """
with s as (select case when o_orderkey % 5 = 0 then 'test' else 'train' end as src, o_totalprice from orders),
e as (select quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) as q from orders),
b as (select src, case when o_totalprice <= q[1] then 1 when o_totalprice <= q[2] then 2 when o_totalprice <= q[3] then 3
                        when o_totalprice <= q[4] then 4 else 5 end as bin from s, e)
select src, bin, count(*) as n, round(count(*) / sum(count(*)) over (partition by src), 6) as share from b group by src, bin""")
def ag24(spark, sf):
    from tabularlab.operators.features import quantile_bins
    o = Tables(spark, sf).orders.withColumn("src", F.when(F.col("o_orderkey") % 5 == 0, "test").otherwise("train"))
    binned = quantile_bins(o, "o_totalprice", 5, "bin")
    counts = binned.groupBy("src", "bin").agg(F.count(F.lit(1)).alias("n"))
    tot = binned.groupBy("src").agg(F.count(F.lit(1)).alias("_t"))
    return counts.join(F.broadcast(tot), "src").select("src", "bin", "n", F.round(F.col("n") / F.col("_t"), 6).alias("share"))


@register("ag25_share_of_total", """
select l_orderkey, l_linenumber, round(l_extendedprice / sum(l_extendedprice) over (partition by l_orderkey), 6) as share
from lineitem""")
def ag25(spark, sf):
    li = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return A.share_of_total(li, ["l_orderkey"], "l_extendedprice").drop("l_extendedprice")


@register("ag27_single_value_check", """
select count(*) as n_groups, max(nd) as max_distinct from (select n_name, count(distinct n_regionkey) as nd from nation group by n_name)""")
def ag27(spark, sf):
    return A.assert_single_value(Tables(spark, sf).nation, ["n_name"], "n_regionkey")


@register("ag29_confusion_matrix", """
select l.quality as quality, count(*) filter (where d.n_chars > 1000) as pred_1, count(*) filter (where d.n_chars <= 1000) as pred_0
from documents d join labels l on d.doc_id = l.doc_id group by l.quality""")
def ag29(spark, sf):
    t = Tables(spark, sf)
    j = t.documents.join(t.labels, "doc_id").withColumn("pred", (F.col("n_chars") > 1000).cast("int"))
    return A.confusion_matrix(j, "quality", "pred", [1, 0])


@register("ag29_confusion_normalised", """
select l.quality as quality, round(count(*) filter (where d.n_chars > 1000) / count(*), 6) as pred_1,
       round(count(*) filter (where d.n_chars <= 1000) / count(*), 6) as pred_0
from documents d join labels l on d.doc_id = l.doc_id group by l.quality""")
def ag29n(spark, sf):
    t = Tables(spark, sf)
    j = t.documents.join(t.labels, "doc_id").withColumn("pred", (F.col("n_chars") > 1000).cast("int"))
    return A.confusion_matrix(j, "quality", "pred", [1, 0], normalize=True)


@register("ag30_daily_counts", """
select strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by 1""")
def ag30(spark, sf):
    ev = Tables(spark, sf).events
    return ev.groupBy(F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@register("ag4_approx_distinct")
def ag4a(spark, sf):
    """HyperLogLog++ estimates (rows / invariants only: estimates are not exact)."""
    return A.distinct_counts(Tables(spark, sf).lineitem, ["l_partkey", "l_suppkey", "l_orderkey"], approx=True)


@register("ag4_stored_sketches")
def ag4s(spark, sf):
    """Sketches per ship year, written once; distinct orders and parts per half decade from the sketches alone."""
    from tabularlab.session import materialize
    li = Tables(spark, sf).lineitem.withColumn("ship_year", F.year("l_shipdate"))
    stored = materialize(A.distinct_sketches(li, ["ship_year"], ["l_orderkey", "l_partkey"]), "sketches")
    return A.merged_distinct(stored.withColumn("since", (F.col("ship_year") - F.col("ship_year") % 5)), ["l_orderkey", "l_partkey"], ["since"])
