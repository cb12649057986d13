"""Relational queries: projections, cleaning, scalar functions, joins, sets, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularlab.functions import strings as SF
from tabularlab.operators import clean as C
from tabularlab.operators import joins as J
from tabularlab.operators import order as O
from tabularlab.operators import sets as ST
from tabularlab.operators.series import group_broadcast
from tabularlab.plans.catalog import register
from tabularlab.plans.q_aggs import WEEKLY_PRICE_SQL
from tabularlab.sources.tables import Tables

# ---------------------------------------------------------------- projections


@register("prj1_projection", "select l_orderkey, l_partkey, l_extendedprice from lineitem")
def prj1(spark, sf):
    return C.select_columns(Tables(spark, sf).lineitem, pattern=r"key$|price$", exclude=["l_suppkey"])


@register("prj2_filter", """
select l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag from lineitem
where l_quantity between 10 and 20 and (l_returnflag = 'R' or l_discount >= 0.05)
  and l_shipdate < timestamp '1997-01-01'""")
def prj2(spark, sf):
    li = Tables(spark, sf).lineitem
    return li.where(F.col("l_quantity").between(10, 20)
                    & ((F.col("l_returnflag") == "R") | (F.col("l_discount") >= 0.05))
                    & (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz"))) \
        .select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")


@register("prj3_membership", """
select n_nationkey, n_name from nation where n_name in ('NATION_1', 'NATION_7', 'NATION_19', 'NOWHERE')""")
def prj3(spark, sf):
    return C.keep_members(Tables(spark, sf).nation, "n_name",
                          ["NATION_1", "NATION_7", "NATION_19", "NOWHERE"]).select("n_nationkey", "n_name")


@register("prj4_key_range", "select p_partkey, p_name from part where p_name between 'green' and 'red bolt'")
def prj4(spark, sf):
    return Tables(spark, sf).part.where(F.col("p_name").between("green", "red bolt")).select("p_partkey", "p_name")


@register("prj5_derived", """
select l_orderkey, l_linenumber,
       l_extendedprice * (1 - l_discount) as disc_price,
       l_extendedprice * (1 - l_discount) * (1 + l_tax) as charge,
       l_extendedprice / l_quantity as unit_price,
       round(100.0 * (l_extendedprice * (1 - l_discount) - l_extendedprice) / l_extendedprice, 6) as pct_diff
from lineitem""")
def prj5(spark, sf):
    li = Tables(spark, sf).lineitem
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.select("l_orderkey", "l_linenumber",
                     disc.alias("disc_price"),
                     (disc * (1 + F.col("l_tax"))).alias("charge"),
                     F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit_price"),
                     F.round(F.try_divide(100.0 * (disc - F.col("l_extendedprice")), F.col("l_extendedprice")), 6)
                     .alias("pct_diff"))


@register("prj6_coerce", """
select event_id, try_cast(case when regexp_matches(trim(json_extract_string(props, '$.k')), '^[0-9]+$')
                          then trim(json_extract_string(props, '$.k')) end as bigint) as k
from events""")
def prj6(spark, sf):
    ev = Tables(spark, sf).events.select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return C.coerce_numeric(ev, "k", digits_only=True)


@register("prj7_conditional_overwrite", """
select o_orderkey, case when o_orderstatus = 'P' then 0.0 else o_totalprice end as o_totalprice from orders""")
def prj7(spark, sf):
    o = Tables(spark, sf).orders
    return o.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.lit(0.0))
                    .otherwise(F.col("o_totalprice")).alias("o_totalprice"))


PATCH = {"NATION_1": "United States", "NATION_3": "United Kingdom", "NATION_12": "Korea, Republic of"}


@register("prj8_value_patch", """
select n_nationkey, case n_name when 'NATION_1' then 'United States' when 'NATION_3' then 'United Kingdom'
       when 'NATION_12' then 'Korea, Republic of' else n_name end as n_name from nation""")
def prj8(spark, sf):
    return C.patch_values(Tables(spark, sf).nation, "n_name", PATCH).select("n_nationkey", "n_name")


@register("prj9_dictionary_map", """
select l_orderkey, l_linenumber, l_returnflag,
       case l_returnflag when 'A' then 'accepted' when 'R' then 'returned' end as flag_name from lineitem""")
def prj9(spark, sf):
    return C.map_values(Tables(spark, sf).lineitem, "l_returnflag", {"A": "accepted", "R": "returned"},
                        "flag_name").select("l_orderkey", "l_linenumber", "l_returnflag", "flag_name")


@register("prj10_null_indicator", """
select c_custkey, cast(n_orders is null as int) as n_orders_na, coalesce(n_orders, 0) as n_orders
from customer left join (select o_custkey, count(*) as n_orders from orders group by o_custkey) o
  on c_custkey = o_custkey""")
def prj10(spark, sf):
    t = Tables(spark, sf)
    o = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    j = t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    j = C.null_indicators(j, ["n_orders"])
    return j.select("c_custkey", "n_orders_na", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


_OL = "orders left join lineitem on o_orderkey = l_orderkey"


@register("prj11_fill_nulls", f"""
select o_orderkey, coalesce(l_quantity, 0.0) as l_quantity, coalesce(l_returnflag, 'none') as l_returnflag from {_OL}""")
def prj11(spark, sf):
    t = Tables(spark, sf)
    j = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", "l_quantity", "l_returnflag").fillna({"l_quantity": 0.0, "l_returnflag": "none"})


@register("prj12_drop_null_rows", f"select o_orderkey, l_linenumber, l_quantity from {_OL} where l_linenumber is not null and l_quantity is not null")
def prj12(spark, sf):
    t = Tables(spark, sf)
    j = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", "l_linenumber", "l_quantity").dropna(how="any")


@register("prj13_null_profile", f"""
select * from (
  select 'o_orderkey' as column, count(*) - count(o_orderkey) as n_null, count(*) as n_rows from {_OL}
  union all select 'o_orderstatus', count(*) - count(o_orderstatus), count(*) from {_OL}
  union all select 'l_orderkey', count(*) - count(l_orderkey), count(*) from {_OL}
  union all select 'l_quantity', count(*) - count(l_quantity), count(*) from {_OL}
  union all select 'l_shipdate', count(*) - count(l_shipdate), count(*) from {_OL})""")
def prj13(spark, sf):
    t = Tables(spark, sf)
    j = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left") \
        .select("o_orderkey", "o_orderstatus", "l_orderkey", "l_quantity", "l_shipdate")
    return C.null_profile(j)


@register("prj14_flat_names", """
select l_returnflag, sum(l_quantity) as l_quantity_sum, round(avg(l_quantity), 6) as l_quantity_mean,
       min(l_extendedprice) as l_extendedprice_min, max(l_extendedprice) as l_extendedprice_max
from lineitem group by l_returnflag""")
def prj14(spark, sf):
    g = C.flatten_agg_names(Tables(spark, sf).lineitem, ["l_returnflag"],
                            {"l_quantity": ["sum", "mean"], "l_extendedprice": ["min", "max"]})
    return g.withColumn("l_quantity_mean", F.round("l_quantity_mean", 6))


@register("prj15_record_transpose", """
select field, value from (
  select 'c_custkey' as field, cast(c_custkey as varchar) as value from customer where c_custkey = 7
  union all select 'c_name', c_name from customer where c_custkey = 7
  union all select 'c_nationkey', cast(c_nationkey as varchar) from customer where c_custkey = 7
  union all select 'c_mktsegment', c_mktsegment from customer where c_custkey = 7)""")
def prj15(spark, sf):
    c = Tables(spark, sf).customer.where(F.col("c_custkey") == 7)
    return C.record_transpose(c, ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


@register("prj16_clip_renormalise", """
with c as (select vec_id, list_transform(embedding, lambda x: least(greatest(abs(x::double), 0.05), 0.95)) as c from embeddings),
t as (select vec_id, c, list_sum(c) as total from c)
select vec_id, cast(i as int) as i, round(c[i] / total, 6) as p from t, unnest(range(1, len(c) + 1)) as x(i)""")
def prj16(spark, sf):
    probs = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    r = Tables(spark, sf).embeddings.select("vec_id", F.posexplode(C.clip_renormalise(probs, 0.95)).alias("i", "p"))
    return r.select("vec_id", (F.col("i") + 1).alias("i"), F.round("p", 6).alias("p"))


@register("prj17_powers", """
select p_partkey, power(p_size, 2) as p_size_pow_2, power(p_size, 3) as p_size_pow_3 from part""")
def prj17(spark, sf):
    return C.power_columns(Tables(spark, sf).part.select("p_partkey", "p_size"), "p_size", [2, 3]).drop("p_size")


@register("prj18_schema_profile", """
select column_name as column, data_type, cast(pos as int) as position, n_rows from (
  select 'l_orderkey' as column_name, 'bigint' as data_type, 0 as pos union all
  select 'l_partkey', 'bigint', 1 union all select 'l_suppkey', 'bigint', 2 union all
  select 'l_linenumber', 'int', 3 union all select 'l_quantity', 'double', 4 union all
  select 'l_extendedprice', 'double', 5 union all select 'l_discount', 'double', 6 union all
  select 'l_tax', 'double', 7 union all select 'l_returnflag', 'string', 8 union all
  select 'l_linestatus', 'string', 9 union all select 'l_shipdate', 'timestamp_ntz', 10) s,
  (select count(*) as n_rows from lineitem)""")
def prj18(spark, sf):
    return C.schema_profile(Tables(spark, sf).lineitem)


@register("prj19_point_lookup", """
select p.p_partkey, p.p_name, p.p_retailprice, (select count(*) from lineitem where l_partkey = 42) as n_lines
from part p where p.p_partkey = 42""")
def prj19(spark, sf):
    t = Tables(spark, sf)
    n = t.lineitem.where(F.col("l_partkey") == 42).agg(F.count(F.lit(1))).scalar()
    return t.part.where(F.col("p_partkey") == 42).select("p_partkey", "p_name", "p_retailprice", n.alias("n_lines"))


# ---------------------------------------------------------------- scalar functions


@register("sc1_split_part", """
select p_partkey, split_part(p_name, ' ', 1) as first_word, nullif(split_part(p_name, ' ', 2), '') as second_word,
       cast(split_part(p_brand, '#', 2) as int) as brand_no from part""")
def sc1(spark, sf):
    p = Tables(spark, sf).part
    return p.select("p_partkey", SF.word(F.col("p_name"), " ", 1).alias("first_word"),
                    F.nullif(SF.word(F.col("p_name"), " ", 2), F.lit("")).alias("second_word"),
                    SF.word(F.col("p_brand"), "#", 2).try_cast("int").alias("brand_no"))


URL_RX = r"^(https?)://([^/]+)/([a-z]{2})/([0-9]+)"


@register("sc2_regex_groups", f"""
select page_id,
  nullif(regexp_extract(url, '{URL_RX}', 1), '') as scheme,
  nullif(regexp_extract(url, '{URL_RX}', 2), '') as host,
  nullif(regexp_extract(url, '{URL_RX}', 3), '') as lang,
  try_cast(nullif(regexp_extract(url, '{URL_RX}', 4), '') as bigint) as doc_no
from pages""")
def sc2(spark, sf):
    p = Tables(spark, sf).pages
    parts = SF.extract_groups(F.col("url"), URL_RX, ["scheme", "host", "lang", "doc_no"])
    return p.select("page_id", *parts[:3], parts[3].try_cast("bigint").alias("doc_no"))


URL_CLASSES = [("mobile", r"https?://m\."), ("secure", r"https://"), ("plain", r"http://")]


@register("sc3_first_pattern", r"""
select page_id, case when regexp_matches(url, '^(?:https?://m\.)') then 'mobile'
                     when regexp_matches(url, '^(?:https://)') then 'secure'
                     when regexp_matches(url, '^(?:http://)') then 'plain' else '-' end as url_class
from pages""")
def sc3(spark, sf):
    return Tables(spark, sf).pages.select("page_id", SF.first_match(F.col("url"), URL_CLASSES).alias("url_class"))


@register("sc4_string_tests", """
select doc_id, contains(text, 'the') as has_the, starts_with(lower(text), 'the') as starts_the,
       length(text) as n_chars, length(trim(text)) as n_trimmed,
       regexp_matches(source, '^src[0-9]+$') as source_is_code, lower(lang) as lang
from documents""")
def sc4(spark, sf):
    d = Tables(spark, sf).documents
    return d.select("doc_id", F.col("text").contains("the").alias("has_the"),
                    F.lower("text").startswith("the").alias("starts_the"),
                    F.length("text").cast("bigint").alias("n_chars"),
                    F.length(F.trim("text")).cast("bigint").alias("n_trimmed"),
                    F.col("source").rlike("^src[0-9]+$").alias("source_is_code"), F.lower("lang").alias("lang"))


@register("sc5_substring_count", """
select doc_id, cast((length(text) - length(replace(text, ' the ', ''))) / 5 as bigint) as n_the from documents""")
def sc5(spark, sf):
    d = Tables(spark, sf).documents
    return d.select("doc_id", SF.count_literal(F.col("text"), " the ").cast("bigint").alias("n_the"))


@register("sc6_key_concat", """
select p_partkey, concat_ws(':', p_type, p_brand, cast(p_size as varchar)) as key_ws,
       p_type || '_' || p_brand || '_' || case when p_size > 25 then 'big' end as key_strict from part""")
def sc6(spark, sf):
    p = Tables(spark, sf).part
    return p.select("p_partkey", F.concat_ws(":", "p_type", "p_brand", F.col("p_size").cast("string")).alias("key_ws"),
                    F.concat("p_type", F.lit("_"), "p_brand", F.lit("_"),
                             F.when(F.col("p_size") > 25, F.lit("big"))).alias("key_strict"))


@register("sc7_dates", """
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as o_date, year(o_orderdate) as yr, month(o_orderdate) as mon,
       (year(o_orderdate) - 1995) * 12 + month(o_orderdate) as month_index,
       strftime(cast(o_orderdate as date) + interval 28 day, '%Y-%m-%d') as due_date,
       datediff('day', date '1995-01-01', cast(o_orderdate as date)) as day_no,
       strftime(o_orderdate, '%d/%m/%Y') as date_str,
       strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') as week_start
from orders""")
def sc7(spark, sf):
    o = Tables(spark, sf).orders
    d = F.to_date("o_orderdate")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")  # noqa: E731 - dates leave as ISO text
    return o.select("o_orderkey", iso(d).alias("o_date"), F.year(d).cast("bigint").alias("yr"),
                    F.month(d).cast("bigint").alias("mon"),
                    ((F.year(d) - 1995) * 12 + F.month(d)).cast("bigint").alias("month_index"),
                    iso(F.date_add(d, 28)).alias("due_date"),
                    F.datediff(d, F.lit("1995-01-01").cast("date")).cast("bigint").alias("day_no"),
                    F.date_format(d, "dd/MM/yyyy").alias("date_str"),
                    iso(F.date_trunc("week", "o_orderdate")).alias("week_start"))


@register("sc7_biweekly_ticks", """
with r as (select cast(min(o_orderdate) as date) as lo, cast(max(o_orderdate) as date) as hi from orders),
t as (select unnest(generate_series(lo, hi, interval 14 day)) as tick from r)
select strftime(tick, '%Y-%m-%d') as tick from t""")
def sc7t(spark, sf):
    o = Tables(spark, sf).orders
    r = o.agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    ticks = r.select(F.explode(F.sequence("lo", "hi", F.expr("interval 2 weeks"))).alias("tick"))
    return ticks.select(F.date_format("tick", "yyyy-MM-dd").alias("tick"))


@register("sc8_math", """
select l_orderkey, l_linenumber, abs(l_discount - 0.05) as abs_dev, power(l_quantity, 2) as qty_sq,
       round(sqrt(l_extendedprice), 6) as sqrt_price, round(l_extendedprice / 7, 2) as r2,
       cast(trunc(l_extendedprice / 1000) as bigint) as thousands,
       cast(floor(l_quantity / 5) * 5 as bigint) as qty_floor5,
       round(1 / (1 + exp(-(l_discount * 10 - 0.5))), 6) as logistic,
       round(exp(l_tax), 6) as exp_tax
from lineitem""")
def sc8(spark, sf):
    li = Tables(spark, sf).lineitem
    return li.select("l_orderkey", "l_linenumber",
                     F.abs(F.col("l_discount") - 0.05).alias("abs_dev"),
                     F.pow("l_quantity", 2).alias("qty_sq"),
                     F.round(F.sqrt("l_extendedprice"), 6).alias("sqrt_price"),
                     F.round(F.col("l_extendedprice") / 7, 2).alias("r2"),
                     (F.col("l_extendedprice") / 1000).cast("bigint").alias("thousands"),
                     (F.floor(F.col("l_quantity") / 5) * 5).cast("bigint").alias("qty_floor5"),
                     F.round(1 / (1 + F.exp(-(F.col("l_discount") * 10 - 0.5))), 6).alias("logistic"),
                     F.round(F.exp("l_tax"), 6).alias("exp_tax"))


@register("sc9_arrays", """
with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings)
select vec_id, list_position(v, list_max(v)) as argmax, round(v[1] * 0.299 + v[2] * 0.587 + v[3] * 0.114, 6) as grey,
       round(list_sum(v[1:4]), 6) as head_sum, len(v) as dim from e""")
def sc9(spark, sf):
    e = Tables(spark, sf).embeddings
    v = F.transform("embedding", lambda x: x.cast("double"))
    from tabularlab.functions.arrays import argmax, weighted_dot
    return e.select("vec_id", argmax(v).alias("argmax"),
                    F.round(weighted_dot(F.slice(v, 1, 3), [0.299, 0.587, 0.114]), 6).alias("grey"),
                    F.round(F.aggregate(F.slice(v, 1, 4), F.lit(0.0), lambda a, x: a + x), 6).alias("head_sum"),
                    F.size(v).cast("bigint").alias("dim"))


@register("sc10_json", """
select event_id, cast(json_extract_string(props, '$.k') as bigint) as k,
       cast(len(json_keys(props)) as int) as n_keys, cast(json_extract_string(props, '$.missing') as varchar) as missing
from events""")
def sc10(spark, sf):
    ev = Tables(spark, sf).events
    return ev.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"),
                     F.size(F.json_object_keys("props")).alias("n_keys"),
                     F.get_json_object("props", "$.missing").alias("missing"))


# ---------------------------------------------------------------- joins


@register("jn1_suffix_join", """
select o_orderkey as orderkey, o_custkey, l_linenumber, o_orderstatus as status_left, l_linestatus as status_right,
       o_totalprice as amount_left, l_extendedprice as amount_right
from orders join lineitem on o_orderkey = l_orderkey""")
def jn1(spark, sf):
    t = Tables(spark, sf)
    o = t.orders.select(F.col("o_orderkey").alias("orderkey"), "o_custkey", F.col("o_orderstatus").alias("status"),
                        F.col("o_totalprice").alias("amount"))
    li = t.lineitem.select(F.col("l_orderkey").alias("orderkey"), "l_linenumber", F.col("l_linestatus").alias("status"),
                           F.col("l_extendedprice").alias("amount"))
    return J.join_with_suffixes(o, li, ["orderkey"])


@register("jn2_left_join_renamed", """
select c_custkey, o_orderkey, o_totalprice from customer left join orders on c_custkey = o_custkey""")
def jn2(spark, sf):
    t = Tables(spark, sf)
    return J.join_on(t.customer, t.orders, ["c_custkey"], ["o_custkey"], "left") \
        .select("c_custkey", "o_orderkey", "o_totalprice")


@register("jn3_multikey_price_join", f"""
select l_orderkey, l_linenumber, l_partkey, l_quantity, wp.sell_price,
       round(l_quantity * wp.sell_price, 2) as dollars
from lineitem left join ({WEEKLY_PRICE_SQL}) wp
  on l_partkey = wp.wp_partkey and cast(date_trunc('week', l_shipdate) as date) = wp.wp_week""")
def jn3(spark, sf):
    from tabularlab.plans.q_aggs import weekly_price
    t = Tables(spark, sf)
    li = t.lineitem.withColumn("_week", F.to_date(F.date_trunc("week", "l_shipdate")))
    j = J.join_on(li, weekly_price(t), ["l_partkey", "_week"], ["wp_partkey", "wp_week"], "left")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "sell_price",
                    F.round(F.col("l_quantity") * F.col("sell_price"), 2).alias("dollars"))


@register("jn4_natural_join", """
select orderkey, custkey, l_linenumber, o_orderstatus from
 (select l_orderkey as orderkey, l_linenumber from lineitem) a
 join (select o_orderkey as orderkey, o_custkey as custkey, o_orderstatus from orders) b using (orderkey)""")
def jn4(spark, sf):
    t = Tables(spark, sf)
    a = t.lineitem.select(F.col("l_orderkey").alias("orderkey"), "l_linenumber")
    b = t.orders.select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"), "o_orderstatus")
    return J.natural_join(a, b)


@register("jn5_fold_join", """
select c_custkey, c_acctbal, c_mktsegment, n_orders from customer
left join (select o_custkey as c_custkey, count(*) as n_orders from orders group by o_custkey) using (c_custkey)""")
def jn5(spark, sf):
    t = Tables(spark, sf)
    packs = [t.customer.select("c_custkey", "c_acctbal"), t.customer.select("c_custkey", "c_mktsegment"),
             t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))]
    return J.fold_join(packs, "c_custkey")


@register("jn6_checked_join", """
select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey""")
def jn6(spark, sf):
    t = Tables(spark, sf)
    r = t.region.withColumnRenamed("r_regionkey", "n_regionkey")
    return J.checked_join(t.nation, r, ["n_regionkey"], validate="many_to_one").select("n_nationkey", "n_name", "r_name")


@register("jn7_positional_join", """
select a.position, a.doc_id, b.doc_id as labelled_doc_id, b.quality from
 (select row_number() over (order by doc_id) as position, doc_id from documents) a
 join (select row_number() over (order by doc_id) as position, doc_id, quality from labels) b using (position)""")
def jn7(spark, sf):
    t = Tables(spark, sf)
    a = t.documents.select("doc_id")
    b = t.labels.select(F.col("doc_id").alias("labelled_doc_id"), "quality")
    return J.positional_join(a, b, ["doc_id"], ["labelled_doc_id"]) \
        .select("position", "doc_id", "labelled_doc_id", "quality")


@register("jn8_anti_join", "select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def jn8(spark, sf):
    t = Tables(spark, sf)
    return J.unmatched(t.orders, t.lineitem, ["o_orderkey"], ["l_orderkey"]).select("o_orderkey", "o_custkey")


@register("jn8_unmatched_ratio", """
select count(*) as n_rows, count(*) filter (where not exists (select 1 from lineitem where l_orderkey = o_orderkey)) as n_unmatched,
       round(count(*) filter (where not exists (select 1 from lineitem where l_orderkey = o_orderkey)) / count(*), 6) as unmatched_ratio
from orders""")
def jn8r(spark, sf):
    t = Tables(spark, sf)
    return J.unmatched_ratio(t.orders, t.lineitem, ["o_orderkey"], ["l_orderkey"])


@register("jn9_semi_join", """
select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')""")
def jn9(spark, sf):
    t = Tables(spark, sf)
    ids = t.customer.where(F.col("c_mktsegment") == "BUILDING")
    return C.keep_members(t.orders, "o_custkey", ids, "c_custkey").select("o_orderkey", "o_custkey")


@register("jn10_lookup_enrich", """
select s_suppkey, s_name, n_name from supplier left join nation on s_nationkey = n_nationkey""")
def jn10(spark, sf):
    t = Tables(spark, sf)
    return J.enrich(t.supplier, t.nation, "s_nationkey", "n_nationkey", fixed_size=True).select("s_suppkey", "s_name", "n_name")


@register("jn10_unmatched_report", """
select count(*) as n_rows, count(*) filter (where n_nationkey is null) as n_unmatched,
       count(distinct s_nationkey) filter (where n_nationkey is null) as n_unmatched_keys
from supplier left join nation on s_nationkey = n_nationkey""")
def jn10u(spark, sf):
    t = Tables(spark, sf)
    j = J.enrich(t.supplier, t.nation, "s_nationkey", "n_nationkey", fixed_size=True)
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("n_nationkey").isNull()).alias("n_unmatched"),
                 F.countDistinct(F.when(F.col("n_nationkey").isNull(), F.col("s_nationkey"))).alias("n_unmatched_keys"))


@register("jn11_record_linkage", """
select l_quantity, l_extendedprice, count(*) as n_rows, count(distinct l_orderkey) as n_ids,
       min(l_orderkey) as min_id, max(l_orderkey) as max_id
from lineitem group by l_quantity, l_extendedprice having count(distinct l_orderkey) > 1""")
def jn11(spark, sf):
    r = J.link_by_measurements(Tables(spark, sf).lineitem, ["l_quantity", "l_extendedprice"], "l_orderkey")
    return r.where(F.col("n_ids") > 1)


@register("jn11_linked_names", """
with c as (select l_quantity, l_extendedprice, min(l_orderkey) as low, max(l_orderkey) as high, count(distinct l_orderkey) as n
           from lineitem where l_returnflag = 'A' group by l_quantity, l_extendedprice)
select l_partkey as name, count(*) as n_measured, sum(n)::bigint as n_links, min(low) as min_id, max(high) as max_id
from lineitem l join c on l.l_quantity = c.l_quantity and l.l_extendedprice = c.l_extendedprice
where l_returnflag = 'R' group by l_partkey""")
def jn11n(spark, sf):
    li = Tables(spark, sf).lineitem
    return J.link_tables(li.where(F.col("l_returnflag") == "R"), li.where(F.col("l_returnflag") == "A"),
                         ["l_quantity", "l_extendedprice"], "l_partkey", "l_orderkey")


@register("jn12_aggregate_join_back", """
with a as (select l_partkey, avg(l_quantity) as avg_qty from lineitem group by l_partkey)
select l_orderkey, l_linenumber, l.l_partkey, l_quantity, round(avg_qty, 6) as avg_qty
from lineitem l join a on l.l_partkey = a.l_partkey where l_quantity > avg_qty""")
def jn12(spark, sf):
    li = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    j = group_broadcast(li, ["l_partkey"], {"avg_qty": F.avg("l_quantity")})
    return j.where(F.col("l_quantity") > F.col("avg_qty")).withColumn("avg_qty", F.round("avg_qty", 6))


@register("jn13_snapshot_compare", """
with y as (select o_custkey, year(o_orderdate) as yr, sum(cast(o_totalprice as decimal(18,2))) as total
           from orders where year(o_orderdate) in (1996, 1997) group by all),
r as (select *, row_number() over (partition by yr order by total desc, o_custkey) as rnk from y)
select a.o_custkey, cast(a.total as double) as total_1996, cast(b.total as double) as total_1997,
       a.rnk as rank_1996, b.rnk as rank_1997, a.rnk - b.rnk as rank_gain,
       cast(b.total - a.total as double) as change
from r a join r b on a.o_custkey = b.o_custkey and a.yr = 1996 and b.yr = 1997""")
def jn13(spark, sf):
    o = Tables(spark, sf).orders
    y = o.where(F.year("o_orderdate").isin(1996, 1997)).groupBy("o_custkey", F.year("o_orderdate").alias("yr")) \
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    snaps = {}
    for yr in (1996, 1997):
        s = y.where(F.col("yr") == yr)
        s = O.with_row_number(s, [F.col("total").desc(), F.col("o_custkey")], "rnk")
        snaps[yr] = s.select("o_custkey", F.col("total").alias(f"t{yr}"), F.col("rnk").alias(f"rank_{yr}"))
    j = snaps[1996].join(snaps[1997], "o_custkey")
    return j.select("o_custkey", F.col("t1996").cast("double").alias("total_1996"),
                    F.col("t1997").cast("double").alias("total_1997"), "rank_1996", "rank_1997",
                    (F.col("rank_1996") - F.col("rank_1997")).alias("rank_gain"),
                    (F.col("t1997") - F.col("t1996")).cast("double").alias("change"))


# ---------------------------------------------------------------- sort / top-k


@register("tk1_sort_nulls_last", """
select o_orderkey, o_orderpriority, o_totalprice from orders order by o_orderpriority, o_totalprice desc nulls last""")
def tk1(spark, sf):
    o = Tables(spark, sf).orders
    return o.select("o_orderkey", "o_orderpriority", "o_totalprice") \
        .orderBy(F.col("o_orderpriority").asc_nulls_last(), F.col("o_totalprice").desc_nulls_last())


@register("tk2_top_k", "select s_suppkey, s_name, s_acctbal from supplier order by s_acctbal desc, s_suppkey limit 10")
def tk2(spark, sf):
    s = Tables(spark, sf).supplier.select("s_suppkey", "s_name", "s_acctbal")
    return O.top_k(s, [F.col("s_acctbal").desc(), "s_suppkey"], 10)


@register("tk2_bottom_k", "select s_suppkey, s_acctbal from supplier order by s_acctbal, s_suppkey limit 5")
def tk2b(spark, sf):
    return O.top_k(Tables(spark, sf).supplier.select("s_suppkey", "s_acctbal"), ["s_acctbal", "s_suppkey"], 5)


@register("tk3_filter_topk_project", """
select p_partkey, p_name from part where p_size > 40 order by p_retailprice desc, p_partkey limit 15""")
def tk3(spark, sf):
    p = Tables(spark, sf).part.where(F.col("p_size") > 40)
    return O.top_k(p, [F.col("p_retailprice").desc(), "p_partkey"], 15).select("p_partkey", "p_name")


@register("wn14_nth_rows", """
select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 15 offset 145""")
def wn14(spark, sf):
    p = Tables(spark, sf).part.select("p_partkey", "p_retailprice")
    return O.top_k(p, [F.col("p_retailprice").desc(), "p_partkey"], 15, offset=145)


# ---------------------------------------------------------------- set operations


@register("st1_union_by_name", """
select c_custkey as key, c_name as name, c_nationkey as nationkey, c_acctbal as acctbal, c_mktsegment as segment from customer
union all
select s_suppkey, s_name, s_nationkey, s_acctbal, null from supplier""")
def st1(spark, sf):
    t = Tables(spark, sf)
    c = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
                          F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"),
                          F.col("c_mktsegment").alias("segment"))
    s = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"),
                          F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"))
    return ST.union_by_name([c, s])


@register("st2_tagged_union_split", """
select 'supplier' as src, count(*) as n_rows, round(sum(s_acctbal), 2) as acctbal from supplier
union all select 'customer', count(*), round(sum(c_acctbal), 2) from customer""")
def st2(spark, sf):
    t = Tables(spark, sf)
    c = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("acctbal"))
    s = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("acctbal"))
    u = ST.tagged_union({"customer": c, "supplier": s}, "src")
    halves = [ST.split_back(u, "src", name) for name in ("customer", "supplier")]
    return halves[0].unionByName(halves[1]).groupBy("src").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("acctbal"), 2).alias("acctbal"))


@register("st3_set_difference", """
select n as nationkey, 'customer_only' as kind from (select c_nationkey as n from customer except select s_nationkey from supplier)
union all
select n, 'both' from (select c_nationkey as n from customer intersect select s_nationkey from supplier)""")
def st3(spark, sf):
    t = Tables(spark, sf)
    a = t.customer.select(F.col("c_nationkey").alias("nationkey"))
    b = t.supplier.select(F.col("s_nationkey").alias("nationkey"))
    return ST.compare_key_sets(a, b, "customer_only", "both")


@register("st4_key_fanout", """
select p_partkey, cast(p_partkey as varchar) || suffix as id
from part, (select unnest(['_evaluation', '_validation']) as suffix)""")
def st4(spark, sf):
    p = Tables(spark, sf).part.select("p_partkey")
    return ST.key_fanout(p, F.col("p_partkey").cast("string"), ["_evaluation", "_validation"], "id")
