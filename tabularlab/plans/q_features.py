"""Feature-engineering and sampling queries (BIN, FE, SM)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularlab.operators import features as FT
from tabularlab.operators.order import contiguous_folds
from tabularlab.operators.reshape import distinct_values
from tabularlab.functions.hashing import unit_hash_sql, unit_md5_sql
from tabularlab.plans.catalog import register
from tabularlab.sources.tables import Tables

Q4_EDGES_SQL = "(select quantile_cont(o_totalprice, [0.0, 0.25, 0.5, 0.75, 1.0]) as q from orders)"


@register("bin1_quantile_bins", f"""
select o_orderkey, case when o_totalprice >= q[1] and o_totalprice <= q[2] then 1
                        when o_totalprice > q[2] and o_totalprice <= q[3] then 2
                        when o_totalprice > q[3] and o_totalprice <= q[4] then 3
                        when o_totalprice > q[4] and o_totalprice <= q[5] then 4 end as price_bin
from orders, {Q4_EDGES_SQL}""")
def bin1(spark, sf):
    o = Tables(spark, sf).orders
    return FT.quantile_bins(o, "o_totalprice", 4, "price_bin").select("o_orderkey", "price_bin")


SIZE_EDGES = [0, 10, 20, 35, 45]
SIZE_LABELS = ["(0, 10]", "(10, 20]", "(20, 35]", "(35, 45]"]


@register("bin2_fixed_bins", """
select p_partkey, case when p_size > 0 and p_size <= 10 then '(0, 10]' when p_size > 10 and p_size <= 20 then '(10, 20]'
                       when p_size > 20 and p_size <= 35 then '(20, 35]' when p_size > 35 and p_size <= 45 then '(35, 45]'
                  end as size_bin from part""")
def bin2(spark, sf):
    p = Tables(spark, sf).part
    return FT.fixed_bins(p, "p_size", SIZE_EDGES, "size_bin", SIZE_LABELS).select("p_partkey", "size_bin")


@register("bin3_bin_indicators", """
select p_partkey, """ + ", ".join(
    f"coalesce(cast(p_size > {SIZE_EDGES[i - 1]} and p_size <= {SIZE_EDGES[i]} as int), 0) as size_is_{i}"
    for i in range(1, len(SIZE_EDGES))) + " from part")
def bin3(spark, sf):
    p = FT.fixed_bins(Tables(spark, sf).part, "p_size", SIZE_EDGES, "_bin")
    return FT.bin_indicators(p, "_bin", len(SIZE_EDGES) - 1, "size_is").select(
        "p_partkey", *[f"size_is_{i}" for i in range(1, len(SIZE_EDGES))])


@register("fe1_rare_merge", """
select p_partkey, case when n >= 70 then p.p_brand else 'Other' end as p_brand
from part p join (select p_brand, count(*) as n from part group by p_brand) c on p.p_brand = c.p_brand""")
def fe1(spark, sf):
    p = Tables(spark, sf).part.select("p_partkey", "p_brand")
    return FT.merge_rare(p, "p_brand", 70).select("p_partkey", "p_brand")


@register("fe2_target_encoding", """
with j as (select l.doc_id, d.source, l.quality, l.doc_id % 4 <> 0 as is_train from labels l join documents d on l.doc_id = d.doc_id),
enc as (select source, avg(quality) as m from j where is_train group by source)
select j.doc_id, j.source, round(enc.m, 6) as source_quality from j left join enc on j.source = enc.source""")
def fe2(spark, sf):
    t = Tables(spark, sf)
    j = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    e = FT.target_mean_encode(j, F.col("doc_id") % 4 != 0, "source", "quality", "source_quality")
    return e.select("doc_id", "source", F.round("source_quality", 6).alias("source_quality"))


@register("fe3_label_encoder", """
select n_name as value, cast(row_number() over (order by n_name) - 1 as int) as code from (select distinct n_name from nation)""")
def fe3(spark, sf):
    return FT.fit_label_encoder(Tables(spark, sf).nation, "n_name")


@register("fe4_apply_encoder", """
with codes as (select n_name as value, cast(row_number() over (order by n_name) - 1 as int) as code
               from (select distinct n_name from nation where n_regionkey <> 4))
select s_suppkey, coalesce(c.code, 0) as code, cast(c.code is null as int) as code_unseen
from supplier join nation on s_nationkey = n_nationkey left join codes c on n_name = c.value""")
def fe4(spark, sf):
    t = Tables(spark, sf)
    codes = FT.fit_label_encoder(t.nation.where(F.col("n_regionkey") != 4), "n_name")
    s = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return FT.apply_label_encoder(s, "n_name", codes, "code").select("s_suppkey", "code", "code_unseen")


@register("fe5_standardize", """
with p as (select avg(l_quantity) as mq, stddev_samp(l_quantity) as sq, median(l_quantity) as medq,
                  avg(l_discount) as md, stddev_samp(l_discount) as sd, median(l_discount) as medd,
                  avg(l_tax) as mt, stddev_samp(l_tax) as st, median(l_tax) as medt
           from lineitem where l_shipdate < timestamp '1999-01-01')
select l_orderkey, l_linenumber, round((coalesce(l_quantity, medq) - mq) / sq, 6) as l_quantity,
       round((coalesce(l_discount, medd) - md) / sd, 6) as l_discount,
       round((coalesce(l_tax, medt) - mt) / st, 6) as l_tax, cast(l_quantity is null as int) as l_quantity_na
from lineitem, p""")
def fe5(spark, sf):
    li = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    cols = ["l_quantity", "l_discount", "l_tax"]
    params = FT.fit_standardizer(li.where(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")),
                                 cols)
    out = FT.apply_standardizer(li, params, cols)
    return out.select("l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"),
                      F.round("l_discount", 6).alias("l_discount"), F.round("l_tax", 6).alias("l_tax"), "l_quantity_na")


@register("fe5_category_codes", """
with tr as (select * from orders where o_orderdate < timestamp '1995-06-01'),
c as (select v, row_number() over (order by v) as code from (select distinct o_custkey as v from tr)),
p as (select v, row_number() over (order by v) as code from (select distinct o_orderpriority as v from tr where o_orderpriority is not null)),
s as (select avg(o_totalprice) as m, stddev_samp(o_totalprice) as sd, median(o_totalprice) as med from tr)
select o_orderkey, round((coalesce(o_totalprice, med) - m) / sd, 6) as o_totalprice, cast(o_totalprice is null as int) as o_totalprice_na,
       cast(coalesce(c.code, 0) as int) as o_custkey_code, cast(coalesce(p.code, 0) as int) as o_orderpriority_code
from orders left join c on o_custkey = c.v left join p on o_orderpriority = p.v, s where o_orderdate >= timestamp '1995-06-01'""")
def fe5c(spark, sf):
    """Fitted on the earlier orders, saved, loaded and applied to the later ones."""
    from tabularlab.operators.preprocess import TabularModel, TabularPreprocessor
    from tabularlab.sources.files import run_folder
    o = Tables(spark, sf).orders
    cut = F.lit("1995-06-01").cast("timestamp_ntz")
    path = run_folder(spark, "preprocessor")
    TabularPreprocessor(["o_totalprice"], ["o_custkey", "o_orderpriority"]).fit(o.where(F.col("o_orderdate") < cut)).save(path)
    out = TabularModel.load(spark, path).transform(o.where(F.col("o_orderdate") >= cut))
    return out.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"), "o_totalprice_na", "o_custkey_code", "o_orderpriority_code")


@register("fe6_minmax_scale", """
select c_custkey, round((c_acctbal - (select min(c_acctbal) from customer)) /
       ((select max(c_acctbal) from customer) - (select min(c_acctbal) from customer)), 6) as c_acctbal_scaled from customer""")
def fe6(spark, sf):
    c = FT.minmax_scale(Tables(spark, sf).customer, ["c_acctbal"])
    return c.select("c_custkey", F.round("c_acctbal_scaled", 6).alias("c_acctbal_scaled"))


@register("fe7_parent_aggregates", """
with o as (select o_custkey, cast(o_totalprice as decimal(18,2)) as price, o_totalprice, o_orderstatus from orders),
mode as (select o_custkey, arg_min(o_totalprice, -n * 1e12 + o_totalprice) as mode_o_totalprice from
         (select o_custkey, o_totalprice, count(*) as n from o group by all) group by o_custkey),
smode as (select o_custkey, o_orderstatus as mode_o_orderstatus from (select o_custkey, o_orderstatus,
            row_number() over (partition by o_custkey order by count(*) desc, o_orderstatus) as r
          from o where o_orderstatus is not null group by o_custkey, o_orderstatus) where r = 1)
select o.o_custkey, count(*) as n_children, cast(sum(price) as double) as sum_o_totalprice,
       round(avg(o_totalprice), 6) as mean_o_totalprice, round(stddev_samp(o_totalprice), 6) as std_o_totalprice,
       min(o_totalprice) as min_o_totalprice, max(o_totalprice) as max_o_totalprice,
       round(case when count(o_totalprice) > 2 then skewness(o_totalprice) end, 6) as skew_o_totalprice,
       count(distinct o_totalprice) as nunique_o_totalprice,
       count(*) filter (where o_orderstatus = 'F') as n_o_orderstatus_F, count(*) filter (where o_orderstatus = 'O') as n_o_orderstatus_O,
       count(*) filter (where o_orderstatus = 'P') as n_o_orderstatus_P,
       any_value(mode.mode_o_totalprice) as mode_o_totalprice, any_value(smode.mode_o_orderstatus) as mode_o_orderstatus
from o join mode on o.o_custkey = mode.o_custkey left join smode on o.o_custkey = smode.o_custkey group by o.o_custkey""")
def fe7(spark, sf):
    o = Tables(spark, sf).orders
    statuses = distinct_values(o, "o_orderstatus")      # every value that occurs
    return FT.parent_aggregate_features(o, "o_custkey", ["o_totalprice"], {"o_orderstatus": statuses},
                                        money=["o_totalprice"])


@register("fe8_noise_columns", f"""
with r as (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer)
select c_custkey, cast({unit_md5_sql('c_custkey', 7, 'label')} < 0.5 as int) as noise_label,
       round(lo + {unit_md5_sql('c_custkey', 7, 'value')} * (hi - lo), 6) as noise_value from customer, r""")
def fe8(spark, sf):
    c = Tables(spark, sf).customer.select("c_custkey", "c_acctbal")
    noisy = FT.noise_columns(c, "c_custkey", seed=7, like="c_acctbal")
    return noisy.select("c_custkey", "noise_label", F.round("noise_value", 6).alias("noise_value"))


@register("sm1_balanced_sample", """
with h as (select doc_id, lang, 'train' as split from (select *, row_number() over (partition by lang order by doc_id) as r from documents) where r <= 20),
t as (select doc_id, lang, 'valid' as split from (select *, row_number() over (partition by lang order by doc_id desc) as r from documents) where r <= 10)
select * from h union all select * from t where doc_id not in (select doc_id from h)""")
def sm1(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "lang")
    return FT.head_tail_sample(d, "lang", ["doc_id"], 20, 10)


HOLDOUT_SOURCES = ["src0", "src5", "src10", "src15"]


@register("sm2_group_holdout", """
select split, count(*) as n_rows, count(distinct lang) as n_langs, round(count(*) / (select count(*) from documents), 6) as share
from (select lang, case when source in ('src0', 'src5', 'src10', 'src15') then 'valid' else 'train' end as split from documents)
group by split""")
def sm2(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "source", "lang")
    chosen = d.where(F.col("source").isin(HOLDOUT_SOURCES)).select("source")
    s = FT.group_holdout(d, "source", chosen)
    FT.assert_classes_on_both_sides(s, "split", "lang")
    n = d.agg(F.count(F.lit(1))).scalar()
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("lang").alias("n_langs"),
                                  F.round(F.count(F.lit(1)) / n, 6).alias("share"))


@register("sm3_last_n_per_class", """
select doc_id, lang from (select *, row_number() over (partition by lang order by doc_id desc) as r from documents) where r <= 25""")
def sm3(spark, sf):
    from tabularlab.operators.series import top_n_per_group
    d = Tables(spark, sf).documents.select("doc_id", "lang")
    return top_n_per_group(d, ["lang"], [F.col("doc_id").desc()], 25)


@register("sm4_random_split", f"""
select o_orderkey, case when {unit_hash_sql('o_orderkey', 42)} < 0.2 then 'test' else 'train' end as split from orders""")
def sm4(spark, sf):
    return FT.hash_split(Tables(spark, sf).orders.select("o_orderkey"), "o_orderkey", 0.2, seed=42)


@register("sm5_contiguous_folds", """
select doc_id, cast(ntile(5) over (order by doc_id) as int) as fold from labels""")
def sm5(spark, sf):
    return contiguous_folds(Tables(spark, sf).labels.select("doc_id"), ["doc_id"], 5)


@register("sm5_stratified_folds", """
select doc_id, quality, cast(ntile(3) over (partition by quality order by doc_id) as int) as fold from labels""")
def sm5s(spark, sf):
    return FT.stratified_folds(Tables(spark, sf).labels.select("doc_id", "quality"), "quality", ["doc_id"], 3)


@register("sm6_permutation", f"""
select doc_id, lang, row_number() over (order by {unit_hash_sql('doc_id', 11)}, doc_id) as position from documents""")
def sm6(spark, sf):
    return FT.permute(Tables(spark, sf).documents.select("doc_id", "lang"), 11, "doc_id")
