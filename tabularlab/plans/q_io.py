"""Source and sink queries: each writes a copy of a driver table in a given
format to a fresh folder under the shared checkpoint folder, reads it back
with the operator under test and returns the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularlab.operators.clean import drop_all_null_columns
from tabularlab.functions.hashing import unit_hash_sql
from tabularlab.plans.catalog import register
from tabularlab.plans.facts import MONTHLY_SALES_SQL, monthly_sales
from tabularlab.sources import files as IO
from tabularlab.sources.tables import Tables


@register("src1_csv_inferred", "select n_nationkey, n_name, n_regionkey from nation")
def src1(spark, sf):
    path = IO.write_csv(Tables(spark, sf).nation, IO.run_folder(spark, "nation-csv"))
    return IO.read_csv(spark, path).select("n_nationkey", "n_name", "n_regionkey")


@register("src2_csv_declared_types", """
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as o_date, o_totalprice, o_orderpriority from orders""")
def src2(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("o_date"),
                                        "o_totalprice", "o_orderpriority")
    path = IO.write_csv(o, IO.run_folder(spark, "orders-csv"))
    schema = "o_orderkey bigint, o_date date, o_totalprice double, o_orderpriority string"
    back = IO.read_csv(spark, path, schema=schema, date_format="dd.MM.yyyy")
    return back.select("o_orderkey", F.date_format("o_date", "yyyy-MM-dd").alias("o_date"), "o_totalprice",
                       "o_orderpriority")


@register("src3_csv_null_marker", """
select o_orderkey, case when o_orderstatus = 'P' then null else o_totalprice end as o_totalprice from orders""")
def src3(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
                                        .alias("o_totalprice"))
    path = IO.write_csv(o, IO.run_folder(spark, "orders-na"), null_value="?")
    return IO.read_csv(spark, path, schema="o_orderkey bigint, o_totalprice double", null_value="?")


@register("src4_tsv_latin1", "select n_nationkey, n_name || 'é' as n_name from nation")
def src4(spark, sf):
    n = Tables(spark, sf).nation.select("n_nationkey", F.concat("n_name", F.lit("é")).alias("n_name"))
    path = IO.write_csv(n, IO.run_folder(spark, "nation-tsv"), sep="\t", encoding="ISO-8859-1")
    return IO.read_csv(spark, path, schema="n_nationkey int, n_name string", sep="\t", encoding="ISO-8859-1")


@register("src5_drop_null_columns", """
select o_orderkey, l_linenumber from orders left join lineitem on o_orderkey = l_orderkey""")
def src5(spark, sf):
    t = Tables(spark, sf)
    j = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left") \
        .select("o_orderkey", "l_linenumber", F.lit(None).cast("string").alias("always_empty"))
    return drop_all_null_columns(j)


@register("src6_sampled_read", f"""
select l_orderkey, l_linenumber from lineitem where floor({unit_hash_sql('l_orderkey', 0)} * 100) < 10""")
def src6(spark, sf):
    li = Tables(spark, sf).lineitem
    return IO.sample_rows(li, key="l_orderkey", buckets=100, keep=10).select("l_orderkey", "l_linenumber")


@register("src7_partitioned_write", "select l_orderkey, l_linenumber, l_quantity, l_returnflag from lineitem")
def src7(spark, sf):
    li = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    path = IO.write_partitioned(li, IO.run_folder(spark, "lineitem-part"), ["l_returnflag"])
    return spark.read.parquet(path).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@register("src7_bucketed_join", """
select o_orderkey, o_totalprice, cast(sum(l_quantity) as bigint) as quantity, count(*) as n_lines
from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey, o_totalprice""")
def src7b(spark, sf):
    """Orders and lines written in equal buckets of the order key, then joined and grouped in place."""
    t = Tables(spark, sf)
    orders = IO.write_bucketed(t.orders.select("o_orderkey", "o_totalprice"), IO.run_folder(spark, "orders-buckets"), ["o_orderkey"], 16)
    lines = IO.write_bucketed(t.lineitem.select("l_orderkey", "l_quantity"), IO.run_folder(spark, "lines-buckets"), ["l_orderkey"], 16)
    joined = spark.table(orders).hint("merge").join(spark.table(lines), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey", "o_totalprice").agg(F.sum("l_quantity").cast("bigint").alias("quantity"), F.count("*").alias("n_lines"))


@register("prj19_sorted_lookup", """
select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where l_orderkey = (select max(l_orderkey) // 2 from lineitem)
union all select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where l_partkey = 42 and l_orderkey <> (select max(l_orderkey) // 2 from lineitem)""")
def prj19s(spark, sf):
    """Lines of one order by the sort key and of one part by the Bloom filters."""
    li = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    path = IO.write_sorted(li, IO.run_folder(spark, "lines-sorted"), ["l_orderkey"], 1 << 20, ["l_partkey"])
    rows = spark.read.parquet(path)
    order = rows.agg(F.max("l_orderkey")).first()[0] // 2
    return rows.where(F.col("l_orderkey") == order).unionByName(rows.where((F.col("l_partkey") == 42) & (F.col("l_orderkey") != order)))


@register("src8_partition_scan", """
select l_orderkey, l_linenumber, l_quantity from lineitem where year(l_shipdate) between 1996 and 1998""")
def src8(spark, sf):
    li = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_quantity",
                                           F.year("l_shipdate").alias("ship_year"))
    path = IO.write_partitioned(li, IO.run_folder(spark, "lineitem-year"), ["ship_year"])
    return IO.scan_partitions(spark, path, "ship_year", r"^199[6-8]$", ["l_orderkey", "l_linenumber", "l_quantity"])


@register("src9_stage_checkpoint", f"""
select item_id, store_id, m, sales, cast(dollars as double) as dollars from ({MONTHLY_SALES_SQL})""")
def src9(spark, sf):
    f = IO.stage_checkpoint(monthly_sales(Tables(spark, sf)), "monthly-sales")
    return f.select("item_id", "store_id", "m", "sales", F.col("dollars").cast("double").alias("dollars"))


@register("src10_build_once", "select o_orderstatus, count(*) as n from orders group by o_orderstatus")
def src10(spark, sf):
    path = IO.run_folder(spark, "status-counts")
    build = lambda: Tables(spark, sf).orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    IO.build_once(spark, path, build)
    return IO.build_once(spark, path, lambda: (_ for _ in ()).throw(RuntimeError("must not rebuild")))


@register("src11_nested_json", """
select lang as class_label, case when doc_id % 4 = 0 then 'test' else 'train' end as split_label,
       source || '/' || cast(doc_id as varchar) || '.txt' as path from documents""")
def src11(spark, sf):
    d = Tables(spark, sf).documents.select(
        "lang", F.col("doc_id").alias("_doc"), F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train").alias("split"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    # one JSON object {class: [paths]} per line, for at most 1000 documents (a
    # block of doc ids) of one split, class and source: no list grows with the data
    objs = d.groupBy("split", "lang", F.split_part("path", F.lit("/"), F.lit(1)).alias("_src"),
                     F.floor(F.col("_doc") / 1000).alias("_block")) \
        .agg(F.collect_list("path").alias("paths")) \
        .select("split", F.to_json(F.create_map(F.col("lang"), F.col("paths"))).alias("value"))
    path = IO.run_folder(spark, "class-lists")
    objs.write.mode("overwrite").partitionBy("split").text(path)
    return IO.read_class_lists(spark, path)


MARKER = "\u0000"


def _corpus(spark, sf):
    d = Tables(spark, sf).documents.select("lang", F.col("text").alias("value"))
    path = IO.run_folder(spark, "corpus")
    d.write.mode("overwrite").option("lineSep", MARKER).partitionBy("lang").text(path)
    return path


@register("src12_text_corpus", "select lang, count(*) as n_docs, sum(length(text))::bigint as n_chars from documents group by lang")
def src12(spark, sf):
    docs = IO.read_text_corpus(spark, _corpus(spark, sf), doc_marker=MARKER)
    return docs.groupBy(F.regexp_extract("file", r"lang=([^/]+)/", 1).alias("lang")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


@register("src13_labelled_folders", """
select lang as class_label, cast(sum(strlen(text) + 1) as bigint) as n_bytes from documents group by lang""")
def src13(spark, sf):
    files = IO.read_labelled_folders(spark, _corpus(spark, sf), "*.txt")
    return files.groupBy(F.regexp_replace("class_label", "^lang=", "").alias("class_label")) \
        .agg(F.sum("length").alias("n_bytes"))     # how many files there are is the writer's matter


@register("src14_word_vectors", """
select 'v' || cast(vec_id as varchar) as token, len(embedding) as dim,
       round(list_sum(list_transform(embedding, lambda x: x::double)), 6) as vsum
from embeddings where label = 0""")
def src14(spark, sf):
    e = Tables(spark, sf).embeddings
    path = IO.run_folder(spark, "vectors")
    body = e.select(F.concat_ws(" ", F.concat(F.lit("v"), F.col("vec_id").cast("string")),
                                F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")).alias("value"))
    body.write.mode("overwrite").text(path + "/body")
    header = e.agg(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), F.max(F.size("embedding")).cast("string"))
                   .alias("value"))
    header.write.mode("overwrite").text(path + "/header")
    vocab = e.where(F.col("label") == 0).select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("token"))
    v = IO.read_word_vectors(spark, path, vocab)
    return v.select("token", F.size("vector").cast("bigint").alias("dim"),
                    F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("vsum"))


@register("src15_artifacts", """
with n as (select n_nationkey, cast(dense_rank() over (order by n_name) - 1 as int) as code from nation),
g as (select c_mktsegment as seg, cast(row_number() over (order by c_mktsegment) - 1 as double) as seg_ix
      from (select distinct c_mktsegment from customer))
select c_custkey, code as nation_code, seg_ix from customer join n on c_nationkey = n_nationkey join g on c_mktsegment = seg""")
def src15(spark, sf):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from tabularlab.operators.features import apply_label_encoder, fit_label_encoder
    t = Tables(spark, sf)
    base = IO.run_folder(spark, "artifacts")
    codes = fit_label_encoder(t.nation, "n_name")
    codes.write.mode("overwrite").parquet(base + "/codes")
    model = Pipeline(stages=[StringIndexer(inputCol="c_mktsegment", outputCol="seg_ix", stringOrderType="alphabetAsc"),
                             VectorAssembler(inputCols=["seg_ix", "c_acctbal"], outputCol="features")]).fit(t.customer)
    model.write().overwrite().save(base + "/pipeline")
    reloaded = PipelineModel.load(base + "/pipeline")
    c = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    enc = apply_label_encoder(c, "n_name", spark.read.parquet(base + "/codes"), "nation_code")
    return reloaded.transform(enc).select("c_custkey", "nation_code", "seg_ix")


@register("src16_csv_export", """
with b as (select d.doc_id, avg(cast(case when n_chars > 1000 then 1 else 0 end as double)) as p
           from documents d join labels l on d.doc_id = l.doc_id group by d.doc_id)
select doc_id, cast(p > 0.5 as int) as target from b""")
def src16(spark, sf):
    t = Tables(spark, sf)
    pred = t.documents.join(t.labels, "doc_id").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("target"))
    path = IO.write_csv(pred, IO.run_folder(spark, "submission"))
    return IO.read_csv(spark, path, schema="doc_id bigint, target int")
