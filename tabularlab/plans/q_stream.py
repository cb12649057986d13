"""Web-page and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularlab.operators import elements as EL
from tabularlab.operators import web as W
from tabularlab.plans.catalog import register
from tabularlab.sources.files import run_folder
from tabularlab.sources.tables import Tables
from tabularlab.streaming.incremental import incremental_copy, upserted_counts, windowed_counts

NAV_SQL = "regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)"


@register("tx12_nav_links", f"""
select distinct page_id, href from (select page_id, unnest(regexp_extract_all({NAV_SQL}, '<a href="([^"]*)"', 1)) as href from pages)
where starts_with(href, '/')""")
def tx12(spark, sf):
    return W.nav_links(Tables(spark, sf).pages)


@register("st5_link_union", """
select distinct unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from pages""")
def st5(spark, sf):
    return W.all_links(Tables(spark, sf).pages)


@register("tx13_main_text")
def tx13(spark, sf):
    t = W.main_text(Tables(spark, sf).pages)
    return t.select("page_id", F.length("text").alias("n_chars"), "text")


@register("tx14_tag_counts", """
select lower(tag) as tag, count(*) as n from (select unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) as tag from pages)
group by lower(tag)""")
def tx14(spark, sf):
    return W.tag_counts(Tables(spark, sf).pages)


FIELDS = {"title": "title", "heading": "heading", "n_paragraphs": "n_paragraphs", "last_paragraph": "last_paragraph",
          "last_ad": "last_ad", "footer": "footer"}


@register("tx14_page_fields_wide", """
select page_id, nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') as title,
       nullif(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '') as heading,
       cast(len(regexp_extract_all(html, '<p>')) as varchar) as n_paragraphs,
       case when len(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)) > 0
            then regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)[-1] end as last_paragraph,
       case when len(regexp_extract_all(html, '(?s)<div class="ad">(.*?)</div>', 1)) > 0
            then regexp_extract_all(html, '(?s)<div class="ad">(.*?)</div>', 1)[-1] end as last_ad,
       nullif(regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1), '') as footer
from pages""")
def tx14w(spark, sf):
    from tabularlab.operators.reshape import pivot_wide
    long = W.page_fields(Tables(spark, sf).pages)
    return pivot_wide(long, ["page_id"], "field", "value", FIELDS, check_unique=False)


def _elements(spark, sf):
    from tabularlab.session import materialize
    return materialize(EL.page_elements(Tables(spark, sf).pages), "elements")      # read by each side of the joins


@register("tx12_links_in_lists", f"""
select distinct page_id, link[1] as href from (select page_id, unnest(list_transform(
    regexp_extract_all({NAV_SQL}, '<a href="[^"]*">[^<]*</a>'), lambda a: [regexp_extract(a, 'href="([^"]*)"', 1), regexp_extract(a, '>([^<]*)<', 1)])) as link
  from pages) where starts_with(link[2], 't')""")
def tx12l(spark, sf):
    return EL.links_inside(_elements(spark, sf), F.col("tag") == "li", "t")


@register("tx14_class_counts", """
select t[1] as tag, t[2] as "class", count(*) as n from (select unnest(list_transform(
    regexp_extract_all(html, '<[a-z][a-z0-9]* class="[^"]+"'), lambda x: [regexp_extract(x, '<([a-z0-9]+)', 1), regexp_extract(x, '"([^"]*)"', 1)])) as t from pages)
group by all""")
def tx14c(spark, sf):
    return EL.tag_statistics(EL.page_elements(Tables(spark, sf).pages)).where(F.col("class").isNotNull())


@register("tx14_last_of_class", r"""
select page_id, 'div' as tag, trim(regexp_replace(replace(replace(replace(x[-1], '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) as content
from (select page_id, regexp_extract_all(html, '(?s)<div class="ad">(.*?)</div>', 1) as x from pages) where len(x) > 0""")
def tx14l(spark, sf):
    return EL.last_of_class(_elements(spark, sf), "ad")


@register("tx14_table_fields", """
select p_partkey // 50 as page_id, p_name as entity, f.field, f.value from part,
  lateral (select unnest([{'field': 'brand', 'value': p_brand}, {'field': 'size', 'value': cast(p_size as varchar)},
                          {'field': 'type', 'value': p_type}]) as f)""")
def tx14f(spark, sf):
    """Field tables of 50 parts a page, written with nested boxes and with cells left open, parsed back."""
    from tabularlab.session import materialize
    p = Tables(spark, sf).part
    row = F.concat(F.lit('<tr id="p'), F.col("p_partkey").cast("string"), F.lit('"><td><div>'), F.col("p_name"),
                   F.lit("</div><td><div><div>"), F.col("p_brand"), F.lit("</div></div></td><td>"), F.col("p_size").cast("string"),
                   F.lit("<td>"), F.col("p_type"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))), lambda x: x["r"]), "\n")
    head = "<html><body><table class='other'><tr><td>x</td></tr></table><table id=fields><tr><th>part<th>brand<th>size<th>type"
    pages = p.groupBy(F.floor(F.col("p_partkey") / 50).alias("page_id")).agg(F.concat(F.lit(head), rows, F.lit("</table><p>end")).alias("html"))
    cells = EL.table_cells(materialize(EL.page_elements(pages), "elements"), F.col("id") == "fields")
    return EL.table_fields(materialize(cells, "cells"))


@register("tx15_messy_numbers", """
select event_type, round(avg(try_cast(nullif(regexp_extract(nullif(trim(props), 'NA'), '(-?[0-9]+(?:\\.[0-9]+)?)', 1), '') as double)), 6) as mean_k,
       count(try_cast(nullif(regexp_extract(nullif(trim(props), 'NA'), '(-?[0-9]+(?:\\.[0-9]+)?)', 1), '') as double)) as n_numbers
from events group by event_type""")
def tx15(spark, sf):
    ev = Tables(spark, sf).events.withColumn("k", W.clean_number(F.col("props")))
    return ev.groupBy("event_type").agg(F.round(F.avg("k"), 6).alias("mean_k"), F.count("k").alias("n_numbers"))


# ---------------------------------------------------------------- streaming


@register("ss1_incremental_scan", "select l_orderkey, l_linenumber, l_quantity, l_shipdate from lineitem")
def ss1(spark, sf):
    li = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    base = run_folder(spark, "stream-facts")
    li.write.mode("overwrite").parquet(base + "/in")     # an append-only directory
    return incremental_copy(spark, base + "/in", li.schema, base + "/out", base + "/ckpt", max_files_per_trigger=2)


@register("ss2_windowed_daily_counts", """
select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) as n from events group by 1""")
def ss2(spark, sf):
    ev = Tables(spark, sf).events.select("event_id", "ts")
    base = run_folder(spark, "stream-events")
    ev.write.mode("overwrite").parquet(base + "/in")
    # an end marker three days later closes the last windows; it is not counted itself
    ev.agg((F.max("ts") + F.expr("interval 3 days")).alias("ts")).select(
        F.lit(None).cast(ev.schema["event_id"].dataType).alias("event_id"), "ts").write.mode("append").parquet(base + "/in")
    out = windowed_counts(spark, base + "/in", ev.schema, "ts", "event_id", base + "/out", base + "/ckpt", max_files_per_trigger=None)
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n")


def _upserts(spark, sf, mode):
    ev = Tables(spark, sf).events.select("event_id", "ts")
    base = run_folder(spark, f"stream-{mode}")
    # in order of time, so that no file lies behind the watermark of one before it
    ev.repartitionByRange(4, "ts").write.mode("overwrite").parquet(base + "/in")
    files = None if mode == "update" else 2        # update: one batch, whatever the order the files are listed in
    out = upserted_counts(spark, base + "/in", ev.schema, "ts", "event_id", base + "/out", base + "/ckpt", mode, max_files_per_trigger=files)
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n")


@register("ss2_daily_counts_update", """
select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) as n from events group by 1""")
def ss2u(spark, sf):
    return _upserts(spark, sf, "update")


@register("ss2_daily_counts_complete", """
select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) as n from events group by 1""")
def ss2c(spark, sf):
    return _upserts(spark, sf, "complete")
