import pytest
from pyspark.sql import functions as F

from tabularlab.operators import elements as EL

NESTED = ('<html><body><div class="ad outer">one <div>two <div class="ad">three</div></div> four</div>'
          '<p>first<p>second <b>bold<ul><li>a<li>b<ul><li>c</ul><li>d</ul></i> tail</body>')
TABLES = ('<table id=t><thead><tr><th>land<th>area<tbody><tr class=x><td>A &amp; B<td><table><tr><td>inner 1<td>inner 2</table>'
          '<tr><td>C<td><p>5 <p>km</table><br><div>after')


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame([(1, NESTED), (2, TABLES), (3, None), (4, ""), (5, "plain"), (None, '<div class="ad">n</div>')],
                               "page_id long, html string")
    return EL.page_elements(df).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_intervals_nest_and_parents_hold_their_children(pages):
    for page in (1, 2):
        got = pages.where(F.col("page_id") == page).orderBy("element").collect()
        for r in got:
            if r.parent is not None:
                p = got[r.parent]
                assert p.open < r.open <= r.close < p.close and p.depth + 1 == r.depth
        for a in got:
            for b in got:
                assert a.close < b.open or b.close < a.open or a.element == b.element \
                    or a.open < b.open <= b.close < a.close or b.open < a.open <= a.close < b.close


def test_unclosed_tags(pages):
    got = {r.element: r for r in pages.where("page_id = 1").collect()}
    paragraphs = [r for r in got.values() if r.tag == "p"]
    assert len(paragraphs) == 2 and paragraphs[0].close < paragraphs[1].open
    items = EL.nearest(pages, F.col("tag") == "li", F.col("tag") == "ul").where("page_id = 1").collect()
    lists = {r.outer_element for r in items}
    assert len(items) == 4 and len(lists) == 2
    texts = {r.content for r in EL.element_text(pages, F.col("tag") == "li").where("page_id = 1").collect()}
    assert texts == {"a", "bc", "c", "d"}          # the tail stands behind the list


def test_classes_and_last_of_class(pages):
    assert rows(EL.last_of_class(pages, "ad")) == sorted([(1, "div", "three"), (None, "div", "n")], key=repr)
    counts = {(r.tag, r["class"]): r.n for r in EL.tag_statistics(pages).collect()}
    assert counts["div", "ad"] == 3 and counts["div", "outer"] == 1 and counts["div", None] == 2
    whole = EL.element_text(pages, EL.has_class("outer")).collect()
    assert [r.content for r in whole] == ["one two three four"]


def test_table_rows_become_fields(pages):
    cells = EL.table_cells(pages, F.col("id") == "t")
    assert rows(EL.table_fields(cells)) == [(2, "A & B", "area", "inner 1inner 2"), (2, "C", "area", "5 km")]
    every = EL.table_cells(pages)
    assert every.select("table").distinct().count() == 2 and every.where("content = 'inner 2'").first().cell == 1


def test_links(spark):
    html = '<dl><dt class="entry title"><a href="/1">Letter one</a><dt class=entry><a href="/2">Note</a> <a>no link</a></dl><a href="/3">Letter</a>'
    df = EL.page_elements(spark.createDataFrame([(1, html), (None, html)], "page_id long, html string")).cache()
    assert rows(EL.links_inside(df, EL.has_class("entry"))) == sorted([(1, "/1"), (1, "/2"), (None, "/1"), (None, "/2")], key=repr)
    assert rows(EL.links_inside(df, EL.has_class("entry"), "Letter").where("page_id = 1")) == [(1, "/1")]
