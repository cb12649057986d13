"""Web-page jobs (TX12-TX15, ST5) on a ``(page_id, html)`` table.

Link, tag and field extraction are regex expressions on the JVM.  Main-text
extraction needs a real HTML tokenizer (scripts may contain tag-like text), so
it runs the standard-library parser inside ``mapInPandas``: Arrow batches per
partition, a small per-page helper, no driver round trip.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAV = r"(?s)<nav>(.*?)</nav>"
HREF = r'<a href="([^"]*)"'
TAG = r"<([a-zA-Z][a-zA-Z0-9]*)"


def nav_links(df: DataFrame, page: str = "page_id", html: str = "html", prefix: str = "/") -> DataFrame:
    """TX12: distinct hrefs of the anchors inside <nav> starting with ``prefix``."""
    nav = F.regexp_extract(F.col(html), NAV, 1)
    links = df.select(page, F.explode(F.regexp_extract_all(nav, F.lit(HREF), 1)).alias("href"))
    return links.where(F.col("href").startswith(prefix)).distinct()


def all_links(df: DataFrame, html: str = "html") -> DataFrame:
    """ST5: the union of the links of every listing page, deduplicated (a
    crawler would page through listings until the set stops growing; here all
    listing pages are already rows, so the fixpoint is one distinct union)."""
    return df.select(F.explode(F.regexp_extract_all(F.col(html), F.lit(HREF), 1)).alias("href")).distinct()


def tag_counts(df: DataFrame, html: str = "html") -> DataFrame:
    """TX14: number of opening tags by name (lower-cased)."""
    return df.select(F.explode(F.regexp_extract_all(F.col(html), F.lit(TAG), 1)).alias("tag")) \
        .groupBy(F.lower("tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def first_group(html: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def page_fields(df: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """TX14: per page (field, value) rows: title, heading, paragraph count,
    text of the last paragraph, text of the last element of class "ad", footer."""
    h = F.col(html)
    paras = F.regexp_extract_all(h, F.lit(r"(?s)<p>(.*?)</p>"), 1)
    ads = F.regexp_extract_all(h, F.lit(r'(?s)<div class="ad">(.*?)</div>'), 1)
    fields = F.array(
        F.struct(F.lit("title").alias("field"), first_group(h, r"(?s)<title>(.*?)</title>").alias("value")),
        F.struct(F.lit("heading").alias("field"), first_group(h, r"(?s)<h1>(.*?)</h1>").alias("value")),
        F.struct(F.lit("n_paragraphs").alias("field"),
                 F.regexp_count(h, F.lit("<p>")).cast("string").alias("value")),
        F.struct(F.lit("last_paragraph").alias("field"),
                 F.when(F.size(paras) > 0, F.element_at(paras, -1)).alias("value")),
        F.struct(F.lit("last_ad").alias("field"), F.when(F.size(ads) > 0, F.element_at(ads, -1)).alias("value")),
        F.struct(F.lit("footer").alias("field"), first_group(h, r"(?s)<footer>(.*?)</footer>").alias("value")))
    return df.select(page, F.explode(fields).alias("f")).select(page, "f.field", "f.value")


# --------------------------------------------------------------- main text (TX13)

SKIP = {"script", "style", "nav", "footer", "head"}


def _article_text(html: str | None) -> str | None:
    """Text inside <article>, outside script/style/nav/footer, whitespace-collapsed."""
    if html is None:
        return None
    from html.parser import HTMLParser

    class P(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth_article = 0
            self.skip_tag: str | None = None   # element that opened the skipped region
            self.skip_depth = 0                # nesting of that element inside it
            self.out: list[str] = []

        def handle_starttag(self, tag, attrs):
            if self.skip_tag is not None:
                if tag == self.skip_tag:
                    self.skip_depth += 1
            elif tag in SKIP or (tag == "div" and ("class", "ad") in attrs):
                self.skip_tag, self.skip_depth = tag, 1
            elif tag == "article":
                self.depth_article += 1

        def handle_endtag(self, tag):
            if self.skip_tag is not None:
                if tag == self.skip_tag:
                    self.skip_depth -= 1
                    if self.skip_depth == 0:
                        self.skip_tag = None
            elif tag == "article":
                self.depth_article = max(0, self.depth_article - 1)

        def handle_data(self, data):
            if self.depth_article and self.skip_tag is None:
                self.out.append(data)

    p = P()
    p.feed(html)
    p.close()
    return " ".join(" ".join(p.out).split())


def main_text(df: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """TX13: (page, text) of the article body, pages streamed per Arrow batch."""
    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        for pdf in batches:
            yield pd.DataFrame({page: pdf[page], "text": [_article_text(h) for h in pdf[html]]})

    from tabularlab.session import spread
    schema = f"{page} {dict(df.dtypes)[page]}, text string"
    return spread(df.select(page, html)).mapInPandas(run, schema)


# --------------------------------------------------------------- messy numbers (TX15)

def clean_number(text: Column, na_marker: str = "NA") -> Column:
    """TX15: marker -> null; otherwise the first number in the text as double."""
    t = F.nullif(F.trim(text), F.lit(na_marker))
    return F.nullif(F.regexp_extract(t, r"(-?[0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")
