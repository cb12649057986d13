"""Web pages as a table of elements (TX12, TX14), queried by interval containment.

One tokenizer pass per page gives a row per element and per piece of text: its tag, classes, id
and href, its depth and parent, and the numbers of the events that open and close it.  An element
lies inside another one exactly when its interval does, so nesting, text content, table cells
and the like are plain joins on the page with a comparison of positions.

Tags that are not closed follow the rules of HTML: void elements hold nothing; a new paragraph, list
item, table row, cell, term or option ends the open one of its kind within the same list or table;
block elements end an open paragraph; an end tag ends all that is open inside its
element and is passed over where no such element is open; the end of the page ends the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularlab.session import spread

# Fixed values of the HTML standard: elements without content, and what ends which open element.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDS_PARAGRAPH = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4",
                  "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
            "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
BARRIERS = {"table", "td", "th", "button", "caption"}       # a paragraph outside these is not ended from inside
TEXT = "#text"


class _Pass(HTMLParser):
    """Rows [element, tag, classes, id, href, depth, open, close, parent, text] of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.stack: list[int] = []
        self.at = 0

    def tag(self, i: int) -> str:
        return self.rows[i][1]

    def push(self, tag, attrs=(), text=None) -> int:
        a = dict(attrs)
        self.at += 1
        self.rows.append([len(self.rows), tag, (a.get("class") or "").split(), a.get("id"), a.get("href"), len(self.stack),
                          self.at, self.at, self.stack[-1] if self.stack else None, text])
        return len(self.rows) - 1

    def end_from(self, level: int) -> None:
        """Close the open elements from this level of the stack on, innermost first."""
        for i in reversed(self.stack[level:]):
            self.at += 1
            self.rows[i][7] = self.at
        del self.stack[level:]

    def end_open(self, tags: set, barriers: set) -> None:
        """Close the outermost open element with one of ``tags`` above the nearest barrier."""
        found = None
        for level in range(len(self.stack) - 1, -1, -1):
            tag = self.tag(self.stack[level])
            if tag in tags:
                found = level
            elif tag in barriers:
                break
        if found is not None:
            self.end_from(found)

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            self.end_open({"p"}, BARRIERS)
        if tag in SIBLINGS:
            self.end_open(*SIBLINGS[tag])
        i = self.push(tag, attrs)
        if tag not in VOID:
            self.stack.append(i)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for level in range(len(self.stack) - 1, -1, -1):
            if self.tag(self.stack[level]) == tag:
                self.end_from(level)
                return
            if self.tag(self.stack[level]) == "table" and tag in {"p", "li", "div", "span", "a", "b", "i"}:
                return                       # a stray end tag does not reach out of a table

    def handle_data(self, data):
        self.push(TEXT, text=data)


def page_rows(html: str | None) -> list[list]:
    if not html:
        return []
    p = _Pass()
    p.feed(html)
    p.close()
    p.end_from(0)
    return p.rows


FIELDS = "element int, tag string, classes array<string>, id string, href string, depth int, open int, close int, parent int, text string"


def page_elements(df: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """The element table: (page, element, tag, classes, id, href, depth, open, close, parent, text).
    Text pieces have the tag ``#text``.  A null or empty page has no rows."""
    source = spread(df.select(page, html))
    schema = f"`{page}` {dict(df.dtypes)[page]}, {FIELDS}"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        kinds = [pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), *[pa.int32()] * 4, pa.string()]
        names = [f.split()[0] for f in FIELDS.split(", ")]
        for b in batches:
            for at in range(0, b.num_rows, 64):                      # pages are cut to batches of bounded rows
                part = b.slice(at, 64)
                made = [page_rows(h) for h in part.column(1).to_pylist()]
                ids = [i for i, rows in enumerate(made) for _ in rows]
                columns = list(zip(*(r for rows in made for r in rows))) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(ids, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    names=[page, *names])

    return source.mapInArrow(run, schema)


def has_class(name: str) -> Column:
    return F.array_contains("classes", name)


def tag_statistics(elements: DataFrame) -> DataFrame:
    """(tag, class, n): elements by tag and class; an element without a class counts under null,
    one with several under each."""
    rows = elements.where(F.col("tag") != TEXT)
    return rows.select("tag", F.explode_outer("classes").alias("class")).groupBy("tag", "class").agg(F.count("*").alias("n"))


def inside(elements: DataFrame, inner: Column, outer: Column, page: str = "page_id") -> DataFrame:
    """Rows that satisfy ``inner`` with ``outer_element`` and ``outer_open`` of each element that satisfies
    ``outer`` and holds them."""
    held = elements.where(outer).select(F.col(page).alias("_page"), F.col("element").alias("outer_element"),
                                        F.col("open").alias("outer_open"), F.col("close").alias("_close"))
    rows = elements.where(inner)
    contained = (F.col("open") > F.col("outer_open")) & (F.col("close") < F.col("_close"))
    return rows.join(held, F.col(page).eqNullSafe(F.col("_page")) & contained).drop("_page", "_close")


def nearest(elements: DataFrame, inner: Column, outer: Column, page: str = "page_id") -> DataFrame:
    """As ``inside``, but only the innermost of the elements that hold a row."""
    rows = inside(elements, inner, outer, page)
    last = Window.partitionBy(page, "element")
    return rows.withColumn("_in", F.max("outer_open").over(last)).where(F.col("_in") == F.col("outer_open")).drop("_in")


def element_text(elements: DataFrame, which: Column, page: str = "page_id") -> DataFrame:
    """(page, element, content): all text inside the elements that satisfy ``which``, in order,
    white space collapsed; elements without text are left out."""
    pieces = inside(elements, F.col("tag") == TEXT, which, page)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("open", "text"))), lambda p: p["text"]), "")
    return pieces.groupBy(page, F.col("outer_element").alias("element")).agg(
        F.trim(F.regexp_replace(joined, r"\s+", " ")).alias("content"))


def last_of_class(elements: DataFrame, name: str, page: str = "page_id") -> DataFrame:
    """(page, tag, content): the last element of each page that has the class."""
    rows = elements.where(has_class(name))
    last = rows.groupBy(page).agg(F.max_by(F.struct("element", "tag"), "open").alias("e")).select(page, "e.*")
    texts = element_text(elements, has_class(name), page).select(F.col(page).alias("_page"), F.col("element").alias("_e"), "content")
    same = F.col(page).eqNullSafe(F.col("_page")) & (F.col("element") == F.col("_e"))
    return last.join(texts, same, "left").select(page, "tag", "content")


def links_inside(elements: DataFrame, outer: Column, prefix: str = "", page: str = "page_id") -> DataFrame:
    """(page, href): distinct links within elements that satisfy ``outer`` whose text begins with ``prefix``."""
    anchor = (F.col("tag") == "a") & F.col("href").isNotNull()
    found = inside(elements, anchor, outer, page).select(page, "element", "href").distinct()
    if prefix:
        texts = element_text(elements, anchor, page).where(F.col("content").startswith(prefix))
        same = [F.col(f"l.{page}").eqNullSafe(F.col(f"t.{page}")), F.col("l.element") == F.col("t.element")]
        found = found.alias("l").join(texts.alias("t"), same, "left_semi")
    return found.select(page, "href").distinct()


def table_cells(elements: DataFrame, table: Column | None = None, page: str = "page_id") -> DataFrame:
    """(page, table, row, cell, header, row_id, content): the cells of each table (those that satisfy
    ``table``), rows and cells numbered from 0.  A cell belongs to its innermost row and that to its innermost table, so
    tables within cells are tables of their own; their text is also part of the outer cell's."""
    is_table = F.col("tag") == "table"
    rows = nearest(elements, F.col("tag") == "tr", is_table, page)
    if table is not None:
        wanted = elements.where(is_table & table).select(F.col(page).alias("_page"), F.col("element").alias("_t"))
        rows = rows.join(wanted, F.col(page).eqNullSafe(F.col("_page")) & (F.col("outer_element") == F.col("_t")), "left_semi")
    rows = rows.select(F.col(page).alias("_page"), F.col("outer_element").alias("table"), F.col("element").alias("_tr"), F.col("id").alias("row_id"),
                       (F.row_number().over(Window.partitionBy(page, "outer_element").orderBy("open")) - 1).alias("row"))
    cell = F.col("tag").isin("td", "th")
    cells = nearest(elements, cell, F.col("tag") == "tr", page)
    cells = cells.withColumn("cell", F.row_number().over(Window.partitionBy(page, "outer_element").orderBy("open")) - 1)
    placed = cells.join(rows, F.col(page).eqNullSafe(F.col("_page")) & (F.col("outer_element") == F.col("_tr"))) \
        .select(page, "table", "row", "cell", (F.col("tag") == "th").alias("header"), "row_id", "element")
    texts = element_text(elements, cell, page).select(F.col(page).alias("_page"), F.col("element").alias("_e"), "content")
    same = F.col(page).eqNullSafe(F.col("_page")) & (F.col("element") == F.col("_e"))
    return placed.join(texts, same, "left").select(page, "table", "row", "cell", "header", "row_id", F.coalesce("content", F.lit("")).alias("content"))


def table_fields(cells: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, entity, field, value): one row per cell behind the first of each table row; the entity is the row's
    first cell, the field the header row's cell above.  Cells without a header above are left out."""
    keys = [page, "table"]
    head = cells.where("row = 0 and header").select(F.col(page).alias("_p"), F.col("table").alias("_t"), F.col("cell").alias("_c"), F.col("content").alias("field"))
    body = cells.where("row > 0")
    named = body.where("cell = 0").select(F.col(page).alias("_p2"), F.col("table").alias("_t2"), F.col("row").alias("_r2"), F.col("content").alias("entity"))
    above = F.col(page).eqNullSafe(F.col("_p")) & (F.col("table") == F.col("_t")) & (F.col("cell") == F.col("_c"))
    first = F.col(page).eqNullSafe(F.col("_p2")) & (F.col("table") == F.col("_t2")) & (F.col("row") == F.col("_r2"))
    return body.where("cell > 0").join(head, above).join(named, first).select(*keys, "entity", "field", F.col("content").alias("value")).drop("table")
