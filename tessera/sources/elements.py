"""Pages as rows: every element and every piece of text with its place, and the items that pages list.

``elements`` is the one step that reads HTML. It gives an element the places where it begins and ends, so one element is within another if its place is between
the other's, and all that follows is selection: ``marked`` marks rows by the outermost selected element around them, ``items`` folds marked rows. A page's rows are ordered once; all
marks come from running values over that order, so nesting needs no join of elements with elements, and a page's text is held once however deep it is nested.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = pa.schema([("page", pa.int64()), ("at", pa.int32()), ("until", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("text", pa.string())])
TYPES = "page long, at int, until int, depth int, tag string, attributes map<string,string>, text string"
#: Elements without content, and those that end where a sibling of their kind begins, up to the element that holds both.
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "p": ({"p"}, {"div", "article", "section", "body", "li", "td", "th", "figure", "blockquote", "main", "aside", "header", "footer"}),
}


class _Reader(HTMLParser):
    """Rows of one page, in order of their beginning."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.place = 0

    def _next(self) -> int:
        self.place += 1
        return self.place

    def _close(self, upto: int) -> None:
        for i in self.open[upto:]:
            self.rows[i][1] = self.place
        del self.open[upto:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS:
            kind, holders = ENDS[tag]
            for k in range(len(self.open) - 1, -1, -1):
                name = self.rows[self.open[k]][3]
                if name in holders:
                    break
                if name in kind and not (tag == "tr" and name != "tr"):
                    self._next()
                    self._close(k)
                    break
        at = self._next()
        self.rows.append([at, at, len(self.open), tag, list({k: v or "" for k, v in reversed(attrs)}.items()), None])
        if tag not in EMPTY:
            self.open.append(len(self.rows) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[k]][3] == tag:
                self._next()
                self._close(k)
                return

    def handle_data(self, data: str) -> None:
        text = " ".join(data.split())
        if text and not (self.open and self.rows[self.open[-1]][3] in ("script", "style")):
            at = self._next()
            self.rows.append([at, at, len(self.open), "#text", [], text])

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1


def read(html: str) -> list[list]:
    """at, until, depth, tag, attributes, text of a page's elements and texts. Elements that nothing ends end with the one around them."""
    r = _Reader()
    r.feed(html)
    r.close()
    r._next()
    r._close(0)
    return r.rows


def elements(pages: DataFrame, page_id: str = "page_id", html: str = "html", rows: int = 10_000) -> DataFrame:
    """page, at, until, depth, tag, attributes, text: a row for each element and, as ``#text``, for each piece of text (white space collapsed, blank ones left out).

    Null and empty pages have no rows. Pages are read one by one, whole; batches end after the page that brings them to ``rows`` rows.
    """

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                out += ((page, *r) for r in read(text.as_py() or ""))
                if len(out) >= rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SCHEMA)], schema=SCHEMA)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SCHEMA)], schema=SCHEMA)

    return pages.select(F.col(page_id).cast("long"), F.col(html).cast("string")).mapInArrow(parsed, TYPES)


def marked(rows: DataFrame, chosen: dict[str, Column]) -> DataFrame:
    """The rows with a column for each selection: the place of its outermost element that a row is or is in; null outside of all.

    An element is outermost if no earlier chosen one ends after it begins. Two running values a selection, all over one order of a page's rows.
    """
    order = Window.partitionBy("page").orderBy("at")
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumns({f"_end_{n}": F.max(F.when(c, F.col("until"))).over(before) for n, c in chosen.items()})
    outer = {n: F.when(c & F.coalesce(F.col("at") > F.col(f"_end_{n}"), F.lit(True)), F.struct("at", "until")) for n, c in chosen.items()}
    last = ends.withColumns({f"_last_{n}": F.last(o, ignorenulls=True).over(so_far) for n, o in outer.items()})
    return last.select(*rows.columns, *(F.when(F.col("at") <= F.col(f"_last_{n}.until"), F.col(f"_last_{n}.at")).alias(n) for n in chosen))


def outermost(rows: DataFrame, chosen: Column) -> DataFrame:
    """The chosen elements that are in no other chosen one."""
    return marked(rows, {"_owner": chosen}).where(F.col("_owner") == F.col("at")).drop("_owner")


#: Classes of cards and of grids of logos, parts of pages that hold no items, names of images that name nothing, and words that no company's heading holds.
CARDS = r"(?i)(?:^|[\s_-])(?:card|cards?-item|portfolio-item|company|company-card|member|member-card|team-member|person|vc_column_container)(?:$|[\s_-])"
GRIDS = r"(?i)logo-grid|portfolio-grid|company-grid|partner-grid|client-grid|logos|(?:^|\s)grid(?:$|\s)"
FRAME = ["nav", "footer", "header", "aside", "form"]
NAMELESS = ["logo", "image", "img", "icon", "photo", "picture", "banner"]
NO_COMPANY = ["invest", "portfolio", "our ", "the ", "team", "about", "news", "contact", "home", "menu", "navigation", "realizzate", "impostazioni", "private equity"]


def company_heading(text: Column) -> Column:
    """Whether a heading reads as a company's name: 3 to 60 characters, at most five words, a capital first, none of the words that head other things."""
    low = F.lower(text)
    other = F.lit(False)
    for w in NO_COMPANY:
        other = other | F.contains(low, F.lit(w))
    return F.char_length(text).between(3, 60) & (F.size(F.split(text, r"\s+")) <= 5) & F.rlike(text, F.lit(r"^\p{Lu}")) & ~other


def items(rows: DataFrame) -> DataFrame:
    """page, family, at, name, link, image, cells: what pages list, by family.

    ``card``: outermost cards (articles and elements of a card's class), named by their first heading, else first link, else first image. ``logo``: images with a name in grids of logos, those for pages
    without scripts included, the first of a name. ``heading``: headings of level 2 to 4 outside of cards that read as companies, the first of a name. ``row``: rows of tables, named by their first cell.
    ``svg``: titles of drawings. What is in navigation, headers and footers is left out, as are items without a name.

    One pass: rows are ordered by page once, marked, and folded by item.
    """
    a = F.col("attributes")
    chosen = {
        "frame": F.col("tag").isin(FRAME), "card": (F.col("tag") == "article") | F.coalesce(F.rlike(a["class"], F.lit(CARDS)), F.lit(False)), "grid": F.coalesce(F.rlike(a["class"], F.lit(GRIDS)), F.lit(False)),
        "head": F.col("tag").isin(*(f"h{i}" for i in range(1, 7))), "sub": F.col("tag").isin("h2", "h3", "h4"), "anchor": F.col("tag") == "a", "line": F.col("tag") == "tr", "cell": F.col("tag").isin("td", "th"),
        "drawing": F.col("tag") == "svg", "label": F.col("tag") == "title",
    }
    of = lambda family, condition, at: F.when(condition, F.struct(F.lit(family).alias("family"), at.alias("item")))
    families = F.array_compact(
        F.array(
            of("card", F.col("card").isNotNull(), F.col("card")), of("logo", F.col("grid").isNotNull() & (F.col("tag") == "img"), F.col("at")), of("heading", F.col("sub").isNotNull() & F.col("card").isNull(), F.col("sub")),
            of("row", F.col("line").isNotNull(), F.col("line")), of("svg", F.col("drawing").isNotNull() & F.col("label").isNotNull(), F.col("label")),
        )
    )
    in_items = marked(rows, chosen).where("frame is null").withColumn("of", F.explode(families)).select("*", "of.family", "of.item")
    image = (F.col("tag") == "img") & (F.trim(a["alt"]) != "") & ~F.lower(F.trim(a["alt"])).isin(NAMELESS)
    parts = lambda owner: F.sort_array(F.collect_list(F.when(F.col(owner).isNotNull() & F.col("text").isNotNull(), F.struct(F.col(owner).alias("of"), "at", "text"))))
    found = in_items.groupBy("page", "family", "item").agg(
        parts("head").alias("heads"), parts("anchor").alias("anchors"), parts("cell").alias("cells"), F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("at", "text")))).alias("texts"),
        F.min_by(F.trim(a["alt"]), F.when(image, F.col("at"))).alias("alt"), F.min_by(a["href"], F.when((F.col("tag") == "a") & a["href"].isNotNull(), F.col("at"))).alias("link"),
        F.min_by(F.coalesce(a["data-src"], a["src"]), F.when(F.col("tag") == "img", F.col("at"))).alias("image"), F.array_sort(F.collect_set(F.when(chosen["cell"], F.col("at")))).alias("places"),
    )
    joined = lambda xs: F.nullif(F.array_join(F.transform(xs, lambda x: x["text"]), " "), F.lit(""))
    first = lambda c: joined(F.filter(c, lambda x: x["of"] == F.try_element_at(F.col(c) if isinstance(c, str) else c, F.lit(1))["of"]))
    each = F.transform("places", lambda p: F.coalesce(joined(F.filter("cells", lambda x: x["of"] == p)), F.lit("")))
    family = F.col("family")
    name = F.when(family == "card", F.coalesce(first("heads"), first("anchors"), F.col("alt"))).when(family == "logo", F.col("alt")).when(family == "row", F.nullif(F.try_element_at(each, F.lit(1)), F.lit(""))).otherwise(joined(F.col("texts")))
    named = found.select("page", "family", F.col("item").alias("at"), name.alias("name"), "link", "image", F.when(family == "row", each).alias("cells")).where("name is not null").where((family != "heading") | company_heading(F.col("name")))
    same = Window.partitionBy("page", "family", F.when(family.isin("logo", "heading"), F.lower("name")).otherwise(F.col("at").cast("string"))).orderBy("at")
    return named.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
