"""HTML as column expressions: text, links, headings, embedded JSON-LD and application state."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def page_text(html: Column) -> Column:
    """Text without comments, scripts, styles, navigation, footers and tags; white space collapsed."""
    c = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?is)<(script|style|nav|footer)[^>]*>.*?</(script|style|nav|footer)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"[ \t\r\n]+", " "))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), 1)


def headings(html: Column, level: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(f"(?s)<h{level}[^>]*>(.*?)</h{level}>"), 1)


def json_ld(html: Column, schema: str) -> Column:
    """All embedded JSON-LD documents parsed by a schema; malformed ones are null."""
    found = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), 1)
    return F.transform(found, lambda x: F.from_json(x, schema))


def app_state(html: Column) -> Column:
    """The page's embedded application state as a variant; null if absent or malformed."""
    return F.try_parse_json(F.nullif(F.regexp_extract(html, r'(?is)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), F.lit("")))


def at_path(state: Column, path: str, kind: str = "string") -> Column:
    """A value at a dotted path."""
    return F.try_variant_get(state, "$." + path, kind)


def items(html: Column) -> Column:
    """Names on cards, logos and list entries: figure captions, image alternatives and list items, in that order, distinct and not blank."""
    found = F.flatten(F.array(*(F.regexp_extract_all(html, F.lit(p), 1) for p in (r"(?is)<figcaption[^>]*>\s*([^<]+?)\s*</figcaption>", r'(?is)<img[^>]*\balt="([^"]+)"', r"(?is)<li[^>]*>\s*(?:<a[^>]*>)?\s*([^<]+?)\s*<"))))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))


def array_under(data: object, keys: Sequence[str]) -> list | None:
    """The first list that isn't empty under a key that holds one of ``keys``: an object's own keys first, then the objects in it, in order."""
    todo = [data]
    while todo:
        x = todo.pop(0)
        if not isinstance(x, dict):
            continue
        for k, v in x.items():
            if isinstance(v, list) and v and any(key in k.lower() for key in keys):
                return v
        todo[:0] = [v for v in x.values() if isinstance(v, dict)]
    return None


def found_array(state: Column, keys: Sequence[str]) -> Column:
    """The elements, as JSON texts, of the list that ``array_under`` finds in a JSON text; null if there is none or the text is malformed."""
    keys = list(keys)

    @F.arrow_udf("array<string>")
    def search(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            try:
                got = array_under(json.loads(t.as_py() or "null"), keys)
            except ValueError:
                got = None
            out.append(None if got is None else [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in got])
        return pa.array(out, pa.list_(pa.string()))

    return search(state)
