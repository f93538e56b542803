"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track visits.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid gclsrc dclid msclkid _ga _gl _hsenc _hsmi mc_cid mc_eid ref source s t".split()
#: Last path segments of listing pages.
LISTING = ("news", "press", "blog", "portfolio", "team", "insights", "media", "index.html")


def scheme(c: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(c, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit("")), F.lit("https"))


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def port(c: Column) -> Column:
    return F.regexp_extract(c, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:]*:([0-9]+)", 1)


def path(c: Column) -> Column:
    """Path with single slashes, no trailing one; the root is '/'."""
    raw = F.regexp_replace(F.regexp_extract(c, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+", "/")
    trimmed = F.regexp_replace(raw, "/$", "")
    return F.when(trimmed == "", "/").otherwise(trimmed)


def query(c: Column) -> Column:
    """Parameters without tracking ones, sorted, the first of each name."""
    parts = F.filter(F.split(F.regexp_extract(c, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING))
    return F.concat_ws("&", F.array_sort(parts))


def canonical(c: Column) -> Column:
    """Lower-case scheme and host, no default port, clean path, sorted parameters without tracking, no fragment. Empty for null or empty."""
    p, q = port(c), query(c)
    standard = (p == "") | ((scheme(c) == "http") & (p == "80")) | ((scheme(c) == "https") & (p == "443"))
    whole = F.concat(scheme(c), F.lit("://"), host(c), F.when(standard, "").otherwise(F.concat(F.lit(":"), p)), path(c), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(whole)


def domain(c: Column) -> Column:
    """Host without www. or m."""
    return F.regexp_replace(host(c), r"^(www|m)\.", "")


def variants(c: Column) -> Column:
    """The canonical URL under both schemes and with and without www."""
    rest = F.regexp_replace(canonical(c), r"^https?://(www\.)?", "")
    return F.array(*(F.concat(F.lit(p), rest) for p in ("http://", "http://www.", "https://", "https://www.")))


def last_segment(c: Column) -> Column:
    return F.substring_index(path(c), "/", -1)


def is_listing(c: Column) -> Column:
    """Whether a URL is a listing page: no last segment, or one of the fixed ones."""
    return (last_segment(c) == "") | F.lower(last_segment(c)).isin(*LISTING)
