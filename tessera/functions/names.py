"""Names of portfolio entries: cleaning of scraping artefacts, and the rules by which an entry isn't a company."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sectors that are no companies.
SECTOR_NAMES = [
    "consumer & leisure", "consumer", "consumer goods", "consumer products", "industrials & energy transition", "industrials", "industrial", "tmt", "technology", "tech", "digital", "business services", "services",
    "professional services", "healthcare", "health", "life sciences", "financial services", "finance", "financials", "energy", "energy transition", "renewables", "infrastructure", "infra", "media & telecom", "telecom",
    "telecommunications", "media", "real estate", "property", "education", "food & beverage", "private equity", "venture capital", "esg", "impact investing", "pri", "unpri", "other", "credit", "equity", "real assets",
]
#: Single words of editorial pages.
EDITORIAL_WORDS = ["acquisitions", "acquisition", "insights", "insight", "investments", "investment", "announcements", "announcement", "news", "newsroom", "podcast", "resources"]
#: Endings of fund names, and of a fund's other entities.
FUND_ENDINGS = r"\b(sgr|s\.?g\.?r\.?|capital|partners|investimenti|advisory|management|group|holding|fund|alternative funds|real estate)\b"
OWN_ENDINGS = r"(?i)\s+(?:asset\s+management|sgr|holding|venture\s+partners|circle)\s*(?:s\.?p\.?a\.?)?$"
#: Patterns of texts that are no names, each with the reason it gives, in order.
TEXT_PATTERNS = [
    ("logo", r"(?i)^Logo\s"),
    ("subtitle", r":\s*.{11,}"),
    ("long_parenthesis", r"\([^)]{21,}\)"),
    ("label", r"^[A-Z]+:$"),
    ("article", r"(?i)^[A-Z][a-z]+ing\s+(?:on|in|into|with|for|new|big|the|a|an)\s"),
    ("article", r"(?i)^[A-Z][a-z]+ing\s+\w+\s+\w*\s*(?:with|for|in|into)\s"),
    ("article", r"(?i)^[A-Z][a-z]+ing\s+.+\b(?:across|through|throughout|toward|towards|via|among|between)\b"),
    ("description", r"(?i)^(?:A\s+)?leading\s+"),
    ("description", r"(?i)^(?:Global|World|European|Italian?)\s+leader\s+"),
    ("description", r"(?i)^One of the\s+"),
    ("description", r"(?i)\bis (?:a|the|one of)\b"),
    ("heading", r"(?i)^Investimenti\s"),
    ("editorial", r"(?i)\bfeatured\s+on\b"),
    ("editorial", r"(?i)\bpodcast\b"),
    ("editorial", r"(?i)^The\s+\w+\s+of\s+the\s+"),
]
GLUED = r"portfolio|company|companies|invest(?:ment|ing)|ourport|insight|acquisit|announc|podcast|news|press"
GENERIC_REST = r"^(investment|capital|partners|management|im |group|advisory|sgr|holding|fund|real estate|alternative)"
#: Headings and controls of pages; a site's further ones are the parameter ``headings``.
HEADINGS = [
    "page not found", "click here", "logout", "what we do", "about us", "contact us", "home", "menu", "search", "privacy policy", "cookie policy", "work with us", "awards", "governance", "sustainability", "compliance", "people",
    "employees", "back to top", "portfolio", "current portfolio", "our portfolio", "our companies", "homepage", "portafoglio", "contatti", "fondi", "chi siamo", "who we are", "next", "previous", "read more", "learn more", "video", "mission", "vision",
]
NAVIGATION = r"(?i)^(?:powered by|vai alla|stay tuned|error page|cookie|strictly necessary|download\b|login\b|torna alla|team\s+\w+$|fondo\s+)|\.(?:pdf|jpe?g|png|gif|svg|webp)$|\?\s*$|:\s*$|_$|\d{2,4}x\d{2,4}|\blogo\b|^[0-9a-f]{8}[\s-][0-9a-f]{4}"


def clean_portfolio_name(c: Column) -> Column:
    """A raw entry without what scraping left on it: logo, promotional and piped endings, a last full stop or underscores."""
    c = F.regexp_replace(F.trim(c), r"(?i)\s+logo$", "")
    c = F.regexp_replace(c, r"(?i)\s*\|\s*(?:Invested by|Formerly)\s+.+$", "")
    c = F.regexp_replace(c, r"(?i)\s*\|\s*\w+\s+(?:SGR|subsidiary)\b.*$", "")
    c = F.regexp_replace(F.regexp_replace(F.trim(c), r"^\s*\|\s*", ""), r"\s*\|\s*$", "")
    head = F.trim(F.substring_index(c, "|", 1))
    c = F.when(F.contains(c, F.lit("|")) & (F.char_length(head) >= 3), head).otherwise(c)
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\.\s*$", ""), "_+$", ""))


def plain(c: Column) -> Column:
    """Lower case, letters, digits and white space alone."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""))


def core(c: Column) -> Column:
    """A name without the endings of fund names."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, FUND_ENDINGS, "")), r"\s+", " "))


def starts_whole(long: Column, short: Column) -> Column:
    """Whether the longer name begins with the shorter, at a word's or number's border."""
    after = F.substring(long, F.char_length(short) + 1, F.lit(1))
    return (F.char_length(long) > F.char_length(short)) & F.startswith(long, short) & F.rlike(after, F.lit("[ 0-9]"))


def entry_reason(name: Column, fund_slug: Column, headings: Sequence[str] = HEADINGS) -> Column:
    """Why a portfolio entry is no company of the fund; null if it may be one. The first rule that holds gives the reason."""
    t = F.trim(name)
    low, bare = F.lower(t), plain(t)
    fund = F.lower(F.replace(fund_slug, F.lit("-"), F.lit(" ")))
    of_fund, of_entry, first = core(fund), core(bare), F.substring_index(fund, " ", 1)
    one_word, squeeze = ~F.contains(t, F.lit(" ")), lambda c: F.replace(c, F.lit(" "), F.lit(""))
    rest = F.trim(F.substring(bare, F.char_length(first) + 1, F.char_length(bare) + 1))
    behind = plain(F.regexp_replace(t, r"(?i)^gruppo\s+", ""))
    before = plain(F.regexp_replace(t, OWN_ENDINGS, ""))
    rules = [("empty", F.coalesce(F.char_length(t), F.lit(0)) <= 2), ("long", F.char_length(t) > 60)]
    rules += [(why, F.rlike(t, F.lit(p))) for why, p in TEXT_PATTERNS]
    rules += [
        ("editorial", one_word & low.isin(EDITORIAL_WORDS)),
        ("sector", low.isin(SECTOR_NAMES)),
        ("glued", one_word & (F.char_length(t) >= 12) & F.rlike(low, F.lit(GLUED))),
        ("navigation", low.isin(list(headings)) | F.rlike(t, F.lit(NAVIGATION))),
        ("fund", (bare == fund) | (squeeze(bare) == squeeze(fund))),
        ("fund", (F.char_length(of_fund) >= 2) & (of_entry == of_fund)),
        ("fund", (F.char_length(of_fund) >= 3) & starts_whole(of_entry, of_fund)),
        ("fund", (F.char_length(of_entry) >= 3) & starts_whole(of_fund, of_entry)),
        ("fund", (F.char_length(first) >= 3) & F.startswith(bare, first) & F.rlike(rest, F.lit(GENERIC_REST))),
        ("fund", F.rlike(t, F.lit(r"(?i)^gruppo\s+")) & (F.char_length(of_fund) >= 3) & F.contains(behind, of_fund)),
        ("fund", F.rlike(t, F.lit(OWN_ENDINGS)) & (F.char_length(first) >= 3) & (F.contains(before, of_fund) | F.contains(of_fund, before))),
    ]
    out = F.when(rules[0][1], rules[0][0])
    for why, holds in rules[1:]:
        out = out.when(holds, why)
    return out


#: Words that end names of companies and funds.
COMPANY_WORDS = [
    "capital", "partners", "partner", "ventures", "venture", "equity", "group", "holdings", "holding", "management", "advisors", "advisor", "dynamics", "investments", "investment", "fund", "sgr", "spa", "srl", "ag", "sa", "inc", "ltd",
]
#: Words in lower case that begin no name.
SMALL = ["a", "an", "and", "at", "by", "for", "from", "in", "il", "la", "le", "of", "on", "the", "to", "with"]
PHRASE = r"\b(?:[A-Z][A-Za-zÀ-ÖØ-öø-ÿ'’.\-]+|[A-Z]{2,6})(?:\s+(?:[A-Z][A-Za-zÀ-ÖØ-öø-ÿ'’.\-]+|[A-Z]{2,6})){1,5}\b"


def company_phrases(text: Column) -> Column:
    """Capitalised phrases of two words or more that hold a word of company names, each once in any case, in order; none begins with a small word."""
    strip = lambda x: F.regexp_replace(F.regexp_replace(x, r"^[ ,.;:()\[\]{}]+|[ ,.;:()\[\]{}]+$", ""), r"\s{2,}", " ")
    ws = lambda x: F.transform(F.split(x, " "), lambda w: F.lower(F.regexp_replace(w, r"^[ ,.;:()\[\]{}]+|[ ,.;:()\[\]{}]+$", "")))
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PHRASE), 0), strip)
    named = F.filter(found, lambda x: (F.char_length(x) >= 4) & (F.size(F.split(x, " ")) >= 2) & ~F.element_at(ws(x), 1).isin(SMALL) & F.arrays_overlap(ws(x), F.array(*map(F.lit, COMPANY_WORDS))))
    return F.filter(named, lambda x, i: F.array_position(F.transform(named, lambda y: F.lower(y)), F.lower(x)) == i + 1)


def recapitalised(text: str | None, names: Sequence[str | None] | None) -> str | None:
    """A text with known names written as they are, longer names first; tokens in capitals stay, and nothing capitalised is made small."""
    if not text or not names:
        return text
    order = sorted({n.strip().lower(): n.strip() for n in reversed(names) if n and len(n.strip()) > 1}.values(), key=lambda n: (-len(n), names.index(n) if n in names else 0))
    for name in order:
        def put(m: re.Match, name: str = name) -> str:
            old = m[0]
            keep = (len(old) > 1 and old.isupper() and not name.isupper()) or (old != old.lower() and name == name.lower())
            return old if keep else name

        text = re.sub(rf"(?<!\w){re.escape(name)}(?!\w)", put, text, flags=re.IGNORECASE)
    return text


def capitalise_names(text: Column, names: Column) -> Column:
    """``recapitalised`` as a column, in Arrow batches."""

    @F.arrow_udf("string")
    def put(texts: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array((recapitalised(t.as_py(), n.as_py()) for t, n in zip(texts, lists)), pa.string())

    return put(text, names)
