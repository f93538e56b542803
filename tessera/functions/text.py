"""Text functions as column expressions: names, slugs, normalised text, token sets, similarities, extraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sentences

#: Legal endings of company names, stripped up to three times from the end.
LEGAL_ENDINGS = r"s\.?p\.?a\.?|s\.?r\.?l\.?|s\.?a\.?s\.?|s\.?n\.?c\.?|ltd\.?|llc\.?|inc\.?|gmbh\.?|ag\.?|b\.?v\.?|n\.?v\.?|plc\.?|corp\.?|corporation|company|group|gruppo|holding|holdings|partecipazioni"
#: Words that carry no meaning in titles of this field.
STRUCTURAL_WORDS = [
    "sgr", "capital", "partners", "group", "investimenti", "investment", "private", "venture", "fondo", "fund", "equity", "the", "of", "in", "to", "an", "a", "for", "and", "with", "at", "by", "from", "on", "as", "is", "are", "was", "were",
    "be", "been", "has", "had", "have", "will", "that", "this", "it", "its", "or", "so",
]
#: Words of fund types, Italian verbs of deals and function words, which every title of a fund has.
TITLE_WORDS = [
    "sgr", "capital", "partners", "group", "investimenti", "investment", "private", "venture", "fondo", "fund", "equity",
    "rileva", "rilevano", "acquisisce", "acquisizione", "investe", "investimento", "maggioranza", "controllo", "entra", "quota", "nuovo", "nuova", "nuovi",
    "la", "il", "lo", "di", "del", "della", "dello", "dei", "degli", "delle", "da", "per", "con", "un", "una", "uno", "in", "nel", "nella", "al", "alla", "allo", "ai", "e",
    "the", "of", "in", "for", "and", "to", "a", "an", "its", "with", "from", "new", "announces", "announcement",
]
#: Italian words and their English counterparts.
CROSS_LANGUAGE = {
    "investe": "invests", "investimento": "investment", "investimenti": "investments", "rileva": "acquires", "acquisisce": "acquires", "acquisizione": "acquisition", "cede": "sells", "cessione": "sale", "vendita": "sale",
    "venduto": "sold", "venduta": "sold", "chiude": "closes", "chiusura": "closing", "raccolta": "fundraising", "raccoglie": "raises", "lancio": "launch", "nasce": "launches", "lancia": "launches", "uscita": "exit", "fusione": "merger",
    "nomina": "appointment", "partecipazione": "stake", "società": "company", "fondo": "fund", "fondi": "funds", "nuovo": "new", "nuova": "new", "nuovi": "new", "operazione": "deal", "accordo": "agreement", "milioni": "million", "miliardi": "billion",
}
#: Accented letters and their plain forms, for slugs.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿß", "aaaaaaceeeeiiiinooooouuuuyys"


def squash(c: Column) -> Column:
    """Runs of other characters than a-z and 0-9 become one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def norm_company(c: Column) -> Column:
    """Company name for matching: lower case, what is in parentheses, 'logo' and legal endings stripped, then alphanumerics alone."""
    c = F.regexp_replace(F.trim(F.lower(c)), r"\s*\(.*\)", "")
    c = F.regexp_replace(c, r"\s*logo\s*$", "")
    for _ in range(3):
        c = F.trim(F.regexp_replace(c, rf"(?:\s+|,\s*)(?:{LEGAL_ENDINGS})\s*$", ""))
    return squash(F.regexp_replace(c, r"\s+technologies\s*$", ""))


def compact(c: Column) -> Column:
    """Normalised name without spaces."""
    return F.replace(norm_company(c), F.lit(" "), F.lit(""))


def slugify(c: Column) -> Column:
    """Lower case, accents stripped, other characters joined by single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def dedupe_key(c: Column, n: int = 80) -> Column:
    """Title normalised for exact matching, first n characters."""
    return F.left(squash(c), F.lit(n))


def sanitize(c: Column, n: int = 500) -> Column:
    """Markup and control characters out, white space collapsed, cut to n characters."""
    c = F.regexp_replace(c, "<[^>]+>", " ")
    c = F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
    return F.left(F.trim(F.regexp_replace(c, "[ \\t\\r\\n]+", " ")), F.lit(n))


def sentence_cut(c: Column, n: int = 500) -> Column:
    """At most n characters, up to the last full sentence if one ends in the second half; else the cut text."""
    head = F.left(c, F.lit(n))
    whole = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    return F.when(F.char_length(c) <= n, c).when(F.char_length(whole) > n // 2, whole).otherwise(head)


def words(c: Column) -> Column:
    """Distinct words of a normalised text, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(squash(c), " "), lambda w: w != "")))


def content_words(c: Column, without: list[str] = STRUCTURAL_WORDS) -> Column:
    """Words without the structural ones."""
    return F.array_except(words(c), F.array(*map(F.lit, without)))


def to_english(ws: Column) -> Column:
    """Words mapped across languages."""
    pairs = F.create_map(*(F.lit(x) for kv in CROSS_LANGUAGE.items() for x in kv))
    return F.array_sort(F.array_distinct(F.transform(ws, lambda w: F.coalesce(F.element_at(pairs, w), w))))


def overlap(a: Column, b: Column) -> Column:
    """Common words over the smaller set; null if either is empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Common over all words; 0 for two empty sets."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def letters(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))


def similarity(a: Column, b: Column) -> Column:
    """Name similarity: 1 if equal; if one holds the other 0.95 times the ratio of lengths; else 0.4 letters' and 0.6 words' Jaccard."""
    a, b = F.lower(a), F.lower(b)
    short, long = F.least(F.char_length(a), F.char_length(b)), F.greatest(F.char_length(a), F.char_length(b))
    split = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda x: x != ""))
    mixed = 0.4 * jaccard(letters(a), letters(b)) + 0.6 * jaccard(split(a), split(b))
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), short / long * 0.95).otherwise(mixed)


def redundant(summary: Column, title: Column) -> Column:
    """Whether a summary adds nothing to its title: equal, or one holds the other and is hardly longer."""
    s, t = squash(summary), squash(title)
    return (s == t) | ((F.contains(s, t) | F.contains(t, s)) & (F.abs(F.char_length(s) - F.char_length(t)) <= 20))


def hashtags(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("#([A-Za-z0-9_]+)"), 1)


def mentions(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("@([A-Za-z0-9_.]+)"), 1)


def humanise(c: Column) -> Column:
    """Source identifiers as names: separators become spaces, words start upper case."""
    return F.initcap(F.regexp_replace(c, "[-_]+", " "))


def stop_word_share(c: Column, stop: list[str]) -> Column:
    """Share of a text's words that are in a stop list: language scoring."""
    ws = F.filter(F.split(F.lower(c), "[^a-zà-ÿ]+"), lambda w: w != "")
    return F.coalesce(F.size(F.filter(ws, lambda w: w.isin(stop))) / F.nullif(F.size(ws), F.lit(0)), F.lit(0.0))


def once_per_sentence(c: Column, share: float = 0.6) -> Column:
    """Sentences of which at least ``share`` of the words, or 0.3 if they are Italian, occurred in sentences kept before are dropped, but
    for those under three words; the rest joined by full stops. In Arrow batches, as a set of words keeps long texts linear."""

    @F.arrow_udf("string")
    def kept(texts: pa.Array) -> pa.Array:
        return pa.array((sentences.once(t.as_py() or "", share) for t in texts), pa.string())

    return kept(c)


def contexts(c: Column, phrase: str, width: int = 60) -> Column:
    """Occurrences of a phrase, in any case, with up to ``width`` characters on both sides; contexts may overlap. A null text has none."""
    import re

    found = re.compile(rf"\b(?:{phrase})\b", re.IGNORECASE)

    @F.arrow_udf("array<string>")
    def around(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            t = t.as_py() or ""
            out.append([t[max(0, m.start() - width) : m.end() + width] for m in found.finditer(t)])
        return pa.array(out, pa.list_(pa.string()))

    return around(c)
