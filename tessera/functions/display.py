"""Display text: amounts in one notation, spacing, cases, and headlines without what scraping left around them.

All stages are column expressions. They share one form of rewriting, ``rewritten``: a pattern cuts a text into spans and the gaps between them, spans and
gaps are changed by themselves, and the parts are put together again. So a span (an amount, an address, a name) that one stage has settled is no longer open
to the rules for the text around it, and no rule has to mend what another one broke. Null texts stay null, empty ones empty; texts of any length are taken whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Change = Callable[[Column], Column]
#: A stage: what it is for, a pattern, and what takes its place.
Stage = tuple[str, str, str]


def rewritten(c: Column, pattern: str, span: Change | None = None, gap: Change | None = None) -> Column:
    """A text whose matches of a pattern are changed by ``span`` and whose other parts by ``gap``. The pattern mustn't match the empty text."""
    spans, gaps = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)
    spans = F.transform(spans, span) if span else spans
    gaps = F.transform(gaps, gap) if gap else gaps
    return F.array_join(F.zip_with(gaps, spans, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")


def staged(c: Column, stages: Sequence[Stage]) -> Column:
    """A text after all stages, in order."""
    for _, pattern, instead in stages:
        c = F.regexp_replace(c, pattern, instead)
    return c


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s{2,}", " "))


# Amounts

#: Units by their letter, and currencies by their symbol.
UNITS = {"M": ["million", "millions", "milione", "milioni", "mln", "mn", "m"], "B": ["billion", "billions", "miliardo", "miliardi", "mld", "bn", "b"], "K": ["k"], "T": ["t"], "mila": ["mila"]}
CURRENCIES = {"€": ["€", "eur", "euro", "euros", "e"], "$": ["$", "usd", "dollar", "dollars", "dollari"], "£": ["£", "gbp", "sterlina", "sterline"]}
#: Units that speak of euros where no currency is named, numbers in words, and things that are counted in millions without being money.
EURO_UNITS = ["milione", "milioni", "miliardo", "miliardi", "mln", "mld"]
NUMBERS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
COUNTED = "azioni|shares?|unit[àa]?"
LETTER = r"\p{L}"


def either(words: Sequence[str]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


_UNIT = either([u for us in UNITS.values() for u in us])
_BEFORE = r"[€$£]|(?<![\p{L}\d])(?:eur|usd|gbp|euro|(?-i:E))(?=\s*\d)"
_AFTER = rf"(?:[€$£]|(?:{either([w for ws in CURRENCIES.values() for w in ws if len(w) > 1])})(?!{LETTER}))(?!\s?\d)"
#: A number with the currency and the unit around it; bare numbers are spans too, and stay as they are.
AMOUNT = rf"(?i)(?:(?:{_BEFORE})\s*|(?<![\p{{L}}\d.,]))\d+(?:[.,]\d+)*(?:\+?\s*(?:{_UNIT})(?![\p{{L}}\d])(?!\s+(?:{COUNTED})(?!{LETTER})))?(?:\+?\s*(?:di\s+)?{_AFTER})?"
#: What is brought into the form of an amount first.
AMOUNT_STAGES: list[Stage] = [
    *(("a number in words", rf"(?i)\b{w}\s+(?=(?:millions?|milion[ei]|billions?|miliard[io])\s+(?:di\s+)?euros?\b)", f"{i} ") for i, w in enumerate(NUMBERS, 1)),
    ("more than", r"(?i)\boltre\b", "over"), ("about", r"(?i)\bcirca\b", "~"), ("about", r"(?i)\bapproximately\s+of\s+(?=\d)", "approximately "),
    ("a round without a currency", r"(?i)(?<![\p{L}\d.,€$£])(\d+(?:[.,]\d+)?)\s+m(?=\s+(?:funding|investment|round|raise|deal)\b)", "€$1M"),
    ("a unit glued to the next word", rf"([€$£]\s?\d+(?:[.,]\d+)*)(?!(?i:{_UNIT})(?!{LETTER}))([KMBT])(?={LETTER})", "$1$2 "),
    ("tens of millions", r"(?i)\b(tens?|hundreds?|dozens?)\s+of\s+mln\b", "$1 of millions"), ("tens of billions", r"(?i)\b(tens?|hundreds?|dozens?)\s+of\s+mld\b", "$1 of billions"),
    ("tens of millions", r"(?i)\bdecine\s+di\s+(?:mln|milioni)\b", "tens of millions"), ("hundreds of millions", r"(?i)\bcentinaia\s+di\s+mln\b", "hundreds of millions"),
]


def _named(word: Column, table: dict[str, list[str]]) -> Column:
    """The key under which a word is listed; null if under none."""
    out = F.lit(None).cast("string")
    for key, words in table.items():
        out = F.when(word.isin(words), key).otherwise(out)
    return out


def _digits(value: Column) -> Column:
    """Whole values without a decimal mark, others with one place, ties of the exact value to even."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(F.call_function("format_number", value, F.lit("0.0")))


def _plain_number(raw: Column, decimals: Column) -> Column:
    """A number's value. A lone comma before one or two digits is a decimal mark, a lone point before other than three too (before three where ``decimals`` holds); with both marks the last is."""
    one_comma, one_point = F.rlike(raw, F.lit(r"^\d+,\d{1,2}$")), F.rlike(raw, F.lit(r"^\d+\.\d+$"))
    thousands = F.rlike(raw, F.lit(r"^\d+\.\d{3}$")) & ~F.coalesce(decimals, F.lit(False))
    last_comma, last_point = F.rlike(raw, F.lit(r"\..*,\d+$")), F.rlike(raw, F.lit(r",.*\.\d+$"))
    text = F.when(one_comma, F.translate(raw, ",", ".")).when(one_point & ~thousands, raw).when(last_point, F.translate(raw, ",", ""))
    return text.when(last_comma, F.translate(F.translate(raw, ".", ""), ",", ".")).otherwise(F.translate(raw, ".,", "")).try_cast("double")


def _scaled(value: Column, symbol: Column, whole: Column) -> Column:
    """A value in units with its largest letter: thousands floored, values of 100 and more whole where ``whole`` holds."""
    letter = F.when(value >= 1e9, "B").when(value >= 1e6, "M").otherwise("K")
    x = F.when(value >= 1e9, value / 1e9).when(value >= 1e6, value / 1e6).otherwise(F.floor(value / 1e3).cast("double"))
    return F.concat(symbol, F.when((x >= 100) & whole, F.bround(x, 0).cast("long").cast("string")).otherwise(_digits(x)), letter)


def _amount(s: Column) -> Column:
    raw = F.regexp_extract(s, r"(\d+(?:[.,]\d+)*)", 1)
    before, tail = F.lower(F.regexp_extract(s, r"^([^\d\s]+)", 1)), F.lower(F.regexp_extract(s, r"\d\+?\s*([^\d+]*)$", 1))
    word = F.regexp_extract(tail, rf"^({_UNIT})(?!{LETTER})", 1)
    unit = _named(word, UNITS)
    after = _named(F.regexp_extract(tail, r"([€$£]|\p{L}+)$", 1), {k: [w for w in ws if w != "e"] for k, ws in CURRENCIES.items()})
    named = F.coalesce(F.when(after != "€", after), _named(before, CURRENCIES), after)
    symbol = F.coalesce(named, F.when(word.isin(EURO_UNITS), "€"))
    value = _plain_number(raw, unit == "B")
    shown = F.when((unit == "M") & (value >= 1000) & (value < 10000) & (value == F.floor(value)), F.regexp_replace(F.floor(value).cast("string"), r"^(\d)", "$1.")).otherwise(_digits(value))
    in_full = (F.rlike(raw, F.lit(r"^\d{1,3}(?:\.\d{3})+$")) & (after == "€")) | (F.rlike(raw, F.lit(r"^\d{1,3}(?:,\d{3})+$")) & before.isin("€", "$", "£"))
    few = F.rlike(raw, F.lit(r"\.")) & (value >= 1e5) & (value < 1e6)
    return (
        F.when(unit.isin("M", "B", "K", "T") & symbol.isNotNull(), F.concat(symbol, shown, unit))
        .when((unit == "mila") & (symbol.isNotNull()), F.concat(symbol, _digits(value / 1000), F.lit("M")))
        .when(unit.isNull() & in_full & few, F.concat(symbol, _digits(value / 1e6), F.lit("M")))
        .when(unit.isNull() & in_full & F.rlike(raw, F.lit(r"\.")) & (value < 1e5), F.concat(symbol, _digits(value / 1e3), F.lit("K")))
        .when(unit.isNull() & in_full, _scaled(value, symbol, F.contains(raw, F.lit(","))))
        .when(unit.isNull() & before.isin("€"), F.regexp_replace(s, r"^€\s+", "€"))
        .otherwise(s)
    )


def amounts(c: Column) -> Column:
    """A text with its amounts as €1.5M: Italian and English units and numbers, currencies before or behind, numbers in full, words for about and over.

    Each number is read once with what stands around it, so nothing is rewritten twice and a second pass changes nothing. Numbers without a currency stay, but for
    units that are of euros in Italian news (milioni, miliardi, mln, mld). 1000 to 9999 millions are written with a point after the first digit.
    """
    return F.when(F.rlike(c, F.lit(r"[0-9]|(?i:mln|mld|oltre|circa|milion|miliard|million|billion)")), collapsed(rewritten(staged(c, AMOUNT_STAGES), AMOUNT, _amount))).otherwise(collapsed(c))


# Spacing

#: Names whose digits or capitals within are no borders of words.
NAMES = [
    "F2i", "B4i", "CO2", "3i", "K3RX", "E4G", "P101", "T2Y", "B2O", "MiCROTEC", "AAVantgarde", "LVenture", "WSense", "NanoPhoria", "UpSurgeOn", "BeNewtral", "Bee2Link", "BeBeez", "Smart4Tech", "IDeA", "FountainVest", "XGen",
    "SMEs", "SaaS", "AccelerORA", "TeamSystem", "iSPLASH", "TGCom24", "ilsole24ore", "sole24ore", "OpenAI", "UniCredit", "BorgWarner", "InfoCert",
]
#: Small words that scraping glues to the name behind them.
SMALL_WORDS = "di|da|del|dello|della|dei|degli|delle|de|e|ed|la|il|lo|gli|le|al|allo|alla|ai|agli|alle|nel|nello|nella|nei|negli|nelle|sul|sullo|sulla|sui|sugli|sulle|per|con|su|in"
_BORDER = re.compile(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[0-9])(?=[A-Za-z])")
#: Spans that no rule of spacing changes: addresses, amounts, names (in one piece or broken at their inner borders), quarters, ordinals, power.
SETTLED = "|".join(
    [
        r"(?i:https?://|www\.)\S+", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", r"(?i:\b[a-z0-9-]+\.(?:it|com|eu|org|net|info)\b)(?:/\S*)?", r"[€$£]\d+(?:[.,]\d+)*(?:\s?[KMBT](?![\p{L}\d]))?",
        rf"(?<![\p{{L}}\d])(?:{'|'.join(_BORDER.sub(r'\\s?', n) for n in sorted(NAMES, key=len, reverse=True))})(?![\p{{L}}\d])", r"\b[QH]\s?\d(?![\p{L}\d])", r"\b\d+\s?(?i:th|st|nd|rd)\b", r"\b\d+\s?M\s?W\b",
    ]
)
SPACING: list[Stage] = [
    ("digits before letters", r"(?<=\d)(?=\p{L})", " "), ("letters before digits", r"(?<=\p{L})(?=\d)", " "), ("capitals before a word", r"(?<=\p{Lu}{2})(?=\p{Ll})", " "), ("a word before capitals", r"(?<=\p{Ll}{3})(?=\p{Lu}{2,})", " "),
    ("punctuation", r"([,;:])(?=\p{L})", "$1 "), ("decimal commas", r"(?<=\d),\s+(?=\d)", ","), ("small words before names", rf"\b(?:{SMALL_WORDS})(?=\p{{Lu}})", "$0 "), ("words before names", r"(?<=\p{Ll}{3})(?=\p{Lu}\p{Ll})", " "),
    ("glued verbs", r"(?<=\p{L}{4})((?:acquis|annunci|accompagn)\w+|insieme)\b", " $1"), ("glued connectors", r"(?i)\b([a-z]{5,}(?:ment|tion|sion|ship|ness))(for|with|of|in|to|per|con|di)\b", "$1 $2"),
    ("opening quotes", r'(?<=\p{L})(?=["“”])', " "), ("broken small words", r"(?i)\b(de|su|al|del)\s+l\b", "$1l"), ("broken articles", r"(?i)\b(del|al)\s+(la|le|lo)\b", "$1$2"), *(("series", rf"(?i)\bserie\s+{x}\b", f"Series {x.upper()}") for x in "abcdefg"),
    ("legal forms", r"\b[Ss]gr\b", "SGR"), ("legal forms", r"\b[Ss]icaf\b", "SICAF"),
]


def spacing(c: Column) -> Column:
    """A text with spaces where extraction lost them and without those it put into names; addresses, amounts, quarters and ordinals stay whole."""
    known = F.create_map(*(F.lit(x) for n in NAMES for x in (n, n)))

    def settled(s: Column) -> Column:
        whole = F.regexp_replace(s, r"\s", "")
        return F.coalesce(F.try_element_at(known, whole), whole)

    clean = F.replace(F.replace(c, F.lit("â¬€"), F.lit("€")), F.lit("â¬"), F.lit("€"))
    return collapsed(rewritten(clean, SETTLED, settled, lambda g: staged(g, SPACING)))


# Case

#: Words that are small within a headline, and those that are always in capitals.
SMALL = [
    "a", "an", "the", "and", "but", "or", "nor", "for", "yet", "so", "in", "on", "at", "to", "by", "of", "up", "as", "if", "is", "with", "from", "into", "over", "after", "before", "between", "through", "during", "without", "within", "about", "its",
]
CAPITALS = ["sgr", "spa", "srl", "sas", "ceo", "cfo", "coo", "cio", "cto", "ipo", "esg", "ai", "vc", "pe", "lp", "gp", "aum", "eu", "uk", "us", "kkr", "eqt", "dif", "dws", "clm"]


def title_cased(words: Column, share: float = 0.6) -> Column:
    """Whether most words of three or more characters begin with a capital while at most half are all capitals; of at least four words."""
    long = F.filter(words, lambda w: F.rlike(w, F.lit(r"^\p{L}..")))
    upper = lambda p: F.size(F.filter(long, lambda w: F.rlike(w, F.lit(p))))
    return (F.size(words) >= 4) & (F.size(long) >= 3) & (upper(r"^[^\p{Ll}]*$") <= F.size(long) * 0.5) & (upper(r"^\p{Lu}") / F.nullif(F.size(long), F.lit(0)) > share)


def sentence_case(c: Column) -> Column:
    """A headline in which Every Word Has A Capital as a sentence; others stay. Names of mixed case and capitals stay, as do words that follow an end of a sentence or a colon.

    Whether a word begins a sentence depends on the one before and on how that one was taken, so words are folded in order. For headlines: the fold copies what it has.
    """
    words = F.filter(F.split(c, r"\s+", -1), lambda w: w != "")

    def step(at: Column, w: Column) -> Column:
        mark = F.regexp_extract(w, "^([(\"']*)", 1)
        core = F.substr(w, F.char_length(mark) + 1)
        low, letter, ends = F.lower(core), F.rlike(core, F.lit(r"^\p{L}")), F.rlike(w, F.lit("[.!?:]$"))
        fixed = F.rlike(core, F.lit(r"^.+\p{Lu}"))
        out = F.when(~letter, w).when(low.isin(CAPITALS), F.concat(mark, F.upper(core))).when(at["fresh"], w).when(low.isin(SMALL), F.concat(mark, low)).when(fixed, w)
        out = out.otherwise(F.concat(mark, F.lower(F.substr(core, F.lit(1), F.lit(1))), F.substr(core, F.lit(2))))
        fresh = F.when(~letter, ends).when(low.isin(CAPITALS) | at["fresh"] | low.isin(SMALL), False).otherwise(ends)
        return F.struct(F.concat(at["text"], F.when(at["text"] == "", "").otherwise(" "), out).alias("text"), fresh.alias("fresh"))

    folded = F.aggregate(words, F.struct(F.lit("").alias("text"), F.lit(True).alias("fresh")), step, lambda at: at["text"])
    first = F.regexp_extract(folded, r"(?s)^(\P{L}*\p{L})", 1)
    return F.when(title_cased(words), F.concat(F.upper(first), F.substr(folded, F.char_length(first) + 1))).otherwise(c)


# Headlines

_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_SHORT = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_ITALIAN = "Gen|Feb|Mar|Apr|Mag|Giu|Lug|Ago|Set|Ott|Nov|Dic"
#: Papers that are named behind a headline, sectors that stand before a date.
PAPERS = r"IL SOLE 24 ORE|CORRIERE\s+\w+|BEBEEZ|FORBES|BLOOMBERG|REUTERS|FINANCIAL TIMES|MILANO FINANZA|MF[\s-]MILANO FINANZA|LA REPUBBLICA|ITALIA OGGI|MF NEWSWIRES|STARTUPITALIA"
SECTORS = r"Healthcare|Tech(?:nology)?|Business\s+Services|Industrials|Financial\s+Services|Consumer|TMT|Energy"
#: What goes from headlines, in order. No pattern looks around, so DuckDB reads them too.
TITLE_STAGES: list[Stage] = [
    ("link texts", r"(?i)more\s*details\s*$", ""), ("link texts", r"(?i)\s*Approfondisci\s*$", ""), ("link texts", r"(?i)^LEGGI\s+TUTTO\s*", ""), ("link texts", r"(?i)\s*Read\s+more\s*$", ""), ("capitals glued to a word", r"([a-z])([A-Z]{3,})", "$1 $2"),
    ("an addition with its sector", r"(?i)^(.+?)\s+added to\s+.+?\s+portfolio\s*(\([^()]*\))\s*$", "New portfolio addition: $1 $2"), ("an addition", r"(?i)^(.+?)\s+added to\s+.+?\s+portfolio\s*$", "New portfolio addition: $1"),
    ("an addition, Italian", r"(?i)^(.+?)\s+aggiunt[oa]\s+al?\s+portafoglio\s+.+$", "New portfolio addition: $1"), ("press release", r"(?i)^Press\s*release\s*", ""),
    ("a place and a date", rf"(?i)^[A-Z][A-Z\s,]+[–—-]+\s*(?:{_MONTHS}|\d{{1,2}})\s+\d{{1,2}},?\s*\d{{4}}\s*[–—-]+\s*", ""), ("a place and a date", rf"(?i)^[A-Z][A-Z\s,]+,\s+\d{{1,2}}\s+(?:{_MONTHS})\s+\d{{4}}\s*[–—-]+\s*", ""),
    ("a date before", rf"(?i)^\d{{1,2}}\s+(?:{_MONTHS}|{_SHORT})\s+\d{{4}}\s*(?:[|–—-]\s*)?", ""), ("a date before", rf"(?i)^(?:{_SHORT})\s+\d{{1,2}}\s*,\s*\d{{4}}\s*[|–—-]\s*(?:\w+\s+(?:news|update)\s*)?", ""),
    ("an Italian date before", rf"(?i)^(?:[A-ZÀ-Ö][a-zà-ö]+,?\s+)?\d{{1,2}}\s+(?:{_ITALIAN})\.?\s+\d{{4}}\s*", ""), ("a sector and a date behind", rf"(?i)(?:{SECTORS})\s*\d{{1,2}}\s+(?:{_MONTHS})\s+\d{{4}}\s*$", ""),
    ("a date behind", rf"(?:{_MONTHS})\s+\d{{1,2}},?\s*\d{{0,4}}\s*$", ""), ("a date behind", rf"(?i)\s+\d{{1,2}}\s+(?:{_MONTHS})\s+\d{{4}}\s*$", ""), ("a day left behind", r"\s+\d{1,2}\s*$", ""),
    ("a paper", rf"(?i)\s*[–—-]+\s*(?:{PAPERS})\s*$", ""), ("quotes", r'^[“”"]+\s*', ""), ("quotes", r'\s*[“”"]+$', ""), ("spaces", r"\s+$", ""),
]
#: What goes from summaries, in order: marks, reading times, headers of press releases, dates that were added, templates.
TEXT_STAGES: list[Stage] = [
    ("rumours", r"(?i)^\s*\[Rumor\]\s*", ""), ("headers", r"(?i)^Featured\s+News\s+Press\s+Review\s*[:–-]?\s*", ""), ("headers", r"(?i)^Media\s*:\s*[A-Za-zÀ-ɏ]+,?\s+", ""), ("reading times", r"(?i)\b\d+\s*min(?:ute)?s?\.?\s*read\b", ""),
    ("reading times", r"(?i)\b\d+\s*min(?:uto|uti)\s*di\s*lettura\b", ""), ("reading times", r"(?i)\b(?:tempo\s+di\s+lettura|read\s+time)\b", ""), ("added dates", r"(?i)[,.]?\s*(?:announced?|published|reported|observed|noted|dated?|as\s+of)\s+(?:on\s+)?\d{4}-\d{2}-\d{2}\s*\.?\s*$", ""),
    ("added dates", rf"(?i)[,.]?\s*(?:announced?|published|reported|observed|noted|dated?|as\s+of)\s+(?:on\s+)?(?:{_MONTHS})\s+\d{{1,2}},?\s*\d{{4}}\s*\.?\s*$", ""), ("dates left behind", r"(?i)(?:\s+on)?\s+\d{4}-\d{2}-\d{2}\s*\.?\s*$", ""),
    ("dates within", r"(?i)\s+the\s+is\s+dated\s+.{0,30}$", ""), ("dates within", r"(?i),?\s+announced\s+in\s+a\s+dated\s+\d{4}-\d{2}-\d{2}\b[^.]*\.", "."), ("dates within", r"(?i),?\s+in\s+a\s+dated\s+\d{4}-\d{2}-\d{2}\b[^,.]*", ""),
    ("headers within", r"(?i)\s+Media\s*:\s*\w+,\s+[A-Za-z]+\s+\d{1,2}(?:\s*(?:th|st|nd|rd))?,?\s+\d{4}\s*[–—-]+\s*", " "), ("templates", r"(?i)\.\s+New\s+investment\s+involving\s+[^.]{3,80}\.?\s*$", ""), ("spaces", r"\s{2,}", " "), ("full stops", r"\.+\s*$", ""), ("spaces", r"^\s+|\s+$", ""),
]


def headline(c: Column) -> Column:
    """A headline without link texts, dates, places of press releases, papers and quotes; additions to portfolios in one form."""
    return staged(c, TITLE_STAGES)


def summary(c: Column) -> Column:
    """A summary without marks, reading times and added dates, with spaces and amounts put right first."""
    return staged(amounts(spacing(c)), TEXT_STAGES)


def stages_sql(text: str, stages: Sequence[Stage]) -> str:
    """The stages as DuckDB SQL."""
    for _, pattern, instead in stages:
        quoted, there = pattern.replace("'", "''"), re.sub(r"\$(\d)", r"\\\1", instead)
        text = f"regexp_replace({text}, '{quoted}', '{there}', 'g')"
    return text
