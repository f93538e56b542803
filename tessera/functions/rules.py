"""Rule tables as column expressions: ordered keyword rules, additive scores, bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: News rules in order; the first with a keyword in the title decides.
NEWS_RULES: tuple[tuple[tuple[str, ...], str], ...] = (
    (("new investment:", "new portfolio"), "deal_announced"),
    (("new exit:",), "exit_announced"),
    (("new team member",), "people_move"),
    (("cookie", "privacy", "gdpr", "terms of service", "terms and conditions"), "noise"),
    (("successivo", "precedente", "pagina", "menu", "contatti", "chi siamo"), "noise"),
    (("governance", "green harvest", "la nostra storia", "i nostri valori"), "noise"),
    (("cede ", "ceduto", "cessione", "dismette", "disinveste", "vendita di", "vende ", "ha venduto"), "exit_announced"),
    (("exit", "exits", "sale of", "sold", "ipo", "divest", "divestment", "listing"), "exit_announced"),
    (("acquisisce", "acquisizione", "rileva", "rilevato", "investe in", "entra nel capitale", "prende il controllo"), "deal_announced"),
    (("acquisition", "acquire", "portfolio company", "deal", "transaction", "minority stake", "majority stake"), "deal_announced"),
    (("fund raise", "fundraise", "raising", "close", "closing", "commit", "committed"), "fundraise_announced"),
    (("nomina", "nominato", "entra nel team", "nuovo partner", "nuovo direttore"), "people_move"),
    (("appoint", "appointed", "join", "joins", "joined", "welcome", "welcomes"), "people_move"),
    (("lavora con noi", "posizione aperta", "cerchiamo", "selezione", "recruiting"), "job_posting"),
    (("hiring", "job opening", "career", "careers", "vacancy", "we're looking", "open position", "open role"), "job_posting"),
)


def any_of(text: Column, keys: Sequence[str]) -> Column:
    """Whether a text holds one of the keywords."""
    found = F.contains(text, F.lit(keys[0]))
    for k in keys[1:]:
        found = found | F.contains(text, F.lit(k))
    return found


def first_rule(text: Column, rules: Sequence[tuple[Sequence[str], str]], default: str) -> Column:
    """The label of the first rule with a keyword in the text."""
    out = F.when(any_of(text, rules[0][0]), rules[0][1])
    for keys, label in rules[1:]:
        out = out.when(any_of(text, keys), label)
    return out.otherwise(default)


def news_type(title: Column) -> Column:
    """Type of a news title; titles under 20 characters or of one word are noise."""
    t = F.trim(F.lower(title))
    return F.when((F.char_length(t) < 20) | ~F.contains(t, F.lit(" ")), "noise").otherwise(first_rule(t, NEWS_RULES, "other"))


def every_label(text: Column, rules: Sequence[tuple[Sequence[str], str]]) -> Column:
    """All labels with a keyword in the text, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(any_of(text, k), label) for k, label in rules)))))


def score(*terms: Column) -> Column:
    """Sum of terms within 0 to 100."""
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.least(F.greatest(total, F.lit(0)), F.lit(100))


def if_then(condition: Column, points: float) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0))


def band(value: Column, bands: Sequence[tuple[float, object]], default: object) -> Column:
    """The value of the first lower bound reached; bounds descend."""
    out = F.when(value >= bands[0][0], F.lit(bands[0][1]))
    for low, got in bands[1:]:
        out = out.when(value >= low, F.lit(got))
    return out.otherwise(F.lit(default))


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, name) for c, name in pairs)))
