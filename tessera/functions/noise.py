"""Texts that are no news: rules in order, each with the reason it gives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of pages' furniture and of items without content.
FURNITURE = [
    r"vai al menu", r"vai al contenuto", r"skip to", r"pagina successiva", r"pagina precedente", r"download pdf", r"read more", r"approfondisci$", r"^leggi", r"cookie", r"privacy policy", r"terms of use", r"©\s*\d{4}", r"all rights reserved",
    r"^menu$", r"^home$", r"^contatti?$", r"^contact$", r"footer", r"header", r"navigation", r"sidebar", r"website update", r"changes detected", r"\bpremio\b", r"\baward\b", r"news list update",
    r"^best\s+[\w\s]{1,35}\s+(?:fund|lbo|pe|vc)\b", r"\bfeatured news press review\b", r"\|\s*deals?\s+com\s+\w", r"^the\s+management\s+team\s+is\s+composed\s+of\s+professionals",
    r"^(?:the\s+)?board\s+of\s+directors?\s+(?:approves?|examines?)\s+(?:the\s+)?(?:net\s+)?financial\s+(?:position|statements?|results?)",
]
#: Words of a site's fixed parts, of lists of companies, and of announcements of little value.
SCAFFOLD = [
    r"\babout us\b", r"\bchi siamo\b", r"\bgovernance\b", r"\bcorporate governance\b", r"\bour (?:companies|portfolio|portfolio companies|activities)\b", r"\bportfolio companies\b", r"\bback to top\b", r"\bsite map\b", r"\bsitemap\b",
    r"\buploads?\b", r"\bdownloads?\b", r"\bnewsletter\b", r"\bsubscribe\b", r"\bfollow us\b",
]
LISTS = [r"\bpartecipata\b", r"\bportfolio\b", r"\bportafoglio\b", r"\bour companies\b", r"\bcurrent portfolio\b", r"\bportfolio companies\b", r"\binvestimenti\s+portfolio\b"]
LOW_VALUE = [
    r"\byear in review\b", r"\bcredit check\b", r"\bmarket update\b", r"\binsight[s]?\b", r"\binterview\b", r"\bpodcast\b", r"\bwebinar\b", r"\bconference\b", r"\bsummit\b", r"\bevent\b", r"\bawards?\b", r"\bbest .* fund\b", r"\bnewsletter\b",
    r"\bwhite paper\b", r"\bpress review\b", r"\bin the press\b", r"\bpress coverage\b", r"\bmission committee report\b",
]
#: Hints at deals and people, which save a text from the three tables above.
HINTS = [
    r"\bacquis\w+\b", r"\binvest\w+\b", r"\bexit\b", r"\bmerg\w+\b", r"\btransaction\b", r"\bdeal\b", r"\bipo\b", r"\bquotazion\w+\b", r"\bfundrais\w+\b", r"\bcloses?\b", r"\bclosing\b", r"\bround\b", r"\bseries\b", r"\baumento di capitale\b",
    r"\bfinanziamento\b", r"\binvestimento\b", r"\bristrutturazion\w+\b", r"\bconcordat\w+\b", r"\bomologa\b", r"\brestructur\w+\b", r"\baccordo di ristrutturazione\b", r"\bentra nel capitale\b", r"\bentra in\b", r"\brileva\b", r"\bacquisizione\b",
    r"\bappoint\w+\b", r"\bjoins?\b", r"\bhired?\b", r"\bpromot\w+\b", r"\bnomin(?:a|at\w+)\b", r"\bpartner\b", r"\bceo\b", r"\bcfo\b", r"\bcoo\b", r"\bcio\b", r"\b(?:lancia|lancio|nasce|launch(?:es|ed)?|new)\b.*\b(?:fondo|fund)\b",
    r"\bfund\s+(?:i|ii|iii|iv|v|vi|vii|viii|\d+)\b", r"\bfondo\s+(?:i|ii|iii|iv|v|vi|vii|viii|\d+)\b", r"\bcarve[\-\s]?out\b", r"\bjoint\s+venture\b", r"\bm&a\b", r"\btakeover\b", r"\bbuyout\b", r"\blbo\b", r"\boperazione\b", r"\bvendita\b",
    r"\bdivest\w+\b", r"\bcessione\b", r"\badd-on\b", r"\bbolt[\-\s]?on\b", r"\boversubscribed\b", r"\bcapital\s+raise\b", r"\bnamed\b", r"\bnew\s+hire\b", r"\bnuovo\s+ingresso\b",
]
AMOUNT = r"€\s*\d+(?:[.,]\d+)?|\$\s*\d+(?:[.,]\d+)?|\b\d+(\.\d+)?\s*(milion|million|mln|m€|bn|billion|miliardi|milioni)\b"
SECTION = r"^(?:investimenti|realizzate|realizzati|operazioni|partecipazioni)\s+(?:fondo|del\s+fondo|gapef|[a-z]+\s+\d)"
WHOLE_LIST = r"\binvestimenti\s+portfolio\b"
#: What announces a deal or exit by its name, and names that are none.
SLOT = r"\bnew (?:portfolio )?(?:investment|exit):?\s*(.+)$"
PLACEHOLDERS = [r"^our activities\b", r"^our latest news\b", r"^our companies\b", r"^our portfolio\b", r"^portfolio companies\b", r"^current portfolio\b", r"^prior investments\b", r"^ourportfoliocompanies\b", r"^portfolio\b"]


def any_of(patterns: list[str]) -> str:
    """One pattern for a table."""
    return "|".join(f"(?:{p})" for p in patterns)


def garbage_reason(text: Column) -> Column:
    """Why a text is no news, the first rule that holds; null if it may be one. A null text is empty."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    has = lambda patterns: F.rlike(t, F.lit("(?U)" + any_of(patterns)))  # noqa: E731  words end at any letter, accented ones too
    hint, amount = has(HINTS), has([AMOUNT])
    listed = F.contains(t, F.lit("|")) | (F.char_length(t) < 90) | has([WHOLE_LIST])
    return (
        F.when(F.char_length(t) < 20, "short")
        .when(has(FURNITURE), "furniture")
        .when(has(SCAFFOLD) & ~hint, "scaffold")
        .when(has(LISTS) & ~hint & ~amount & listed, "list")
        .when(has(LOW_VALUE) & ~hint, "low_value")
        .when(has([SECTION]), "section")
        .when(F.rlike(F.trim(F.regexp_extract(t, "(?d)" + SLOT, 1)), F.lit("(?U)" + any_of(PLACEHOLDERS))), "placeholder")
    )
