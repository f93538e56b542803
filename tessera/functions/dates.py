"""Free-text dates as column expressions. Operators that depend on the present take ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names and their numbers.
MONTHS = {
    "gennaio": "01", "febbraio": "02", "marzo": "03", "aprile": "04", "maggio": "05", "giugno": "06", "luglio": "07", "agosto": "08", "settembre": "09", "ottobre": "10", "novembre": "11", "dicembre": "12",
    "january": "01", "february": "02", "march": "03", "april": "04", "may": "05", "june": "06", "july": "07", "august": "08", "september": "09", "october": "10", "november": "11", "december": "12",
    "jan": "01", "feb": "02", "mar": "03", "apr": "04", "jun": "06", "jul": "07", "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12", "gen": "01", "mag": "05", "giu": "06", "lug": "07", "ago": "08", "set": "09", "ott": "10", "dic": "12",
}


def parse(c: Column, as_of: Column) -> Column:
    """ISO, dd.mm.yyyy, 'dd month yyyy' and 'month dd, yyyy' (English, Italian), 'n days ago', today and yesterday. Null unless the
    year is 2000 or later and the date at most seven days after ``as_of``."""
    t = F.trim(F.lower(c))
    month = F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv))
    part = lambda p, i: F.regexp_extract(t, p, i)
    made = lambda y, m, d: F.concat_ws("-", y, m, F.lpad(d, 2, "0")).try_cast("date")
    iso, dotted = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", r"^([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{4})$"
    dmy, mdy, ago = r"^([0-9]{1,2})\s+([a-z]+)\.?,?\s+([0-9]{4})$", r"^([a-z]+)\.?\s+([0-9]{1,2}),?\s+([0-9]{4})$", r"^([0-9]+)\s+(?:days?|giorni|giorno)\s+(?:ago|fa)$"
    d = F.coalesce(
        part(iso, 1).try_cast("date"), made(part(dotted, 3), F.lpad(part(dotted, 2), 2, "0"), part(dotted, 1)), made(part(dmy, 3), F.element_at(month, part(dmy, 2)), part(dmy, 1)), made(part(mdy, 3), F.element_at(month, part(mdy, 1)), part(mdy, 2)),
        F.date_sub(as_of, part(ago, 1).try_cast("int")), F.when(t.isin("today", "oggi"), as_of), F.when(t.isin("yesterday", "ieri"), F.date_sub(as_of, 1)),
    )
    return F.when((F.year(d) >= 2000) & (d <= F.date_add(as_of, 7)), d)


def effective(published: Column, observed: Column, penalty: str = "1 hour") -> Column:
    """Published time, else observed time less a penalty."""
    return F.coalesce(published, observed - F.expr(f"INTERVAL {penalty}"))
