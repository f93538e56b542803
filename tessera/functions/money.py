"""Amounts as column expressions: parsing, labels, slider stops."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_amount(c: Column) -> Column:
    """Amounts such as '1,5 Bln Euro' or '250 mln' in units; null where none is found. A comma is a decimal mark if at most two digits follow."""
    text = F.lower(c)
    raw = F.regexp_extract(text, r"([0-9]+(?:[.,][0-9]+)*)", 1)
    number = F.replace(F.when(F.rlike(raw, F.lit(r",[0-9]{1,2}$")), F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(raw, F.lit(","), F.lit(""))), F.lit(" "), F.lit(""))
    scale = F.when(F.rlike(text, F.lit(r"[0-9]\s*(bln|billion|mld|miliardi|b\b)")), 1e9).when(F.rlike(text, F.lit(r"[0-9]\s*(mln|million|milioni|m\b)")), 1e6).when(F.rlike(text, F.lit(r"[0-9]\s*(k\b|thousand|mila)")), 1e3).otherwise(1.0)
    return F.when(raw != "", number.try_cast("double") * scale)


def max_amount_millions(c: Column) -> Column:
    """Largest amount in a text, in millions; 0 if there is none."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"([0-9]+(?:\.[0-9]+)?)\s*(?:m\b|mln|million|milioni)"), 1)
    return F.coalesce(F.array_max(F.transform(found, lambda x: x.try_cast("double"))), F.lit(0.0))


def label(c: Column) -> Column:
    """Short label: T, B, M or K; from ten on floored, below with one decimal unless whole."""

    def scaled(x: Column, s: str) -> Column:
        whole = (x >= 10) if s != "K" else F.lit(False)
        text = F.when(whole, F.format_string("%d", F.floor(x))).when(x % 1 == 0, F.format_string("%d", F.floor(x))).otherwise(F.format_string("%.1f", x))
        return F.concat(F.lit("€"), text, F.lit(s))

    return F.when(c >= 1e12, scaled(c / 1e12, "T")).when(c >= 1e9, scaled(c / 1e9, "B")).when(c >= 1e6, scaled(c / 1e6, "M")).when(c >= 1e3, scaled(c / 1e3, "K")).otherwise(F.concat(F.lit("€"), F.floor(c).cast("string")))


def stops(top: Column) -> Column:
    """Slider stops up to a maximum, which is the last."""
    fixed = F.array(*(F.lit(float(b * m)) for m in (10**6, 10**9, 10**12) for b in (10, 25, 50, 100, 250, 500)))
    low = F.concat(F.array(F.lit(0.0)), F.filter(fixed, lambda x: x <= top))
    return F.when(F.array_max(low) < top, F.concat(low, F.array(top))).otherwise(low)


def nearest_stop(stop: Column, value: Column) -> Column:
    """Index (from 0) of the stop nearest to a value, the first of equals."""
    gaps = F.transform(stop, lambda x: F.abs(x - value))
    return F.array_position(gaps, F.array_min(gaps)) - 1


def parse_stake(c: Column) -> Column:
    """A share in percent; null if none is given."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin("n.a.", "-", ""), F.trim(F.regexp_replace(c, "[%<>]", "")).try_cast("double"))


def co_investors(c: Column) -> Column:
    """Names between commas or semicolons; null if there is none."""
    found = F.filter(F.transform(F.split(c, "[,;]"), lambda x: F.trim(x)), lambda x: ~x.isin("", "-"))
    return F.when(~F.trim(c).isin("", "-") & (F.size(found) > 0), found)
