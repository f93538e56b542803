"""Judgements on funds and signals: geographic scope and relevance, evidence and confidence, trust in sources, categories of funds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of places, by which a fund's scope is told.
ITALIAN_REGIONS = [
    "lombardia", "lombardy", "veneto", "emilia-romagna", "emilia romagna", "piemonte", "piedmont", "toscana", "tuscany", "lazio", "campania", "puglia", "sicilia", "sicily", "sardegna", "sardinia", "liguria", "marche", "friuli-venezia giulia",
    "friuli venezia giulia", "abruzzo", "calabria", "umbria", "basilicata", "molise", "trentino-alto adige", "trentino alto adige", "valle d'aosta", "friuli",
]
EUROPE = ["europe", "italy", "france", "germany", "spain", "switzerland", "united kingdom", "uk", "benelux", "serbia"]
OUTSIDE = ["worldwide", "north america", "south america", "latin america", "usa", "canada", "asia", "asia pacific", "asia-pacific", "australia", "middle east", "brazil", "egypt", "morocco", "vietnam"]
LEGAL_FORM = r"(?i)\b(sgr|sicaf|sicav|sim)\b"
#: Types whose signals count most, and sites of the trade press.
CORE_TYPES = ["deal_announced", "exit_announced", "fundraise_announced", "fundraise_closed", "fund_launch"]
NEWS_SITES = [
    "bebeez.it", "financecommunity.it", "ilsole24ore.com", "startupitalia.eu", "milanofinanza.it", "reuters.com", "bloomberg.com", "corriere.it", "repubblica.it", "ansa.it", "dealflower.com", "privateequityitalia.it", "mergermarket.com", "pitchbook.com",
]


def geo_scope(geographies: Column, headquarters: Column, name: Column, slug: Column) -> Column:
    """italy_focused, europe_wide, mixed_or_global or unknown: by the fund's geographies and legal form; without geographies by its seat; else by its slug."""
    geos = F.filter(F.transform(F.coalesce(geographies, F.array().cast("array<string>")), lambda g: F.trim(F.lower(g))), lambda g: g.isNotNull() & (g != ""))
    local_form = F.coalesce(F.rlike(name, F.lit(LEGAL_FORM)), F.lit(False))
    some = lambda places: F.arrays_overlap(geos, F.array(*map(F.lit, places)))
    italy, region = some(["italy"]), some(ITALIAN_REGIONS)
    by_geos = (
        F.when(some(OUTSIDE), "mixed_or_global").when((italy | region) & local_form, "italy_focused").when(region & ~italy, "italy_focused").when(italy & (F.size(geos) == 1), "italy_focused").when(italy, "europe_wide")
        .when(local_form, "italy_focused").when(some(EUROPE), "europe_wide").otherwise("mixed_or_global")
    )
    seat, s = F.trim(F.lower(F.coalesce(headquarters, F.lit("")))), F.lower(F.coalesce(slug, F.lit("")))
    home = seat.isin([*ITALIAN_REGIONS, "italy"])
    by_seat = F.when(home & local_form, "italy_focused").when(home | seat.isin(EUROPE), "europe_wide")
    by_slug = F.when(F.contains(s, F.lit("sgr")) | F.contains(s, F.lit("italy")) | F.contains(s, F.lit("italia")), "italy_focused").when(F.contains(s, F.lit("europe")), "europe_wide")
    return F.when(F.size(geos) > 0, by_geos).otherwise(F.coalesce(by_seat, by_slug, F.lit("unknown")))


def geo_relevant(scope: Column, kind: Column, evidence: Column, flagged: Column, abroad: Column, own_team: Column) -> Column:
    """Whether a signal counts for a fund of a scope. ``evidence``: its text, reasons or places name the country; ``flagged``: a flag that rests on
    evidence; ``abroad``: it names places outside the continent; ``own_team``: it is of the team page of a fund of local legal form."""
    return F.when(evidence | own_team, True).when(scope == "italy_focused", flagged | kind.isin(CORE_TYPES) | ~abroad).when(scope.isin("europe_wide", "mixed_or_global"), False).otherwise(flagged & kind.isin(CORE_TYPES))


def evidence_score(*evidence: Column) -> Column:
    """How many kinds of evidence there are: entity, amount, date, word of a deal, launch of a fund, core type."""
    out = F.lit(0)
    for e in evidence:
        out = out + F.when(e, 1).otherwise(0)
    return out


def confidence_band(kind: Column, senior: Column, local: Column, evidence: Column, concrete: Column, score: Column) -> Column:
    """high, medium or low. Moves of people count by rank and place, others by evidence, concrete (an amount or entity) or not, and quality."""
    people = F.when(senior & local, "high").when(senior, "medium").otherwise("low")
    rest = F.when((evidence >= 4) | ((evidence >= 3) & concrete), "high").when((evidence >= 2) | (score >= 90), "medium").otherwise("low")
    return F.when(kind == "people_move", people).otherwise(rest)


def blended_confidence(score: Column, evidence: Column, local: Column, kind: Column, band: Column) -> Column:
    """A number from 0 to 1 of quality, evidence, place, type and band."""
    extra = F.when(local, 0.1).otherwise(0.0) + F.when(kind.isin([*CORE_TYPES, "debt_financing"]), 0.05).otherwise(0.0) + F.when(band == "high", 0.05).when(band == "low", -0.05).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.4 * score / 100 + 0.4 * evidence / 5 + extra)), 3)


def source_trust(domain: Column, fund_domain: Column, score: Column, rumour: Column) -> Column:
    """source, confidence: rumours least, then others, the trade press (verified if the quality is 90 or more), and the fund's own site."""
    of = lambda name, c: F.struct(F.lit(name).alias("source"), F.lit(c).alias("confidence"))
    news = F.coalesce(domain.isin(NEWS_SITES), F.lit(False))
    return (
        F.when(F.coalesce(rumour, F.lit(False)), of("signal_rumor", 0.6)).when(F.coalesce(domain == fund_domain, F.lit(False)), of("signal_fund_press", 0.9))
        .when(news & (F.coalesce(score, F.lit(50)) >= 90), of("signal_news_verified", 0.8)).when(news, of("signal_news", 0.75)).otherwise(of("signal_other", 0.7))
    )


def fund_category(asset_classes: Column, focuses: Column) -> Column:
    """vc, infra, debt, real_estate, pe, growth or unknown, by what a member list says of a fund; the first rule that holds."""
    a = F.transform(asset_classes, lambda x: F.replace(F.lower(x), F.lit("."), F.lit(" ")))
    f = F.transform(focuses, lambda x: F.lower(x))
    holds = lambda xs, *words: F.exists(xs, lambda x: F.rlike(x, F.lit("|".join(words))))
    return (
        F.when(holds(a, "venture capital"), "vc").when(F.array_contains(a, "infrastructure") | F.array_contains(f, "infrastructure"), "infra").when(holds(a, "private debt") | holds(f, "private debt", "private-debt"), "debt")
        .when(holds(f, "real estate", "real-estate"), "real_estate").when(holds(f, "early stage", "early-stage"), "vc").when(holds(f, "buy out", "buyout", "buy-out"), "pe").when(holds(f, "expansion"), "growth")
        .when(holds(a, "private equity"), "pe").otherwise("unknown")
    )


#: Words by which a text is about the country, with the weight of each kind, its growth by a further mention, and its cap.
COUNTRY = ["Italy", "Italia", "Italian", "Italiano", "Italiana"]
CITIES = [
    "Milano", "Milan", "Roma", "Rome", "Torino", "Turin", "Napoli", "Naples", "Bologna", "Firenze", "Florence", "Genova", "Genoa", "Venezia", "Venice", "Palermo", "Padova", "Padua", "Verona", "Trieste", "Bari", "Catania", "Bergamo", "Brescia",
    "Modena", "Parma", "Reggio Emilia", "Monza", "Vicenza", "Treviso", "Udine", "Ancona", "Pescara", "Lecce", "Salerno", "Taranto", "Perugia", "Cagliari", "Sassari", "Bolzano", "Trento",
]
REGIONS = [
    "Lombardia", "Lombardy", "Veneto", "Emilia-Romagna", "Emilia Romagna", "Piemonte", "Piedmont", "Toscana", "Tuscany", "Lazio", "Campania", "Puglia", "Sicilia", "Sicily", "Sardegna", "Sardinia", "Liguria", "Marche", "Friuli-Venezia Giulia",
    "Friuli Venezia Giulia", "Abruzzo", "Calabria", "Umbria", "Basilicata", "Molise", "Trentino-Alto Adige", "Trentino Alto Adige", "Valle d'Aosta",
]
LEGAL_ENDINGS = [r"S\.?p\.?A\.?", r"S\.?r\.?l\.?", r"S\.?a\.?s\.?", r"S\.?n\.?c\.?", r"S\.?c\.?a\.?r\.?l\.?", "SGR"]
BUSINESS = ["Borsa Italiana", "Piazza Affari", "CONSOB", "Banca d'Italia", "Cassa Depositi", "CDP", "AIFI", "Assonime", "Confindustria", "made in Italy", "Italian market", "mercato italiano"]
MENTIONS = [("country", COUNTRY, 0.4, 0.1, 0.6), ("cities", CITIES, 0.25, 0.1, 0.4), ("regions", REGIONS, 0.2, 0.05, 0.3), ("legal_form", LEGAL_ENDINGS, 0.3, 0.15, 0.5)]
THRESHOLDS = {"NEWS": 0.25, "TEAM": 0.3, "CAREERS": 0.3}


def word_of(words: list[str]) -> str:
    return r"(?i)\b(" + "|".join(words) + r")\b"


def relevance(text: Column, page: Column, present: Column) -> Column:
    """score, reasons, relevant, places: weighted mentions of each kind, each capped, and a bonus for a fund known to be present; relevant from the
    page's threshold on. Reasons are the kinds that counted, in order; places are named alike and sorted. A null or empty text scores 0."""
    t = F.coalesce(text, F.lit(""))
    found = {kind: F.regexp_extract_all(t, F.lit(word_of(words)), 1) for kind, words, *_ in MENTIONS}
    terms = F.array_distinct(F.regexp_extract_all(t, F.lit("(?i)(" + "|".join(BUSINESS) + ")"), 1))
    parts = [(kind, F.size(found[kind]) > 0, F.least(weight * (1 + more * (F.size(found[kind]) - 1)), F.lit(cap))) for kind, _, weight, more, cap in MENTIONS]
    parts += [("business", F.size(terms) > 0, F.least(0.25 * F.size(terms), F.lit(0.3))), ("present", F.coalesce(present, F.lit(False)) & (t != ""), F.lit(0.15))]
    score = F.lit(0.0)
    for _, holds, worth in parts:
        score = score + F.when(holds, worth).otherwise(0.0)
    score = F.round(F.least(score, F.lit(1.0)), 3)
    least = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in THRESHOLDS.items() for x in kv)), page), F.lit(0.35))
    reasons = F.array_compact(F.array(*(F.when(holds, kind) for kind, holds, _ in parts)))
    places = F.array_sort(F.array_distinct(F.transform(F.concat(found["cities"], found["regions"]), lambda x: F.initcap(x))))
    return F.struct(score.alias("score"), reasons.alias("reasons"), ((score >= least) & (t != "")).alias("relevant"), places.alias("places"))
