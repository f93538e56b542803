"""Plans of judgements on funds and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import ml
from tessera.functions import judgement as G
from tessera.functions import names as N
from tessera.operators import matching as M

from .entities import Entities as E
from .queries_f import isin, q
from .registry import plan

LONG = "bigint"
#: Geographies, seats and names that funds get by their id; null where none is known.
GEOGRAPHIES = [["Italy"], ["Italy", "France"], ["Veneto"], ["Veneto", "Italy"], ["France", "Germany"], ["Worldwide", "Italy"], ["Mars"], [], None, ["italy ", None]]
SEATS, NAMES, SLUGS = ["Lombardia", "France", "USA", None, "italy"], ["Alfa SGR", "Beta Capital", "Gamma Sicaf S.p.A."], ["alfa-sgr", "beta-europe", "gamma", "italia-four"]


def listed(values) -> str:
    return "[" + ", ".join("NULL" if v is None else listed(v) if isinstance(v, list) else q(v) for v in values) + "]" if values else "CAST([] AS VARCHAR[])"


def pick(values, key):
    of = lambda v: F.lit(None).cast("string") if v is None else F.array(*map(of, v)).cast("array<string>") if isinstance(v, list) else F.lit(v)
    kind = "array<string>" if any(isinstance(v, list) for v in values) else "string"
    return F.try_element_at(F.array(*(of(v).cast(kind) if v is not None else F.lit(None).cast(kind) for v in values)), (key % len(values) + 1).cast("int"))


def picked(values, key: str) -> str:
    return f"(CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else listed(v) if isinstance(v, list) else q(v)}" for i, v in enumerate(values)) + " END)"


SCOPE = f"""g AS (SELECT fund_id, list_filter(list_transform(coalesce({picked(GEOGRAPHIES, 'fund_id')}, CAST([] AS VARCHAR[])), lambda x: trim(lower(x))), lambda x: x IS NOT NULL AND x <> '') AS geos, coalesce(lower({picked(SEATS, 'fund_id')}), '') AS seat, regexp_matches({picked(NAMES, 'fund_id')}, {q(G.LEGAL_FORM)}) AS form, {picked(SLUGS, 'fund_id')} AS slug2 FROM funds),
sc AS (SELECT fund_id, form, CASE WHEN len(geos) > 0 THEN CASE WHEN list_has_any(geos, {listed(G.OUTSIDE)}) THEN 'mixed_or_global' WHEN (list_contains(geos, 'italy') OR list_has_any(geos, {listed(G.ITALIAN_REGIONS)})) AND form THEN 'italy_focused' WHEN list_has_any(geos, {listed(G.ITALIAN_REGIONS)}) AND NOT list_contains(geos, 'italy') THEN 'italy_focused'
WHEN list_contains(geos, 'italy') AND len(geos) = 1 THEN 'italy_focused' WHEN list_contains(geos, 'italy') THEN 'europe_wide' WHEN form THEN 'italy_focused' WHEN list_has_any(geos, {listed(G.EUROPE)}) THEN 'europe_wide' ELSE 'mixed_or_global' END
WHEN seat IN {isin([*G.ITALIAN_REGIONS, 'italy'])} AND form THEN 'italy_focused' WHEN seat IN {isin([*G.ITALIAN_REGIONS, 'italy', *G.EUROPE])} THEN 'europe_wide' WHEN contains(slug2, 'sgr') OR contains(slug2, 'italy') OR contains(slug2, 'italia') THEN 'italy_focused' WHEN contains(slug2, 'europe') THEN 'europe_wide' ELSE 'unknown' END AS scope FROM g)"""


def scopes(e):
    i = F.col("fund_id")
    return e.funds.select("fund_id", F.rlike(pick(NAMES, i), F.lit(G.LEGAL_FORM)).alias("form"), G.geo_scope(pick(GEOGRAPHIES, i), pick(SEATS, i), pick(NAMES, i), pick(SLUGS, i)).alias("scope"))


@plan("c10_geo_scope", f", {SCOPE} SELECT fund_id, scope FROM sc")
def c10(spark, d):
    """Scope of each fund by geographies, legal form, seat and slug."""
    return scopes(E(spark, d)).select("fund_id", "scope")


@plan("p25_geo_relevance", f""", {SCOPE}, s AS (SELECT signal_id, type, signal_id % 7 = 0 AS ev, signal_id % 3 = 0 AS fl, signal_id % 4 = 0 AS ab, signal_id % 9 = 0 AND form AS team, scope FROM signals JOIN sc USING (fund_id))
SELECT signal_id FROM s WHERE CASE WHEN ev OR team THEN true WHEN scope = 'italy_focused' THEN fl OR type IN {isin(G.CORE_TYPES)} OR NOT ab WHEN scope IN ('europe_wide', 'mixed_or_global') THEN false ELSE fl AND type IN {isin(G.CORE_TYPES)} END""")
def p25(spark, d):
    """Signals that count for their fund's scope."""
    e, i = E(spark, d), F.col("signal_id")
    s = e.signals.join(scopes(e), "fund_id")
    return s.where(G.geo_relevant(F.col("scope"), F.col("type"), i % 7 == 0, i % 3 == 0, i % 4 == 0, (i % 9 == 0) & F.col("form"))).select("signal_id")


@plan("c8_evidence_and_confidence", f""", s AS (SELECT signal_id, type, score, signal_id % 2 = 0 AS ent, signal_id % 3 = 0 AS amt, published_at IS NOT NULL AS dat, signal_id % 5 < 2 AS deal, signal_id % 11 = 0 AS lau, type IN {isin(G.CORE_TYPES)} AS core, signal_id % 4 = 0 AS sen, company_id % 3 = 0 AS loc FROM signals),
e AS (SELECT *, CAST(ent AS INT) + CAST(amt AS INT) + CAST(dat AS INT) + CAST(deal AS INT) + CAST(lau AS INT) + CAST(core AS INT) AS ev FROM s), b AS (SELECT *, CASE WHEN type = 'people_move' THEN CASE WHEN sen AND loc THEN 'high' WHEN sen THEN 'medium' ELSE 'low' END WHEN ev >= 4 OR (ev >= 3 AND (ent OR amt)) THEN 'high' WHEN ev >= 2 OR score >= 90 THEN 'medium' ELSE 'low' END AS band FROM e)
SELECT signal_id, CAST(ev AS BIGINT) AS evidence, band, round(least(1.0, greatest(0.0, CAST(0.4 AS DOUBLE) * score / 100 + CAST(0.4 AS DOUBLE) * ev / 5 + (CASE WHEN loc THEN CAST(0.1 AS DOUBLE) ELSE 0 END + CASE WHEN core OR type = 'debt_financing' THEN CAST(0.05 AS DOUBLE) ELSE 0 END + CASE band WHEN 'high' THEN CAST(0.05 AS DOUBLE) WHEN 'low' THEN CAST(-0.05 AS DOUBLE) ELSE 0 END))), 3) AS confidence FROM b""")
def c8(spark, d):
    """Kinds of evidence, band of confidence, and the number blended from both and quality."""
    i, kind, score = F.col("signal_id"), F.col("type"), F.col("score")
    entity, amount, local = i % 2 == 0, i % 3 == 0, F.col("company_id") % 3 == 0
    ev = G.evidence_score(entity, amount, F.col("published_at").isNotNull(), i % 5 < 2, i % 11 == 0, kind.isin(G.CORE_TYPES))
    band = G.confidence_band(kind, i % 4 == 0, local, ev, entity | amount, score)
    return E(spark, d).signals.select("signal_id", ev.cast(LONG).alias("evidence"), band.alias("band"), G.blended_confidence(score, ev, local, kind, band).alias("confidence"))


SITES = ["bebeez.it", "reuters.com", "fund.example", "blog.example", None]


@plan("c11_source_trust", f"""SELECT signal_id, CASE WHEN signal_id % 13 = 0 THEN 'signal_rumor' WHEN dom = 'fund.example' THEN 'signal_fund_press' WHEN dom IN {isin(G.NEWS_SITES)} AND coalesce(score, 50) >= 90 THEN 'signal_news_verified' WHEN dom IN {isin(G.NEWS_SITES)} THEN 'signal_news' ELSE 'signal_other' END AS source,
CAST(CASE WHEN signal_id % 13 = 0 THEN 0.6 WHEN dom = 'fund.example' THEN 0.9 WHEN dom IN {isin(G.NEWS_SITES)} AND coalesce(score, 50) >= 90 THEN 0.8 WHEN dom IN {isin(G.NEWS_SITES)} THEN 0.75 ELSE 0.7 END AS DOUBLE) AS confidence FROM (SELECT *, {picked(SITES, 'signal_id')} AS dom FROM signals)""")
def c11(spark, d):
    """Where a signal comes from, and how far that is trusted."""
    i = F.col("signal_id")
    trust = G.source_trust(pick(SITES, i), F.lit("fund.example"), F.col("score"), i % 13 == 0)
    return E(spark, d).signals.select("signal_id", trust.alias("t")).select("signal_id", "t.source", "t.confidence")


CLASSES = [["Venture.Capital"], ["Infrastructure"], ["Private Debt"], ["Private Equity"], [], ["Private Equity", "Other"]]
FOCUSES = [[], ["Infrastructure"], ["Real Estate"], ["Early stage"], ["Buy Out"], ["Expansion"], ["private-debt fund"]]


@plan("c14_fund_category", f"""SELECT fund_id, CASE WHEN len(list_filter(a, lambda x: contains(x, 'venture capital'))) > 0 THEN 'vc' WHEN list_contains(a, 'infrastructure') OR list_contains(f, 'infrastructure') THEN 'infra' WHEN len(list_filter(a, lambda x: contains(x, 'private debt'))) > 0 OR len(list_filter(f, lambda x: regexp_matches(x, 'private debt|private-debt'))) > 0 THEN 'debt'
WHEN len(list_filter(f, lambda x: regexp_matches(x, 'real estate|real-estate'))) > 0 THEN 'real_estate' WHEN len(list_filter(f, lambda x: regexp_matches(x, 'early stage|early-stage'))) > 0 THEN 'vc' WHEN len(list_filter(f, lambda x: regexp_matches(x, 'buy out|buyout|buy-out'))) > 0 THEN 'pe' WHEN len(list_filter(f, lambda x: contains(x, 'expansion'))) > 0 THEN 'growth'
WHEN len(list_filter(a, lambda x: contains(x, 'private equity'))) > 0 THEN 'pe' ELSE 'unknown' END AS category FROM (SELECT fund_id, list_transform({picked(CLASSES, 'fund_id')}, lambda x: replace(lower(x), '.', ' ')) AS a, list_transform({picked(FOCUSES, 'fund_id')}, lambda x: lower(x)) AS f FROM funds)""")
def c14(spark, d):
    """Category of a fund by its asset classes and focuses."""
    i = F.col("fund_id")
    return E(spark, d).funds.select("fund_id", G.fund_category(pick(CLASSES, i), pick(FOCUSES, i)).alias("category"))


TEXTS = [
    "", "The Italian market: a fund from Milano and Bergamo buys", "Offices in Milan, milan and Rome; Italy, Italia and Italian firms in Italy", "Alfa S.p.A. and Beta S.r.l. of Lombardia", "CDP and cdp and Confindustria on Piazza Affari",
    "London and Paris", "Toscana, Lazio, Umbria, Puglia, Marche", "A podcast from Reggio Emilia", "Alfa SGR",
]
PAGES = ["NEWS", "TEAM", "PORTFOLIO", "OTHER", None]


def part_sql(kind, words, weight, more, cap) -> str:
    return f"CASE WHEN len({kind}) > 0 THEN least(CAST({weight} AS DOUBLE) * (1 + CAST({more} AS DOUBLE) * (len({kind}) - 1)), CAST({cap} AS DOUBLE)) ELSE 0 END"


@plan("c9_relevance_of_texts", f""", t AS (SELECT doc_id, {picked(TEXTS, 'doc_id')} || CASE WHEN doc_id % 9 = 0 THEN '' ELSE ' ' || coalesce(title, '') END AS t, {picked(PAGES, 'doc_id')} AS page, doc_id % 4 = 0 AS present FROM docs),
m AS (SELECT doc_id, t, page, present, {', '.join(f"regexp_extract_all(t, {q(G.word_of(words))}, 1) AS {kind}" for kind, words, *_ in G.MENTIONS)}, list_distinct(regexp_extract_all(t, {q('(?i)(' + '|'.join(G.BUSINESS) + ')')}, 1)) AS business FROM (SELECT doc_id, regexp_replace(t, '[à-öø-ɏÀ-ÖØ-Þ]', 'a', 'g') AS t, page, present FROM t)),
s AS (SELECT *, round(least(1.0, {' + '.join(part_sql(*x) for x in G.MENTIONS)} + CASE WHEN len(business) > 0 THEN least(CAST(0.25 AS DOUBLE) * len(business), CAST(0.3 AS DOUBLE)) ELSE 0 END + CASE WHEN present AND t <> '' THEN CAST(0.15 AS DOUBLE) ELSE 0 END), 3) AS score FROM m)
SELECT doc_id, score, list_filter([{', '.join(f"CASE WHEN len({kind}) > 0 THEN {q(kind)} END" for kind, *_ in [*G.MENTIONS, ('business',)])}, CASE WHEN present AND t <> '' THEN 'present' END], lambda x: x IS NOT NULL) AS reasons, score >= CASE page {' '.join(f"WHEN {q(k)} THEN {v}" for k, v in G.THRESHOLDS.items())} ELSE 0.35 END AND t <> '' AS relevant,
list_sort(list_distinct(list_transform(list_concat(cities, regions), lambda x: array_to_string(list_transform(string_split(lower(x), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')))) AS places FROM s""")
def c9(spark, d):
    """How much a text is about the country: mentions of each kind, the page's threshold, and the places named."""
    i = F.col("doc_id")
    text = F.concat(pick(TEXTS, i), F.when(i % 9 == 0, "").otherwise(F.concat(F.lit(" "), F.coalesce("title", F.lit("")))))
    plain = F.regexp_replace(text, "[à-öø-ɏÀ-ÖØ-Þ]", "a")
    return E(spark, d).docs.select("doc_id", G.relevance(plain, pick(PAGES, i), i % 4 == 0).alias("r")).select("doc_id", "r.*")


PHRASES = ["the deal of Alfa Capital Partners with Beta S.p.A. and alfa capital partners.", "The Group of Four", "KKR Group, and Gamma Delta Holding; KKR GROUP", "no names here", None, "Alfa Beta and Omega Ventures Management, London"]


@plan("f11_company_phrases", f"""SELECT doc_id, list_filter(n, lambda x, i: list_position(list_transform(n, lambda y: lower(y)), lower(x)) = i) AS phrases FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce({picked(PHRASES, 'doc_id')}, ''), {q(N.PHRASE)}), lambda x: regexp_replace(regexp_replace(x, '^[ ,.;:()\\[\\]{{}}]+|[ ,.;:()\\[\\]{{}}]+$', '', 'g'), '\\s{{2,}}', ' ', 'g')),
lambda x: length(x) >= 4 AND len(string_split(x, ' ')) >= 2 AND lower(split_part(x, ' ', 1)) NOT IN {isin(N.SMALL)} AND list_has_any(list_transform(string_split(x, ' '), lambda w: lower(regexp_replace(w, '^[ ,.;:()\\[\\]{{}}]+|[ ,.;:()\\[\\]{{}}]+$', '', 'g'))), {listed(N.COMPANY_WORDS)})) AS n FROM docs)""")
def f11(spark, d):
    """Phrases that look like names of companies."""
    return E(spark, d).docs.select("doc_id", N.company_phrases(pick(PHRASES, F.col("doc_id"))).alias("phrases"))


@plan("f11_names_in_text")
def f11_names(spark, d):
    """Texts in lower case with the names of the table's companies written as they are."""
    names = F.array(F.lit("Alfa Capital"), F.lit("Alfa Capital Partners"), F.lit("KKR"), F.lit("beta"))
    return E(spark, d).docs.select("doc_id", N.capitalise_names(F.lower(pick(PHRASES, F.col("doc_id"))), names).alias("text"))


@plan("a23_hires_by_period", """, f AS (SELECT o_custkey AS c_custkey, min(CAST(o_orderdate AS DATE)) AS joined, count(*) AS n FROM orders GROUP BY 1), z AS (SELECT max(joined) AS as_of FROM f)
SELECT c_nationkey, count(*) AS people, count(*) FILTER (n >= 20) AS senior, count(*) FILTER (n < 20 AND n >= 10) AS mid, count(*) FILTER (n < 10) AS junior, count(*) FILTER (joined > as_of - INTERVAL 6 MONTH) AS hires_6, count(*) FILTER (joined > as_of - INTERVAL 12 MONTH) AS hires_12,
count(*) FILTER (joined > as_of - INTERVAL 24 MONTH) AS hires_24, count(*) FILTER (joined > as_of - INTERVAL 36 MONTH) AS hires_36, count(*) FILTER (joined > as_of - INTERVAL 48 MONTH) AS hires_48, count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')) AS industry, round(100.0 * count(*) FILTER (c_custkey % 3 = 0) / count(*), 1) AS share_a FROM customer JOIN f USING (c_custkey), z GROUP BY c_nationkey""")
def a23(spark, d):
    """People of a group: ranks by experience, hires within 6 to 48 months before the latest one, backgrounds, shares; one pass."""
    e = E(spark, d)
    first = e.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.col("o_orderdate").cast("date")).alias("joined"), F.count("*").alias("n"))
    as_of = first.agg(F.max("joined").alias("as_of"))
    x = e.table("customer").join(first, "c_custkey").join(F.broadcast(as_of))
    hires = [F.count_if(F.col("joined") > F.add_months("as_of", -m)).alias(f"hires_{m}") for m in (6, 12, 24, 36, 48)]
    n = F.col("n")
    return x.groupBy("c_nationkey").agg(F.count("*").alias("people"), F.count_if(n >= 20).alias("senior"), F.count_if((n < 20) & (n >= 10)).alias("mid"), F.count_if(n < 10).alias("junior"), *hires, F.count_if(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).alias("industry"), F.round(100.0 * F.count_if(F.col("c_custkey") % 3 == 0) / F.count("*"), 1).alias("share_a"))


STARTS = ["Alfa acquires Beta for €30 million", "Exit: sale of Gamma on 2024-05-01, 12 mln", "Nasce il fondo delta", "The team: Rossi joins 3 March", "Careers: an opening", "A deal of 15 % and more", "", "Nothing  of  note"]
SITES_OF = ["NEWS", "portfolio", "TEAM", "CAREERS", "HOME", None]


@plan("x5_numeric_features", f"""SELECT doc_id, CAST(length(t) AS DOUBLE) AS char_len, CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS DOUBLE) AS token_len, coalesce(round(length(t) / CAST(nullif(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END, 0) AS DOUBLE), 6), 0) AS avg_token_len, {', '.join(f"CAST(regexp_matches(t, {q(p)}) AS DOUBLE) AS {k}" for k, p in ml.HAS.items())},
{', '.join(f"CAST(page = {q(x)} AS DOUBLE) AS is_{x.lower()}" for x in ml.PAGES)}, CAST(page NOT IN {isin(ml.PAGES)} AS DOUBLE) AS is_other, CAST(doc_id % 3 = 0 AS DOUBLE) AS italy_relevant, CASE WHEN doc_id % 5 = 0 THEN 0.0 ELSE (doc_id % 10) / CAST(10 AS DOUBLE) END AS relevance_score
FROM (SELECT doc_id, trim(regexp_replace(coalesce({picked(STARTS, 'doc_id')}, '') || ' ' || coalesce(regexp_replace(title, '[^ -~]', 'a', 'g'), ''), '\\s+', ' ', 'g')) AS t, upper(coalesce({picked(SITES_OF, 'doc_id')}, '')) AS page FROM docs)""")
def x5(spark, d):
    """The 18 numbers of each text that go beside its words."""
    i = F.col("doc_id")
    x = E(spark, d).docs.select("doc_id", ml.one_line(pick(STARTS, i), F.regexp_replace("title", "[^ -~]", "a")).alias("t"))
    score = F.when(i % 5 != 0, (i % 10) / 10.0)
    cols = ml.extra_features(F.col("t"), pick(SITES_OF, i), i % 3 == 0, score)
    return x.select("doc_id", *(F.round(c, 6).alias(k) if k == "avg_token_len" else c.alias(k) for k, c in cols.items()))


@plan("p16_portfolio_filter_set", """SELECT 'unknown_small_with_site' AS view, fund_id, company_id FROM items JOIN companies USING (company_id) WHERE status IS NULL AND sector = 'SMALL' AND company_id % 4 <> 0 UNION ALL
SELECT 'current_home', fund_id, company_id FROM items JOIN companies USING (company_id) WHERE status = 'current' AND brand IN ('Brand#1', 'Brand#2', 'Brand#3') UNION ALL SELECT 'without_site', fund_id, company_id FROM items JOIN companies USING (company_id) WHERE company_id % 4 = 0""")
def p16(spark, d):
    """Filters of a portfolio, each 'all' or a value: sector, status (unknown is null), with or without a site, home region; three choices of them."""
    e = E(spark, d)
    site = F.when(F.col("company_id") % 4 != 0, F.concat(F.lit("https://c"), "company_id"))
    x = e.items.join(e.companies, "company_id").select("fund_id", "company_id", "sector", "status", site.alias("website"), F.col("brand").isin("Brand#1", "Brand#2", "Brand#3").alias("home"))

    def chosen(view, sector="all", status="all", website="all", region="all"):
        out = x
        if sector != "all":
            out = out.where(F.col("sector") == sector)
        if status != "all":
            out = out.where(F.col("status").isNull() if status == "unknown" else F.col("status") == status)
        if website != "all":
            out = out.where(F.col("website").isNotNull() if website == "with" else F.col("website").isNull())
        if region == "home":
            out = out.where("home")
        return out.select(F.lit(view).alias("view"), "fund_id", "company_id")

    return chosen("unknown_small_with_site", "SMALL", "unknown", "with").unionByName(chosen("current_home", status="current", region="home")).unionByName(chosen("without_site", website="without"))


#: Amounts that were left in Italian.
ITALIAN_AMOUNTS = [
    r"\d+(?:[,.]\d+)?\s+milioni\s+di\s+euro", r"\d+(?:[,.]\d+)?\s+mln\s+(?:di\s+)?euro", r"\d+(?:[,.]\d+)?\s+milioni\s+euro", r"milioni\s+di\s+euro", r"\d+(?:[,.]\d+)?\s+miliardi\s+di\s+euro", r"\d+(?:[,.]\d+)?\s+mld\s+(?:di\s+)?euro",
    r"miliardi\s+di\s+euro", r"\d+(?:[,.]\d+)?\s+migliaia\s+di\s+euro", r"migliaia\s+di\s+euro", r"\boltre\s+\d+(?:[,.]\d+)?\s+mil", r"\boltre\s+(?:i\s+)?\d+\s+mil",
]
SUMMARIES = ["", "Round da 3,5 milioni di euro e oltre 20 milioni", "A deal of 12 MLN di euro", "miliardi di euro", "Worth EUR 3m", "oltre i 50 milioni di Euro", None]


@plan("p33_currency_residue", f"""SELECT doc_id, list_filter(m, lambda x, i: list_position(list_transform(m, lambda y: lower(y)), lower(x)) = i) AS residue FROM (SELECT doc_id, list_concat({', '.join(f"regexp_extract_all(t, {q('(?i)' + p)})" for p in ITALIAN_AMOUNTS[:2])}, {', '.join(f"regexp_extract_all(t, {q('(?i)' + p)})" for p in ITALIAN_AMOUNTS[2:])}) AS m FROM (SELECT doc_id, coalesce({picked(SUMMARIES, 'doc_id')}, '') || ' ' || coalesce(title, '') AS t FROM docs)) WHERE len(m) > 0""")
def p33(spark, d):
    """Summaries with amounts left in Italian, and what was found, each once in any case."""
    t = F.concat(F.coalesce(pick(SUMMARIES, F.col("doc_id")), F.lit("")), F.lit(" "), F.coalesce("title", F.lit("")))
    found = F.flatten(F.array(*(F.regexp_extract_all(t, F.lit("(?i)" + p), 0) for p in ITALIAN_AMOUNTS)))
    x = E(spark, d).docs.select("doc_id", found.alias("m")).where(F.size("m") > 0)
    return x.select("doc_id", F.filter("m", lambda v, i: F.array_position(F.transform("m", lambda y: F.lower(y)), F.lower(v)) == i + 1).alias("residue"))


#: Endings that don't count when names are matched.
ENDINGS = ["sgr", "spa", "srl", "s.p.a.", "s.r.l.", "sa", "partners", "capital", "group"]


def bare(c):
    """A name without endings and other characters than letters and digits."""
    c = F.lower(c)
    for x in ENDINGS:
        c = F.replace(c, F.lit(x), F.lit(""))
    return F.regexp_replace(c, "[^a-z0-9]", "")


def bare_sql(c: str) -> str:
    c = f"lower({c})"
    for x in ENDINGS:
        c = f"replace({c}, {q(x)}, '')"
    return f"regexp_replace({c}, '[^a-z0-9]', '', 'g')"


URL_NAME = "CASE doc_id % 5 WHEN 0 THEN f.name || ' SGR' WHEN 1 THEN f.slug WHEN 2 THEN 'www ' || f.name || ' partners' WHEN 3 THEN substr(f.name, 1, 12) ELSE 'nobody' || doc_id END"


@plan("j28_url_entities", f"""SELECT doc_id, min(i.fund_id) AS fund_id FROM (SELECT doc_id, {bare_sql(URL_NAME)} AS u FROM docs JOIN funds f ON f.fund_id = doc_id % 50 + 1) x JOIN (SELECT fund_id, {bare_sql('name')} AS n, replace(slug, '-', '') AS s FROM funds) i ON u = n OR u = s OR (length(u) >= 4 AND length(n) >= 4 AND (contains(n, u) OR contains(u, n))) GROUP BY doc_id""")
def j28(spark, d):
    """Names taken from addresses matched to investors: equal to the name or slug without endings, or one holding the other from four letters on; the
    first investor counts."""
    e, i = E(spark, d), F.col("doc_id")
    funds = e.funds.select("fund_id", "name", "slug")
    named = e.docs.select("doc_id", (i % 50 + 1).alias("fund_id")).join(funds, "fund_id")
    name = F.when(i % 5 == 0, F.concat("name", F.lit(" SGR"))).when(i % 5 == 1, F.col("slug")).when(i % 5 == 2, F.concat(F.lit("www "), "name", F.lit(" partners"))).when(i % 5 == 3, F.left("name", F.lit(12))).otherwise(F.concat(F.lit("nobody"), i))
    x = named.select("doc_id", bare(name).alias("u"))
    y = funds.select("fund_id", bare(F.col("name")).alias("n"), F.replace("slug", F.lit("-"), F.lit("")).alias("s"))
    first = y.select("fund_id", F.explode(F.array_distinct(F.array("n", "s"))).alias("u")).groupBy("u").agg(F.min("fund_id").alias("fund_id"))
    equal = x.join(first, "u").select("doc_id", "fund_id")
    held = M.first_held(x.where(F.char_length("u") >= 4), y.where(F.char_length("n") >= 4), "doc_id", "fund_id", "u", "n")
    return equal.unionByName(held).groupBy("doc_id").agg(F.min("fund_id").alias("fund_id"))
