"""Plans: flagship, scans, projections, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import relational as R

from .entities import Entities as E
from .registry import plan

LONG = "bigint"


@plan("flagship_portfolio_by_fund", """, s AS (SELECT f.fund_id, f.name, c.sector, count(*) AS n FROM items i JOIN funds f USING (fund_id) JOIN companies c USING (company_id) WHERE i.status IS NULL OR i.status = 'current' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY fund_id ORDER BY n DESC, sector) AS k FROM s)
SELECT fund_id, name, sector AS top_sector, n AS in_sector, (SELECT count(*) FROM items i WHERE i.fund_id = r.fund_id) AS companies FROM r WHERE k = 1""")
def flagship(spark, d):
    """Portfolio by fund: size, and the sector with most current companies."""
    e = E(spark, d)
    items = e.items
    now = items.where("status is null or status = 'current'").join(e.companies.select("company_id", "sector"), "company_id")
    top = R.first_per_key(now.groupBy("fund_id", "sector").agg(F.count("*").alias("n")), ["fund_id"], [F.desc("n"), F.col("sector")])
    return top.join(items.groupBy("fund_id").agg(F.count("*").alias("companies")), "fund_id").join(e.funds.select("fund_id", "name"), "fund_id").select("fund_id", "name", F.col("sector").alias("top_sector"), F.col("n").alias("in_sector"), "companies")


@plan("s1_json_documents", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s1(spark, d):
    """JSON documents parsed with a schema; malformed ones give null."""
    return E(spark, d).table("events").select("event_id", F.from_json("props", "k long", {"mode": "PERMISSIVE"})["k"].alias("k"))


@plan("s2_map_of_arrays_flatten", "SELECT fund_id, company_id, coalesce(confidence, 0.7) AS confidence FROM items WHERE coalesce(confidence, 0.7) >= 0.5")
def s2(spark, d):
    """The stored form, a map from fund to a list of items as JSON, flattened again, with the default confidence and its filter."""
    per_fund = E(spark, d).items.groupBy("fund_id").agg(F.to_json(F.create_map(F.col("fund_id").cast("string"), F.collect_list(F.struct("company_id", "confidence")))).alias("doc"))
    flat = per_fund.select(F.explode(F.from_json("doc", "map<string, array<struct<company_id: long, confidence: double>>>")).alias("fund", "list")).select("fund", F.inline("list"))
    return flat.select(F.col("fund").cast(LONG).alias("fund_id"), "company_id", F.coalesce("confidence", F.lit(0.7)).alias("confidence")).where("confidence >= 0.5")


@plan("s5_two_level_override", "SELECT fund_id, company_id, coalesce(CASE WHEN company_id % 17 = 0 THEN 'exited' END, CASE WHEN company_id % 20 = 3 THEN 'partial' END, status) AS status FROM items")
def s5(spark, d):
    """Status overrides by id, then by sector of the name: two lookups, the first that has a value wins."""
    e = E(spark, d)
    by_id = e.companies.where("company_id % 17 = 0").select("company_id", F.lit("exited").alias("by_id"))
    by_rest = e.companies.where("company_id % 20 = 3").select("company_id", F.lit("partial").alias("by_rest"))
    return e.items.join(by_id, "company_id", "left").join(by_rest, "company_id", "left").select("fund_id", "company_id", F.coalesce("by_id", "by_rest", "status").alias("status"))


@plan("s9_text_table_scan", r"""SELECT doc_id, regexp_extract(title, '^([A-Za-z]+)', 1) AS head, len(regexp_extract_all(text, '\|')) AS bars FROM docs WHERE contains(text, '|')""")
def s9(spark, d):
    """Delimited lines in plain text."""
    return E(spark, d).docs.where(F.contains("text", F.lit("|"))).select("doc_id", F.regexp_extract("title", "^([A-Za-z]+)", 1).alias("head"), F.size(F.regexp_extract_all("text", F.lit(r"\|"), 0)).cast(LONG).alias("bars"))


HTML_SQL = r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<(script|style|nav|footer)[^>]*>.*?</(script|style|nav|footer)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS content FROM pages"""


@plan("s14_html_text", HTML_SQL)
def s14(spark, d):
    """Text of pages: comments, scripts, styles, navigation and footers out, then all tags."""
    from tessera.sources.html import page_text

    return E(spark, d).table("pages").select("page_id", page_text(F.col("html")).alias("content"))


@plan("s17_html_links", r"""SELECT page_id, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS heading FROM pages""")
def s17(spark, d):
    """Links and headings of pages."""
    from tessera.sources.html import headings, links

    return E(spark, d).table("pages").select("page_id", F.size(links(F.col("html"))).cast(LONG).alias("links"), F.coalesce(F.element_at(headings(F.col("html")), 1), F.lit("")).alias("heading"))


@plan("s19_url_sources", "SELECT url, min(origin) AS origin FROM (SELECT url, 'pages' AS origin FROM pages UNION ALL SELECT 'https://fund-' || fund_id || '.example.com/', 'funds' FROM funds UNION ALL SELECT 'https://url-' || url_id || '.example.com/', 'events' FROM signals) GROUP BY url")
def s19(spark, d):
    """One list of URLs from three sources (U4)."""
    e = E(spark, d)
    made = lambda df, p, c, o: df.select(F.concat(F.lit(f"https://{p}-"), c, F.lit(".example.com/")).alias("url"), F.lit(o).alias("origin"))
    every = e.table("pages").select("url", F.lit("pages").alias("origin")).unionByName(made(e.funds, "fund", "fund_id", "funds")).unionByName(made(e.signals, "url", "url_id", "events"))
    return every.groupBy("url").agg(F.min("origin").alias("origin"))


@plan("p1_slim_projection", "SELECT fund_id, slug, name, country, aum > 0 AS has_aum FROM funds")
def p1(spark, d):
    return E(spark, d).funds.select("fund_id", "slug", "name", "country", (F.col("aum") > 0).alias("has_aum"))


@plan("p2_lookup_with_alias", "SELECT a.slug AS asked, f.fund_id FROM (SELECT 'fund-3' AS slug UNION ALL SELECT 'old-fund-4' UNION ALL SELECT 'nobody') a LEFT JOIN funds f ON f.slug = CASE WHEN a.slug LIKE 'old-%' THEN substr(a.slug, 5) ELSE a.slug END")
def p2(spark, d):
    """Lookup by key, else by alias; unknown keys give null."""
    f = E(spark, d).funds.select("slug", "fund_id")
    alias = f.select(F.concat(F.lit("old-"), "slug").alias("asked"), "slug")
    asked = spark.createDataFrame([("fund-3",), ("old-fund-4",), ("nobody",)], "asked string")
    return asked.join(alias, "asked", "left").withColumn("slug", F.coalesce("slug", "asked")).join(f, "slug", "left").select("asked", "fund_id")


@plan("p4_deals_of_fund", "SELECT order_id, line, round(amount, 4) AS amount, deal_year, CASE WHEN amount >= 50000 THEN 'large' ELSE 'small' END AS size_class FROM deals WHERE fund_id = 3")
def p4(spark, d):
    return E(spark, d).deals.where("fund_id = 3").select("order_id", "line", F.round("amount", 4).alias("amount"), "deal_year", F.when(F.col("amount") >= 50000, "large").otherwise("small").alias("size_class"))


@plan("p5_type_exclusion", "SELECT signal_id, type FROM signals WHERE type <> 'website_change'")
def p5(spark, d):
    """Null-safe exclusion of a type."""
    return E(spark, d).signals.where(~F.col("type").eqNullSafe("website_change")).select("signal_id", "type")


@plan("p6_array_contains", "SELECT signal_id FROM signals WHERE list_contains([fund_id, (fund_id * 7) % 10], 7)")
def p6(spark, d):
    return E(spark, d).signals.where(F.array_contains(F.array("fund_id", (F.col("fund_id") * 7) % 10), 7)).select("signal_id")


@plan("p7_range_overlap", "SELECT fund_id FROM funds WHERE coalesce(inv_max, 0) <> 0 AND NOT (coalesce(inv_max, 0) < 3000000 OR coalesce(inv_min, 0) > 8000000)")
def p7(spark, d):
    """Investment range overlaps [3M, 8M]; null bounds count 0, a maximum of 0 excludes."""
    low, high = F.coalesce("inv_min", F.lit(0)), F.coalesce("inv_max", F.lit(0))
    return E(spark, d).funds.where((high != 0) & ~((high < 3000000) | (low > 8000000))).select("fund_id")


@plan("p8_p9_numeric_and_enum", "SELECT fund_id, category FROM funds WHERE aum >= 1000000000 AND aum <= 5000000000 AND category IN ('pe', 'vc')")
def p8(spark, d):
    return E(spark, d).funds.where(F.col("aum").between(1000000000, 5000000000) & F.col("category").isin("pe", "vc")).select("fund_id", "category")


@plan("p10_any_of_canonical_tags", "SELECT fund_id FROM funds WHERE list_has_any([CASE category WHEN 'vc' THEN 'venture' WHEN 'growth' THEN 'venture' ELSE category END, lower(region)], ['venture', 'europe'])")
def p10(spark, d):
    """Any tag, after canonicalisation, among the wanted ones."""
    tags = F.transform(F.array("category", F.lower("region")), lambda t: F.when(t.isin("vc", "growth"), "venture").otherwise(t))
    return E(spark, d).funds.where(F.arrays_overlap(tags, F.array(F.lit("venture"), F.lit("europe")))).select("fund_id")


@plan("p11_derived_country", "SELECT fund_id, coalesce(CASE WHEN aum > 5000000000 THEN country END, CASE WHEN category = 'pe' THEN region END, CASE WHEN inv_min IS NOT NULL THEN 'ranged' END, 'unknown') AS hq FROM funds")
def p11(spark, d):
    """A value by a cascade of four fallbacks."""
    return E(spark, d).funds.select("fund_id", F.coalesce(F.when(F.col("aum") > 5000000000, F.col("country")), F.when(F.col("category") == "pe", F.col("region")), F.when(F.col("inv_min").isNotNull(), "ranged"), F.lit("unknown")).alias("hq"))


@plan("p12_ranked_search", """, p AS (SELECT DISTINCT fund_id FROM items JOIN companies USING (company_id) WHERE contains(name, 'widget 1'))
SELECT f.fund_id, CASE WHEN contains(lower(f.name), '1') THEN 'name' WHEN contains(lower(country), '1') THEN 'location' WHEN contains(category, '1') THEN 'category' ELSE 'portfolio' END AS reason
FROM funds f LEFT JOIN p USING (fund_id) WHERE contains(lower(f.name), '1') OR contains(lower(country), '1') OR contains(category, '1') OR p.fund_id IS NOT NULL""")
def p12(spark, d):
    """Search over fields in order, with the field that matched first; the portfolio comes last."""
    e = E(spark, d)
    hit = e.items.join(e.companies.where(F.contains("name", F.lit("widget 1"))).select("company_id"), "company_id", "left_semi").select("fund_id").distinct().withColumn("p", F.lit(True))
    has = lambda c: F.contains(F.lower(c), F.lit("1"))
    reason = F.when(has("name"), "name").when(has("country"), "location").when(has("category"), "category").when(F.col("p"), "portfolio")
    return e.funds.join(hit, "fund_id", "left").select("fund_id", reason.alias("reason")).where("reason is not null")


@plan("p13_substring_search", "SELECT doc_id FROM docs WHERE contains(lower(text), 'the th') OR contains(lower(source), 'src1')")
def p13(spark, d):
    return E(spark, d).docs.where(F.contains(F.lower("text"), F.lit("the th")) | F.contains(F.lower("source"), F.lit("src1"))).select("doc_id")


@plan("p14_existential_per_predicate", """, r AS (SELECT signal_id, unnest([fund_id, (fund_id * 7) % 10]) AS fund_id FROM signals)
SELECT signal_id FROM signals s WHERE EXISTS (SELECT 1 FROM r JOIN funds USING (fund_id) WHERE r.signal_id = s.signal_id AND category = 'pe') AND EXISTS (SELECT 1 FROM r JOIN funds USING (fund_id) WHERE r.signal_id = s.signal_id AND aum > 2000000000)""")
def p14(spark, d):
    """Any related fund meets the category, and any (maybe another) the size: a semi-join per predicate."""
    e = E(spark, d)
    related = e.signals.select("signal_id", F.explode(F.array_distinct(F.array("fund_id", (F.col("fund_id") * 7) % 10))).alias("fund_id")).join(e.funds.select("fund_id", "category", "aum"), "fund_id")
    flags = related.groupBy("signal_id").agg(F.bool_or(F.col("category") == "pe").alias("a"), F.bool_or(F.col("aum") > 2000000000).alias("b"))
    return flags.where("a and b").select("signal_id")


@plan("p15_p16_portfolio_filters", "SELECT fund_id, company_id, coalesce(status, 'unknown') AS status FROM items JOIN companies USING (company_id) WHERE sector IN ('SMALL', 'LARGE') AND (status IS NULL OR status = 'exited') AND contains(name, 'ring')")
def p15(spark, d):
    e = E(spark, d)
    return e.items.where("status is null or status = 'exited'").join(e.companies.where(F.col("sector").isin("SMALL", "LARGE") & F.contains("name", F.lit("ring"))), "company_id").select("fund_id", "company_id", F.coalesce("status", F.lit("unknown")).alias("status"))


@plan("p17_recency", "SELECT signal_id FROM signals WHERE coalesce(published_at, observed_at) > (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def p17(spark, d):
    """Signals of the last seven days before ``as_of``, the latest time in the data."""
    e = E(spark, d)
    as_of = e.table("events").agg(F.max("ts").alias("as_of"))
    return e.signals.join(F.broadcast(as_of)).where(F.coalesce("published_at", "observed_at") > F.col("as_of") - F.expr("INTERVAL 7 DAYS")).select("signal_id")


@plan("p18_garbage_rules", r"""SELECT doc_id, CASE WHEN length(title) < 10 THEN 'short' WHEN regexp_matches(title, '(###|%%%|&&&|\*\*\*)') THEN 'symbols' WHEN regexp_matches(title, '^[^a-z]*$') THEN 'no_lower' WHEN contains(title, ' | ') THEN 'navigation' ELSE 'keep' END AS decision FROM docs""")
def p18(spark, d):
    """Garbage rules in order, cheap ones first, as one decision column."""
    t = F.col("title")
    return E(spark, d).docs.select("doc_id", F.when(F.char_length(t) < 10, "short").when(F.rlike(t, F.lit(r"(###|%%%|&&&|\*\*\*)")), "symbols").when(F.rlike(t, F.lit("^[^a-z]*$")), "no_lower").when(F.contains(t, F.lit(" | ")), "navigation").otherwise("keep").alias("decision"))


@plan("p22_misattribution", "SELECT signal_id, fund_id FROM signals s WHERE EXISTS (SELECT 1 FROM funds f WHERE f.fund_id = (s.company_id % 10) AND f.fund_id <> s.fund_id AND f.category = 'vc')")
def p22(spark, d):
    """Signals whose text names another fund of a kind."""
    e = E(spark, d)
    named = e.funds.where("category = 'vc'").select(F.col("fund_id").alias("named"))
    return e.signals.join(named, (F.col("company_id") % 10 == F.col("named")) & (F.col("named") != F.col("fund_id")), "left_semi").select("signal_id", "fund_id")


@plan("p24_threshold_by_type", "SELECT signal_id FROM signals WHERE score >= CASE WHEN type IN ('deal_announced', 'exit_announced', 'fundraise_announced') THEN 75 ELSE 80 END")
def p24(spark, d):
    return E(spark, d).signals.where(F.col("score") >= F.when(F.col("type").isin("deal_announced", "exit_announced", "fundraise_announced"), 75).otherwise(80)).select("signal_id")


@plan("p25_geo_scope", """SELECT signal_id FROM signals JOIN funds USING (fund_id) WHERE CASE WHEN region IN ('EUROPE', 'AFRICA') THEN true WHEN type = 'deal_announced' THEN score >= 50 ELSE company_id % 2 = 0 END""")
def p25(spark, d):
    """Relevance by the fund's scope."""
    e = E(spark, d)
    ok = F.when(F.col("region").isin("EUROPE", "AFRICA"), F.lit(True)).when(F.col("type") == "deal_announced", F.col("score") >= 50).otherwise(F.col("company_id") % 2 == 0)
    return e.signals.join(e.funds.select("fund_id", "region"), "fund_id").where(ok).select("signal_id")


@plan("p26_rewrite_people", "SELECT conv_id, list_sort(list_distinct(list(role) FILTER (role <> 'system'))) AS roles FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role <> 'system') > 0")
def p26(spark, d):
    """Support roles taken out of a row's list; rows left empty go."""
    per = E(spark, d).table("conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return per.select("conv_id", F.array_sort(F.filter("roles", lambda r: r != "system")).alias("roles")).where(F.size("roles") > 0)


@plan("p27_truncated_title", r"""SELECT doc_id, CASE WHEN regexp_matches(title, '(?i) (the|of|and|de|la|und|en|y)[.]?$') THEN 'reject' ELSE 'keep' END AS verdict FROM docs""")
def p27(spark, d):
    return E(spark, d).docs.select("doc_id", F.when(F.rlike("title", F.lit("(?i) (the|of|and|de|la|und|en|y)[.]?$")), "reject").otherwise("keep").alias("verdict"))


@plan("p28_relevant_profiles", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING') AND c_acctbal > 0")
def p28(spark, d):
    return E(spark, d).table("customer").where(F.col("c_mktsegment").isin("MACHINERY", "BUILDING") & (F.col("c_acctbal") > 0)).select("c_custkey")


@plan("p29_freshness_skip", "SELECT fund_id FROM funds f WHERE NOT EXISTS (SELECT 1 FROM signals s WHERE s.fund_id = f.fund_id AND s.observed_at > (SELECT max(ts) FROM events) - INTERVAL 2 HOUR)")
def p29(spark, d):
    """Funds not seen within two hours before ``as_of``: the latest time of each key, then an anti-join."""
    e = E(spark, d)
    as_of = e.table("events").agg(F.max("ts").alias("as_of"))
    fresh = e.signals.groupBy("fund_id").agg(F.max("observed_at").alias("seen")).join(F.broadcast(as_of)).where(F.col("seen") > F.col("as_of") - F.expr("INTERVAL 2 HOURS"))
    return e.funds.join(fresh, "fund_id", "left_anti").select("fund_id")


@plan("p31_actionable", "SELECT signal_id FROM signals WHERE score >= 60 AND (type = 'deal_announced' OR (signal_id % 5 > 1 AND company_id % 4 = 1))")
def p31(spark, d):
    """Type, or a usable element in a list that may be null (never tried) or empty (none found)."""
    targets = F.when(F.col("signal_id") % 5 == 0, F.lit(None).cast("array<bigint>")).when(F.col("signal_id") % 5 == 1, F.array().cast("array<bigint>")).otherwise(F.array("company_id"))
    return E(spark, d).signals.where((F.col("score") >= 60) & ((F.col("type") == "deal_announced") | F.coalesce(F.exists(targets, lambda x: x % 4 == 1), F.lit(False)))).select("signal_id")


@plan("p32_noise_lines", r"""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(x) >= 20 AND NOT regexp_matches(x, '(###|%%%|&&&)'))) AS lines FROM docs""")
def p32(spark, d):
    return E(spark, d).docs.select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: (F.char_length(x) >= 20) & ~F.rlike(x, F.lit("(###|%%%|&&&)")))).cast(LONG).alias("lines"))


@plan("p33_suspect_audit", r"""SELECT doc_id, length(text) < 40 AS short, NOT regexp_matches(text, '[.!?]$') AS truncated FROM docs WHERE length(text) < 40 OR NOT regexp_matches(text, '[.!?]$')""")
def p33(spark, d):
    short, cut = F.char_length("text") < 40, ~F.rlike("text", F.lit("[.!?]\\z"))
    return E(spark, d).docs.where(short | cut).select("doc_id", short.alias("short"), cut.alias("truncated"))


@plan("p34_entity_exclusion", r"""SELECT company_id FROM companies WHERE NOT regexp_matches(name, '(?i)\b(gear|bolt)\b')""")
def p34(spark, d):
    return E(spark, d).companies.where(~F.rlike("name", F.lit(r"(?i)\b(gear|bolt)\b"))).select("company_id")
