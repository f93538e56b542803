"""Plans: joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import matching as M
from tessera.operators import relational as R

from .entities import Entities as E
from .registry import plan

LONG = "bigint"


@plan("j1_override_from", "SELECT fund_id, coalesce(s.top, category) AS category FROM funds LEFT JOIN (SELECT fund_id, min(sector) AS top FROM items JOIN companies USING (company_id) WHERE size > 40 GROUP BY fund_id) s USING (fund_id)")
def j1(spark, d):
    """Left join that overrides a column where the other side has a value."""
    e = E(spark, d)
    top = e.items.join(e.companies.where("size > 40"), "company_id").groupBy("fund_id").agg(F.min("sector").alias("category"))
    return R.fill_from(e.funds.select("fund_id", "category"), top, ["fund_id"], ["category"])


@plan("j2_signal_fund", "SELECT signal_id, f.name AS fund_name FROM signals LEFT JOIN funds f USING (fund_id)")
def j2(spark, d):
    e = E(spark, d)
    return e.signals.join(e.funds.select("fund_id", "name"), "fund_id", "left").select("signal_id", F.col("name").alias("fund_name"))


NAME = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@plan("j3_cascaded_match", f""", c AS (SELECT company_id, name, {NAME.format('name')} AS n FROM companies), t AS (SELECT c_custkey AS target_id, {NAME.format("(SELECT min(name) FROM companies WHERE company_id = c_custkey % 50) || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '!' ELSE ' group' END")} AS n FROM customer),
m AS (SELECT target_id, 0 AS r, min(company_id) AS company_id FROM t JOIN c USING (n) GROUP BY target_id UNION ALL SELECT target_id, 1, min(company_id) FROM t JOIN c ON replace(t.n, ' ', '') = replace(c.n, ' ', '') GROUP BY target_id UNION ALL SELECT target_id, 2, min(company_id) FROM t JOIN c ON regexp_replace(t.n, ' group$', '') = c.n GROUP BY target_id),
b AS (SELECT target_id, arg_min(company_id, r) AS company_id, min(r) AS r FROM m GROUP BY target_id)
SELECT target_id, company_id, CASE r WHEN 0 THEN 'exact' WHEN 1 THEN 'compact' WHEN 2 THEN 'no_group' ELSE 'none' END AS tier FROM t LEFT JOIN b USING (target_id)""")
def j3(spark, d):
    """Names matched in tiers: normalised, without spaces, without 'group'; each tier an equi-join."""
    e = E(spark, d)
    c = e.companies.select("company_id", T.squash(F.col("name")).alias("n"))
    names = e.companies.where("company_id < 50").select(F.col("company_id").alias("k"), "name")
    ending = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, "!").otherwise(" group")
    t = e.table("customer").withColumn("k", F.col("c_custkey") % 50).join(names, "k").select(F.col("c_custkey").alias("target_id"), T.squash(F.concat("name", ending)).alias("n"))
    n, bare = F.col("n"), F.replace(F.col("n"), F.lit(" "), F.lit(""))
    return R.cascade(t, c, "target_id", "company_id", [("exact", n, n), ("compact", bare, bare), ("no_group", F.regexp_replace(n, " group$", ""), n)])


@plan("j5_profile_wins", "SELECT company_id, coalesce(p.brand, c.brand) AS brand, coalesce(p.sector, c.sector) AS sector FROM companies c LEFT JOIN (SELECT company_id, upper(brand) AS brand, CASE WHEN company_id % 4 = 0 THEN NULL ELSE lower(sector) END AS sector FROM companies WHERE company_id % 2 = 0) p USING (company_id)")
def j5(spark, d):
    c = E(spark, d).companies.select("company_id", "brand", "sector")
    p = c.where("company_id % 2 = 0").select("company_id", F.upper("brand").alias("brand"), F.when(F.col("company_id") % 4 != 0, F.lower("sector")).alias("sector"))
    return R.fill_from(c, p, ["company_id"], ["brand", "sector"])


@plan("j6_company_signals", "SELECT company_id, count(*) AS signals, max(coalesce(published_at, observed_at)) AS latest FROM signals JOIN companies USING (company_id) GROUP BY company_id")
def j6(spark, d):
    """Companies with the signals that target them, through the exploded target list."""
    e = E(spark, d)
    t = e.signals.select(F.explode(F.array("company_id")).alias("company_id"), F.coalesce("published_at", "observed_at").alias("at"))
    return t.join(e.companies.select("company_id"), "company_id").groupBy("company_id").agg(F.count("*").alias("signals"), F.max("at").alias("latest"))


@plan("j7_semi_investors", "SELECT signal_id FROM signals s WHERE EXISTS (SELECT 1 FROM items i WHERE i.fund_id = s.fund_id AND i.company_id = s.company_id)")
def j7(spark, d):
    e = E(spark, d)
    return e.signals.join(e.items, ["fund_id", "company_id"], "left_semi").select("signal_id")


@plan("j8_mention_join", """, t AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM docs),
q AS (SELECT item_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS p FROM benchmark UNION ALL SELECT 1000000 + item_id, ' ' || array_to_string((string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '))[1:3], ' ') || ' ' FROM benchmark)
SELECT doc_id, item_id FROM t JOIN q ON contains(t, p)""")
def j8(spark, d):
    """Texts that mention a phrase, at word borders: an equi-join on word n-grams, not a scan of all phrases. Phrases are whole items and their
    first three words."""
    e = E(spark, d)
    items = e.table("benchmark").select("item_id", T.squash(F.col("text")).alias("phrase"))
    heads = items.select((F.col("item_id") + 1_000_000).alias("item_id"), F.array_join(F.slice(F.split("phrase", " "), 1, 3), " ").alias("phrase"))
    return M.mentions(e.docs.select("doc_id", "text"), items.unionByName(heads), "doc_id", "text", "item_id", "phrase")


@plan("j10_fuzzy_pairs", """, p AS (SELECT company_id, brand, string_split(name, ' ') AS w FROM companies)
SELECT a.company_id AS a, b.company_id AS b FROM p a JOIN p b ON a.brand = b.brand AND a.company_id < b.company_id WHERE len(list_intersect(a.w, b.w)) * 1.0 / len(list_distinct(list_concat(a.w, b.w))) >= 0.5""")
def j10(spark, d):
    """Fuzzy name pairs within a scope: Jaccard of words, candidates by shared words."""
    c = E(spark, d).companies.select("company_id", "brand", F.split("name", " ").alias("words"))
    return M.jaccard_pairs(c, ["brand"], "company_id", "words", 0.5)


@plan("j11_merge_portfolio", """, o AS (SELECT fund_id, company_id, n_deals AS n FROM items WHERE company_id % 10 <> 0), w AS (SELECT fund_id, company_id, n_deals + 1 AS n FROM items WHERE company_id % 10 <> 1 AND fund_id % 4 <> 2),
s AS (SELECT fund_id, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM (SELECT fund_id, count(*) AS x FROM o GROUP BY 1) FULL JOIN (SELECT fund_id, count(*) AS y FROM w GROUP BY 1) USING (fund_id)), g AS (SELECT fund_id, y = 0 OR (x >= 4 AND y < 0.5 * x) AS guard FROM s)
SELECT fund_id, company_id, CASE WHEN guard THEN o.n ELSE coalesce(w.n, o.n) END AS n, CASE WHEN guard THEN 'guarded' WHEN w.n IS NULL THEN 'exited' WHEN o.n IS NULL THEN 'added' ELSE 'kept' END AS state FROM o FULL JOIN w USING (fund_id, company_id) JOIN g USING (fund_id) WHERE NOT (guard AND o.n IS NULL)""")
def j11(spark, d):
    """Merge sink with guards (K4, T12): a scope that came back empty or halved keeps its old rows."""
    i = E(spark, d).items
    old = i.where("company_id % 10 <> 0").select("fund_id", "company_id", F.col("n_deals").alias("n"))
    new = i.where("company_id % 10 <> 1 and fund_id % 4 <> 2").select("fund_id", "company_id", (F.col("n_deals") + 1).alias("n"))
    return R.merge_keep(old, new, ["fund_id", "company_id"], ["n"])


@plan("j12_new_by_fingerprint", "SELECT DISTINCT substr(md5(title || '|' || source), 1, 12) AS fp FROM docs d WHERE doc_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM docs o WHERE o.doc_id % 3 = 1 AND o.title = d.title AND o.source = d.source)")
def j12(spark, d):
    """News whose fingerprint is not known yet."""
    x = E(spark, d).docs.select("doc_id", F.substring(F.md5(F.concat_ws("|", "title", "source")), 1, 12).alias("fp"))
    return x.where("doc_id % 3 = 0").join(x.where("doc_id % 3 = 1"), "fp", "left_anti").select("fp").distinct()


@plan("j13_entity_cascade", """, k AS (SELECT company_id, lower(name) AS exact, brand || '/' || sector AS alias, split_part(name, ' ', 2) || size AS domain FROM companies WHERE company_id < 100), t AS (SELECT company_id AS target_id, lower(name) AS exact, brand || '/' || sector AS alias, split_part(name, ' ', 2) || size AS domain FROM companies WHERE company_id >= 100),
m AS (SELECT target_id, 0 AS r, min(company_id) AS c FROM t JOIN k USING (exact) GROUP BY 1 UNION ALL SELECT target_id, 1, min(company_id) FROM t JOIN k USING (alias) GROUP BY 1 UNION ALL SELECT target_id, 2, min(company_id) FROM t JOIN k USING (domain) GROUP BY 1)
SELECT target_id, arg_min(c, r) AS company_id, CASE min(r) WHEN 0 THEN 'exact' WHEN 1 THEN 'alias' WHEN 2 THEN 'domain' ELSE 'none' END AS tier FROM t LEFT JOIN m USING (target_id) GROUP BY target_id""")
def j13(spark, d):
    """Entity resolution: exact, alias, domain, else new."""
    c = E(spark, d).companies.select("company_id", F.lower("name").alias("exact"), F.concat_ws("/", "brand", "sector").alias("alias"), F.concat(F.split("name", " ")[1], "size").alias("domain"))
    k, t = c.where("company_id < 100"), c.where("company_id >= 100").withColumnRenamed("company_id", "target_id")
    return R.cascade(t, k, "target_id", "company_id", [(x, F.col(x), F.col(x)) for x in ("exact", "alias", "domain")])


@plan("j14_slug_canonicalisation", """SELECT signal_id, CASE WHEN url_id % 13 = 0 THEN NULL ELSE coalesce(f.slug, g.slug) END AS slug, CASE WHEN url_id % 13 = 0 THEN 'invalid' WHEN f.slug IS NOT NULL THEN 'canonical' WHEN g.slug IS NOT NULL THEN 'alias' ELSE 'orphan' END AS reason FROM signals s LEFT JOIN funds f ON f.slug = 'fund-' || s.url_id LEFT JOIN funds g ON g.fund_id = s.url_id - 100""")
def j14(spark, d):
    """Keys made canonical by a cascade of lookups, with the reason."""
    e = E(spark, d)
    f = e.funds.select("slug", "fund_id")
    x = e.signals.select("signal_id", "url_id", F.concat(F.lit("fund-"), "url_id").alias("raw")).join(f.select(F.col("slug").alias("raw"), F.col("slug").alias("direct")), "raw", "left")
    x = x.join(f.select((F.col("fund_id") + 100).alias("url_id"), F.col("slug").alias("old")), "url_id", "left")
    bad = F.col("url_id") % 13 == 0
    return x.select("signal_id", F.when(~bad, F.coalesce("direct", "old")).alias("slug"), F.when(bad, "invalid").when(F.col("direct").isNotNull(), "canonical").when(F.col("old").isNotNull(), "alias").otherwise("orphan").alias("reason"))


@plan("j18_suppress_by_group", "SELECT signal_id FROM signals s WHERE NOT (type = 'website_change' AND EXISTS (SELECT 1 FROM signals n WHERE n.type = 'deal_announced' AND n.fund_id = s.fund_id AND n.company_id = s.company_id))")
def j18(spark, d):
    """One kind of signal suppresses another for the same fund and company."""
    s = E(spark, d).signals
    gone = s.where("type = 'website_change'").join(s.where("type = 'deal_announced'"), ["fund_id", "company_id"], "left_semi")
    return s.join(gone, "signal_id", "left_anti").select("signal_id")


@plan("j19_negatives", "SELECT d.doc_id FROM docs d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j19(spark, d):
    e = E(spark, d)
    return e.docs.join(e.table("labels"), "doc_id", "left_anti").select("doc_id")


@plan("j20_restore_by_key_then_id", """, o AS (SELECT doc_id, title, n_chars AS old FROM docs WHERE doc_id % 2 = 0), t AS (SELECT title, min(old) AS by_title FROM o GROUP BY 1), i AS (SELECT doc_id, min(old) AS by_id FROM o GROUP BY 1)
SELECT doc_id, coalesce(by_title, by_id, -1) AS restored FROM docs LEFT JOIN t USING (title) LEFT JOIN i USING (doc_id)""")
def j20(spark, d):
    """Earlier results restored by content key, else by id."""
    x = E(spark, d).docs.select("doc_id", "title", "n_chars")
    old = x.where("doc_id % 2 = 0")
    t, i = old.groupBy("title").agg(F.min("n_chars").alias("by_title")), old.groupBy("doc_id").agg(F.min("n_chars").alias("by_id"))
    return x.join(t, "title", "left").join(i, "doc_id", "left").select("doc_id", F.coalesce("by_title", "by_id", F.lit(-1)).alias("restored"))


@plan("j22_conflicts", """, j AS (SELECT a.company_id, a.sector AS s1, b.sector AS s2, a.brand AS b1, b.brand AS b2 FROM companies a JOIN companies b ON b.company_id = a.company_id + 1)
SELECT company_id, 'sector' AS field, s1 AS old, s2 AS new FROM j WHERE s1 <> s2 UNION ALL SELECT company_id, 'brand', b1, b2 FROM j WHERE b1 <> b2""")
def j22(spark, d):
    """Conflicting values of matched rows, a row for each field."""
    c = E(spark, d).companies.select("company_id", "sector", "brand")
    o = c.select((F.col("company_id") - 1).alias("company_id"), F.col("sector").alias("s2"), F.col("brand").alias("b2"))
    return c.join(o, "company_id").select("company_id", F.expr("stack(2, 'sector', sector, s2, 'brand', brand, b2) as (field, old, new)")).where("old <> new")


@plan("j23_unresolved_work", "SELECT signal_id FROM signals s WHERE type = 'deal_announced' AND (signal_id % 3 <> 0 OR NOT EXISTS (SELECT 1 FROM items i WHERE i.fund_id = s.fund_id AND i.company_id = s.company_id))")
def j23(spark, d):
    """Work not processed yet, or processed without effect."""
    e = E(spark, d)
    s = e.signals.where("type = 'deal_announced'")
    done = s.where("signal_id % 3 = 0").join(e.items, ["fund_id", "company_id"], "left_semi")
    return s.join(done, "signal_id", "left_anti").select("signal_id")


@plan("j24_consistency", "SELECT fund_id, 'unused' AS issue FROM (SELECT fund_id FROM funds EXCEPT SELECT fund_id FROM signals) UNION ALL SELECT fund_id, 'unknown' FROM (SELECT url_id AS fund_id FROM signals EXCEPT SELECT fund_id FROM funds)")
def j24(spark, d):
    """Differences of two key sets, both ways."""
    e = E(spark, d)
    f, s = e.funds.select("fund_id"), e.signals
    return f.subtract(s.select("fund_id")).withColumn("issue", F.lit("unused")).unionByName(s.select(F.col("url_id").alias("fund_id")).subtract(f).withColumn("issue", F.lit("unknown")))


@plan("j26_lookup_fallback", "SELECT s_suppkey, coalesce(n_name, 'nowhere') AS place FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON s_nationkey = n_nationkey")
def j26(spark, d):
    e = E(spark, d)
    return e.table("supplier").join(e.table("nation").where("n_regionkey <> 2"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("nowhere")).alias("place"))


@plan("j27_unknown_keys", "SELECT DISTINCT 'fund-' || url_id AS slug FROM signals s WHERE NOT EXISTS (SELECT 1 FROM funds f WHERE f.slug = 'fund-' || s.url_id) AND NOT EXISTS (SELECT 1 FROM funds f WHERE starts_with(f.slug, 'fund-' || s.url_id || '-'))")
def j27(spark, d):
    """Keys that are neither known nor the head of a known one; heads are exploded, so the join stays by equality."""
    e = E(spark, d)
    known = e.funds.select("slug")
    heads = known.select(F.explode(F.expr("transform(sequence(1, size(split(slug, '-')) ), n -> array_join(slice(split(slug, '-'), 1, n), '-'))")).alias("slug")).distinct()
    return e.signals.select(F.concat(F.lit("fund-"), "url_id").alias("slug")).distinct().join(heads, "slug", "left_anti")


@plan("a1_count_favoured_first", "SELECT region AS value, count(*) AS n, row_number() OVER (ORDER BY (region = 'EUROPE') DESC, count(*) DESC, region) AS place FROM funds GROUP BY region")
def a1(spark, d):
    g = E(spark, d).funds.groupBy(F.col("region").alias("value")).agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.when(F.col("value") == "EUROPE", 0).otherwise(1), F.desc("n"), "value")).cast(LONG))


@plan("a2_distinct_over_tags", "SELECT tag, count(DISTINCT fund_id) AS funds FROM (SELECT fund_id, unnest([category, lower(region), 'all']) AS tag FROM funds) GROUP BY tag")
def a2(spark, d):
    return E(spark, d).funds.select("fund_id", F.explode(F.array("category", F.lower("region"), F.lit("all"))).alias("tag")).groupBy("tag").agg(F.countDistinct("fund_id").alias("funds"))


@plan("a3_contextual_facets", """SELECT 'category' AS facet, category AS value, count(*) AS n FROM funds WHERE region IN ('EUROPE', 'ASIA') AND aum > 1000000000 GROUP BY 2 UNION ALL SELECT 'region', region, count(*) FROM funds WHERE category IN ('pe', 'vc') AND aum > 1000000000 GROUP BY 2 UNION ALL SELECT 'size', CAST(aum > 1000000000 AS VARCHAR), count(*) FROM funds WHERE category IN ('pe', 'vc') AND region IN ('EUROPE', 'ASIA') GROUP BY 2""")
def a3(spark, d):
    """Each facet counted under all other filters, in one pass."""
    f = {"category": F.col("category").isin("pe", "vc"), "region": F.col("region").isin("EUROPE", "ASIA"), "size": F.col("aum") > 1000000000}
    return R.facets(E(spark, d).funds, f, {"category": F.col("category"), "region": F.col("region"), "size": F.col("aum") > 1000000000})


@plan("a4_facets_over_links", "SELECT f.category AS value, count(*) AS n FROM funds f WHERE EXISTS (SELECT 1 FROM signals s WHERE s.score > 30 AND (s.fund_id = f.fund_id OR (s.fund_id * 7) % 10 = f.fund_id)) GROUP BY f.category")
def a4(spark, d):
    """Funds of matching signals, each once, counted by attribute."""
    e = E(spark, d)
    slugs = e.signals.where("score > 30").select(F.explode(F.array("fund_id", (F.col("fund_id") * 7) % 10)).alias("fund_id")).distinct()
    return e.funds.join(slugs, "fund_id").groupBy(F.col("category").alias("value")).agg(F.count("*").alias("n"))


@plan("a5_type_counts", "SELECT CASE WHEN type IN ('deal_announced', 'exit_announced') THEN 'transaction' ELSE type END AS shown, count(*) AS n FROM signals GROUP BY 1")
def a5(spark, d):
    return E(spark, d).signals.groupBy(F.when(F.col("type").isin("deal_announced", "exit_announced"), "transaction").otherwise(F.col("type")).alias("shown")).agg(F.count("*").alias("n"))


@plan("a6_sector_ranking", """, c AS (SELECT fund_id, sector, count(*) AS n FROM items JOIN companies USING (company_id) WHERE status IS NULL OR status = 'current' GROUP BY ALL) SELECT fund_id, list(sector ORDER BY n DESC, sector) AS sectors FROM c GROUP BY fund_id""")
def a6(spark, d):
    """Sectors of each fund's present portfolio in order of count."""
    e = E(spark, d)
    n = e.items.where("status is null or status = 'current'").join(e.companies, "company_id").groupBy("fund_id", "sector").agg(F.count("*").alias("n"))
    return n.groupBy("fund_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "sector"))), lambda x: x.sector).alias("sectors"))


@plan("a8_company_rollup", """SELECT name, arg_max(brand, length(brand) * 100000 - company_id) AS longest_brand, count(*) AS members, count(DISTINCT fund_id) AS funds, min(entry_date) AS first_entry, list(DISTINCT fund_id ORDER BY fund_id) AS investors FROM items JOIN companies USING (company_id) GROUP BY name""")
def a8(spark, d):
    """Companies over all funds: longest attribute (first of equals), counts, investors."""
    e = E(spark, d)
    return e.items.join(e.companies, "company_id").groupBy("name").agg(F.max_by("brand", F.struct(F.char_length("brand"), -F.col("company_id"))).alias("longest_brand"), F.count("*").alias("members"), F.countDistinct("fund_id").alias("funds"), F.min("entry_date").alias("first_entry"), F.array_sort(F.collect_set("fund_id")).alias("investors"))


@plan("a9_any_all_flags", "SELECT company_id, bool_or(status = 'current') AS any_current, bool_and(coalesce(status, '') = 'exited') AS all_exited, count(*) AS n FROM items GROUP BY company_id")
def a9(spark, d):
    return E(spark, d).items.groupBy("company_id").agg(F.bool_or(F.col("status") == "current").alias("any_current"), F.bool_and(F.coalesce("status", F.lit("")) == "exited").alias("all_exited"), F.count("*").alias("n"))


@plan("a10_top_with_other", """, c AS (SELECT brand, count(*) AS n FROM companies GROUP BY brand), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, brand) AS k FROM c) SELECT CASE WHEN k <= 7 THEN brand ELSE 'Other' END AS brand, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def a10(spark, d):
    return R.top_with_other(E(spark, d).companies.groupBy("brand").agg(F.count("*").alias("n")), "brand", "n", 7)


@plan("a11_histogram_merge", "SELECT key, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 4) AS mean FROM (SELECT fund_id, type AS key, count(*) AS n FROM signals GROUP BY ALL) GROUP BY key")
def a11(spark, d):
    """Histograms kept as maps, merged over funds."""
    per = E(spark, d).signals.groupBy("fund_id", "type").agg(F.count("*").alias("n")).groupBy("fund_id").agg(F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("hist"))
    return per.select(F.explode("hist").alias("key", "n")).groupBy("key").agg(F.sum("n").alias("total"), F.round(F.avg("n"), 4).alias("mean"))


@plan("a12_share_of_total", "SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM docs), 4) AS share FROM docs GROUP BY lang")
def a12(spark, d):
    """Shares of total."""
    return R.share(E(spark, d).docs.groupBy("lang").agg(F.count("*").alias("n")), "n")


@plan("a13_disjoint_buckets", "SELECT fund_id, y1, greatest(0, y2 - y1) AS y1_2, greatest(0, y4 - y2) AS y2_4 FROM (SELECT fund_id, count(*) FILTER (entry_date > DATE '2000-01-01') AS y1, count(*) FILTER (entry_date > DATE '1999-01-01') AS y2, count(*) FILTER (entry_date > DATE '1997-01-01') AS y4 FROM items GROUP BY fund_id)")
def a13(spark, d):
    since = lambda day: F.count_if(F.col("entry_date") > F.lit(day).cast("date"))
    c = E(spark, d).items.groupBy("fund_id").agg(since("2000-01-01").alias("y1"), since("1999-01-01").alias("y2"), since("1997-01-01").alias("y4"))
    return c.select("fund_id", "y1", F.greatest(F.lit(0), F.col("y2") - F.col("y1")).alias("y1_2"), F.greatest(F.lit(0), F.col("y4") - F.col("y2")).alias("y2_4"))


@plan("a14_portal_stats", "SELECT count(*) AS signals, count(DISTINCT fund_id) AS funds_with_signals, count(*) FILTER (type = 'deal_announced') AS deals, min(observed_at) AS first_seen FROM signals")
def a14(spark, d):
    """One-row report."""
    return E(spark, d).signals.agg(F.count("*").alias("signals"), F.countDistinct("fund_id").alias("funds_with_signals"), F.count_if(F.col("type") == "deal_announced").alias("deals"), F.min("observed_at").alias("first_seen"))


@plan("a15_fund_quality", """, x AS (SELECT fund_id, aum, inv_min, (SELECT count(*) FROM items i WHERE i.fund_id = f.fund_id) AS c, (SELECT count(*) FROM items i WHERE i.fund_id = f.fund_id AND status IS NULL) AS u, (SELECT count(*) FROM signals s WHERE s.fund_id = f.fund_id) AS g FROM funds f),
s AS (SELECT fund_id, CASE WHEN aum > 0 THEN 60 ELSE 0 END + CASE WHEN inv_min IS NOT NULL THEN 40 ELSE 0 END AS profile, CASE WHEN c >= 50 THEN 100 WHEN c >= 20 THEN 70 WHEN c >= 1 THEN 40 ELSE 0 END AS portfolio, CASE WHEN c = 0 THEN 0 ELSE round(100.0 * (c - u) / c, 2) END AS status, CASE WHEN g >= 100 THEN 100 WHEN g >= 1 THEN 50 ELSE 0 END AS news, c, u, g FROM x),
t AS (SELECT *, floor(0.3 * profile + 0.3 * portfolio + 0.2 * status + 0.2 * news + 0.5) AS score FROM s)
SELECT fund_id, CAST(score AS BIGINT) AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade, list_filter([CASE WHEN c = 0 THEN 'no_portfolio' END, CASE WHEN g = 0 THEN 'no_news' END, CASE WHEN profile < 100 THEN 'thin_profile' END], lambda z: z IS NOT NULL) AS flags FROM t""")
def a15(spark, d):
    """Quality of funds: section scores by bands, weighted sum rounded half up, grade, red flags."""
    from tessera.functions import rules as Q

    e = E(spark, d)
    c = e.items.groupBy("fund_id").agg(F.count("*").alias("c"), F.count_if(F.col("status").isNull()).alias("u"))
    g = e.signals.groupBy("fund_id").agg(F.count("*").alias("g"))
    x = e.funds.select("fund_id", "aum", "inv_min").join(c, "fund_id", "left").join(g, "fund_id", "left").na.fill(0, ["c", "u", "g"])
    profile = Q.if_then(F.col("aum") > 0, 60) + Q.if_then(F.col("inv_min").isNotNull(), 40)
    status = F.when(F.col("c") == 0, 0.0).otherwise(F.round(100.0 * (F.col("c") - F.col("u")) / F.col("c"), 2))
    total = F.floor(0.3 * profile + 0.3 * Q.band(F.col("c"), [(50, 100), (20, 70), (1, 40)], 0) + 0.2 * status + 0.2 * Q.band(F.col("g"), [(100, 100), (1, 50)], 0) + 0.5)
    return x.select("fund_id", total.cast(LONG).alias("score"), Q.band(total, [(90, "A"), (75, "B"), (60, "C"), (40, "D")], "F").alias("grade"), Q.reasons((F.col("c") == 0, "no_portfolio"), (F.col("g") == 0, "no_news"), (profile < 100, "thin_profile")).alias("flags"))


@plan("a16_score_histogram", "SELECT CASE WHEN score >= 90 THEN '90+' WHEN score >= 80 THEN '80-89' WHEN score >= 70 THEN '70-79' WHEN score >= 60 THEN '60-69' ELSE '<60' END AS bucket, count(*) AS n, round(avg(score), 4) AS mean FROM signals GROUP BY 1")
def a16(spark, d):
    from tessera.functions import rules as Q

    return E(spark, d).signals.groupBy(Q.band(F.col("score"), [(90, "90+"), (80, "80-89"), (70, "70-79"), (60, "60-69")], "<60").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"))


@plan("a17_coverage", "SELECT count(*) FILTER (coalesce(r, 0) = 0) AS none_raw, count(*) FILTER (coalesce(r, 0) > 0 AND coalesce(k, 0) = 0) AS raw_only, count(*) FILTER (coalesce(k, 0) > 0) AS kept FROM funds LEFT JOIN (SELECT fund_id, count(*) AS r, count(*) FILTER (score > 95) AS k FROM signals GROUP BY 1) USING (fund_id)")
def a17(spark, d):
    e = E(spark, d)
    c = e.signals.groupBy("fund_id").agg(F.count("*").alias("r"), F.count_if(F.col("score") > 95).alias("k"))
    x = e.funds.select("fund_id").join(c, "fund_id", "left").na.fill(0)
    return x.agg(F.count_if(F.col("r") == 0).alias("none_raw"), F.count_if((F.col("r") > 0) & (F.col("k") == 0)).alias("raw_only"), F.count_if(F.col("k") > 0).alias("kept"))


@plan("a18_removal_reasons", "SELECT CASE WHEN score < 10 THEN 'low_score' WHEN type = 'website_change' THEN 'type' WHEN published_at IS NULL THEN 'no_date' ELSE 'kept' END AS reason, count(*) AS n FROM signals GROUP BY 1")
def a18(spark, d):
    """One decision column, then counts by reason."""
    return E(spark, d).signals.groupBy(F.when(F.col("score") < 10, "low_score").when(F.col("type") == "website_change", "type").when(F.col("published_at").isNull(), "no_date").otherwise("kept").alias("reason")).agg(F.count("*").alias("n"))


@plan("a19_domain_health", "SELECT url_id, round(count(*) FILTER (event_type <> 'error') / count(*), 4) AS success, count(*) FILTER (event_type = 'error') AS errors, max(observed_at) FILTER (event_type = 'error') AS last_error FROM signals GROUP BY url_id")
def a19(spark, d):
    bad = F.col("event_type") == "error"
    return E(spark, d).signals.groupBy("url_id").agg(F.round(F.count_if(~bad) / F.count("*"), 4).alias("success"), F.count_if(bad).alias("errors"), F.max(F.when(bad, F.col("observed_at"))).alias("last_error"))


@plan("a20_status_pivot", "SELECT fund_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS \"view\" FROM signals GROUP BY fund_id HAVING count(*) FILTER (event_type = 'error') * 6 > count(*)")
def a20(spark, d):
    """Counts by key and status, pivoted over fixed values; only keys failing often."""
    s = E(spark, d).signals
    p = s.groupBy("fund_id").pivot("event_type", ["click", "error", "view"]).agg(F.count(F.lit(1))).na.fill(0)
    return p.join(s.groupBy("fund_id").agg(F.count("*").alias("all")), "fund_id").where("error * 6 > all").select("fund_id", "click", "error", "view")


@plan("a21_investor_rollup", """, l AS (SELECT investor_id AS who, deal_year AS y, 1 AS lead FROM deals UNION ALL SELECT (investor_id + 1) % 150, NULL, 0 FROM deals) SELECT who, count(*) AS n, min(y) AS first_year, CAST(sum(lead) AS BIGINT) AS led FROM l GROUP BY who""")
def a21(spark, d):
    """Lead and co-investors united; the first year counts lead deals alone."""
    x = E(spark, d).deals.select("investor_id", "deal_year")
    every = x.select(F.col("investor_id").alias("who"), F.col("deal_year").alias("y"), F.lit(1).alias("lead")).unionByName(x.select(((F.col("investor_id") + 1) % 150).alias("who"), F.lit(None).cast("int").alias("y"), F.lit(0).alias("lead")))
    return every.groupBy("who").agg(F.count("*").alias("n"), F.min("y").alias("first_year"), F.sum("lead").alias("led"))


@plan("a22_deals_per_fund", "SELECT fund_id, count(*) AS n, round(sum(amount), 4) AS total FROM deals GROUP BY fund_id")
def a22(spark, d):
    return E(spark, d).deals.groupBy("fund_id").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 4).alias("total"))


@plan("a23_people_stats", "SELECT c_nationkey, count(*) AS people, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_acctbal > 5000) AS senior, round(avg(nullif(c_acctbal, 0)), 1) AS mean_balance FROM customer GROUP BY c_nationkey")
def a23(spark, d):
    """Conditional counts and means without nulls and zeros."""
    return E(spark, d).table("customer").groupBy("c_nationkey").agg(F.count("*").alias("people"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"), F.count_if(F.col("c_acctbal") > 5000).alias("senior"), F.round(F.avg(F.nullif("c_acctbal", F.lit(0.0))), 1).alias("mean_balance"))


@plan("a24_top_frequency", "SELECT word, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(string_split(lower(title), ' ')) AS word FROM docs) GROUP BY word ORDER BY n DESC, word LIMIT 10")
def a24(spark, d):
    """Ten most frequent values of a list, once per row."""
    return E(spark, d).docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("title"), " "))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(10)


@plan("a26_attribute_election", "SELECT sector, arg_min(name, length(name) * 1000000 + company_id) AS best_name, arg_max(brand, size * 1000000 - company_id) AS best_brand FROM companies GROUP BY sector")
def a26(spark, d):
    """The best value of each attribute by its own criteria."""
    return R.elect(E(spark, d).companies, ["sector"], {"best_name": (F.col("name"), [F.char_length("name"), F.col("company_id")]), "best_brand": (F.col("brand"), [-F.col("size"), F.col("company_id")])})


@plan("a27_majority_vote", """, c AS (SELECT fund_id, sector, count(*) AS n, min(company_id) AS p FROM items JOIN companies USING (company_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY fund_id ORDER BY n DESC, p) AS k FROM c) SELECT fund_id, sector FROM r WHERE k = 1""")
def a27(spark, d):
    """Majority, of equals the first seen."""
    e = E(spark, d)
    return R.majority(e.items.join(e.companies, "company_id"), ["fund_id"], "sector", "company_id")


@plan("a28_multi_fund_groups", "SELECT company_id, count(DISTINCT fund_id) AS funds FROM items GROUP BY company_id HAVING count(DISTINCT fund_id) >= 2")
def a28(spark, d):
    return E(spark, d).items.groupBy("company_id").agg(F.countDistinct("fund_id").alias("funds")).where("funds >= 2")


@plan("a29_vote_merge", "SELECT company_id, round(least(1.0, avg(coalesce(confidence, 0.7)) + 0.1 * (count(*) - 1)), 6) AS confidence, CASE WHEN bool_or(status = 'exited') THEN 'exited' ELSE min(status) END AS status FROM items GROUP BY company_id")
def a29(spark, d):
    """Votes of several strategies merged: mean confidence plus a bonus, capped; an exit wins."""
    return E(spark, d).items.groupBy("company_id").agg(F.round(F.least(F.lit(1.0), F.avg(F.coalesce("confidence", F.lit(0.7))) + 0.1 * (F.count("*") - 1)), 6).alias("confidence"), F.when(F.bool_or(F.col("status") == "exited"), "exited").otherwise(F.min("status")).alias("status"))


@plan("a32_range_max", "SELECT max(inv_max) FILTER (inv_max > 0) AS top FROM funds")
def a32(spark, d):
    return E(spark, d).funds.agg(F.max(F.when(F.col("inv_max") > 0, F.col("inv_max"))).alias("top"))


@plan("a34_category_fold", "SELECT lower(trim(source)) AS k, list(DISTINCT lang ORDER BY lang) AS langs, min(doc_id) AS first_doc, min(title) FILTER (title <> '') AS title FROM docs GROUP BY 1")
def a34(spark, d):
    """Attributes from many files united by entity."""
    return E(spark, d).docs.groupBy(F.lower(F.trim("source")).alias("k")).agg(F.array_sort(F.collect_set("lang")).alias("langs"), F.min("doc_id").alias("first_doc"), F.min(F.when(F.col("title") != "", F.col("title"))).alias("title"))


@plan("a35_regression_diff", """, o AS (SELECT fund_id, company_id FROM items WHERE company_id % 7 <> 0), n AS (SELECT fund_id, company_id FROM items WHERE company_id % 7 <> 1) SELECT fund_id, count(*) FILTER (o.company_id IS NULL) AS added, count(*) FILTER (n.company_id IS NULL) AS removed, count(*) FILTER (n.company_id IS NULL) * 5 <= count(o.company_id) AS passed FROM o FULL JOIN n USING (fund_id, company_id) GROUP BY fund_id""")
def a35(spark, d):
    """Added, removed and the pass rule per key."""
    i = E(spark, d).items
    x = R.diff(i.where("company_id % 7 <> 0"), i.where("company_id % 7 <> 1"), ["fund_id", "company_id"], [])
    c = x.groupBy("fund_id").agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"), F.count_if(F.col("change") != "added").alias("old"))
    return c.select("fund_id", "added", "removed", (F.col("removed") * 5 <= F.col("old")).alias("passed"))


@plan("a37_class_metrics", "SELECT quality, count(*) AS n, round(count(*) FILTER (n_chars > 300 AND quality = 1 OR n_chars <= 300 AND quality = 0) / count(*), 4) AS accuracy FROM labels JOIN docs USING (doc_id) GROUP BY quality")
def a37(spark, d):
    """Class distribution and accuracy of a length rule."""
    e = E(spark, d)
    guess = (F.col("n_chars") > 300).cast("int")
    return e.table("labels").join(e.docs.select("doc_id", "n_chars"), "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.round(F.count_if(guess == F.col("quality")) / F.count("*"), 4).alias("accuracy"))
