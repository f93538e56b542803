"""Plans: further joins, reports, parsers and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rules as Q
from tessera.operators import relational as R
from tessera.operators import sinks
from tessera.sources import files, html

from .entities import Entities as E
from .registry import plan

LONG = "bigint"


@plan("s3_priority_scan", "SELECT doc_id, source FROM documents WHERE lang = 'fr'")
def s3(spark, d):
    """The first of several paths that exists: enriched, filtered, raw."""
    paths = [f"{d}/documents_enriched.parquet", f"{d}/documents_filtered.parquet", f"{d}/documents.parquet"]
    return files.first_existing(spark, paths, spark.read.parquet).where("lang = 'fr'").select("doc_id", "source")


@plan("s7_side_file", "SELECT f.fund_id, 'https://link/' || c.c_name AS link FROM funds f LEFT JOIN customer c ON c.c_custkey = f.fund_id AND c.c_acctbal > 0 AND c.c_mktsegment <> 'BUILDING'")
def s7(spark, d):
    """Side data with a row filter, joined left."""
    e = E(spark, d)
    side = e.table("customer").where("c_acctbal > 0 and c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("fund_id"), F.concat(F.lit("https://link/"), "c_name").alias("link"))
    return e.funds.select("fund_id").join(side, "fund_id", "left")


@plan("s17_card_items", r"SELECT page_id, len(regexp_extract_all(html, '(?i)<li[^>]*>')) AS entries FROM pages")
def s17b(spark, d):
    """List entries of pages; the names themselves come from ``html.items``."""
    return E(spark, d).table("pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("(?i)<li[^>]*>"), 0)).cast(LONG).alias("entries"))


@plan("s17_item_names")
def s17c(spark, d):
    """Names on cards, logos and list entries."""
    return E(spark, d).table("pages").select("page_id", html.items(F.col("html")).alias("names"))


@plan("s20_record_variants", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END, CASE WHEN event_id % 2 = 0 THEN 'alt-' || user_id END, 'none') AS kind FROM events")
def s20(spark, d):
    """Records under variant field names made uniform."""
    e = E(spark, d).table("events")
    v = e.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("type"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("alt-"), "user_id")).alias("eventKind"), F.lit("none").alias("fallback"))
    return files.renamed(v, {"event_id": ["event_id"], "kind": ["kind", "type", "eventKind", "fallback"]})


@plan("p30_backoff_gate", """, l AS (SELECT url_id, max(observed_at) AS at, arg_max(event_type, struct_pack(a := observed_at, b := signal_id)) AS last FROM signals GROUP BY url_id) SELECT fund_id FROM funds f LEFT JOIN l ON l.url_id = f.fund_id WHERE l.at IS NULL OR last <> 'error' OR l.at + INTERVAL 4 HOUR <= (SELECT max(ts) FROM events)""")
def p30(spark, d):
    """What may be checked at ``as_of``: never checked, last check sound, or the wait is over."""
    e = E(spark, d)
    last = e.signals.groupBy(F.col("url_id").alias("fund_id")).agg(F.max("observed_at").alias("at"), F.max_by("event_type", F.struct("observed_at", "signal_id")).alias("last"))
    as_of = e.table("events").agg(F.max("ts").alias("as_of"))
    x = e.funds.select("fund_id").join(last, "fund_id", "left").join(F.broadcast(as_of))
    return x.where(F.col("at").isNull() | (F.col("last") != "error") | (F.col("at") + F.expr("INTERVAL 4 HOURS") <= F.col("as_of"))).select("fund_id")


@plan("j15_metrics_match", """, m AS (SELECT c_custkey AS target_id, CASE c_custkey % 3 WHEN 0 THEN 'fund-' || c_custkey % 20 WHEN 1 THEN 'supplier#' || lpad(CAST(c_custkey % 20 AS VARCHAR), 9, '0') ELSE 'other' END AS k FROM customer), t AS (SELECT target_id, 0 AS r, min(fund_id) AS fund_id FROM m JOIN funds ON slug = k GROUP BY 1 UNION ALL SELECT target_id, 1, min(fund_id) FROM m JOIN funds ON lower(name) = k GROUP BY 1)
SELECT m.target_id, arg_min(t.fund_id, t.r) AS fund_id, CASE min(t.r) WHEN 0 THEN 'slug' WHEN 1 THEN 'name' ELSE 'none' END AS tier FROM m LEFT JOIN t USING (target_id) GROUP BY m.target_id""")
def j15(spark, d):
    """Rows of another source matched by slug, else by name."""
    e = E(spark, d)
    i = F.col("c_custkey")
    k = F.when(i % 3 == 0, F.concat(F.lit("fund-"), i % 20)).when(i % 3 == 1, F.concat(F.lit("supplier#"), F.lpad((i % 20).cast("string"), 9, "0"))).otherwise("other")
    t = e.table("customer").select(i.alias("target_id"), k.alias("k"))
    return R.cascade(t, e.funds.select("fund_id", "slug", F.lower("name").alias("name")), "target_id", "fund_id", [("slug", F.col("k"), F.col("slug")), ("name", F.col("k"), F.col("name"))])


@plan("j17_routing", "SELECT signal_id, fund_id, 'own' AS via FROM signals WHERE type = 'deal_announced' UNION ALL SELECT signal_id, (fund_id + 1) % 10, 'organiser' FROM signals WHERE type = 'deal_announced' AND company_id % 4 = 0")
def j17(spark, d):
    """Signals fanned out to further funds that the text names in a role."""
    s = E(spark, d).signals.where("type = 'deal_announced'")
    extra = s.where("company_id % 4 = 0").select("signal_id", ((F.col("fund_id") + 1) % 10).alias("fund_id"), F.lit("organiser").alias("via"))
    return s.select("signal_id", "fund_id", F.lit("own").alias("via")).unionByName(extra)


@plan("j21_gap_fill", "SELECT company_id, coalesce(c.v, k.v, 'unknown') AS sector FROM (SELECT company_id, CASE WHEN company_id % 3 <> 0 THEN sector END AS v, name FROM companies) c LEFT JOIN (SELECT name, min(sector) AS v FROM companies GROUP BY name) k USING (name)")
def j21(spark, d):
    """Gaps filled from a knowledge base by normalised name; values that are there stay."""
    c = E(spark, d).companies
    kb = c.groupBy("name").agg(F.min("sector").alias("sector"))
    own = c.select("company_id", "name", F.when(F.col("company_id") % 3 != 0, F.col("sector")).alias("sector"))
    return R.fill_from(own, kb, ["name"], ["sector"], right_wins=False).select("company_id", F.coalesce("sector", F.lit("unknown")).alias("sector"))


@plan("j25_parity", "SELECT fund_id, count(*) FILTER (b IS NULL) AS only_filtered, count(*) FILTER (a IS NULL) AS only_enriched FROM (SELECT coalesce(x.fund_id, y.fund_id) AS fund_id, x.signal_id AS a, y.signal_id AS b FROM (SELECT * FROM signals WHERE score > 20) x FULL JOIN (SELECT * FROM signals WHERE score < 60) y USING (signal_id)) GROUP BY fund_id")
def j25(spark, d):
    """Two result sets compared per fund, both ways."""
    s = E(spark, d).signals.select("fund_id", "signal_id", "score")
    x = R.diff(s.where("score > 20"), s.where("score < 60"), ["fund_id", "signal_id"], [])
    return x.groupBy("fund_id").agg(F.count_if(F.col("change") == "removed").alias("only_filtered"), F.count_if(F.col("change") == "added").alias("only_enriched"))


@plan("a31_completeness", "SELECT fund_id, round(((aum > 0)::INT + (inv_min IS NOT NULL)::INT + (inv_max <> 0)::INT) / 3.0, 4) AS complete, list_filter([CASE WHEN NOT aum > 0 THEN 'aum' END, CASE WHEN inv_min IS NULL THEN 'min' END, CASE WHEN inv_max = 0 THEN 'max' END], lambda x: x IS NOT NULL) AS missing FROM funds")
def a31(spark, d):
    """Completeness and what is missing."""
    has = {"aum": F.col("aum") > 0, "min": F.col("inv_min").isNotNull(), "max": F.col("inv_max") != 0}
    total = sum((c.cast("int") for c in has.values()), F.lit(0))
    return E(spark, d).funds.select("fund_id", F.round(total / F.lit(3.0), 4).alias("complete"), Q.reasons(*((~c, k) for k, c in has.items())).alias("missing"))


@plan("a33_clusters", "SELECT country, count(*) AS n, list(struct_pack(fund_id := fund_id, slug := slug) ORDER BY fund_id) AS members FROM funds GROUP BY country")
def a33(spark, d):
    """Members gathered per place, as sorted structs."""
    return E(spark, d).funds.groupBy("country").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("fund_id", "slug"))).alias("members"))


@plan("a38_storage_stats", "SELECT count(*) AS docs, count(DISTINCT sha256(text)) AS blobs, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents")
def a38(spark, d):
    t = E(spark, d).table("documents")
    return t.agg(F.count("*").alias("docs"), F.countDistinct(F.sha2("text", 256)).alias("blobs"), F.sum(F.octet_length("text")).alias("bytes"))


@plan("k6_blobs", "SELECT sha256(text) AS hash FROM documents WHERE text IS NOT NULL GROUP BY 1")
def k6(spark, d):
    """Content-addressed blobs."""
    return sinks.blobs(E(spark, d).table("documents").select("text"), "text").select("hash")


@plan("k9_summary_report", "SELECT lang, count(*) AS \"rows\", round(count(text) / count(*), 4) AS text_filled, round(count(source) / count(*), 4) AS source_filled FROM documents GROUP BY lang")
def k9(spark, d):
    return sinks.summary(E(spark, d).table("documents").select("lang", "text", "source"), ["lang"])


@plan("f14_label_prefix", r"SELECT doc_id, trim(regexp_replace(title, '(?i)^(of|the|is|de|la|und|en)[ ,:-]+', '')) AS bare FROM docs")
def f14(spark, d):
    return E(spark, d).docs.select("doc_id", F.trim(F.regexp_replace("title", "(?i)^(of|the|is|de|la|und|en)[ ,:-]+", "")).alias("bare"))


@plan("f15_doubled_letters")
def f15(spark, d):
    """Letters that a scan doubled made single, where every letter of a word is doubled; needs a back-reference, so it has no SQL."""
    doubled = F.rlike("name", F.lit(r"^(?:(\S)\1|\s)+$"))
    two = E(spark, d).companies.select("company_id", F.regexp_replace("name", r"(\S)", "$1$1").alias("name"))
    return two.select("company_id", F.when(doubled, F.regexp_replace("name", r"(\S)\1", "$1")).otherwise(F.col("name")).alias("name"))


@plan("f41_row_parser", "SELECT doc_id, nullif(trim(split_part(title, ' ', 1)), '') AS name, nullif(trim(split_part(title, ' ', 3)), '') AS amount, NULL AS year FROM docs")
def f41(spark, d):
    """Cells under canonical names, by a header whose spelling varies."""
    rows = E(spark, d).docs.select(F.concat(F.array(F.col("doc_id").cast("string")), F.split("title", " ")).alias("cells"))
    got = files.table_rows(rows, "cells", ["Id", "Nome", "skip", "Importo"], {"doc_id": ["id"], "name": ["name", "nome"], "amount": ["amount", "importo"], "year": ["anno"]})
    return got.withColumn("doc_id", F.col("doc_id").cast(LONG))


@plan("f43_canonical_values", "SELECT CASE WHEN contains(lower(c_mktsegment), 'build') OR contains(lower(c_mktsegment), 'furn') THEN 'Home' WHEN contains(lower(c_mktsegment), 'auto') THEN 'Cars' ELSE 'Other' END AS segment, count(*) AS n FROM customer GROUP BY 1")
def f43(spark, d):
    return E(spark, d).table("customer").groupBy(Q.first_rule(F.lower("c_mktsegment"), [(["build", "furn"], "Home"), (["auto"], "Cars")], "Other").alias("segment")).agg(F.count("*").alias("n"))


@plan("t12_guarded_scopes", "SELECT fund_id, n = 0 OR (o >= 4 AND n < 0.5 * o) AS guarded FROM (SELECT fund_id, count(*) AS o, count(*) FILTER (company_id % 4 = fund_id % 4) AS n FROM items GROUP BY fund_id)")
def t12(spark, d):
    """Scopes whose new rows are none, or fewer than half of four or more old ones."""
    x = E(spark, d).items.groupBy("fund_id").agg(F.count("*").alias("o"), F.count_if(F.col("company_id") % 4 == F.col("fund_id") % 4).alias("n"))
    return x.select("fund_id", ((F.col("n") == 0) | ((F.col("o") >= 4) & (F.col("n") < 0.5 * F.col("o")))).alias("guarded"))


@plan("t14_bounded_log", ", r AS (SELECT *, row_number() OVER (PARTITION BY fund_id ORDER BY signal_id DESC) AS k FROM signals) SELECT signal_id FROM r WHERE k <= 50")
def t14(spark, d):
    """The last fifty records of each key."""
    return R.first_per_key(E(spark, d).signals.select("fund_id", "signal_id"), ["fund_id"], [F.desc("signal_id")], 50).select("signal_id")
