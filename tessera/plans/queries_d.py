"""Plans: scalar functions, classification, scoring, learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import dates as D
from tessera.functions import money as Y
from tessera.functions import rules as Q
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import relational as R
from tessera.operators.sequences import line_diff

from .entities import Entities as E
from .registry import plan

LONG = "bigint"
SQUASH = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
ENDINGS = r"s\.?p\.?a\.?|s\.?r\.?l\.?|s\.?a\.?s\.?|s\.?n\.?c\.?|ltd\.?|llc\.?|inc\.?|gmbh\.?|ag\.?|b\.?v\.?|n\.?v\.?|plc\.?|corp\.?|corporation|company|group|gruppo|holding|holdings|partecipazioni"


def stripped(c: str) -> str:
    return f"trim(regexp_replace({c}, '(?:\\s+|,\\s*)(?:{ENDINGS})\\s*$', ''))"


RAW = "name || CASE company_id % 6 WHEN 0 THEN ' (via Beta) S.p.A.' WHEN 1 THEN ', Holding S.r.l.' WHEN 2 THEN ' Technologies' WHEN 3 THEN ' logo' WHEN 4 THEN '-Group' ELSE ' Gruppo Holdings Ltd' END"


NO_LOGO = f"regexp_replace(regexp_replace(trim(lower({RAW})), '\\s*\\(.*\\)', ''), '\\s*logo\\s*$', '')"
NO_ENDING = f"regexp_replace({stripped(stripped(stripped(NO_LOGO)))}, '\\s+technologies\\s*$', '')"


@plan("f1_company_name", f"SELECT company_id, {SQUASH.format(NO_ENDING)} AS norm FROM companies")
def f1(spark, d):
    """Company names for matching (F2)."""
    k = F.col("company_id") % 6
    raw = F.concat("name", F.when(k == 0, " (via Beta) S.p.A.").when(k == 1, ", Holding S.r.l.").when(k == 2, " Technologies").when(k == 3, " logo").when(k == 4, "-Group").otherwise(" Gruppo Holdings Ltd"))
    return E(spark, d).companies.select("company_id", T.norm_company(raw).alias("norm"))


@plan("f3_slugify", "SELECT doc_id, regexp_replace(regexp_replace(translate(lower(title), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿß', 'aaaaaaceeeeiiiinooooouuuuyys'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM docs")
def f3(spark, d):
    return E(spark, d).docs.select("doc_id", T.slugify(F.col("title")).alias("slug"))


@plan("f5_dedupe_key", f"SELECT doc_id, left({SQUASH.format('title')}, 80) AS k, md5(text) AS h FROM docs")
def f5(spark, d):
    """Keys for exact matching, and hashes."""
    return E(spark, d).docs.select("doc_id", T.dedupe_key(F.col("title")).alias("k"), F.md5("text").alias("h"))


@plan("f6_redundant_summary", f", x AS (SELECT doc_id, {SQUASH.format('title')} AS t, {SQUASH.format('left(text, 120)')} AS s FROM docs) SELECT doc_id, s = t OR ((contains(s, t) OR contains(t, s)) AND abs(length(s) - length(t)) <= 20) AS redundant FROM x")
def f6(spark, d):
    return E(spark, d).docs.select("doc_id", T.redundant(F.left("text", F.lit(120)), F.col("title")).alias("redundant"))


@plan("f12_sanitize", r"SELECT page_id, left(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')), 500) AS clean FROM pages")
def f12(spark, d):
    return E(spark, d).table("pages").select("page_id", T.sanitize(F.col("html")).alias("clean"))


@plan("f13_sentence_cut")
def f13(spark, d):
    """Truncation at a sentence's end."""
    return E(spark, d).docs.select("doc_id", T.sentence_cut(F.col("text"), 300).alias("cut"))


@plan("f16_f17_places", "SELECT fund_id, CASE WHEN region = 'EUROPE' THEN 'EU' WHEN country LIKE '%_1' THEN 'one' ELSE upper(left(country, 6)) END AS place, region <> 'ASIA' AS domestic FROM funds")
def f16(spark, d):
    return E(spark, d).funds.select("fund_id", F.when(F.col("region") == "EUROPE", "EU").when(F.like("country", F.lit("%_1")), "one").otherwise(F.upper(F.left("country", F.lit(6)))).alias("place"), (F.col("region") != "ASIA").alias("domestic"))


@plan("f18_sector_canonical", "SELECT company_id, CASE WHEN contains(lower(sector), 'standard') THEN 'core' WHEN contains(lower(sector), 'promo') OR contains(lower(sector), 'economy') THEN 'value' ELSE 'size' END AS canon, [lower(sector), lower(brand)] AS tags FROM companies")
def f18(spark, d):
    """Sectors by keyword rules, longest first; tag lists distinct in order."""
    s = F.lower("sector")
    return E(spark, d).companies.select("company_id", Q.first_rule(s, [(["standard"], "core"), (["promo", "economy"], "value")], "size").alias("canon"), F.array_distinct(F.array(s, F.lower("brand"))).alias("tags"))


@plan("f20_language_score", r", w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(title), '[^a-zà-ÿ]+'), lambda x: x <> '') AS w FROM docs) SELECT doc_id, round(coalesce(len(list_filter(w, lambda x: x IN ('the', 'of', 'and', 'that', 'is'))) / nullif(len(w), 0), 0), 4) AS english, round(coalesce(len(list_filter(w, lambda x: x IN ('le', 'la', 'de', 'les', 'des'))) / nullif(len(w), 0), 0), 4) AS french FROM w")
def f20(spark, d):
    share = lambda ws: F.round(T.stop_word_share(F.col("title"), ws), 4)
    return E(spark, d).docs.select("doc_id", share(["the", "of", "and", "that", "is"]).alias("english"), share(["le", "la", "de", "les", "des"]).alias("french"))


@plan("f21_f23_word_sets", f", p AS (SELECT a.doc_id, list_distinct(string_split({SQUASH.format('a.title')}, ' ')) AS x, list_distinct(string_split({SQUASH.format('b.title')}, ' ')) AS y FROM docs a JOIN docs b ON b.doc_id = a.doc_id + 1) SELECT doc_id, round(len(list_intersect(x, y)) / least(len(x), len(y)), 4) AS overlap, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 4) AS jaccard FROM p WHERE len(x) > 0 AND len(y) > 0 AND x <> [''] AND y <> ['']")
def f21(spark, d):
    """Overlap and Jaccard of neighbouring titles' word sets."""
    t = E(spark, d).docs.select("doc_id", T.words(F.col("title")).alias("x"))
    o = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y"))
    return t.join(o, "doc_id").where((F.size("x") > 0) & (F.size("y") > 0)).select("doc_id", F.round(T.overlap(F.col("x"), F.col("y")), 4).alias("overlap"), F.round(T.jaccard(F.col("x"), F.col("y")), 4).alias("jaccard"))


@plan("f23_name_similarity", """, p AS (SELECT a.company_id, lower(a.name) AS x, lower(b.name) AS y FROM companies a JOIN companies b ON b.company_id = a.company_id + 1)
SELECT company_id, round(CASE WHEN x = y THEN 1 WHEN contains(x, y) OR contains(y, x) THEN least(length(x), length(y)) * 0.95 / greatest(length(x), length(y)) ELSE 0.4 * len(list_intersect(list_distinct(string_split(x, '')), list_distinct(string_split(y, '')))) / len(list_distinct(list_concat(string_split(x, ''), string_split(y, '')))) + 0.6 * len(list_intersect(string_split(x, ' '), string_split(y, ' '))) / len(list_distinct(list_concat(string_split(x, ' '), string_split(y, ' ')))) END, 4) AS sim FROM p""")
def f23(spark, d):
    c = E(spark, d).companies.select("company_id", "name")
    o = c.select((F.col("company_id") - 1).alias("company_id"), F.col("name").alias("other"))
    return c.join(o, "company_id").select("company_id", F.round(T.similarity(F.col("name"), F.col("other")), 4).alias("sim"))


@plan("f24_line_diff", "SELECT a.doc_id, len(list_filter(string_split(b.text, chr(10)), lambda l: NOT list_contains(string_split(a.text, chr(10)), l))) AS added, len(list_filter(string_split(a.text, chr(10)), lambda l: NOT list_contains(string_split(b.text, chr(10)), l))) AS removed FROM docs a JOIN docs b ON b.doc_id = a.doc_id + 1")
def f24(spark, d):
    """Lines added and removed between versions of any length, by a set of each version's lines; null where a version has no text. The sequence
    form with ratio and opcodes is ``operators.sequences``."""
    x = E(spark, d).docs.select("doc_id", F.col("text").alias("a"))
    y = x.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return x.join(y, "doc_id").select("doc_id", line_diff(F.col("a"), F.col("b")).alias("n")).select("doc_id", "n.added", "n.removed")


@plan("f24_line_diff_whole")
def f24_whole(spark, d):
    """The same, under the name of a time when ``f24_line_diff`` had short versions alone."""
    return f24(spark, d)


@plan("f26_extraction", r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+')) AS mails, len(regexp_extract_all(text, '@([A-Za-z0-9_.]+)')) AS mentions, len(regexp_extract_all(text, '#([A-Za-z0-9_]+)')) AS tags FROM docs")
def f26(spark, d):
    n = lambda c: F.size(c).cast(LONG)
    return E(spark, d).docs.select("doc_id", n(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+"), 0)).alias("mails"), n(T.mentions(F.col("text"))).alias("mentions"), n(T.hashtags(F.col("text"))).alias("tags"))


AMOUNT = "CASE l_linenumber % 5 WHEN 0 THEN '1,5 Bln Euro' WHEN 1 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' mln' WHEN 2 THEN '2.500,75' WHEN 3 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || 'k' ELSE 'n.a.' END"


@plan("f27_f36_amounts", "SELECT l_linenumber, CAST(CAST(l_quantity AS INTEGER) AS BIGINT) AS q, CASE l_linenumber % 5 WHEN 0 THEN 1500000000.0 WHEN 1 THEN CAST(l_quantity AS INTEGER) * 1000000.0 WHEN 2 THEN 2500.75 WHEN 3 THEN CAST(l_quantity AS INTEGER) * 1000.0 END AS amount, CASE WHEN l_linenumber % 5 = 1 THEN CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) ELSE 0.0 END AS millions, count(*) AS n FROM lineitem GROUP BY ALL")
def f27(spark, d):
    """Amounts in free text, in units and in millions."""
    q = F.col("l_quantity").cast("int").cast("string")
    k = F.col("l_linenumber") % 5
    text = F.when(k == 0, "1,5 Bln Euro").when(k == 1, F.concat(q, F.lit(" mln"))).when(k == 2, "2.500,75").when(k == 3, F.concat(q, F.lit("k"))).otherwise("n.a.")
    return E(spark, d).table("lineitem").groupBy("l_linenumber", F.col("l_quantity").cast("int").cast(LONG).alias("q"), Y.parse_amount(text).alias("amount"), Y.max_amount_millions(text).alias("millions")).agg(F.count("*").alias("n"))


@plan("f29_f30_sentences", "SELECT fund_id, upper(left(category, 1)) || substr(category, 2) || ' fund in ' || country AS line FROM funds")
def f29(spark, d):
    """Readable names and sentences."""
    return E(spark, d).funds.select("fund_id", F.concat_ws(" ", T.humanise(F.col("category")), F.lit("fund in"), "country").alias("line"))


@plan("f31_free_dates", """, x AS (SELECT order_id, line, deal_date AS d, (order_id + line) % 6 AS k FROM deals) SELECT order_id, line, CASE WHEN k = 5 THEN NULL WHEN year(d) < 2000 THEN NULL ELSE d END AS parsed, count(*) AS n FROM x GROUP BY ALL""")
def f31(spark, d):
    """Free-text dates in five spellings and one that is none."""
    day, k = F.col("deal_date"), (F.col("order_id") + F.col("line")) % 6
    text = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "dd.MM.yyyy")).when(k == 2, F.date_format(day, "d MMMM yyyy")).when(k == 3, F.date_format(day, "MMM d, yyyy")).when(k == 4, F.date_format(day, "dd/MM/yyyy")).otherwise("soon")
    return E(spark, d).deals.select("order_id", "line", D.parse(text, F.lit("2002-01-01").cast("date")).alias("parsed")).groupBy("order_id", "line", "parsed").agg(F.count("*").alias("n"))


@plan("f34_canonical_url", r"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#:]*)', 1)) || CASE WHEN regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/$', '') END || CASE WHEN contains(url, 'page=2') THEN '?page=2' ELSE '' END AS canonical, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^(www|m)\.', '') AS domain FROM pages""")
def f34(spark, d):
    """Canonical URLs and domains."""
    return E(spark, d).table("pages").select("page_id", U.canonical(F.col("url")).alias("canonical"), U.domain(F.col("url")).alias("domain"))


@plan("f38_f39_labels_and_stops", """, x AS (SELECT fund_id, CAST(inv_max AS DOUBLE) AS v FROM funds) SELECT fund_id, CASE WHEN v >= 1e6 AND v / 1e6 >= 10 THEN '€' || CAST(floor(v / 1e6) AS BIGINT) || 'M' WHEN v >= 1e6 THEN '€' || CAST(floor(v / 1e6) AS BIGINT) || 'M' ELSE '€' || CAST(floor(v) AS BIGINT) END AS label, CASE WHEN v < 5e6 THEN 0 WHEN v = 5e6 THEN 0 WHEN v <= 17.5e6 THEN 1 ELSE 2 END AS stop FROM x""")
def f38(spark, d):
    """Short labels, and the nearest slider stop of 0, 10M, 25M, 29M."""
    v = F.col("inv_max").cast("double")
    return E(spark, d).funds.select("fund_id", Y.label(v).alias("label"), Y.nearest_stop(F.array(*map(F.lit, (0.0, 1e7, 2.5e7, 5e7))), v).cast("int").alias("stop"))


@plan("f42_tenure", "SELECT c_custkey, list_sort(list(DISTINCT year(o_orderdate))) AS years, max(year(o_orderdate)) - min(year(o_orderdate)) AS tenure FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def f42(spark, d):
    """Experience over a nested list."""
    e = E(spark, d)
    per = e.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_set(F.year("o_orderdate").cast(LONG))).alias("years"))
    return e.table("customer").select("c_custkey").join(per, "c_custkey").select("c_custkey", "years", (F.array_max("years") - F.array_min("years")).alias("tenure"))


@plan("f44_priority_score", "SELECT fund_id, round(CASE WHEN aum > 0 THEN greatest(0, log10(aum) - 7) * 10 ELSE 0 END + CASE WHEN category = 'pe' THEN 15 ELSE 0 END, 4) AS score FROM funds")
def f44(spark, d):
    return E(spark, d).funds.select("fund_id", F.round(F.when(F.col("aum") > 0, F.greatest(F.lit(0.0), F.log10("aum") - 7) * 10).otherwise(0.0) + Q.if_then(F.col("category") == "pe", 15), 4).alias("score"))


RULES_SQL = " ".join("WHEN " + " OR ".join(f"contains(t, '{k.replace(chr(39), chr(39) * 2)}')" for k in keys) + f" THEN '{label}'" for keys, label in Q.NEWS_RULES)


@plan("c1_news_rules", f", x AS (SELECT doc_id, trim(lower(title)) AS t FROM docs) SELECT doc_id, CASE WHEN length(t) < 20 OR NOT contains(t, ' ') THEN 'noise' {RULES_SQL} ELSE 'other' END AS type FROM x")
def c1(spark, d):
    """Ordered keyword rules, the first match wins."""
    return E(spark, d).docs.select("doc_id", Q.news_type(F.col("title")).alias("type"))


@plan("c3_two_phase_corrections", "SELECT signal_id, CASE WHEN t = 'exit_announced' AND score < 20 THEN 'website_change' ELSE t END AS type FROM (SELECT *, CASE WHEN type = 'website_change' AND score > 60 THEN 'deal_announced' WHEN type = 'people_move' AND company_id % 2 = 0 THEN 'exit_announced' ELSE type END AS t FROM signals)")
def c3(spark, d):
    """Universal demotions after corrections by current type, in two phases."""
    t = F.col("type")
    first = F.when((t == "website_change") & (F.col("score") > 60), "deal_announced").when((t == "people_move") & (F.col("company_id") % 2 == 0), "exit_announced").otherwise(t)
    s = E(spark, d).signals.withColumn("t", first)
    return s.select("signal_id", F.when((F.col("t") == "exit_announced") & (F.col("score") < 20), "website_change").otherwise(F.col("t")).alias("type"))


@plan("c6_multi_label", "SELECT doc_id, list_sort(list_filter([CASE WHEN contains(t, 'the') THEN 'en' END, CASE WHEN contains(t, 'que') OR contains(t, 'les') THEN 'romance' END, CASE WHEN contains(t, 'und') THEN 'de' END], lambda x: x IS NOT NULL)) AS labels FROM (SELECT doc_id, lower(title) AS t FROM docs)")
def c6(spark, d):
    return E(spark, d).docs.select("doc_id", Q.every_label(F.lower("title"), [(["the"], "en"), (["que", "les"], "romance"), (["und"], "de")]).alias("labels"))


@plan("c7_quality_score", """SELECT signal_id, least(greatest(50 + CASE WHEN published_at IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN type IN ('deal_announced', 'exit_announced') THEN 20 ELSE 0 END - CASE WHEN type = 'website_change' THEN 45 ELSE 0 END + CASE WHEN score >= 80 THEN 25 WHEN score >= 40 THEN 10 ELSE 0 END - CASE WHEN company_id % 10 = 0 THEN 20 ELSE 0 END, 0), 100) AS quality FROM signals""")
def c7(spark, d):
    """Additive score within 0 to 100."""
    t = F.col("type")
    q = Q.score(F.lit(50), Q.if_then(F.col("published_at").isNotNull(), 15), Q.if_then(t.isin("deal_announced", "exit_announced"), 20), -Q.if_then(t == "website_change", 45), Q.band(F.col("score"), [(80, 25), (40, 10)], 0), -Q.if_then(F.col("company_id") % 10 == 0, 20))
    return E(spark, d).signals.select("signal_id", q.cast("int").alias("quality"))


@plan("c9_relevance", r""", x AS (SELECT doc_id, len(regexp_extract_all(lower(text), '(^|[^a-z])the([^a-z]|$)')) AS a, len(regexp_extract_all(lower(text), '(^|[^a-z])und([^a-z]|$)')) AS b FROM docs) SELECT doc_id, round(least(1.0, CASE WHEN a > 0 THEN least(0.4 * (1 + 0.1 * (a - 1)), 0.6) ELSE 0 END + CASE WHEN b > 0 THEN least(0.25 * (1 + 0.1 * (b - 1)), 0.4) ELSE 0 END), 3) AS relevance, list_filter([CASE WHEN a > 0 THEN 'direct' END, CASE WHEN b > 0 THEN 'city' END], lambda z: z IS NOT NULL) AS reasons FROM x""")
def c9(spark, d):
    """Relevance: weighted mentions, each capped, with reasons (weights and caps of direct and city mentions)."""
    a, b = F.regexp_count(F.lower("text"), F.lit("(^|[^a-z])the([^a-z]|$)")), F.regexp_count(F.lower("text"), F.lit("(^|[^a-z])und([^a-z]|$)"))
    capped = lambda n, w, top: F.when(n > 0, F.least(w * (1 + 0.1 * (n - 1)), F.lit(top))).otherwise(0.0)
    return E(spark, d).docs.select("doc_id", F.round(F.least(F.lit(1.0), capped(a, 0.4, 0.6) + capped(b, 0.25, 0.4)), 3).alias("relevance"), Q.reasons((a > 0, "direct"), (b > 0, "city")).alias("reasons"))


@plan("c13_profile_rules", "SELECT c_custkey, CASE WHEN c_acctbal >= 8000 THEN 'partner' WHEN c_acctbal >= 4000 THEN 'director' WHEN c_acctbal >= 0 THEN 'analyst' ELSE 'intern' END AS seniority FROM customer")
def c13(spark, d):
    return E(spark, d).table("customer").select("c_custkey", Q.band(F.col("c_acctbal"), [(8000, "partner"), (4000, "director"), (0, "analyst")], "intern").alias("seniority"))


@plan("c16_speculative_context")
def c16(spark, d):
    """Mentions within a context that makes them speculative are suppressed."""
    found = T.contexts(F.col("text"), "the|die|el|le", 60)
    firm = F.filter(found, lambda c: ~F.rlike(c, F.lit(r"(?i)\b(would|could|may|rumou?r)\b")))
    return E(spark, d).docs.select("doc_id", F.size(found).cast(LONG).alias("mentions"), F.size(firm).cast(LONG).alias("firm"))


@plan("x5_text_features", r", w AS (SELECT doc_id, unnest(regexp_extract_all(lower(title), '[a-z]+')) AS w FROM docs), n AS (SELECT w, count(DISTINCT doc_id) AS df FROM w GROUP BY w HAVING count(DISTINCT doc_id) >= 5) SELECT doc_id, count(*) AS terms, round(sum(ln((1 + (SELECT count(*) FROM docs)) / (1 + df)) + 1), 4) AS weight FROM w JOIN n USING (w) GROUP BY doc_id")
def x5(spark, d):
    """Smoothed TF-IDF weights of a vocabulary with a least document frequency."""
    docs = E(spark, d).docs
    w = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]+"), 0)).alias("w"))
    df = w.distinct().groupBy("w").agg(F.count("*").alias("df")).where("df >= 5")
    total = docs.agg(F.count("*").alias("n"))
    idf = df.join(F.broadcast(total)).select("w", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    return w.join(idf, "w").groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("idf"), 4).alias("weight"))


@plan("x6_classifier")
def x6(spark, d):
    """TF-IDF and logistic regression on labelled documents, predictions for all of them."""
    from tessera.ml import predicted, text_classifier

    e = E(spark, d)
    rows = e.table("labels").select("doc_id", F.col("quality").alias("label")).join(e.docs.select("doc_id", "text"), "doc_id")
    return predicted(text_classifier(rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)), rows).select("doc_id", "label", F.col("prediction").cast("int").alias("prediction"))
