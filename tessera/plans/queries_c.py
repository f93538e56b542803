"""Plans: dedup, windows, ordering, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import dates as D
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import dedup as X
from tessera.operators import relational as R

from .entities import Entities as E
from .registry import plan

LONG = "bigint"
KEY = "left(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), 80)"


@plan("d1_exact_two_keys")
def d1(spark, d):
    """Greedy dedup by two keys within a source: newest first, a row suppressed by either key registers neither."""
    x = E(spark, d).docs.select("doc_id", "source", T.dedupe_key(F.col("title")).alias("k1"), F.concat(F.col("lang"), F.col("n_chars") % 50).alias("k2"))
    return X.greedy_keys(x, ["source"], "doc_id", ["k1", "k2"], [F.desc("doc_id")]).select("doc_id")


@plan("d2_listing_exempt", r"""SELECT page_id, regexp_matches(url, '^[a-z]+://[^/?#]+(/[^?#]*)?/([?#].*)?$') OR regexp_matches(url, '(?i)/(news|press|blog|portfolio|team|insights|media|index.html)([?#].*)?$') OR NOT regexp_matches(url, '^[a-z]+://[^/?#]+/') AS listing_or_slash FROM pages""")
def d2(spark, d):
    u = F.col("url")
    raw_slash = F.rlike(u, F.lit(r"^[a-z]+://[^/?#]+(/[^?#]*)?/([?#].*)?$"))
    return E(spark, d).table("pages").select("page_id", (raw_slash | U.is_listing(u)).alias("listing_or_slash"))


@plan("d3_cross_fund_url", """, r AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY n_chars DESC, doc_id) AS k FROM docs), s AS (SELECT title, list(DISTINCT source ORDER BY source) AS all_sources FROM docs GROUP BY title) SELECT doc_id, list_filter(all_sources, lambda x: x <> source) AS co_sources FROM r JOIN s USING (title) WHERE k = 1""")
def d3(spark, d):
    """One row per key, the best; the losers' sources are gathered, sorted."""
    x = E(spark, d).docs.select("doc_id", "title", "source", "n_chars")
    g = x.groupBy("title").agg(F.min(F.struct((-F.col("n_chars")).alias("q"), "doc_id", "source")).alias("b"), F.collect_set("source").alias("all"))
    return g.select("b.doc_id", F.array_sort(F.array_remove("all", F.col("b.source"))).alias("co_sources"))


@plan("d4_three_key_merge")
def d4(spark, d):
    """Greedy merge by three global keys: components of rows that share a key first, then the greedy pass within each; the survivor unites the sources."""
    x = E(spark, d).docs.select("doc_id", "source", T.dedupe_key(F.col("title")).alias("k1"), F.concat_ws("/", "source", "n_chars").alias("k2"), F.md5("text").alias("k3"))
    return X.greedy_merge(x, "doc_id", ["k1", "k2", "k3"], [F.col("doc_id")], "source").select("doc_id", "sources")


@plan("d6_near_pairs", """, w AS (SELECT signal_id, fund_id, published_at AS t, string_split('a' || company_id || ' b' || url_id || ' c' || company_id % 40 || ' ' || type, ' ') AS w FROM signals)
, p AS (SELECT a.fund_id, a.signal_id AS a, b.signal_id AS b, len(list_intersect(a.w, b.w)) AS common, len(list_intersect(a.w, b.w)) / 4.0 AS ratio, abs(date_diff('day', CAST(a.t AS DATE), CAST(b.t AS DATE))) AS days FROM w a JOIN w b ON a.fund_id = b.fund_id AND a.signal_id < b.signal_id)
SELECT fund_id, a, b, common, round(ratio, 4) AS ratio, days FROM p WHERE (days IS NULL AND ratio >= 0.6) OR (days <= 3 AND ratio >= 0.4) OR (days <= 7 AND ratio >= 0.5)""")
def d6(spark, d):
    """Near-duplicate pairs: overlap 0.4 within 3 days, 0.5 within 7, 0.6 undated."""
    s = E(spark, d).signals
    words = F.array(F.concat(F.lit("a"), "company_id"), F.concat(F.lit("b"), "url_id"), F.concat(F.lit("c"), F.col("company_id") % 40), F.col("type"))
    return R.pairs_by_word(s.select("fund_id", "signal_id", words.alias("w"), F.col("published_at").alias("t")), ["fund_id"], "signal_id", "w", "t", [(3, 0.4), (7, 0.5)], 0.6)


@plan("d6_semantic_survivors")
def d6_greedy(spark, d):
    """Greedy near-duplicate suppression within a source, best quality first: titles without the words of their source and of deals, the larger of the
    native and the mapped overlap over the smaller native set, whole days; fewer than three words pass and suppress nothing."""
    x = dated(E(spark, d).docs).select("doc_id", "source", "at", F.array_except(T.content_words(F.col("title"), T.TITLE_WORDS), T.words(F.col("source"))).alias("native"), T.words(F.col("title")).alias("all"), F.col("n_chars").alias("quality"))
    x = x.withColumn("words", T.to_english(F.col("native")))
    return X.greedy_similar(x, ["source"], "doc_id", "words", "all", "at", [F.desc("quality"), F.col("doc_id")], native="native", whole_days=True).select("doc_id")


def dated(docs):
    """Documents with a time, a function of the doc_id; some have none."""
    return docs.withColumn("at", F.when(F.col("doc_id") % 5 != 0, F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("doc_id"), F.lit(60)) * 43_200)))


@plan("d7_semantic_feed")
def d7(spark, d):
    """The feed's form of the same: rows in the order they come, mapped words alone, fractions of days, the feed's own structural words."""
    x = dated(E(spark, d).docs).select("doc_id", "source", "at", T.to_english(T.content_words(F.col("title"))).alias("words"), T.words(F.col("title")).alias("all"))
    return X.greedy_similar(x, ["source"], "doc_id", "words", "all", "at", [F.col("doc_id")]).select("doc_id")


@plan("d8_news_upsert", """, v AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 4 = 0 THEN '' ELSE coalesce(trim(title), '') END AS what, doc_id % 3 AS quality, CASE WHEN doc_id % 5 = 0 THEN -1 ELSE doc_id % 2 END AS observed, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE doc_id % 2 END AS created FROM docs)
SELECT source, lang, arg_max(doc_id, struct_pack(a := what <> '', b := quality, c := observed, d := created, e := length(what), f := -doc_id)) AS doc_id FROM v GROUP BY source, lang""")
def d8(spark, d):
    """Best version of a key by an ordered preference: a text, then quality, then the newer observation and creation (none is older than any),
    then the longer text; of equals the first (T2)."""
    i = F.col("doc_id")
    what = F.when(i % 4 == 0, "").otherwise(F.coalesce(F.trim("title"), F.lit("")))
    v = E(spark, d).docs.select("doc_id", "source", "lang", what.alias("what"), (i % 3).alias("quality"), F.when(i % 5 == 0, -1).otherwise(i % 2).alias("observed"), F.when(i % 7 == 0, -1).otherwise(i % 2).alias("created"))
    best = F.max(F.struct((F.col("what") != "").alias("a"), "quality", "observed", "created", F.char_length("what").alias("e"), (-i).alias("f")))
    return v.groupBy("source", "lang").agg((-best["f"]).alias("doc_id"))


@plan("d9_first_per_key", f"SELECT min(doc_id) AS doc_id FROM docs GROUP BY {KEY}")
def d9(spark, d):
    """First row per key."""
    return E(spark, d).docs.groupBy(T.dedupe_key(F.col("title")).alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@plan("d12_canonical_url", r"""SELECT min(page_id) AS page_id FROM pages GROUP BY lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#:]*)', 1)) || CASE WHEN regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/$', '') END || array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: NOT regexp_matches(x, '^(utm_source|ref)=') AND x <> '')), '&')""")
def d12(spark, d):
    return E(spark, d).table("pages").groupBy(U.canonical(F.col("url")).alias("u")).agg(F.min("page_id").alias("page_id")).select("page_id")


@plan("d13_sentence_dedup")
def d13(spark, d):
    """Sentences that repeat earlier words are dropped, in texts of any length."""
    return E(spark, d).docs.select("doc_id", T.once_per_sentence(F.col("text")).alias("text"))


@plan("d14_fingerprint", "SELECT substr(md5(coalesce(title, '') || '|' || coalesce(lang, '')), 1, 12) AS fp, count(*) AS n FROM docs GROUP BY 1 HAVING count(*) > 1")
def d14(spark, d):
    return E(spark, d).docs.groupBy(F.substring(F.md5(F.concat(F.coalesce("title", F.lit("")), F.lit("|"), F.coalesce("lang", F.lit("")))), 1, 12).alias("fp")).agg(F.count("*").alias("n")).where("n > 1")


@plan("d16_ordered_union", "SELECT signal_id, CASE WHEN fund_id = (fund_id * 7) % 10 THEN [fund_id] ELSE [fund_id, (fund_id * 7) % 10] END AS related FROM signals")
def d16(spark, d):
    """Union of lists, order kept."""
    return E(spark, d).signals.select("signal_id", F.array_distinct(F.concat(F.array("fund_id"), F.array((F.col("fund_id") * 7) % 10))).alias("related"))


@plan("w1_latest_per_key", ", r AS (SELECT *, row_number() OVER (PARTITION BY url_id ORDER BY observed_at DESC, signal_id) AS k FROM signals) SELECT url_id, signal_id, k FROM r WHERE k <= 2")
def w1(spark, d):
    """Latest and second latest version of each key."""
    return R.first_per_key(E(spark, d).signals, ["url_id"], [F.desc("observed_at"), F.col("signal_id")], 2, "k").select("url_id", "signal_id", F.col("k").cast(LONG).alias("k"))


@plan("w3_retention", """, r AS (SELECT *, row_number() OVER (PARTITION BY url_id ORDER BY observed_at DESC, signal_id) AS k FROM signals) SELECT signal_id FROM r WHERE k <= 5 AND observed_at > (SELECT max(ts) FROM events) - INTERVAL 10 DAY""")
def w3(spark, d):
    """The five newest versions of a key that are at most ten days old."""
    e = E(spark, d)
    as_of = e.table("events").agg(F.max("ts").alias("as_of"))
    return R.first_per_key(e.signals, ["url_id"], [F.desc("observed_at"), F.col("signal_id")], 5).join(F.broadcast(as_of)).where(F.col("observed_at") > F.col("as_of") - F.expr("INTERVAL 10 DAYS")).select("signal_id")


@plan("w5_latest_n_per_fund", ", r AS (SELECT *, row_number() OVER (PARTITION BY fund_id ORDER BY observed_at DESC, signal_id) AS k FROM signals) SELECT fund_id, signal_id FROM r WHERE k <= 10")
def w5(spark, d):
    return R.first_per_key(E(spark, d).signals, ["fund_id"], [F.desc("observed_at"), F.col("signal_id")], 10).select("fund_id", "signal_id")


@plan("w6_change_flag", "SELECT signal_id, coalesce(event_type <> lag(event_type) OVER (PARTITION BY url_id ORDER BY observed_at, signal_id), true) AS changed FROM signals")
def w6(spark, d):
    """Change between consecutive snapshots; the first counts as one."""
    w = Window.partitionBy("url_id").orderBy("observed_at", "signal_id")
    return E(spark, d).signals.select("signal_id", F.coalesce(F.col("event_type") != F.lag("event_type").over(w), F.lit(True)).alias("changed"))


@plan("w7_failure_runs", """, g AS (SELECT *, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY url_id ORDER BY observed_at, signal_id ROWS UNBOUNDED PRECEDING) AS g FROM signals) SELECT signal_id, CASE WHEN event_type = 'error' THEN row_number() OVER (PARTITION BY url_id, g, event_type = 'error' ORDER BY observed_at, signal_id) ELSE 0 END AS failures FROM g""")
def w7(spark, d):
    """Consecutive failures up to each check."""
    x = R.islands(E(spark, d).signals, ["url_id"], [F.col("observed_at"), F.col("signal_id")], F.col("event_type") == "error", "failures")
    return x.select("signal_id", "failures")


@plan("w8_sliding_rate", "SELECT signal_id, count(*) OVER (PARTITION BY fund_id ORDER BY observed_at RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS in_minute FROM signals")
def w8(spark, d):
    """Events of the last minute per key."""
    s = E(spark, d).signals.select("signal_id", "fund_id", F.unix_micros(F.col("observed_at").cast("timestamp")).alias("us"))
    return s.select("signal_id", F.count("*").over(Window.partitionBy("fund_id").orderBy("us").rangeBetween(-60_000_000, 0)).alias("in_minute"))


@plan("w10_priority_rank", """, c AS (SELECT fund_id, count(*) AS n FROM items GROUP BY 1), s AS (SELECT fund_id, 5 + CASE WHEN region = 'EUROPE' THEN 25 ELSE 0 END + CASE WHEN aum >= 5000000000 THEN 35 WHEN aum >= 1000000000 THEN 30 WHEN aum >= 500000000 THEN 20 WHEN aum >= 100000000 THEN 10 ELSE 0 END + CASE WHEN category IN ('pe', 'vc') THEN 15 WHEN category = 'growth' THEN 10 ELSE 0 END + least(25, coalesce(n, 0) // 10) AS score FROM funds LEFT JOIN c USING (fund_id)) SELECT fund_id, CAST(score AS BIGINT) AS score, rank() OVER (ORDER BY score DESC) AS place FROM s""")
def w10(spark, d):
    """Scraping priority by bands, ranked."""
    from tessera.functions import rules as Q

    e = E(spark, d)
    c = e.items.groupBy("fund_id").agg(F.count("*").alias("n"))
    f = e.funds.join(c, "fund_id", "left")
    score = 5 + Q.if_then(F.col("region") == "EUROPE", 25) + Q.band(F.col("aum"), [(5e9, 35), (1e9, 30), (5e8, 20), (1e8, 10)], 0) + F.when(F.col("category").isin("pe", "vc"), 15).when(F.col("category") == "growth", 10).otherwise(0) + F.least(F.lit(25), F.floor(F.coalesce("n", F.lit(0)) / 10))
    return f.select("fund_id", score.cast(LONG).alias("score")).withColumn("place", F.rank().over(Window.orderBy(F.desc("score"))).cast(LONG))


@plan("w11_quality_baseline")
def w11(spark, d):
    """Self-raising baseline per key: a new value is accepted if it is at least 0.9 of the baseline. An ordered fold per key."""
    from tessera.streaming.folds import baseline

    return baseline(E(spark, d).signals.select("url_id", "observed_at", "signal_id", "score"), "url_id", ["observed_at", "signal_id"], "score").select("signal_id", F.round("baseline", 6).alias("baseline"), "alert")


@plan("o1_portfolio_order", "SELECT fund_id, company_id, row_number() OVER (PARTITION BY fund_id ORDER BY CASE status WHEN 'current' THEN 0 WHEN 'partial' THEN 1 WHEN 'exited' THEN 2 ELSE 3 END, entry_date DESC, company_id) AS place FROM items")
def o1(spark, d):
    """Status rank, date descending with nulls last, name."""
    rank = F.when(F.col("status") == "current", 0).when(F.col("status") == "partial", 1).when(F.col("status") == "exited", 2).otherwise(3)
    return E(spark, d).items.select("fund_id", "company_id", F.row_number().over(Window.partitionBy("fund_id").orderBy(rank, F.desc_nulls_last("entry_date"), "company_id")).cast(LONG).alias("place"))


@plan("o2_feed_order", "SELECT signal_id, coalesce(published_at, observed_at - INTERVAL 1 HOUR) AS shown_at FROM signals ORDER BY shown_at DESC, signal_id LIMIT 100")
def o2(spark, d):
    """Feed order with a penalty for unconfirmed times; the first 100."""
    return E(spark, d).signals.select("signal_id", D.effective(F.col("published_at"), F.col("observed_at")).alias("shown_at")).orderBy(F.desc("shown_at"), "signal_id").limit(100)


@plan("o5_nested_sort", "SELECT n_regionkey, list(n_name ORDER BY (n_nationkey % 5 = 0) DESC, n_name) AS places FROM nation GROUP BY n_regionkey")
def o5(spark, d):
    """Sorted nested arrays by a compound key."""
    return E(spark, d).table("nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct((F.col("n_nationkey") % 5 != 0).alias("k"), "n_name"))), lambda x: x.n_name).alias("places"))


@plan("o7_page", "SELECT fund_id, aum FROM funds ORDER BY aum DESC, fund_id LIMIT 5 OFFSET 5")
def o7(spark, d):
    """The second page of a total order."""
    return R.page(E(spark, d).funds.select("fund_id", "aum"), [F.desc("aum"), F.col("fund_id")], 5, 1)


@plan("o9_primary_then_secondary", "SELECT fund_id, CASE WHEN aum > 0 THEN 1 ELSE 2 END AS tier FROM funds WHERE category IN ('pe', 'vc')")
def o9(spark, d):
    return E(spark, d).funds.where(F.col("category").isin("pe", "vc")).select("fund_id", F.when(F.col("aum") > 0, 1).otherwise(2).alias("tier"))


@plan("o12_batches", "SELECT signal_id, (row_number() OVER (PARTITION BY fund_id ORDER BY signal_id) - 1) // 25 AS batch FROM signals")
def o12(spark, d):
    return R.chunks(E(spark, d).signals, [F.col("signal_id")], 25, ["fund_id"]).select("signal_id", "batch")


@plan("u1_union_by_name", "SELECT fund_id, company_id, status, NULL AS amount FROM items UNION ALL SELECT fund_id, company_id, NULL, round(amount, 4) FROM deals")
def u1(spark, d):
    """Union of different shapes."""
    e = E(spark, d)
    return e.items.select("fund_id", "company_id", "status").unionByName(e.deals.select("fund_id", "company_id", F.round("amount", 4).alias("amount")), allowMissingColumns=True)


@plan("u2_distinct_names", "SELECT fund_id, list(DISTINCT company_id ORDER BY company_id) AS names FROM (SELECT fund_id, company_id FROM items UNION SELECT fund_id, company_id FROM signals) GROUP BY fund_id")
def u2(spark, d):
    """All names of a fund from both tables. The pairs are made distinct first, so that a fund's rows are spread."""
    e = E(spark, d)
    both = e.items.select("fund_id", "company_id").unionByName(e.signals.select("fund_id", "company_id")).distinct()
    return both.groupBy("fund_id").agg(F.array_sort(F.collect_list("company_id")).alias("names"))


@plan("u2_distinct_names_whole", "SELECT fund_id, list(DISTINCT company_id ORDER BY company_id) AS names FROM (SELECT fund_id, company_id FROM items UNION SELECT fund_id, company_id FROM signals) GROUP BY fund_id")
def u2_whole(spark, d):
    """The same, under the name of a time when ``u2_distinct_names`` had fewer companies."""
    return u2(spark, d)


@plan("u6_intersection", "SELECT company_id FROM items INTERSECT SELECT company_id FROM signals")
def u6(spark, d):
    e = E(spark, d)
    return e.items.select("company_id").intersect(e.signals.select("company_id"))


@plan("t3_seen_within_ttl", """, o AS (SELECT *, lag(observed_at) OVER (PARTITION BY url_id ORDER BY observed_at, signal_id) AS before FROM signals) SELECT signal_id FROM o WHERE before IS NULL OR observed_at - before > INTERVAL 12 HOUR""")
def t3(spark, d):
    """Rows whose key wasn't seen for twelve hours (T4), in batch."""
    w = Window.partitionBy("url_id").orderBy("observed_at", "signal_id")
    s = E(spark, d).signals.withColumn("before", F.lag("observed_at").over(w))
    return s.where(F.col("before").isNull() | (F.col("observed_at") - F.col("before") > F.expr("INTERVAL 12 HOURS"))).select("signal_id")


@plan("t5_backoff", """, g AS (SELECT *, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY url_id ORDER BY observed_at, signal_id ROWS UNBOUNDED PRECEDING) AS g FROM signals), f AS (SELECT *, CASE WHEN event_type = 'error' THEN row_number() OVER (PARTITION BY url_id, g, event_type = 'error' ORDER BY observed_at, signal_id) ELSE 0 END AS n FROM g)
SELECT signal_id, n AS failures, observed_at + INTERVAL 1 MINUTE * (CASE least(n, 5) WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 15 WHEN 3 THEN 60 WHEN 4 THEN 240 ELSE 1440 END) AS next_check FROM f""")
def t5(spark, d):
    """Time of the next check by consecutive failures: 0, 5, 15, 60, 240, 1440 minutes."""
    from tessera.streaming.folds import backoff_minutes

    x = R.islands(E(spark, d).signals, ["url_id"], [F.col("observed_at"), F.col("signal_id")], F.col("event_type") == "error", "failures")
    return x.select("signal_id", "failures", (F.col("observed_at") + F.make_interval(mins=backoff_minutes(F.col("failures")))).alias("next_check"))


@plan("t6_circuit_breaker")
def t6(spark, d):
    """State of a circuit breaker after each check: opens at five failures, tries again after 300 s. An ordered fold per key."""
    from tessera.streaming.folds import breaker

    return breaker(E(spark, d).signals.select("url_id", "observed_at", "signal_id", (F.col("event_type") == "error").alias("failed")), "url_id", ["observed_at", "signal_id"]).select("signal_id", "state")


@plan("t8_incremental", "SELECT doc_id FROM docs d WHERE NOT EXISTS (SELECT 1 FROM docs o WHERE o.doc_id % 2 = 0 AND o.title = d.title AND o.lang = d.lang)")
def t8(spark, d):
    """Rows whose fingerprint is not in the cache of an earlier run."""
    x = E(spark, d).docs.select("doc_id", F.sha2(F.to_json(F.struct("title", "lang")), 256).alias("fp"))
    return x.join(x.where("doc_id % 2 = 0").select("fp").distinct(), "fp", "left_anti").select("doc_id")


@plan("t13_snapshot_events", """, o AS (SELECT fund_id, company_id, n_deals % 3 AS s FROM items WHERE company_id % 9 <> 0), n AS (SELECT fund_id, company_id, n_deals % 2 AS s FROM items WHERE company_id % 9 <> 1) SELECT fund_id, company_id, CASE WHEN o.s IS NULL THEN 'added' WHEN n.s IS NULL THEN 'removed' WHEN o.s <> n.s THEN 'changed' ELSE 'same' END AS change, CASE WHEN o.s <> n.s THEN ['s'] ELSE [] END AS fields FROM o FULL JOIN n USING (fund_id, company_id)""")
def t13(spark, d):
    """Two snapshots compared: change events with the fields that changed."""
    i = E(spark, d).items
    return R.diff(i.where("company_id % 9 <> 0").select("fund_id", "company_id", (F.col("n_deals") % 3).alias("s")), i.where("company_id % 9 <> 1").select("fund_id", "company_id", (F.col("n_deals") % 2).alias("s")), ["fund_id", "company_id"], ["s"])


@plan("t_tumbling_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling(spark, d):
    """Hourly counts in event time; the streaming form is ``tessera.streaming.tumbling``."""
    from tessera.streaming.streams import tumbling as hourly

    return hourly(E(spark, d).table("events"), "ts", "1 hour", ["event_type"], "value").select("start", "event_type", "n", F.round("total", 2).alias("total"))
