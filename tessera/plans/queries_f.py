"""Plans of names and matching: portfolio entries, fuzzy tiers, and smaller rules that have no plan of their own elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import dates as D
from tessera.functions import money as Y
from tessera.functions import names as N
from tessera.functions import text as T
from tessera.operators import dedup as X
from tessera.operators import matching as M
from tessera.operators import relational as R

from .entities import Entities as E
from .registry import plan

LONG = "bigint"
SQUASH = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def isin(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


#: Raw entries: every company, in a form that depends on its id.
FORMS = [
    ("{0}", lambda c: c), ("Logo {0}", lambda c: F.concat(F.lit("Logo "), c)), ("{0} logo", lambda c: F.concat(c, F.lit(" logo"))), ("{0} | Invested by Beta", lambda c: F.concat(c, F.lit(" | Invested by Beta"))),
    ("{0} | Alfa SGR S.p.A.", lambda c: F.concat(c, F.lit(" | Alfa SGR S.p.A."))), ("{0}. ", lambda c: F.concat(c, F.lit(". "))), ("{0}__", lambda c: F.concat(c, F.lit("__"))), ("| {0} | x", lambda c: F.concat(F.lit("| "), c, F.lit(" | x"))),
    ("{0}: a subtitle that is long", lambda c: F.concat(c, F.lit(": a subtitle that is long"))), ("{0} (a long remark within parentheses)", lambda c: F.concat(c, F.lit(" (a long remark within parentheses)"))),
    ("Investing in {0}", lambda c: F.concat(F.lit("Investing in "), c)), ("Leading {0}", lambda c: F.concat(F.lit("Leading "), c)), ("{0} is one of many", lambda c: F.concat(c, F.lit(" is one of many"))), ("Page not found", lambda c: F.lit("Page not found")),
    ("Healthcare", lambda c: F.lit("Healthcare")), ("Newsroom", lambda c: F.lit("Newsroom")), ("Portfoliocompanies", lambda c: F.lit("Portfoliocompanies")), ("Alfa Capital", lambda c: F.lit("Alfa Capital")), ("Alfa Partners 2", lambda c: F.lit("Alfa Partners 2")),
    ("Gruppo Alfa", lambda c: F.lit("Gruppo Alfa")), ("Alfa Asset Management S.p.A.", lambda c: F.lit("Alfa Asset Management S.p.A.")), ("Alfacapital", lambda c: F.lit("Alfacapital")), ("{0}.png", lambda c: F.concat(c, F.lit(".png"))), ("ab", lambda c: F.lit("ab")), ("What is {0}?", lambda c: F.concat(F.lit("What is "), c, F.lit("?"))),
]


def form_sql(column: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {' || '.join(x for x in (q(f.split('{0}')[0]), column, q(f.split('{0}')[1])))}" if "{0}" in f else f"WHEN {i} THEN {q(f)}" for i, (f, _) in enumerate(FORMS))
    return f"CASE company_id % {len(FORMS)} {cases} END"


def form(key, column):
    out = None
    for i, (_, make) in enumerate(FORMS):
        out = F.when(key % len(FORMS) == i, make(column)) if out is None else out.when(key % len(FORMS) == i, make(column))
    return out


CLEAN = r"""trim(regexp_replace(regexp_replace(CASE WHEN contains(c2, '|') AND length(trim(split_part(c2, '|', 1))) >= 3 THEN trim(split_part(c2, '|', 1)) ELSE c2 END, '\.\s*$', ''), '_+$', ''))"""
STEPS = rf""", r AS (SELECT company_id, {form_sql('name')} AS raw FROM companies),
a AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(trim(raw), '(?i)\s+logo$', ''), '(?i)\s*\|\s*(?:Invested by|Formerly)\s+.+$', ''), '(?i)\s*\|\s*\w+\s+(?:SGR|subsidiary)\b.*$', '')) AS c1 FROM r), b AS (SELECT *, regexp_replace(regexp_replace(c1, '^\s*\|\s*', ''), '\s*\|\s*$', '') AS c2 FROM a)"""


@plan("f4_portfolio_names", f"{STEPS} SELECT company_id, {CLEAN} AS name FROM b")
def f4(spark, d):
    """Raw portfolio entries without artefacts of scraping."""
    c = E(spark, d).companies
    return c.select("company_id", N.clean_portfolio_name(form(F.col("company_id"), F.col("name"))).alias("name"))


def text_cases() -> str:
    return " ".join(f"WHEN regexp_matches(t, {q(p)}) THEN {q(why)}" for why, p in N.TEXT_PATTERNS)


CORE = "trim(regexp_replace(trim(regexp_replace({0}, " + q(N.FUND_ENDINGS) + ", '', 'g')), '\\s+', ' ', 'g'))"
STARTS = "(length({0}) > length({1}) AND starts_with({0}, {1}) AND regexp_matches(substr({0}, length({1}) + 1, 1), '[ 0-9]'))"


@plan("p20_name_validity", rf"""{STEPS}, n AS (SELECT company_id, {CLEAN} AS name FROM b), l AS (SELECT company_id, trim(name) AS t, lower(trim(name)) AS low, trim(regexp_replace(lower(trim(name)), '[^a-z0-9\s]', '', 'g')) AS bare, 'alfa capital' AS fund FROM n),
k AS (SELECT *, {CORE.format('fund')} AS fcore, {CORE.format('bare')} AS ecore, split_part(fund, ' ', 1) AS first FROM l)
SELECT company_id, CASE WHEN coalesce(length(t), 0) <= 2 THEN 'empty' WHEN length(t) > 60 THEN 'long' {text_cases()} WHEN NOT contains(t, ' ') AND low IN {isin(N.EDITORIAL_WORDS)} THEN 'editorial' WHEN low IN {isin(N.SECTOR_NAMES)} THEN 'sector'
WHEN NOT contains(t, ' ') AND length(t) >= 12 AND regexp_matches(low, {q(N.GLUED)}) THEN 'glued' WHEN low IN {isin(N.HEADINGS)} OR regexp_matches(t, {q(N.NAVIGATION)}) THEN 'navigation' WHEN bare = fund OR replace(bare, ' ', '') = replace(fund, ' ', '') THEN 'fund'
WHEN length(fcore) >= 2 AND ecore = fcore THEN 'fund' WHEN length(fcore) >= 3 AND {STARTS.format('ecore', 'fcore')} THEN 'fund' WHEN length(ecore) >= 3 AND {STARTS.format('fcore', 'ecore')} THEN 'fund'
WHEN length(first) >= 3 AND starts_with(bare, first) AND regexp_matches(trim(substr(bare, length(first) + 1)), {q(N.GENERIC_REST)}) THEN 'fund'
WHEN regexp_matches(t, '(?i)^gruppo\s+') AND length(fcore) >= 3 AND contains(trim(regexp_replace(lower(regexp_replace(t, '(?i)^gruppo\s+', '')), '[^a-z0-9\s]', '', 'g')), fcore) THEN 'fund'
WHEN regexp_matches(t, {q(N.OWN_ENDINGS)}) AND length(first) >= 3 AND (contains(trim(regexp_replace(lower(regexp_replace(t, {q(N.OWN_ENDINGS)}, '')), '[^a-z0-9\s]', '', 'g')), fcore) OR contains(fcore, trim(regexp_replace(lower(regexp_replace(t, {q(N.OWN_ENDINGS)}, '')), '[^a-z0-9\s]', '', 'g')))) THEN 'fund' END AS reason FROM k""")
def p20(spark, d):
    """Why a cleaned portfolio entry is no company of its fund; null if it may be one."""
    c = E(spark, d).companies
    name = N.clean_portfolio_name(form(F.col("company_id"), F.col("name")))
    return c.select("company_id", N.entry_reason(name, F.lit("alfa-capital")).alias("reason"))


@plan("p21_confidence_and_length", "SELECT fund_id, company_id FROM items JOIN companies USING (company_id) WHERE coalesce(confidence, 0.7) >= 0.5 AND length(trim(name)) > 2")
def p21(spark, d):
    """Entries of enough confidence, 0.7 where none is known, and of more than two letters."""
    e = E(spark, d)
    return e.items.where(F.coalesce("confidence", F.lit(0.7)) >= 0.5).join(e.companies.where(F.char_length(F.trim("name")) > 2), "company_id").select("fund_id", "company_id")


SIMILAR = """CASE WHEN a.n = b.n THEN 1.0 WHEN contains(a.n, b.n) OR contains(b.n, a.n) THEN CAST(least(length(a.n), length(b.n)) AS DOUBLE) / greatest(length(a.n), length(b.n)) * CAST(0.95 AS DOUBLE)
ELSE CAST(0.4 AS DOUBLE) * len(list_intersect(a.l, b.l)) / len(list_distinct(list_concat(a.l, b.l))) + CAST(0.6 AS DOUBLE) * len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END"""
SETS = "string_split(n, '') AS l, string_split(n, ' ') AS w"
VARIANT = "CASE company_id % 6 WHEN 1 THEN split_part(name, ' ', 2) || ' ' || split_part(name, ' ', 1) || ' ' || split_part(name, ' ', 3) WHEN 2 THEN name || 's' WHEN 3 THEN replace(name, ' ', '') WHEN 4 THEN regexp_replace(name, ' [0-9]+$', '') ELSE name END"


def variants(e):
    """Companies under names as other sources write them: words in another order, a letter more, without spaces, without the number."""
    k, n = F.col("company_id"), F.col("name")
    w = F.split(n, " ")
    v = F.when(k % 6 == 1, F.concat_ws(" ", w[1], w[0], w[2])).when(k % 6 == 2, F.concat(n, F.lit("s"))).when(k % 6 == 3, F.replace(n, F.lit(" "), F.lit(""))).when(k % 6 == 4, F.regexp_replace(n, " [0-9]+$", "")).otherwise(n)
    return e.companies.where("company_id % 6 <> 0").select(k.alias("target_id"), T.squash(v).alias("n"), "size")


@plan("j13_entity_resolution", f""", k AS (SELECT company_id, n, {SETS} FROM (SELECT company_id, {SQUASH.format('name')} AS n FROM companies WHERE company_id % 6 = 0)), t AS (SELECT company_id AS target_id, n, {SETS} FROM (SELECT company_id, {SQUASH.format(VARIANT)} AS n FROM companies WHERE company_id % 6 <> 0)),
p AS (SELECT target_id, company_id, {SIMILAR} AS s, a.n = b.n AS same FROM t a JOIN k b ON true), m AS (SELECT * FROM p WHERE same OR s >= 0.9 - 1e-9), r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY same DESC, s DESC, company_id) AS o FROM m)
SELECT target_id, company_id, CASE WHEN company_id IS NULL THEN 'new' WHEN same THEN 'exact' ELSE 'fuzzy' END AS tier, round(coalesce(s, 1.0), 4) AS score, CASE WHEN company_id IS NULL THEN 'new-' || md5(n) ELSE 'known-' || company_id END AS entity FROM t LEFT JOIN (SELECT * FROM r WHERE o = 1) USING (target_id)""")
def j13(spark, d):
    """Entity resolution: exact name, else the most similar of 0.9 or more, else a new entity whose id is a digest of its name."""
    e = E(spark, d)
    known, targets = e.companies.where("company_id % 6 = 0").select("company_id", T.squash(F.col("name")).alias("n")), variants(e).drop("size")
    best = M.best_similar(targets, known, "target_id", "company_id", "n", 0.9)
    exact = F.coalesce(F.col("score") == 1.0, F.lit(False)) & (F.col("n") == F.col("match"))
    entity = F.when(F.col("company_id").isNull(), F.concat(F.lit("new-"), F.md5("n"))).otherwise(F.concat(F.lit("known-"), "company_id"))
    return targets.join(best, "target_id", "left").select("target_id", "company_id", F.when(F.col("company_id").isNull(), "new").when(exact, "exact").otherwise("fuzzy").alias("tier"), F.round(F.coalesce("score", F.lit(1.0)), 4).alias("score"), entity.alias("entity"))


@plan("j10_portfolio_diff", f""", o AS (SELECT company_id AS old_id, n, size, company_id % 3 AS status, {SETS} FROM (SELECT *, {SQUASH.format('name')} AS n FROM companies WHERE company_id % 6 = 0)), t AS (SELECT company_id AS new_id, n, size, company_id % 2 AS status, {SETS} FROM (SELECT *, {SQUASH.format(VARIANT)} AS n FROM companies WHERE company_id % 6 <> 0)),
p AS (SELECT a.new_id, b.old_id, a.status AS s1, b.status AS s2, CASE WHEN a.n = b.n THEN 1.0 WHEN a.size = b.size AND a.w[1] = b.w[1] THEN 0.95 ELSE {SIMILAR} END AS s FROM t a JOIN o b ON true), r AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY s DESC, old_id) AS k FROM p WHERE s >= 0.85 - 1e-9)
SELECT new_id, old_id, CASE WHEN old_id IS NULL THEN 'added' WHEN s1 <> s2 THEN 'status_changed' ELSE 'unchanged' END AS change FROM t LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (new_id) UNION ALL SELECT NULL, old_id, 'removed' FROM o WHERE old_id NOT IN (SELECT old_id FROM r WHERE k = 1)""")
def j10(spark, d):
    """Changes between two versions of a portfolio: equal names, the same site (0.95), or the most similar name of 0.85 or more; the best match counts."""
    e = E(spark, d)
    old = e.companies.where("company_id % 6 = 0").select(F.col("company_id").alias("old_id"), T.squash(F.col("name")).alias("n"), "size")
    new = variants(e).withColumnRenamed("target_id", "new_id")
    site = lambda df: F.concat_ws("/", F.col("size"), F.split("n", " ")[0])
    by_site = new.select("new_id", site(new).alias("k")).join(old.select("old_id", site(old).alias("k")), "k").groupBy("new_id").agg(F.min("old_id").alias("old_id")).select("new_id", "old_id", F.lit(0.95).alias("score"))
    best = by_site.unionByName(M.best_similar(new.drop("size"), old.drop("size"), "new_id", "old_id", "n", 0.85).select("new_id", "old_id", "score"))
    best = best.groupBy("new_id").agg(F.min(F.struct((-F.round("score", 12)).alias("s"), "old_id"))["old_id"].alias("old_id"))
    state = F.when(F.col("old_id").isNull(), "added").when(F.col("new_id") % 2 != F.col("old_id") % 3, "status_changed").otherwise("unchanged")
    gone = old.join(best, "old_id", "left_anti").select(F.lit(None).cast(LONG).alias("new_id"), "old_id", F.lit("removed").alias("change"))
    return new.select("new_id").join(best, "new_id", "left").select("new_id", "old_id", state.alias("change")).unionByName(gone)


NUMBERLESS = r"trim(regexp_replace(n, '\s*[0-9]+$', ''))"


@plan("j16_existing_company", f""", k AS (SELECT company_id, n, replace(n, ' ', '') AS c, {NUMBERLESS} AS s, string_split(n, ' ') AS w FROM (SELECT company_id, {SQUASH.format('name')} AS n FROM companies WHERE company_id % 6 = 0)), t AS (SELECT company_id AS target_id, n, replace(n, ' ', '') AS c, {NUMBERLESS} AS s, string_split(n, ' ') AS w FROM (SELECT company_id, {SQUASH.format(VARIANT)} AS n FROM companies WHERE company_id % 6 <> 0)),
m AS (SELECT target_id, company_id, CASE WHEN t.n = k.n THEN 0 WHEN t.c = k.c THEN 1 WHEN t.s <> t.n AND t.s <> '' AND t.s = k.n THEN 2 WHEN k.s <> k.n AND k.s <> '' AND k.s = t.n THEN 2 WHEN len(list_intersect(t.w, k.w)) * 5 >= 4 * len(list_distinct(list_concat(t.w, k.w))) AND (len(list_distinct(t.w)) > 1 OR len(list_distinct(k.w)) > 1) THEN 3 END AS r FROM t JOIN k ON true),
b AS (SELECT target_id, arg_min(company_id, r * 1000000000 + company_id) AS company_id, min(r) AS r FROM m WHERE r IS NOT NULL GROUP BY target_id) SELECT target_id, company_id, CASE r WHEN 0 THEN 'exact' WHEN 1 THEN 'compact' WHEN 2 THEN 'number' WHEN 3 THEN 'words' ELSE 'none' END AS tier FROM t LEFT JOIN b USING (target_id)""")
def j16(spark, d):
    """Whether a company is known: by name, without spaces, without a number at either end, or by four fifths of the words."""
    e = E(spark, d)
    known = e.companies.where("company_id % 6 = 0").select("company_id", T.squash(F.col("name")).alias("n"))
    t = variants(e).drop("size")
    n, compact = F.col("n"), F.replace("n", F.lit(" "), F.lit(""))
    bare = F.trim(F.regexp_replace("n", r"\s*[0-9]+$", ""))
    less = F.when(bare != n, bare)
    exact = R.cascade(t, known, "target_id", "company_id", [("exact", n, n), ("compact", compact, compact), ("number", less, n), ("number", n, less)]).where("company_id is not null")
    left = t.join(exact, "target_id", "left_anti")
    words = M.best_words(left, known, "target_id", "company_id", "n", 0.8).select("target_id", "company_id", F.lit("words").alias("tier"))
    return t.select("target_id").join(exact.unionByName(words), "target_id", "left").select("target_id", "company_id", F.coalesce("tier", F.lit("none")).alias("tier"))


@plan("j3_substring_tier", f""", k AS (SELECT company_id, {SQUASH.format('name')} AS n FROM companies WHERE company_id % 6 = 0), t AS (SELECT c_custkey AS target_id, {SQUASH.format("CASE c_custkey % 3 WHEN 0 THEN name || ' service' WHEN 1 THEN 'nuova ' || name ELSE split_part(name, ' ', 1) || ' ' || split_part(name, ' ', 2) END")} AS n FROM customer JOIN companies ON company_id = 6 * (c_custkey % 60))
SELECT target_id, min(company_id) AS company_id FROM t JOIN k ON length(t.n) >= 5 AND length(k.n) >= 5 AND (contains(' ' || t.n || ' ', ' ' || k.n || ' ') OR contains(' ' || k.n || ' ', ' ' || t.n || ' ')) GROUP BY target_id""")
def j3(spark, d):
    """The last tier of the cascade: one name holds the other at word borders, both of five letters at least; the first known name counts."""
    e = E(spark, d)
    known = e.companies.where("company_id % 6 = 0").select("company_id", T.squash(F.col("name")).alias("n"))
    c, w = F.col("c_custkey"), F.split("name", " ")
    named = F.when(c % 3 == 0, F.concat("name", F.lit(" service"))).when(c % 3 == 1, F.concat(F.lit("nuova "), "name")).otherwise(F.concat_ws(" ", w[0], w[1]))
    t = e.table("customer").withColumn("company_id", 6 * (c % 60)).join(e.companies.select("company_id", "name"), "company_id").select(c.alias("target_id"), T.squash(named).alias("n"))
    k, t = known.where(F.char_length("n") >= 5), t.where(F.char_length("n") >= 5)
    return M.first_held(t, k, "target_id", "company_id", "n", "n", words=True)


@plan("j15_partial_names", """, m AS (SELECT c_custkey AS target_id, CASE c_custkey % 4 WHEN 0 THEN 'supplier#' || lpad(CAST(c_custkey % 20 AS VARCHAR), 9, '0') || ' sgr' WHEN 1 THEN lpad(CAST(c_custkey % 20 AS VARCHAR), 9, '0') WHEN 2 THEN 'supplier#' || lpad(CAST(c_custkey % 20 AS VARCHAR), 9, '0') ELSE 'other' || c_custkey END AS k FROM customer)
SELECT target_id, min(fund_id) AS fund_id FROM m JOIN funds ON contains(lower(name), k) OR contains(k, lower(name)) GROUP BY target_id""")
def j15(spark, d):
    """Rows of another source whose name holds a fund's or is held by it, in either direction; the first fund counts."""
    e = E(spark, d)
    i = F.col("c_custkey")
    number = F.lpad((i % 20).cast("string"), 9, "0")
    k = F.when(i % 4 == 0, F.concat(F.lit("supplier#"), number, F.lit(" sgr"))).when(i % 4 == 1, number).when(i % 4 == 2, F.concat(F.lit("supplier#"), number)).otherwise(F.concat(F.lit("other"), i))
    t = e.table("customer").select(i.alias("target_id"), k.alias("k"))
    return M.first_held(t, e.funds.select("fund_id", F.lower("name").alias("name")), "target_id", "fund_id", "k", "name")


@plan("a7_local_sector_groups", """, c AS (SELECT fund_id, sector, count(*) AS n FROM items JOIN companies USING (company_id) WHERE brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5') AND sector IS NOT NULL GROUP BY ALL) SELECT fund_id, list(sector ORDER BY n DESC, sector) AS sectors FROM c GROUP BY fund_id""")
def a7(spark, d):
    """Sector groups of each fund's companies of one country, the most frequent first; funds without any have no row."""
    e = E(spark, d)
    own = e.companies.where(F.col("brand").isin(*(f"Brand#{i}" for i in range(1, 6))) & F.col("sector").isNotNull())
    n = e.items.join(own, "company_id").groupBy("fund_id", "sector").agg(F.count("*").alias("n"))
    return n.groupBy("fund_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "sector"))), lambda x: x.sector).alias("sectors"))


@plan("a25_means_without_zeros", "SELECT c_nationkey, round(avg(nullif(CASE WHEN c_custkey % 4 = 0 THEN 0 WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 30 END, 0)), 1) AS mean_years, round(100.0 * count(*) FILTER (c_custkey % 3 = 0) / nullif(count(*) FILTER (c_custkey % 3 < 2), 0), 1) AS share_a FROM customer GROUP BY c_nationkey")
def a25(spark, d):
    """Rounded means that leave out nulls and zeros, and the share of one value among the known ones; null where none is known."""
    i = F.col("c_custkey")
    years = F.when(i % 4 == 0, 0).when(i % 5 == 0, F.lit(None)).otherwise(i % 30)
    return E(spark, d).table("customer").groupBy("c_nationkey").agg(F.round(F.avg(F.nullif(years, F.lit(0))), 1).alias("mean_years"), F.round(100.0 * F.count_if(i % 3 == 0) / F.nullif(F.count_if(i % 3 < 2), F.lit(0)), 1).alias("share_a"))


@plan("a30_outliers_of_mode", ", c AS (SELECT priority, count(*) AS n, min(order_id) AS p FROM deals GROUP BY priority), m AS (SELECT priority FROM c ORDER BY n DESC, p LIMIT 1) SELECT DISTINCT fund_id FROM deals WHERE coalesce(priority, '') <> (SELECT priority FROM m)")
def a30(spark, d):
    """Rows that differ from the most frequent value, of equals the first seen."""
    deals = E(spark, d).deals
    mode = deals.groupBy("priority").agg(F.count("*").alias("n"), F.min("order_id").alias("p")).agg(F.max_by("priority", F.struct("n", -F.col("p"))).alias("mode"))
    return deals.join(F.broadcast(mode)).where(F.coalesce("priority", F.lit("")) != F.col("mode")).select("fund_id").distinct()


@plan("a36_background_summary", """, per AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) SELECT c_nationkey, CAST(sum(n) AS BIGINT) AS people, CAST(coalesce(sum(n) FILTER (c_mktsegment = 'BUILDING'), 0) AS BIGINT) AS building, CAST(coalesce(sum(n) FILTER (c_mktsegment = 'MACHINERY'), 0) AS BIGINT) AS machinery,
round(100.0 * coalesce(sum(n) FILTER (c_mktsegment = 'BUILDING'), 0) / sum(n), 1) AS building_share, first(c_mktsegment ORDER BY n DESC, c_mktsegment) AS top FROM per GROUP BY c_nationkey""")
def a36(spark, d):
    """Backgrounds of a group: counts and share of each kind, and the most frequent, of equals the first by name."""
    per = E(spark, d).table("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("c_mktsegment") == kind, F.col("n"))), F.lit(0))
    top = F.min(F.struct((-F.col("n")).alias("k"), "c_mktsegment"))["c_mktsegment"]
    return per.groupBy("c_nationkey").agg(F.sum("n").alias("people"), of("BUILDING").alias("building"), of("MACHINERY").alias("machinery"), F.round(100.0 * of("BUILDING") / F.sum("n"), 1).alias("building_share"), top.alias("top"))


@plan("d5_page_two_keys")
def d5(spark, d):
    """First row per source and page, by two keys: its address with title and day, or its title, text and day; a row that either stops registers none."""
    x = E(spark, d).docs.select("doc_id", "source", F.concat_ws("::", F.col("doc_id") % 40, T.squash(F.col("title")), F.col("doc_id") % 3).alias("k1"), F.concat_ws("::", T.squash(F.col("title")), T.squash(F.col("text")), F.col("doc_id") % 3).alias("k2"))
    return X.greedy_keys(x, ["source"], "doc_id", ["k1", "k2"], [F.col("doc_id")]).select("doc_id")


@plan("d15_audit_issues", "SELECT fund_id, status, min(company_id) AS company_id FROM items i WHERE status IS NOT NULL AND NOT EXISTS (SELECT 1 FROM signals s WHERE s.fund_id = i.fund_id AND s.company_id = i.company_id) GROUP BY fund_id, status")
def d15(spark, d):
    """Issues of an audit, one of each fund and kind, without those that have their asset."""
    e = E(spark, d)
    return e.items.where("status is not null").join(e.signals.select("fund_id", "company_id").distinct(), ["fund_id", "company_id"], "left_anti").groupBy("fund_id", "status").agg(F.min("company_id").alias("company_id"))


@plan("d17_outermost", """, e AS (SELECT company_id, size, company_id % 40 AS lo, company_id % 40 + size AS hi FROM companies) SELECT company_id FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.size <> a.size AND b.lo <= a.lo AND b.hi >= a.hi AND a.company_id // 100 = b.company_id // 100 AND (b.lo, -b.hi, b.company_id) < (a.lo, -a.hi, a.company_id))""")
def d17(spark, d):
    """Nested elements of a page: the outermost are kept. Sorted by start, an element is nested if an earlier one ends as late or later."""
    from pyspark.sql import Window

    lo = F.col("company_id") % 40
    x = E(spark, d).companies.select("company_id", "size", lo.alias("lo"), (lo + F.col("size")).alias("hi"), F.floor(F.col("company_id") / 100).alias("page"))
    before = Window.partitionBy("page").orderBy("lo", F.desc("hi"), "company_id").rowsBetween(Window.unboundedPreceding, -1)
    # Equal elements aren't nested in each other.
    within = F.coalesce(F.max("hi").over(before) >= F.col("hi"), F.lit(False))
    same = Window.partitionBy("page", "lo", "hi")
    return x.withColumn("in", within).withColumn("first_in", F.max_by("in", -F.col("company_id")).over(same)).where(~F.col("first_in")).select("company_id")


#: Confidence of extraction strategies; others count 0.5.
STRATEGIES = [("next_data", 0.9), ("json_ld", 0.9), ("html_cards", 0.8), ("logo_grid", 0.7), ("link_list", 0.6), ("table_rows", 0.8), ("noscript", 0.5)]


@plan("x3_strategy_confidence", f""", w AS (SELECT * FROM (VALUES {', '.join(f"('{s}', CAST({c} AS DOUBLE))" for s, c in STRATEGIES)}) v(strategy, c)), i AS (SELECT DISTINCT fund_id, company_id % 9 AS s FROM items), n AS (SELECT fund_id, CASE s WHEN 0 THEN 'next_data' WHEN 1 THEN 'json_ld' WHEN 2 THEN 'html_cards' WHEN 3 THEN 'logo_grid' WHEN 4 THEN 'link_list' WHEN 5 THEN 'table_rows' WHEN 6 THEN 'noscript' ELSE 'other' || s END AS strategy FROM i WHERE (fund_id + s) % 3 = 0)
SELECT fund_id, count(*) AS strategies, round(least(least(sum(coalesce(c, 0.5)) / count(*), 1.0) + CASE WHEN count(*) > 1 THEN 0.1 * (count(*) - 1) ELSE 0 END, 1.0), 4) AS confidence FROM n LEFT JOIN w USING (strategy) GROUP BY fund_id""")
def x3(spark, d):
    """Confidence of what several strategies agree on: the mean of their weights, and a tenth for each further one, 1 at most."""
    e = E(spark, d)
    s = F.col("company_id") % 9
    name = F.element_at(F.array(*(F.lit(x) for x, _ in STRATEGIES)), (F.least(s, F.lit(6)) + 1).cast("int"))
    found = e.items.select("fund_id", s.alias("s"), F.when(s < 7, name).otherwise(F.concat(F.lit("other"), s)).alias("strategy")).distinct().where((F.col("fund_id") + F.col("s")) % 3 == 0)
    weight = F.create_map(*(F.lit(v) for pair in STRATEGIES for v in pair))
    n = F.count("*")
    mean = F.least(F.sum(F.coalesce(F.element_at(weight, F.col("strategy")), F.lit(0.5))) / n, F.lit(1.0))
    return found.groupBy("fund_id").agg(n.alias("strategies"), F.round(F.least(mean + F.when(n > 1, 0.1 * (n - 1)).otherwise(0.0), F.lit(1.0)), 4).alias("confidence"))


@plan("o3_feed_by_importance", """, s AS (SELECT signal_id, date_trunc('day', coalesce(published_at, observed_at - INTERVAL 1 HOUR)) AS shown, published_at IS NOT NULL AS pub, coalesce(score, 50) + 4 * (signal_id % 4) + CASE type WHEN 'deal_announced' THEN 30 WHEN 'exit_announced' THEN 25 ELSE 5 END + (fund_id * 3) % 10 + CASE WHEN company_id % 3 = 0 THEN 10 ELSE 0 END + 10 * 0.5 + greatest(0, log10(1 + company_id)) * 10 AS importance FROM signals) SELECT signal_id, row_number() OVER (ORDER BY shown DESC, pub DESC, round(importance, 6) DESC, signal_id) AS place FROM s ORDER BY place LIMIT 200""")
def o3(spark, d):
    """Feed: the newer day first, confirmed dates before others, then importance: quality, evidence, type, fund, locality, confidence and the logarithm
    of the amount. The first 200; places are counted among those alone, so no task holds all rows."""
    s, i, kind = E(spark, d).signals, F.col("signal_id"), F.col("type")
    worth = F.coalesce("score", F.lit(50.0)) + 4 * (i % 4) + F.when(kind == "deal_announced", 30).when(kind == "exit_announced", 25).otherwise(5) + (F.col("fund_id") * 3) % 10 + F.when(F.col("company_id") % 3 == 0, 10).otherwise(0) + 5.0 + F.greatest(F.lit(0.0), F.log10(1 + F.col("company_id"))) * 10
    rows = s.select("signal_id", F.date_trunc("day", D.effective(F.col("published_at"), F.col("observed_at"))).alias("at"), F.col("published_at").isNotNull().alias("pub"), F.round(worth, 6).alias("worth"))
    order = [F.desc("at"), F.desc("pub"), F.desc("worth"), "signal_id"]
    from pyspark.sql import Window

    return rows.orderBy(*order).limit(200).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast(LONG)).select("signal_id", "place")


STAKE = "CASE l_linenumber % 5 WHEN 0 THEN '>50%' WHEN 1 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '%' WHEN 2 THEN 'n.a.' WHEN 3 THEN '-' ELSE 'most of it' END"
PARTNERS = "CASE l_linenumber % 4 WHEN 0 THEN '-' WHEN 1 THEN 'Alfa, Beta; Gamma' WHEN 2 THEN ' Alfa ,-,; ' ELSE '' END"


@plan("f37_stakes_and_partners", f""", v AS (SELECT l_orderkey, l_linenumber, {STAKE} AS s, {PARTNERS} AS p FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN lower(trim(s)) IN ('n.a.', '-', '') THEN NULL ELSE try_cast(trim(regexp_replace(s, '[%<>]', '', 'g')) AS DOUBLE) END AS stake,
CASE WHEN trim(p) IN ('-', '') THEN NULL ELSE nullif(list_filter(list_transform(string_split_regex(p, '[,;]'), lambda x: trim(x)), lambda x: x NOT IN ('', '-')), CAST([] AS VARCHAR[])) END AS partners FROM v""")
def f37(spark, d):
    """Stakes in percent and lists of co-investors from free text; null where none is given."""
    i = F.col("l_linenumber")
    s = F.when(i % 5 == 0, ">50%").when(i % 5 == 1, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("%"))).when(i % 5 == 2, "n.a.").when(i % 5 == 3, "-").otherwise("most of it")
    p = F.when(i % 4 == 0, "-").when(i % 4 == 1, "Alfa, Beta; Gamma").when(i % 4 == 2, " Alfa ,-,; ").otherwise("")
    return E(spark, d).table("lineitem").select("l_orderkey", "l_linenumber", Y.parse_stake(s).alias("stake"), Y.co_investors(p).alias("partners"))

