"""Plans of display text: amounts, spacing, cases, headlines, and broken words."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import display as D
from tessera.operators import repair as R

from .entities import Entities as E
from .queries_i import pick
from .registry import plan

#: How an amount of millions is written, and what becomes of it: {it} and {en} stand for its digits, {full} for its thousands in full, {n} for the number in the result.
FORMS = [
    ("raccoglie {it} milioni di euro", "raccoglie €{n}M"), ("raises €{en} million", "raises €{n}M"), ("raises USD {en} million", "raises ${n}M"), ("raises £{en} bn", "raises £{b}B"), ("raccoglie {it} mld", "raccoglie €{b}B"), ("raises EUR {en}M", "raises €{n}M"),
    ("raises {en}M€", "raises €{n}M"), ("raccoglie circa € {it} mln", "raccoglie ~ €{n}M"), ("raccoglie {it} milioni di dollari", "raccoglie ${n}M"), ("reaches {en} million people", "reaches {en} million people"), ("raccoglie oltre {full} euro", "raccoglie over {f}"),
]


def spelled(form: str, places: dict[str, str]) -> str:
    """SQL of a form with SQL expressions in its places."""
    parts = ["'" + form.replace("'", "''") + "'"]
    for name, expression in places.items():
        parts = [y for x in parts for y in (x if not x.startswith("'") else x.replace("{" + name + "}", f"' || {expression} || '")).split("\0")]
    return "".join(parts)


def of_forms(i: int, places: dict[str, str]) -> str:
    return f"CASE o_orderkey % {len(FORMS)} " + " ".join(f"WHEN {k} THEN {spelled(f[i], places)}" for k, f in enumerate(FORMS)) + " END"


#: SQL of tenths of millions, and of texts with them; Spark and DuckDB read it alike.
TENTHS = "CAST(floor(o_totalprice / 10) AS BIGINT)"
WHOLE, REST = "CAST(floor(k / 10) AS BIGINT)", "(k % 10)"
WRITTEN = {"it": f"{WHOLE} || ',' || {REST}", "en": f"{WHOLE} || '.' || {REST}", "full": "CAST(floor(k / 1000) AS BIGINT) || '.' || right('00' || (k % 1000), 3) || '.000'"}
SHOWN = f"CASE WHEN {REST} = 0 THEN CAST({WHOLE} AS VARCHAR) ELSE {WRITTEN['en']} END"
RESULT = WRITTEN | {
    "n": f"CASE WHEN {REST} = 0 AND {WHOLE} BETWEEN 1000 AND 9999 THEN left(CAST({WHOLE} AS VARCHAR), 1) || '.' || right(CAST({WHOLE} AS VARCHAR), 3) ELSE {SHOWN} END", "b": SHOWN,
    "f": "CASE WHEN k % 1000 = 0 THEN '€' || CAST(k / 1000 AS BIGINT) ELSE '€' || format('{:.1f}', k / 1000.0) END || 'M'",
}
RESULT = {k: f"({v})" for k, v in RESULT.items()}


@plan("f28_amounts", f"""SELECT o_orderkey AS id, 'Customer ' || o_custkey || ' ' || {of_forms(1, RESULT)} || ' with ' || o_orderpriority AS text FROM (SELECT *, {TENTHS} AS k FROM orders WHERE o_totalprice >= 10000)""")
def f28(spark, d):
    """Orders' totals as amounts in eleven notations, rewritten in their sentences; the SQL knows the results from the numbers alone."""
    orders = E(spark, d).table("orders").where("o_totalprice >= 10000").select("o_orderkey", "o_custkey", "o_orderpriority", F.expr(TENTHS).alias("k"))
    text = F.concat(F.lit("Customer "), "o_custkey", F.lit(" "), F.expr(of_forms(0, {k: f"({v})" for k, v in WRITTEN.items()})), F.lit(" with "), "o_orderpriority")
    return orders.select(F.col("o_orderkey").alias("id"), D.amounts(text).alias("text"))


#: Names of parts as scraping glues them, and what they should be. {w} and {v} stand for the first two words of a name, capitalised, {s} for a size.
GLUED = [
    ("investimento di{w}", "investimento di {w}"), ("tedesca{u}", "tedesca {u}"), ("{u}sostenuta da {w}", "{u} sostenuta da {w}"), ("{s}Comunicato di {w}", "{s} Comunicato di {w}"), ("{w},{v};{w}", "{w}, {v}; {w}"), ("F 2 i e {v}{w}", "F2i e {v} {w}"),
    ("Q 1 risultati della{w}", "Q1 risultati della {w}"), ("€{s} M per {w}", "€{s}M per {w}"), ("see https://{v}.it/a{s}B?c=D,e and {w}{s}", "see https://{v}.it/a{s}B?c=D,e and {w} {s}"), ("{s} th de l gruppo {w}", "{s}th del gruppo {w}"),
]
WORD = {"w": "(upper(left(v1, 1)) || substr(v1, 2))", "v": "v2", "u": "upper(v2)", "s": "CAST(p_size AS STRING)"}
NAMED = "SELECT p_partkey, p_size, split_part(p_name, ' ', 1) AS v1, split_part(p_name, ' ', 2) AS v2 FROM part"


def of_glued(i: int) -> str:
    return f"CASE p_partkey % {len(GLUED)} " + " ".join(f"WHEN {k} THEN {spelled(f[i], WORD)}" for k, f in enumerate(GLUED)) + " END"


@plan("f9_spacing", f"SELECT p_partkey AS id, {of_glued(1)} AS text FROM ({NAMED})")
def f9(spark, d):
    """Names of parts glued to words, digits and marks, with their spaces put right; the SQL writes them right to begin with."""
    parts = E(spark, d).table("part").selectExpr("p_partkey", "p_size", "split_part(p_name, ' ', 1) AS v1", "split_part(p_name, ' ', 2) AS v2")
    return parts.select(F.col("p_partkey").alias("id"), D.spacing(F.expr(of_glued(0))).alias("text"))


BROKEN = r"(?s)^(.*? )([a-z]{5})([a-z]{3,} )"
BARE = r"""nullif(regexp_extract(lower({}), '^(\p{{L}}+)[.,;:!?]*$', 1), '')"""


@plan("f9_word_repair", rf""", src AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '{BROKEN}', '\1\2 \3') ELSE text END AS t FROM docs), s AS (SELECT doc_id, string_split(t, ' ') AS ws FROM src WHERE t IS NOT NULL),
r AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM s), v AS (SELECT {BARE.format('w')} AS word, count(*) AS n FROM r GROUP BY 1),
p AS (SELECT doc_id, pos, CASE WHEN regexp_matches(w, '^\p{{L}}+$') THEN lower(w) END AS a, {BARE.format('nw')} AS b FROM (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS nw FROM r)),
g AS (SELECT a, b, count(*) AS n FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY a, b),
k AS (SELECT g.a, g.b FROM g JOIN v ON v.word = g.a || g.b JOIN v x ON x.word = g.a JOIN v y ON y.word = g.b WHERE v.n >= 3 AND v.n >= 2 * g.n AND (x.n <= 2 * g.n OR y.n <= 2 * g.n)),
h AS (SELECT doc_id, list(pos) AS places FROM p JOIN k USING (a, b) GROUP BY doc_id), f AS (SELECT doc_id, list_filter(places, lambda x: NOT list_contains(places, x - 1)) AS kept FROM h)
SELECT src.doc_id, md5(CASE WHEN kept IS NULL THEN t ELSE array_to_string(list_transform(string_split(t, ' '), lambda w, i: CASE WHEN i = 1 OR list_contains(kept, i - 2) THEN '' ELSE ' ' END || w), '') END) AS digest, coalesce(len(kept), 0) AS n_repaired FROM src LEFT JOIN f USING (doc_id)""")
def f9_words(spark, d):
    """Documents of which every third has a broken word, repaired by the words of all."""
    docs = E(spark, d).docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", BROKEN, "$1$2 $3")).otherwise(F.col("text")).alias("text"))
    return R.repaired(docs, "doc_id", "text").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "n_repaired")


SMALL, CAPITALS = (f"({', '.join(repr(w) for w in ws)})" for ws in (D.SMALL, D.CAPITALS))
#: SQL of a step over words: the text so far ends with chr(1) where the next word begins a sentence.
MARK = """regexp_extract(x, '^([("'']*)', 1)"""
CORE = f"substr(x, length({MARK}) + 1)"
FRESH, ENDS, LETTER = "(s[-1] = chr(1))", "regexp_matches(x, '[.!?:]$')", rf"regexp_matches({CORE}, '^\p{{L}}')"
STEP = rf"""rtrim(s, chr(1)) || CASE WHEN rtrim(s, chr(1)) = '' THEN '' ELSE ' ' END || CASE WHEN NOT {LETTER} THEN x WHEN lower({CORE}) IN {CAPITALS} THEN {MARK} || upper({CORE}) WHEN {FRESH} THEN x WHEN lower({CORE}) IN {SMALL} THEN {MARK} || lower({CORE})
WHEN regexp_matches({CORE}, '^.+\p{{Lu}}') THEN x ELSE {MARK} || lower(left({CORE}, 1)) || substr({CORE}, 2) END
|| CASE WHEN NOT {ENDS} THEN '' WHEN NOT {LETTER} THEN chr(1) WHEN lower({CORE}) IN {CAPITALS} OR {FRESH} OR lower({CORE}) IN {SMALL} THEN '' ELSE chr(1) END"""


@plan("f10_sentence_case", rf""", t AS (SELECT doc_id, array_to_string(list_transform(string_split(replace(array_to_string(string_split(title, '. ')[1:2], '. '), 'ß', 'ss'), ' '), lambda x: upper(left(x, 1)) || substr(x, 2)), ' ') || CASE WHEN doc_id % 4 = 0 THEN ' For Alfa Sgr: (The IPO Of McKinsey' ELSE '' END AS t FROM docs),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '\s+'), lambda x: x <> '') AS ws FROM t), l AS (SELECT *, list_filter(ws, lambda x: regexp_matches(x, '^\p{{L}}..')) AS long FROM w),
c AS (SELECT *, len(ws) >= 4 AND len(long) >= 3 AND len(list_filter(long, lambda x: regexp_matches(x, '^\P{{Ll}}*$'))) <= len(long) * 0.5 AND len(list_filter(long, lambda x: regexp_matches(x, '^\p{{Lu}}'))) / nullif(len(long), 0) > 0.6 AS cased FROM l),
f AS (SELECT doc_id, t, cased, CASE WHEN cased THEN rtrim(list_reduce(ws, lambda s, x: {STEP}, chr(1)), chr(1)) END AS r FROM c)
SELECT doc_id, CASE WHEN cased THEN upper(regexp_extract(r, '^(\P{{L}}*\p{{L}})', 1)) || substr(r, length(regexp_extract(r, '^(\P{{L}}*\p{{L}})', 1)) + 1) ELSE t END AS title FROM f""")
def f10_sentence(spark, d):
    """The first two sentences of each document as a headline in title case, back in sentence case."""
    first = F.replace(F.substring_index("title", ". ", 2), F.lit("ß"), F.lit("ss"))
    cased = F.array_join(F.transform(F.split(first, " ", -1), lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substr(x, F.lit(2)))), " ")
    return E(spark, d).docs.select("doc_id", D.sentence_case(F.concat(cased, F.when(F.col("doc_id") % 4 == 0, " For Alfa Sgr: (The IPO Of McKinsey").otherwise(""))).alias("title"))


#: What stands around headlines and summaries; the documents' own sentences are between.
BEFORE = ["", "LEGGI TUTTO ", "Press release ", "MILAN – November 25, 2025 – ", "16 January 2026", "Feb 4,2026|BU news ", "Padova, 22 Dic. 2025 ", "“", "ROME, 15 January 2026 – "]
BEHIND = ["", "more details", " Approfondisci", " Read more", " added to Alfa Capital portfolio (ICT)", " Healthcare29 October 2025", "December 30, 2025", " 3 March 2025", " – IL SOLE 24 ORE", "”", " aggiunta al portafoglio di Alfa"]
HEADERS = ["", "[Rumor] ", "Featured News Press Review: ", "Media: Milan, ", "3 min read "]
ADDED = ["", ", announced on 2026-01-15.", " as of January 15, 2026.", " on 2026-01-15", " the is dated 3 May", ", announced in a dated 2026-01-15 note.", ". New investment involving Alfa.", "..", " Media: Rome, May 3rd, 2025 – next"]
AROUND = f"{pick(BEFORE, 'doc_id')} || split_part(title, '. ', 1) || {pick(BEHIND, '(doc_id // 9)')}"
AROUND_TEXT = f"{pick(HEADERS, 'doc_id')} || split_part(title, '. ', 1) || {pick(ADDED, '(doc_id // 5)')}"


@plan("f7_headlines", f"SELECT doc_id, {D.stages_sql(AROUND, D.TITLE_STAGES)} AS title, {D.stages_sql(AROUND_TEXT, D.TEXT_STAGES)} AS summary FROM docs")
def f7(spark, d):
    """First sentences of documents amid link texts, dates, places, papers and templates, as headlines and summaries."""
    div = lambda sql: sql.replace("//", "div")
    docs = E(spark, d).docs
    return docs.select("doc_id", D.headline(F.expr(div(AROUND))).alias("title"), D.staged(F.expr(div(AROUND_TEXT)), D.TEXT_STAGES).alias("summary"))
