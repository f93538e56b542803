"""Plans of rule tables: types of signals corrected by rules, and all types that a text speaks of."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessera.functions import signal_types as S
from tessera.functions.signal_values import MASK, MASKED
from tessera.operators import matching as M

from .entities import Entities as E
from .queries_f import q
from .registry import plan

#: Beginnings of texts that the rules are about; the documents' own texts follow them.
OPENINGS = [
    "", "Press review: top stories of the week.", "Speaker at the annual summit on private equity trends.", "Podcast series episode 5 on ESG.", "New spring/summer campaign launched by a brand.", "Magazine switches from weekly to fortnightly.",
    "Interview with the CEO about the next years.", "Interview: Alfa acquires Beta for €3B.", "€500M bond issuance completed.", "New revolving credit facility of €200M signed.", "Annual report 2024 published today.", "Offerta di stage presso la sede di Milano.",
    "Trading Floor: private credit giants take center stage. Alfa rises 7.2%.", "Trading Floor: Alfa exits Beta, selling its stake for €2.5B.", "Did two networks engage in anti-competitive conduct? The authority asks.", "Coalition launched to promote standards.",
    "Our outlook for European private equity.", "Seeks a full-time analyst for the Milan office.", "Investe nel capitale della società.", "Exited from Alfa portfolio.", "Exploring the sale of its subsidiary.", "Strategic partnership for distribution.",
    "Gamma will merge with Delta to create a larger group.", "The sellers are Alfa and Beta.", "Obtains €50M in financing from a bank.", "Portfolio company Delta expands into Spain.", "Acquires majority stake in Delta for €500M.", "Chiude la raccolta del fondo a €500M.",
    "Places €300M bond for expansion.", "Sells 35% stake in Delta.", "Alfa-backed Delta acquires Gamma online.", "Delta, backed by Alfa, acquires Gamma.", "Lambda Power (EOS IM) acquires majority stake in Innovo.", "Completes bolt-on acquisition of Gamma.",
    "Fifth investment for fund II in an Italian SME.", "Final close of fund III above target.", "Announces new fund targeting €500M.", "Places €200M senior secured notes.", "Launches new fund III targeting €500M.", "Accelerator programme launches in Milan.",
    "New initiative for SMEs.", "Join forces to promote ESG.", "New advisory board formed for the initiative.", "Friulia joins Quin and supports the group's multi-year growth plan.", "Appointed John Smith as new head of investments.", "Snam joins Tech 4 Planet hub.",
    "Giulio Pesenti head of strategic business development", "Senior Investment Associate, clean energy - Delta Dynamics", "Volumes up in Q1 2025 and net profit at €1.6M.", "Nel 2025 utile netto superiore a 7 milioni.", "Strategic alliance with a local partner.",
    "CIO Giampaolo Di Dio is stepping down.", "EBITDA shortfall of €449M, CEO resigns after 7 months.", "Offers €500M for acquisition of Delta.", "Alfa invests in Delta to accelerate growth.", "Announces the sale of its stake in Delta.", "Names John Smith as new head of strategy.",
    "Buys and builds: how the strategy works.", "Court case over the old plant.", "Invests in a new plant for its companies: Delta (Alfa Capital) doubles capacity.", "Opens a new office in Madrid.", "Accordo di ristrutturazione con i creditori.", "Closes Series A round at €10M.",
    "Launched in 2019, the vehicle grows.", "Board of directors approves the half-year statements.", "Investor day in London.", "Call for applications: the programme opens.", "Società in portafoglio: nuova sede.",
]
KINDS = [*S.BY_TYPE, "website_change"]
PAGES = ["NEWS", "TEAM", "PORTFOLIO"]
#: SQL of the signals: a document's text with an opening, a type and a page by its id.
pick = lambda values, of: f"CASE {of} % {len(values)} " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values)) + " END"
SIGNALS = f"""SELECT doc_id, {pick(KINDS, '(doc_id // 7)')} AS type, {pick(PAGES, 'doc_id')} AS page, {pick(OPENINGS, 'doc_id')} || ' ' || coalesce(title, '') AS title,
{pick(OPENINGS, 'doc_id')} || ' ' || coalesce(text, '') AS text, CASE WHEN doc_id % 13 = 0 THEN 'New portfolio company detected' END AS changes FROM docs"""
#: Letters beyond a to z end no word in the patterns of DuckDB, so they become letters there, in texts and patterns alike.
ASCII = "[à-öø-ɏ]"


def plain_fact(name: str, field: str) -> str:
    """SQL of a fact over the columns of lower-case texts."""
    pattern = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", re.sub(ASCII, "a", S.PATTERNS[name].replace("À-ſ", "")))
    of = f"regexp_replace({field}, {q(MASK)}, ' ', 'g')" if name in MASKED else field
    return f"regexp_matches({of}, {q('(?i)' + pattern)})"


def facts_sql(rules) -> str:
    return ", ".join(f"{plain_fact(p, 'l_' + f)} AS {n}" for n, (p, f) in S.facts_of([r.holds for r in rules]).items())


LOWER = ", ".join(f"regexp_replace(lower(trim(coalesce({f}, ''))), '{ASCII}', 'a', 'g') AS l_{f}" for f in S.FIELDS.values())
ALL_RULES = [r for rules in (S.UNIVERSAL, *S.BY_TYPE.values()) for r in rules]


def signals(e: E):
    of = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    i = F.col("doc_id")
    opening = of(OPENINGS, i)
    return e.docs.select(
        i, of(KINDS, F.floor(i / 7)).alias("type"), of(PAGES, i).alias("page"), F.concat(opening, F.lit(" "), F.coalesce("title", F.lit(""))).alias("title"),
        F.concat(opening, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"), F.when(i % 13 == 0, "New portfolio company detected").alias("changes"),
    )


@plan("c3_type_corrections", f""", s AS ({SIGNALS}), x AS (SELECT doc_id, type, page, {LOWER} FROM s), f AS (SELECT doc_id, type, page, {facts_sql(ALL_RULES)} FROM x), r AS (SELECT doc_id, type, {S.fired()} AS rule FROM f)
SELECT doc_id, type, rule, coalesce(MAP {{{', '.join(f"{q(k)}: {q(v)}" for k, v in S.outcomes().items())}}}[rule], type) AS corrected FROM r""")
def c3_types(spark, d):
    """Universal rules, then those of the signal's type, the first that holds decides; with the rule that fired."""
    return S.corrected(signals(E(spark, d))).select("doc_id", "type", "rule", "corrected")


@plan("c6_all_types", f""", s AS ({SIGNALS}), x AS (SELECT doc_id, type, page, {LOWER} FROM s), f AS (SELECT doc_id, type, {facts_sql(S.SPOKEN_OF)} FROM x)
SELECT doc_id, [type] || list_filter([{', '.join(f"CASE WHEN ({S.spelled(r.holds)}) AND type <> {q(r.gives)} THEN {q(r.gives)} END" for r in S.SPOKEN_OF)}], lambda x: x IS NOT NULL) AS types FROM f""")
def c6_types(spark, d):
    """A signal's type, then every other one that its text speaks of."""
    return S.all_types(signals(E(spark, d))).select("doc_id", "types")


@plan("c3_held_news", f""", s AS ({SIGNALS}), x AS (SELECT doc_id, type, page, {LOWER} FROM s), f AS (SELECT doc_id, type, {facts_sql([S.HELD])} FROM x)
SELECT doc_id, type, CASE WHEN type IN ({', '.join(map(q, S.HELD_TYPES))}) AND ({S.spelled(S.HELD.holds)}) THEN {q(S.HELD.gives)} END AS held FROM f""")
def c3_held(spark, d):
    """News of companies already held, among signals whose type may be changed for it."""
    return S.held_news(signals(E(spark, d))).select("doc_id", "type", "held")


#: Sentences about deals; {} is a fund's name, or the first word of it.
ROLES = ["The club deal was organized by {}.", "Round led by the investment team of {} in May.", "{} leads a funding round of 5 million.", "{} ha guidato il round.", "Promosso by {}", "Arranged by the advisers and friends of {}.", "{} leads the market.", "A deal with {}.", "Led by 3 funds and {}."]
NORMAL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@plan("j17_organisers", f""", f AS (SELECT fund_id, c.name FROM funds JOIN companies c ON c.company_id = fund_id), k AS (SELECT count(*) AS n FROM f),
s AS (SELECT doc_id, o.fund_id AS own_id, replace({pick(ROLES, 'doc_id')}, '{{}}', CASE WHEN doc_id % 4 = 0 THEN string_split(f.name, ' ')[1] ELSE f.name END) || ' ' || coalesce(text, '') AS text
  FROM docs JOIN k ON true JOIN f ON f.fund_id = 1 + doc_id * 7 % k.n JOIN f o ON o.fund_id = 1 + doc_id % k.n),
t AS (SELECT doc_id, own_id, ' ' || {NORMAL.format('text')} || ' ' AS t FROM s),
n AS (SELECT DISTINCT fund_id, {NORMAL.format('x')} AS x FROM (SELECT fund_id, name AS x FROM f WHERE length(trim(name)) >= 4 UNION ALL SELECT fund_id, string_split(trim(name), ' ')[1] FROM f WHERE length(trim(name)) >= 4 AND length(string_split(trim(name), ' ')[1]) >= 6))
SELECT doc_id, own_id AS fund_id, 'own' AS via FROM t UNION ALL
SELECT DISTINCT doc_id, fund_id, 'organiser' FROM t JOIN n ON contains(t, ' ' || x || ' ') WHERE fund_id <> own_id AND (regexp_matches(t, ' ({M.ORGANISED_BY}) by ([a-z ]{{0,{M.GAP - 2}}}[a-z] )?' || x || ' ') OR regexp_matches(t, ' ' || x || ' ({M.ORGANISES}) (({M.ARTICLES}) )?({M.DEALS}) '))""")
def j17_organisers(spark, d):
    """Texts go to their own fund and to every fund that they name as an organiser, by the words around the name."""
    e = E(spark, d)
    f = e.funds.select("fund_id").join(e.companies.select(F.col("company_id").alias("fund_id"), "name"), "fund_id")
    i, n = F.col("doc_id"), F.col("n")
    role = F.element_at(F.array(*map(F.lit, ROLES)), (i % len(ROLES) + 1).cast("int"))
    docs = e.docs.select(i, "text").join(F.broadcast(f.agg(F.count("*").alias("n")))).withColumns({"named": 1 + i * 7 % n, "own_id": 1 + i % n})
    docs = docs.join(f.withColumnsRenamed({"fund_id": "named"}), "named").join(f.select(F.col("fund_id").alias("own_id")), "own_id")
    name = F.when(i % 4 == 0, F.substring_index("name", " ", 1)).otherwise(F.col("name"))
    texts = docs.select("doc_id", "own_id", F.concat(F.replace(role, F.lit("{}"), name), F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))
    others = M.organisers(texts.select("doc_id", "text"), f, "doc_id", "text", "fund_id", "name").join(texts.select("doc_id", "own_id"), "doc_id").where("fund_id <> own_id")
    return texts.select("doc_id", F.col("own_id").alias("fund_id"), F.lit("own").alias("via")).unionByName(others.select("doc_id", "fund_id", F.lit("organiser").alias("via")))
