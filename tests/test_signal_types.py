"""Corrected types of signals: single cases of each rule table, and the compiled plan against a plain reading of the rules."""

from __future__ import annotations

import re

import pytest

from tessera.functions import signal_types as S
from tessera.functions.signal_values import MASK, MASKED

ANY = "website_change"  # a type that has universal rules alone
CASES = [
    (ANY, "Rassegna stampa del 15 gennaio", "", "other"), (ANY, "", "Press review: top stories this week", "other"), (ANY, "Speaker at the annual summit on PE trends", "", "other"), (ANY, "Podcast series episode 5 on ESG", "", "other"),
    (ANY, "New spring/summer campaign launched by brand", "", "other"), (ANY, "Magazine switches from weekly to fortnightly", "", "other"), (ANY, "Interview with the CEO about market outlook", "", "other"), (ANY, "Interview: Alfa acquires Beta for €3B", "", ANY),
    (ANY, "€500M bond issuance completed", "", "debt_financing"), (ANY, "New revolving credit facility of €200M signed", "", "debt_financing"), (ANY, "Annual report 2024 published today", "", "report"), (ANY, "The motorway has approved a new €29.8B financial plan", "", "report"),
    (ANY, "Offerta di stage presso la sede di Milano", "", "job_posting"), (ANY, "Alfa acquires majority stake in Beta for €3B", "", ANY), (ANY, "This week's executive shuffles. News from KKR, Anthropic and Carlyle", "", "other"),
    (ANY, "Trading Floor: private credit giants take center stage. Alfa rises 7.2%", "same", "other"), (ANY, "Nexi shares fall 12% in Milan trading", "", "other"), (ANY, "Did the networks engage in anti-competitive conduct? The FCA investigation", "same", "other"),
    (ANY, "Trading Floor: Permira exits Golden Goose, selling its stake for €2.5B", "same", "exit_announced"), (ANY, "Our outlook for European private equity in 2025", "", "other"), (ANY, "Coalition launched to promote ESG standards", "", "other"),
    ("exit_announced", "Seeks a full-time analyst for the Milan office", "", "job_posting"), ("exit_announced", "Buyer cues present takes a stake", "Acquires Beta", "deal_announced"), ("exit_announced", "Exited from Alfa portfolio", "Alfa exits Beta", "exit_announced"),
    ("exit_announced", "Exploring the sale of its portfolio company", "Considering sale", "deal_announced"), ("exit_announced", "Strategic partnership for distribution", "Partners with Beta", "partnership"), ("exit_announced", "Gamma will merge with Delta to create a larger group", "Gamma Delta merger", "deal_announced"),
    ("deal_announced", "The sellers are Alfa and Beta", "", "exit_announced"), ("deal_announced", "Obtains €50M in financing from bank", "", "debt_financing"), ("deal_announced", "Portfolio company Beta expands into Spain", "Beta", "portfolio_update"),
    ("deal_announced", "Beta exited from portfolio", "", "exit_announced"), ("deal_announced", "Acquires majority stake in Beta for €500M", "Alfa acquires Beta", "deal_announced"), ("deal_announced", "Chiude la raccolta del fondo a €500M", "", "fundraise_closed"),
    ("deal_announced", "Places €300M bond for expansion", "", "debt_financing"), ("deal_announced", "Sells 35% stake in Beta", "", "exit_announced"), ("deal_announced", "Alfa-backed Beta acquires Gamma online", "same", "portfolio_update"),
    ("deal_announced", "Beta, backed by Alfa, acquires Gamma", "same", "portfolio_update"), ("deal_announced", "Lexham Power (EOS IM) acquires majority stake in Innovo", "same", "portfolio_update"), ("deal_announced", "Alfa portfolio company completes bolt-on acquisition of Beta", "Bolt-on acquisition completed", "portfolio_update"),
    ("deal_announced", "KKR acquires Italian tech company for €500M", "KKR acquires Italian tech company", "deal_announced"), ("deal_announced", "Giampaolo Di Dio is stepping down as CIO of the manager", "The manager, CIO leaves", "people_move"),
    ("fundraise_announced", "Obtains financing from bank for project", "", "debt_financing"), ("fundraise_announced", "Fifth investment for fund II in Italian SME", "", "deal_announced"), ("fundraise_announced", "Final close of fund III above target", "", "fundraise_closed"),
    ("fundraise_announced", "Announces new fund targeting €500M", "", "fundraise_announced"), ("fundraise_announced", "Places €200M senior secured notes", "", "debt_financing"),
    ("fund_launch", "Merger with competitor creates new entity", "", "deal_announced"), ("fund_launch", "Investe nel capitale di Beta", "Investimento in Beta", "deal_announced"), ("fund_launch", "Launches new fund III targeting €500M", "Launches new fund III", "fund_launch"),
    ("fund_launch", "Accelerator programme launches in Milan", "Accelerator launch", "other"), ("fund_launch", "New initiative for SMEs", "", "other"),
    ("people_move", "Join forces to promote ESG", "", "partnership"), ("people_move", "New advisory board formed for the initiative", "", "other"), ("people_move", "Friulia joins Quin and supports the group's multi-year growth plan", "Friulia joins Quin", "deal_announced"),
    ("people_move", "Appointed John Smith as new head of investments", "Appointed John Smith as head", "people_move"), ("people_move", "Generic text about prices", "Prices", "other"), ("people_move", "Snam joins Tech 4 Planet hub", "Snam joins hub", "partnership"),
    ("people_move", "Senior Investment Associate, Clean Energy - Capital Dynamics", "same", "other"), ("report", "Volumes up in Q1 2025 and net profit at €1.6M", "", "report"), ("partnership", "Acquires majority of Grifo Group", "Alfa acquires Grifo", "deal_announced"),
    ("partnership", "Portfolio company Beta expands", "", "portfolio_update"), ("partnership", "Strategic alliance with local partner", "New partnership", "partnership"), ("portfolio_update", "Announces the sale of its stake in Beta", "Announces the sale", "exit_announced"),
    ("other", "Names John Smith as new head of investments and strategy", "Names John Smith as head", "people_move"), ("other", "Reports €449M EBITDA shortfall, CEO resigns after 7 months", "CEO resigns", "people_move"), ("other", "The company leaves the market after weak numbers", "Company leaves market", "other"),
    ("other", "Offers €500M for acquisition of Beta", "Offers €500M for Beta", "deal_announced"), ("other", "Alfa invests in Beta to accelerate growth", "Alfa invests in Beta", "deal_announced"), ("fundraise_closed", "Closes Series A round at €10M", "", "deal_announced"),
    ("fundraise_closed", "Closes fund III at €500M above target", "", "fundraise_closed"), (ANY, "Generic text", "Generic title", ANY), ("other", "Buys and builds", "", "other"), (None, None, None, None),
]


def plainly(kind, title, text, page, changes):
    """Rules read one by one with Python's own expressions."""
    fields = {"text": (text or "").strip().lower(), "title": (title or "").strip().lower(), "changes": (changes or "").strip().lower()}

    def holds(condition):
        names = {"page": page or ""}
        for n, (p, f) in S.facts_of([condition]).items():
            t = re.sub(MASK, " ", fields[f]) if p in MASKED else fields[f]
            names[n] = re.search(S.PATTERNS[p], t, re.IGNORECASE) is not None
        python = S.spelled(condition).replace(" AND ", " and ").replace(" OR ", " or ").replace("NOT ", "not ").replace("<>", "!=").replace(" = ", " == ")
        return eval(python, {}, names)

    for group, rules in (("universal", S.UNIVERSAL), (kind, S.BY_TYPE.get(kind, []))):
        for r in rules:
            if holds(r.holds):
                return f"{group}/{r.name}", r.gives
    return None, kind


def rows_of(cases):
    return [(i, kind, text if title == "same" else title, text, None, None) for i, (kind, text, title, _) in enumerate(cases)]


SCHEMA = "id long, type string, title string, text string, page string, changes string"


def test_single_cases(spark):
    got = {r.id: r for r in S.corrected(spark.createDataFrame(rows_of(CASES), SCHEMA)).collect()}
    wrong = [(case, got[i].rule, got[i].corrected) for i, case in enumerate(CASES) if got[i].corrected != case[3]]
    assert not wrong


def test_team_pages_and_summaries_of_changes(spark):
    rows = [
        (0, "people_move", "Giulio Pesenti head of strategic business development", "Giulio Pesenti head of strategic business development", "TEAM", None),
        (1, "people_move", "Delta", "Delta is the parent company of the group", "TEAM", None),
        (2, "deal_announced", "", "New listing on the page", "PORTFOLIO", "New portfolio company detected"),
        (3, "exit_announced", "", "A quiet year", "PORTFOLIO", ""), (4, "exit_announced", "", "A quiet year", "NEWS", ""),
    ]
    got = {r.id: r.corrected for r in S.corrected(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: "other", 1: "other", 2: "portfolio_update", 3: "exit_announced", 4: "other"}


def test_plan_against_plain_reading(spark, data):
    from tessera.plans.entities import Entities
    from tessera.plans.queries_i import signals

    df = signals(Entities(spark, data)).where("length(text) < 4000")
    got = {r.doc_id: (r.rule, r.corrected) for r in S.corrected(df).collect()}
    rows = df.collect()
    for r in rows:
        assert got[r.doc_id] == plainly(r.type, r.title, r.text, r.page, r.changes), r.text[:100]
    assert len({g for g, _ in got.values()}) > 40


@pytest.mark.parametrize("pattern", sorted(S.PATTERNS))
def test_every_match_holds_a_needle(pattern):
    wanted = S.needles(pattern)
    texts = [t for _, t, *_ in CASES if t]
    for t in texts:
        for m in re.finditer(S.PATTERNS[pattern], t.lower(), re.IGNORECASE):
            assert not wanted or any(n in m[0] for n in wanted)


def test_all_types(spark):
    text = "D-Orbit: final close at €110M as Indaco exits; appointed John Smith, who joins forces with Alfa"
    df = spark.createDataFrame([("fundraise_closed", text), ("other", "Alfa and Beta join forces"), (None, None)], "type string, text string")
    got = [r.types for r in S.all_types(df).collect()]
    assert got == [["fundraise_closed", "exit_announced", "people_move"], ["other"], ["other"]]


def test_held_news(spark):
    rows = [("other", "Portfolio company Beta opens new office"), ("other", "Backed by Alfa, Beta expands into Spain"), ("exit_announced", "Portfolio company news"), ("other", "Generic news about prices"), ("partnership", None), (None, "Portfolio company news")]
    got = [r.held for r in S.held_news(spark.createDataFrame(rows, "type string, text string")).collect()]
    assert got == ["portfolio_update", "portfolio_update", None, None, None, None]


def test_needles_in_one_pass(spark):
    """Patterns worth trying, against a search for each needle: overlapping needles, ones that others begin with, signs, letters of other scripts."""
    import random

    from pyspark.sql import functions as F

    from tessera.functions import signal_types as S

    r = random.Random(1)
    needles = sorted({n for p in S.PATTERNS for n in S.needles(p)})
    texts = ["", "€🙂\nà", *needles, *("".join(r.choice([n, n[:-1], n[1:], " ", "é🙂", "\n"]) for n in r.sample(needles, 12)) for _ in range(300))]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", S.worth_trying(F.col("t"), list(S.PATTERNS)).alias("x")).collect()
    for row in got:
        assert set(row.x) == {S.NUMBERS[p] for p in S.PATTERNS if any(n in texts[row.i] for n in S.needles(p))} and len(set(row.x)) == len(row.x)
    plan = spark.range(1).select(S.worth_trying(F.col("id").cast("string"), list(S.PATTERNS)).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert "contains(" not in plan.lower()  # no search for each needle
