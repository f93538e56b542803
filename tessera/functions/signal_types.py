"""Types of signals corrected by rules over their texts.

Rules are data: a name, a condition and the type that it gives. Conditions are SQL over facts, and a fact is whether a pattern is found in one of a signal's
fields: ``merger`` in its text, ``merger_t`` in its title, ``merger_d`` in its summary of changes. A table of rules is compiled into two projections: one that finds
every fact once, and only for signals whose type has a rule that asks for it; and one CASE for each table, whose branches read booleans alone. So
the plan grows with the number of patterns, not with the number of times that rules mention them. Before any pattern is tried, one pass over each text finds which of the
patterns' needles it holds (letters of which one is in every match); a pattern without a needle there can't match and isn't tried.

Correction has two phases. The universal rules come first; where none holds, those of the signal's current type. The first rule that holds decides and is named in the result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable
from re import _parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .signal_values import MASK, MASKED, SHARED, SINGLE


class Rule(NamedTuple):
    name: str
    holds: str
    gives: str


#: Evidence of several patterns, by name; conditions use these names like facts.
EVIDENCE = {
    "deal": "(acquisition_verbs OR invest_verbs OR offer_bid OR company_round OR strong_deal)",
    "leaving": "(exit_verbs OR strong_exit_verbs OR explicit_seller OR exited_from_portfolio)",
    "raising": "(fund_level_fundraise OR fundraise_closing OR fundraise_milestone OR chiude_raccolta)",
    "any_event": "(deal OR leaving OR raising)",
    "plain_bond": "(bond_issuance AND NOT bond_exclude)",
    "plain_project": "(project_financing AND NOT bond_exclude)",
    "plain_debt": "(debt_financing_broad AND NOT bond_exclude)",
    "moves": "(appointment_verbs OR named_as OR people_departure_transition)",
    "static_team": "(page = 'TEAM' AND (team_profile_noise_t OR parent_company))",
    "own_plant": "(capex AND owner_then_capex)",
}

UNIVERSAL = [
    Rule("dated_event", "annual_dated", "other"),
    Rule("press_review", "press_review OR press_review_title_t", "other"),
    Rule("plan_presented", "strategic_plan_presentation", "report"),
    Rule("committee", "committee_establishment", "other"),
    Rule("roundup", "management_roundup", "other"),
    Rule("press_opinion", "press_source_opinion", "other"),
    Rule("opinion_piece", "opinion_piece", "other"),
    Rule("scouting", "taking_steps_to_scout AND NOT acquisition_verbs", "other"),
    Rule("fund_closing", "fundraise_closing", "fundraise_closed"),
    Rule("talk", "talk_series AND NOT (deal OR raising)", "other"),
    Rule("open_call", "open_call AND NOT (deal OR raising OR currency_amount)", "other"),
    Rule("tender", "exploratory OR outsourced_control", "other"),
    Rule("investor_event", "investor_event AND NOT (deal OR raising)", "other"),
    Rule("research_summary", "research_summary", "other"),
    Rule("sold", "strong_exit_verbs AND NOT acquisition_verbs", "exit_announced"),
    Rule("fashion", "fashion_campaign", "other"),
    Rule("court", "court AND NOT (deal OR leaving)", "other"),
    Rule("market", "(market_move OR trading_floor_t OR price_move) AND NOT any_event", "other"),
    Rule("antitrust", "anti_competitive AND competition_probe", "other"),
    Rule("format_change", "editorial_format", "other"),
    Rule("template", "boilerplate_template", "other"),
    Rule("outsourcing", "outsourcing AND NOT (deal OR leaving)", "other"),
    Rule("attendance", "event_attendance", "other"),
    Rule("series", "series_opening AND NOT (deal OR raising)", "other"),
    Rule("event_title", "event_title AND NOT (deal OR raising)", "other"),
    Rule("joins_event", "joins_event AND NOT deal", "other"),
    Rule("meeting", "investor_meeting AND NOT (deal OR raising)", "other"),
    Rule("interview", "interview AND NOT any_event", "other"),
    Rule("commentary", "commentary AND NOT any_event", "other"),
    Rule("essay", "essay_title AND NOT any_event", "other"),
    Rule("matching", "private_matching AND NOT deal", "other"),
    Rule("our_reasons", "that_is_why AND NOT any_event", "other"),
    Rule("coalition", "coalition AND NOT (deal OR raising)", "other"),
    Rule("crossroads", "crossroads AND NOT any_event", "other"),
    Rule("recap", "event_insights OR event_recap_italian", "other"),
    Rule("value_creation", "value_creation", "other"),
    Rule("internship", "internship", "job_posting"),
    Rule("strategy", "editorial_strategy AND (NOT (deal OR leaving OR strong_deal) OR NOT monetary)", "other"),
    Rule("results", "report AND NOT (fund_launch_verbs OR deal)", "report"),
    Rule("revenue", "revenue_performance AND NOT (deal OR leaving OR people_departure_transition)", "other"),
    Rule("bond", "plain_bond", "debt_financing"),
    Rule("credit_facility", "credit_facility AND NOT deal", "debt_financing"),
    Rule("debt", "plain_debt AND NOT (deal OR fund_level_fundraise)", "debt_financing"),
    Rule("regulatory", "regulatory_communication", "other"),
    Rule("research", "research AND NOT (deal OR raising)", "other"),
    Rule("notice", "notice_t AND NOT any_event", "other"),
]

BY_TYPE = {
    "exit_announced": [
        Rule("job", "job_posting_reclassify", "job_posting"),
        Rule("no_exit", "outsourcing OR fashion_campaign OR editorial_format", "other"),
        Rule("results", "report", "report"),
        Rule("debt", "(plain_bond OR debt_financing_broad OR credit_facility) AND NOT strong_exit_verbs", "debt_financing"),
        Rule("weighed", "weighing_sale AND NOT (exited_from_portfolio OR strong_exit_verbs)", "deal_announced"),
        Rule("left_portfolio", "exited_from_portfolio", "exit_announced"),
        Rule("mandate", "selected AND mandate AND NOT (exit_verbs OR strong_exit_verbs)", "partnership"),
        Rule("agreement", "agreement AND agreement_partnership_context AND NOT (exit_verbs OR acquisition_verbs)", "partnership"),
        Rule("merger", "merger AND NOT (explicit_seller OR strong_exit_verbs)", "deal_announced"),
        Rule("buyer_in_title", "(acquires_name_t OR buyer_cues_t) AND NOT explicit_seller", "deal_announced"),
        Rule("buyer", "(buyer_cues OR offer_bid) AND NOT strong_exit_verbs", "deal_announced"),
        Rule("launch", "launch_fund", "fund_launch"),
        Rule("acquisition", "acquisition_verbs AND NOT exit_verbs", "deal_announced"),
        Rule("investment", "invest_verbs AND NOT strong_exit_verbs", "deal_announced"),
        Rule("partnership", "partnership AND NOT strong_exit_verbs", "partnership"),
        Rule("no_verb", "page <> 'PORTFOLIO' AND NOT has_any_pe_verb", "other"),
    ],
    "deal_announced": [
        Rule("listed", "new_portfolio_detected_d AND NOT (deal OR leaving)", "portfolio_update"),
        Rule("sale", "sale_announced OR seller_named", "exit_announced"),
        Rule("credit", "obtains_credit", "debt_financing"),
        Rule("stake_sold", "stake_sold", "exit_announced"),
        Rule("held_acquirer", "portfolio_co_as_acquirer", "portfolio_update"),
        Rule("held", "portfolio_update AND NOT (acquisition_verbs_t OR invest_verbs_t OR acquisition_verbs OR strong_deal)", "portfolio_update"),
        Rule("seller", "exited_from_portfolio OR explicit_seller", "exit_announced"),
        Rule("sold", "strong_exit_verbs AND NOT (acquisition_verbs OR buyer_cues_t)", "exit_announced"),
        Rule("outsourcing", "outsourcing", "other"),
        Rule("job", "internship OR job_selection", "job_posting"),
        Rule("fund_raised", "fund_level_fundraise", "fundraise_closed"),
        Rule("results", "report AND NOT acquisition_verbs_t", "report"),
        Rule("bond", "bond_issuance OR project_financing", "debt_financing"),
        Rule("team", "team_strengthening AND NOT deal", "people_move"),
        Rule("expansion", "portfolio_expansion AND NOT any_event", "portfolio_update"),
        Rule("people", "people_language AND NOT (buying OR invest_in OR offer_bid OR company_round OR strong_deal OR leaving OR merger)", "people_move"),
        Rule("partnership", "partnership AND NOT (invest_verbs OR exit_verbs OR partnership_exclude)", "partnership"),
        Rule("acquired", "acquisition_by OR insolvency", "other"),
        Rule("debt_restructured", "debt_restructuring AND debt_restructure_context", "debt_financing"),
        Rule("restructured", "debt_restructuring", "other"),
        Rule("debt", "credit_facility OR plain_debt OR (funds_provided AND NOT invest_verbs)", "debt_financing"),
        Rule("fund_closed", "closing_fund OR chiude_raccolta", "fundraise_closed"),
        Rule("launch", "launch_fund", "fund_launch"),
        Rule("plant", "own_plant", "portfolio_update"),
    ],
    "fund_launch": [
        Rule("merger", "merger", "deal_announced"),
        Rule("fund_closed", "fund_level_fundraise AND (fundraise_closing OR chiude_fondo)", "fundraise_closed"),
        Rule("fund_raised", "fund_level_fundraise", "fundraise_announced"),
        Rule("debt", "plain_bond OR credit_facility OR plain_project OR plain_debt", "debt_financing"),
        Rule("accelerator", "(accelerator_launch OR accelerator_results) AND NOT fund_launch_strict_t", "other"),
        Rule("subscriber", "lp_commitment AND NOT fund_launch_strict_t", "fundraise_announced"),
        Rule("outsourcing", "outsourcing", "other"),
        Rule("job", "job_selection", "job_posting"),
        Rule("nth_investment", "ordinal_investment", "deal_announced"),
        Rule("board", "board_appoint AND NOT fund_launch_strict_t", "people_move"),
        Rule("office", "office_opening AND NOT invest_verbs", "people_move"),
        Rule("investment", "offer_bid OR (invest_verbs AND NOT fund_launch_strict_t) OR company_round", "deal_announced"),
        Rule("round_closed", "round_invest_t AND close_verbs_t", "fundraise_closed"),
        Rule("round", "round_invest_t", "fundraise_announced"),
        Rule("closed", "chiude_fondo OR fundraise_milestone", "fundraise_closed"),
        Rule("finalised", "finalizzat", "deal_announced"),
        Rule("partnership", "partnership AND NOT (fund_launch_strict_t OR partnership_exclude)", "partnership"),
        Rule("partners_buy", "partnership AND NOT fund_launch_strict_t", "deal_announced"),
        Rule("restructured", "debt_restructuring AND NOT invest_verbs", "other"),
        Rule("editorial", "(revenue_performance OR editorial_strategy) AND NOT fund_launch_strict_t", "other"),
        Rule("partnership_launched", "launch_of_partnership_t", "partnership"),
        Rule("years_ago", "launched_years_ago", "other"),
        Rule("no_vehicle", "NOT fund_launch_strict_t", "other"),
    ],
    "fundraise_announced": [
        Rule("credit", "obtains_credit_from", "debt_financing"),
        Rule("investment", "ordinal_investment OR fundraise_acquisition", "deal_announced"),
        Rule("closed", "fundraise_closing OR fundraise_milestone OR fundraise_closed_verbs OR closing_fund", "fundraise_closed"),
        Rule("debt", "(plain_bond OR debt_financing_broad OR plain_project) AND NOT fund_level_fundraise", "debt_financing"),
        Rule("strategy", "editorial_strategy AND NOT invest_verbs", "other"),
        Rule("results", "report AND NOT fund_level_fundraise", "report"),
    ],
    "people_move": [
        Rule("board_results", "board_acts AND statements", "report"),
        Rule("forces", "join_forces", "partnership"),
        Rule("council", "joins_council AND NOT hired", "other"),
        Rule("backer", "joins AND backs_growth AND NOT hired_as", "deal_announced"),
        Rule("programme", "joins AND programme AND NOT (hired_as OR board_appoint)", "partnership"),
        Rule("advisers", "advisory_board AND NOT appointment_verbs", "other"),
        Rule("team_page", "static_team AND NOT moves", "other"),
        Rule("role_opening", "role_opening_title_t AND NOT moves", "other"),
        Rule("sold", "strong_exit_verbs", "exit_announced"),
        Rule("team", "team_strengthening AND NOT deal", "people_move"),
        Rule("departure", "people_departure_transition AND senior_role_hint", "people_move"),
        Rule("results", "report AND NOT deal", "report"),
        Rule("investment", "invest_verbs OR strong_deal", "deal_announced"),
        Rule("fund_closed", "(chiude_fondo OR raising) AND fundraise_closed_verbs", "fundraise_closed"),
        Rule("fund_raised", "chiude_fondo OR raising", "fundraise_announced"),
        Rule("editorial", "interview_editorial AND NOT (people_language OR resigns)", "other"),
        Rule("no_person", "NOT (people_title OR board_appoint OR people_language)", "other"),
    ],
    "report": [
        Rule("manager_results", "mgmt_company_financials", "other"),
        Rule("sold", "strong_exit_verbs OR explicit_seller", "exit_announced"),
        Rule("accelerator", "accelerator_launch", "other"),
        Rule("launch", "fund_compartment_operational OR fund_launch_verbs", "fund_launch"),
        Rule("deal", "deal AND NOT report", "deal_announced"),
    ],
    "partnership": [
        Rule("acquisition", "acquisition_verbs", "deal_announced"),
        Rule("held", "portfolio_update", "portfolio_update"),
        Rule("accelerator", "accelerator_launch AND NOT fund_launch_strict", "other"),
        Rule("raised", "capital_raised", "deal_announced"),
        Rule("sold", "strong_exit_verbs", "exit_announced"),
        Rule("editorial", "interview_editorial AND NOT named_or_signed", "other"),
    ],
    "portfolio_update": [
        Rule("held_seller", "portfolio_co_as_acquirer AND strong_exit_verbs", "exit_announced"),
        Rule("held_acquirer", "portfolio_co_as_acquirer", "portfolio_update"),
        Rule("deal_in_title", "acquisition_verbs_t OR invest_verbs_t", "deal_announced"),
        Rule("sold", "strong_exit_verbs OR sale_agreed", "exit_announced"),
    ],
    "fundraise_closed": [Rule("company_round", "company_round AND NOT fund_level_fundraise", "deal_announced")],
    "other": [
        Rule("team_page", "(static_team OR role_opening_title_t) AND NOT moves", "other"),
        Rule("departure", "people_departure_transition AND senior_role_hint", "people_move"),
        Rule("appointment", "people_appointment_rescue", "people_move"),
        Rule("launch", "launch_fund", "fund_launch"),
        Rule("office", "opens_office", "people_move"),
        Rule("plant", "own_plant", "portfolio_update"),
        Rule("restructured", "debt_restructuring", "debt_financing"),
        Rule("fund_closed", "fundraise_closed_verbs AND vehicle AND NOT (obtains_credit_from OR ordinal_investment OR fundraise_acquisition)", "fundraise_closed"),
        Rule("investment", "invest_verbs AND NOT (editorial_strategy OR interview_editorial)", "deal_announced"),
        Rule("role", "role_title_t AND NOT fund_title_t", "people_move"),
        Rule("priced", "(offer_bid OR acquisition_verbs) AND currency_amount", "deal_announced"),
    ],
}

#: All types that a text speaks of.
SPOKEN_OF = [
    Rule("exit", "exit_verbs", "exit_announced"),
    Rule("closed", "fundraise_closing", "fundraise_closed"),
    Rule("raised", "fundraise_verbs_full AND NOT fundraise_closing", "fundraise_announced"),
    Rule("people", "(people_title OR people_language) AND NOT (forces_joined AND NOT appointment_stated)", "people_move"),
    Rule("bond", "bond_issuance", "debt_financing"),
    Rule("deal", "invest_verbs OR bought", "deal_announced"),
]

#: Types under which news of a company already held may run, and what tells it.
HELD_TYPES = ("other", "deal_announced", "partnership")
HELD = Rule("held", "portfolio_update OR portfolio_company_backed OR portfolio_co_as_acquirer", "portfolio_update")

PATTERNS = SHARED | SINGLE
FIELDS = {"": "text", "_t": "title", "_d": "changes"}


def spelled(condition: str) -> str:
    """A condition with the names of evidence written out."""
    while (out := re.sub(r"\w+", lambda m: EVIDENCE.get(m[0], m[0]), condition)) != condition:
        condition = out
    return condition


def facts_of(conditions: list[str]) -> dict[str, tuple[str, str]]:
    """The facts that conditions ask for: name -> (pattern's name, field)."""
    found = {}
    for word in re.findall(r"\w+", " ".join(map(spelled, conditions))):
        for ending, field in FIELDS.items():
            if word in PATTERNS and not ending or ending and word.removesuffix(ending) in PATTERNS and word.endswith(ending):
                found[word] = (word.removesuffix(ending) if ending else word, field)
    return found


def asked_by() -> dict[str, set[str] | None]:
    """The types whose rules ask for a fact; None if signals of all types need it."""
    out: dict = {name: None for name in facts_of([r.holds for r in UNIVERSAL])}
    for kind, rules in BY_TYPE.items():
        for name in facts_of([r.holds for r in rules]):
            if out.get(name, ()) is not None:
                out.setdefault(name, set()).add(kind)
    return out


def cases(rules: list[Rule], group: str) -> str:
    """SQL: the name of the first rule that holds, as group/name."""
    return "CASE " + " ".join(f"WHEN {spelled(r.holds)} THEN '{group}/{r.name}'" for r in rules) + " END"


def fired() -> str:
    """SQL over facts and the current type: the rule that decides, or null."""
    return f"coalesce({cases(UNIVERSAL, 'universal')}, CASE type " + " ".join(f"WHEN '{k}' THEN {cases(rules, k)}" for k, rules in BY_TYPE.items()) + " END)"


def outcomes() -> dict[str, str]:
    """The type that each rule gives."""
    return {f"{g}/{r.name}": r.gives for g, rules in {"universal": UNIVERSAL, **BY_TYPE}.items() for r in rules}


@functools.cache
def needles(pattern: str) -> frozenset[str]:
    """Strings of which one at least is in every match of a pattern, in lower case; none if there are no such strings of three letters or more."""
    return frozenset(n.lower() for n in sought(_parser.parse(PATTERNS[pattern])))


def sought(items) -> set[str]:
    """The needles of a parsed sequence: those of its part whose shortest needle is longest."""
    best: list[set[str]] = [set()]
    run = ""
    for op, arg in [*items, (None, None)]:
        if op is _parser.LITERAL:
            run += chr(arg)
            continue
        if op is _parser.AT:  # takes no letters
            continue
        best.append({run})
        run = ""
        if op is _parser.SUBPATTERN:
            best.append(sought(arg[-1]))
        elif op is _parser.BRANCH:
            each = [sought(x) for x in arg[1]]
            best.append(set().union(*each) if all(each) else set())
        elif op is _parser.MAX_REPEAT and arg[0] > 0:
            best.append(sought(arg[2]))
    found = max(best, key=lambda x: (min(map(len, x), default=0), -len(x)))
    return found if min(map(len, found), default=0) >= 3 else set()


#: Patterns by number.
NUMBERS = {name: i for i, name in enumerate(PATTERNS)}


def longest_of(words: Iterable[str]) -> str:
    """A pattern that matches the longest of the words that begin at a place: alternatives part at single characters, so each is read once."""
    after: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        if w:
            after.setdefault(w[0], []).append(w[1:])
    branches = [re.escape(c) + longest_of(rest) for c, rest in after.items()]
    return f"(?:{'|'.join(branches)})" + ("?" if "" in words else "") if branches else ""


def worth_trying(field: Column, patterns: Iterable[str]) -> Column:
    """The numbers of those patterns of which a field holds a needle. All needles are looked for in one pass: at each place the longest is found, and
    it stands for those that it begins with."""
    of: dict[str, set[int]] = {}
    for p in dict.fromkeys(patterns):
        for n in needles(p):
            of.setdefault(n, set()).add(NUMBERS[p])
    if not of:
        return F.array().cast("array<int>")
    known = F.create_map(*(x for n in sorted(of) for x in (F.lit(n), F.array(*map(F.lit, sorted(set().union(*(of[n[:k]] for k in range(1, len(n) + 1) if n[:k] in of))))))))
    found = F.array_distinct(F.regexp_extract_all(field, F.lit(f"(?s)(?=({longest_of(of)}))"), 1))
    return F.array_distinct(F.flatten(F.transform(found, lambda n: known[n])))


def fact(pattern: str, field: Column, tried: Column) -> Column:
    """Whether a lower-case field holds a pattern, if it is worth trying: any case, letters of any script, lines ended by a line feed alone."""
    text = F.regexp_replace(field, MASK, " ") if pattern in MASKED else field
    holds = F.rlike(text, F.lit("(?iUd)" + PATTERNS[pattern]))
    return F.array_contains(tried, NUMBERS[pattern]) & holds if needles(pattern) else holds


def corrected(signals: DataFrame) -> DataFrame:
    """Adds ``corrected`` and ``rule`` to ``signals(type, title, text, page, changes, ...)``; null fields are empty, unknown types have universal rules alone.

    ``text`` is what the rules read; it should begin with the title.
    """
    fields = {f: F.lower(F.trim(F.coalesce(f, F.lit("")))) for f in FIELDS.values()}
    kinds, wanted = asked_by(), facts_of([r.holds for rules in (UNIVERSAL, *BY_TYPE.values()) for r in rules])
    own = signals.withColumns({f"_{f}": c for f, c in fields.items()})
    own = own.withColumns({f"_try_{f}": worth_trying(F.col(f"_{f}"), [p for p, of in wanted.values() if of == f]) for f in fields})
    found = {}
    for name, (pattern, field) in wanted.items():
        holds = fact(pattern, F.col(f"_{field}"), F.col(f"_try_{field}"))
        found[name] = holds if kinds[name] is None else F.when(F.col("type").isin(sorted(kinds[name])), holds)
    gives = F.create_map(*(F.lit(x) for kv in outcomes().items() for x in kv))
    rows = own.select(*signals.columns, *(c.alias(n) for n, c in found.items())).withColumn("page", F.coalesce("page", F.lit(""))).withColumn("rule", F.expr(fired()))
    return rows.select(*signals.columns, "rule", F.coalesce(gives[F.col("rule")], F.col("type")).alias("corrected"))


def all_types(signals: DataFrame) -> DataFrame:
    """Adds ``types`` to ``signals(type, text, ...)``: its own type, then every other one that its text speaks of."""
    wanted = facts_of([r.holds for r in SPOKEN_OF])
    own = signals.withColumn("_text", F.lower(F.trim(F.coalesce("text", F.lit(""))))).withColumn("_try_text", worth_trying(F.col("_text"), [p for p, _ in wanted.values()]))
    rows = own.select(*signals.columns, *(fact(p, F.col("_text"), F.col("_try_text")).alias(n) for n, (p, _) in wanted.items()))
    spoken = F.array(*(F.when(F.expr(spelled(r.holds)), r.gives) for r in SPOKEN_OF))
    types = F.array_distinct(F.concat(F.array(F.coalesce("type", F.lit("other"))), F.array_compact(spoken)))
    return rows.select(*signals.columns, types.alias("types"))


def held_news(signals: DataFrame) -> DataFrame:
    """Adds ``held`` to ``signals(type, text, ...)``: ``portfolio_update`` where the text is of a company already held and the type may be changed for it, else null."""
    wanted = facts_of([HELD.holds])
    own = signals.withColumn("_text", F.lower(F.trim(F.coalesce("text", F.lit(""))))).withColumn("_try_text", worth_trying(F.col("_text"), [p for p, _ in wanted.values()]))
    rows = own.select(*signals.columns, *(fact(p, F.col("_text"), F.col("_try_text")).alias(n) for n, (p, _) in wanted.items()))
    return rows.select(*signals.columns, F.when(F.col("type").isin(*HELD_TYPES) & F.expr(spelled(HELD.holds)), HELD.gives).alias("held"))
