"""Display text: single cases of each stage, and stages that change nothing when they run again."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import display as D

AMOUNTS = [
    ("NANDO raccoglie €3.3Mper rivoluzionare la gestione", "NANDO raccoglie €3.3M per rivoluzionare la gestione"), ("Aumento di capitale da €120 milioni per Yarpa", "Aumento di capitale da €120M per Yarpa"), ("€62 million of capital increase", "€62M of capital increase"),
    ("€200Magreementfor startup", "€200M agreementfor startup"), ("120 milioni di euro", "€120M"), ("2 miliardi di euro", "€2B"), ("un fondo da 500 mln", "un fondo da €500M"), ("3 mld", "€3B"), ("$200 million", "$200M"), ("£150 million", "£150M"), ("€500 million", "€500M"),
    ("€2 billion", "€2B"), ("three million euros", "€3M"), ("two miliardi di euro", "€2B"), ("USD 500 million", "$500M"), ("EUR 200 million", "€200M"), ("oltre 500 mln di euro", "over €500M"), ("circa 200 milioni di euro", "~ €200M"), ("€200Mfor the acquisition", "€200M for the acquisition"),
    ("€120 milioni di euro", "€120M"), ("1.350.000 euro", "€1.4M"), ("500 mila euro", "€0.5M"), ("50.500 euro", "€50.5K"), ("tens of mln", "tens of millions"), ("decine di milioni", "tens of millions"), ("centinaia di mln", "hundreds of millions"), ("€720,000", "€720K"), ("€1,200,000", "€1.2M"),
    ("€1,65 M", "€1.6M"), ("570 K EUR", "€570K"), ("12 M€", "€12M"), ("12M$ e 3 M €", "$12M e €3M"), ("5 milioni di dollari", "$5M"), ("€5M di dollari", "$5M"), ("100+ mln €", "€100M"), ("EUR 200M", "€200M"), ("200M EUR", "€200M"), ("€ 500M", "€500M"), ("€4985M", "€4.985M"), ("€5 Mn, €1 Bn", "€5M, €1B"),
    ("7 m Funding Round", "€7M Funding Round"), ("approximately of 7 millions euros", "approximately €7M"), ("euro 35 million", "€35M"), ("1.250 miliardi", "€1.2B"), ("1.500 milioni", "€1.500M"), ("E 30 mln", "€30M"),
    ("10 Members, 3 times, F2i, 2025Q1, 10 m, 5 million people", "10 Members, 3 times, F2i, 2025Q1, 10 m, 5 million people"), ("20 mln azioni", "20 mln azioni"), ("rose 7.2% in 2024.", "rose 7.2% in 2024."), ("a  b", "a b"), ("", ""), (None, None), ("€5 Milan", "€5 Milan"), ("1.2.3 mln 4", "€123M 4"),
]
SPACING = [
    ("F 2 i SGR investe", "F2i SGR investe"), ("B 4 i accelerator", "B4i accelerator"), ("CO 2 emissions", "CO2 emissions"), ("TGC om 24 reports", "TGCom24 reports"), ("Q 1 results, H 2 earnings", "Q1 results, H2 earnings"), ("14 th edition", "14th edition"), ("Sgr investe", "SGR investe"),
    ("â¬€500M deal", "€500M deal"), ("investimento diAlba", "investimento di Alba"), ("tedescaKBC Group", "tedesca KBC Group"), ("NTCsostenuta da", "NTC sostenuta da"), ("2025Comunicato", "2025 Comunicato"), ("uno,due;tre:quattro", "uno, due; tre: quattro"), ("1, 5", "1,5"),
    ("see https://a.it/b2cX?y=Z1 and a1B@c2d.it", "see https://a.it/b2cX?y=Z1 and a1B@c2d.it"), ("an agreementfor growth", "an agreement for growth"), ("de l fondo, del la casa", "del fondo, della casa"), ("Serie b round", "Series B round"), ("39 M W plant", "39MW plant"),
    ("Uni Credit e OpenAI", "UniCredit e OpenAI"), ("€3.3 M raised", "€3.3M raised"), ("Apollo3", "Apollo 3"), ("", ""), (None, None),
]
CASES = [
    ("Capza Invests In Travelsoft", "Capza invests in travelsoft"), ("The Fund Buys A Stake In McKinsey And KKR", "The fund buys a stake in McKinsey and KKR"), ("Alfa Sgr Appoints New Ceo: Mario Rossi", "Alfa SGR appoints new ceo: Mario rossi"), ("Deal Closed. Next Round Is Coming", "Deal closed. Next round is coming"),
    ("One two three four", "One two three four"), ("ALL CAPITALS ARE LEFT HERE", "ALL CAPITALS ARE LEFT HERE"), ("Too Few Words", "Too Few Words"), ("(Alfa Buys \"Beta Gamma\" Today", "(Alfa buys \"beta gamma\" today"), ("", ""), (None, None),
]


def results(spark, change, cases):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i long, t string").repartition(2)
    return dict(map(tuple, df.select("i", change(F.col("t"))).collect()))


@pytest.mark.parametrize("change, cases", [(D.amounts, AMOUNTS), (D.spacing, SPACING), (D.sentence_case, CASES)], ids=["amounts", "spacing", "case"])
def test_single_cases(spark, change, cases):
    got = results(spark, change, cases)
    assert not [(t, got[i], wanted) for i, (t, wanted) in enumerate(cases) if got[i] != wanted]


@pytest.mark.parametrize("change, cases", [(D.amounts, AMOUNTS), (D.spacing, SPACING), (D.sentence_case, CASES)], ids=["amounts", "spacing", "case"])
def test_second_pass_changes_nothing(spark, change, cases):
    got = results(spark, change, cases)
    again = results(spark, change, [(got[i], None) for i in range(len(cases))])
    assert [got[i] for i in range(len(cases))] == [again[i] for i in range(len(cases))]


def test_long_texts(spark):
    text = "Alfa raccoglie 120 milioni di euro daBeta. " * 20_000
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(D.amounts("t").alias("a"), D.spacing("t").alias("s")).first()
    assert got.a == text.replace("120 milioni di euro", "€120M").strip() and got.s == text.replace("daBeta", "da Beta").strip()


HEADLINES = [
    ("Alfa buys Betamore details", "Alfa buys Beta"), ("LEGGI TUTTO Alfa compra Beta Approfondisci", "Alfa compra Beta"), ("16 January 2026F2i enters Beta", "F2i enters Beta"), ("MILAN – November 25, 2025 – Alfa buys Beta", "Alfa buys Beta"), ("Padova, 22 Dic. 2025 Alfa compra", "Alfa compra"),
    ("NPO Torino added to Alfa SGR portfolio (ICT)", "New portfolio addition: NPO Torino (ICT)"), ("NPO Torino added to Alfa SGR portfolio", "New portfolio addition: NPO Torino"), ("Beta aggiunta al portafoglio di Alfa", "New portfolio addition: Beta"), ("Alfa enters TinextaDecember 30, 2025", "Alfa enters Tinexta"),
    ("Alfa exits Beta Healthcare29 October 2025", "Alfa exits Beta"), ("Alfa compra Beta – IL SOLE 24 ORE", "Alfa compra Beta"), ("“Alfa buys aNEVERHACK”", "Alfa buys a NEVERHACK"), ("Alfa buys 100 shares", "Alfa buys 100 shares"), ("", ""), (None, None),
]
SUMMARIES = [
    ("[Rumor] Alfa buys Beta, announced on 2026-01-15.", "Alfa buys Beta"), ("Media: Milan, Alfa raccoglie 120 milioni di euro. 3 min read", "Alfa raccoglie €120M"), ("Alfa buys Beta. New investment involving Beta.", "Alfa buys Beta"), ("Alfa investe daBeta as of January 15, 2026.", "Alfa investe da Beta"), ("", ""), (None, None),
]


@pytest.mark.parametrize("change, cases", [(D.headline, HEADLINES), (D.summary, SUMMARIES)], ids=["headline", "summary"])
def test_headlines_and_summaries(spark, change, cases):
    got = results(spark, change, cases)
    assert not [(t, got[i], wanted) for i, (t, wanted) in enumerate(cases) if got[i] != wanted]


def test_broken_words(spark):
    from tessera.operators import repair as R

    whole = "Il finanziamento cresce, il finanziamento aiuta: to be, to go."
    texts = [whole, whole, whole, "Il finanziamen to cresce", "A Finanziamen to. Then", "finanziamen. to stays", "finanziamen  to stays", "", None, "to", " to ", "il cre sce to", whole + " un finanziamen to fin anziamento"]
    got = {r.i: (r.t, r.n_repaired) for r in R.repaired(spark.createDataFrame(list(enumerate(texts)), "i long, t string"), "i", "t").collect()}
    wanted = {3: ("Il finanziamento cresce", 1), 4: ("A Finanziamento. Then", 1), 11: ("il cresce to", 1), 12: (whole + " un finanziamento finanziamento", 2)}
    assert got == {i: wanted.get(i, (t, 0)) for i, t in enumerate(texts)}
    assert R.repaired(spark.createDataFrame([], "i long, t string"), "i", "t").count() == 0
