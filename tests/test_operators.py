"""Greedy passes, folds, sources, sinks, streams and functions against plain Python and small fixtures."""

from __future__ import annotations

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from tessera.functions import dates, money, sentences, text, urls
from tessera.operators import dedup, relational, sequences, sinks
from tessera.plans import QUERIES
from tessera.sources import files, html
from tessera.streaming import folds, streams


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_greedy_keys_follow_order(spark):
    r = random.Random(1)
    rows = [(i, r.randrange(3), r.choice([None, "", "a", "b", "c", "d"]), r.choice([None, "x", "y", "z"])) for i in range(200)]
    kept, seen = [], {}
    for i, s, a, b in rows:
        ka, kb = seen.setdefault(s, (set(), set()))
        if not (a and a in ka or b and b in kb):
            kept.append(i)
            ka.add(a)
            kb.add(b)
    df = spark.createDataFrame(rows, "id long, s int, a string, b string").repartition(3)
    assert sorted(x.id for x in dedup.greedy_keys(df, ["s"], "id", ["a", "b"], [F.col("id")]).collect()) == kept
    assert dedup.greedy_keys(df.limit(0), ["s"], "id", ["a", "b"], [F.col("id")]).count() == 0


def test_greedy_merge_over_global_keys(spark):
    rows = [(1, "s1", "a", None), (2, "s2", "b", "x"), (3, "s3", "a", "x"), (4, "s4", "c", "x"), (5, "s5", None, None), (6, None, "c", "q"), (7, "s7", "d", "q")]
    df = spark.createDataFrame(rows, "id long, src string, k1 string, k2 string").withColumn("extra", F.lit(1))
    got = {r.id: r.srcs for r in dedup.greedy_merge(df, "id", ["k1", "k2"], [F.col("id")], "src").collect()}
    assert got == {1: ["s1", "s3"], 2: ["s2", "s4"], 5: ["s5"], 6: ["s7"]}


def test_greedy_similar(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [
        (1, "f", ["alpha", "beta", "gamma", "delta"], 9, day), (2, "f", ["alpha", "beta", "x", "y"], 8, day + dt.timedelta(days=2)), (3, "f", ["alpha", "beta", "x", "z"], 7, day + dt.timedelta(days=30)),
        (4, "f", ["alpha"], 6, day), (5, "f", ["alpha", "beta", "gamma", "q"], 5, None), (6, "g", ["alpha", "beta", "gamma", "delta"], 4, day), (7, None, None, 3, None),
    ]
    df = spark.createDataFrame(rows, "id long, fund string, words array<string>, q int, at timestamp")
    got = sorted(r.id for r in dedup.greedy_similar(df.withColumn("every", F.col("words")), ["fund"], "id", "words", "every", "at", [F.desc("q")]).where("fund is not null").collect())
    assert got == [1, 3, 4, 6]


def test_greedy_similar_native_and_whole_days(spark):
    """Two languages: the larger of both overlaps over the smaller native set; days rounded down before the sign is dropped."""
    day = dt.datetime(2024, 1, 1)
    rows = [
        (1, "f", ["acquires", "gamma", "delta"], ["acquires", "gamma", "delta"], 9, day), (2, "f", ["acquires", "omega", "gamma"], ["rileva", "omega", "gamma"], 8, day + dt.timedelta(days=3, hours=12)),
        (3, "g", ["a", "b", "c", "d"], ["a", "b", "c", "d"], 9, day + dt.timedelta(days=3, hours=12)), (4, "g", ["a", "b", "x", "y", "z"], ["a", "b", "x", "y", "z"], 8, day), (5, "h", ["a", "b"], ["a", "b"], 1, day), (6, "h", ["a", "b"], ["a", "b"], 1, day),
    ]
    df = spark.createDataFrame(rows, "id long, fund string, mapped array<string>, native array<string>, q int, at timestamp").withColumn("every", F.array_append("native", F.lit("w")))
    run = lambda **k: sorted(r.id for r in dedup.greedy_similar(df, ["fund"], "id", "mapped", "every", "at", [F.desc("q"), F.col("id")], **k).collect())
    assert run(native="native", whole_days=True) == [1, 3, 5]  # 3.5 days later are 3 whole ones; 3.5 days earlier are 4, and half the words suffice
    assert run() == [1, 3, 5]


def plain_survivors(rows):
    """(id, scope, native, mapped, n_words, quality, at): the pass over all kept rows, as the rule says."""
    out = []
    for scope in {r[1] for r in rows}:
        kept = []
        for i, _, own, mapped, n, _, at in sorted((r for r in rows if r[1] == scope), key=lambda r: (-r[5], r[0])):
            gone = False
            if n >= 3:
                for o, m, t in kept:
                    if o and own:
                        ratio = max(len(own & o), len(mapped & m)) / min(len(own), len(o))
                        days = abs((at - t).days) if at and t else None
                        if (days is not None and (days <= 3 and ratio >= 0.4 or days <= 7 and ratio >= 0.5)) or (days is None and ratio >= 0.6):
                            gone = True
                            break
            if not gone:
                kept.append((own, mapped, at) if n >= 3 else (set(), set(), None))
                out.append(i)
    return sorted(out)


def test_semantic_survivors_against_plain_python(spark, data):
    from tessera.functions import text as T
    from tessera.plans import QUERIES
    from tessera.plans.entities import Entities
    from tessera.plans.queries_c import dated

    x = dated(Entities(spark, data).docs).select("doc_id", "source", F.array_except(T.content_words(F.col("title"), T.TITLE_WORDS), T.words(F.col("source"))).alias("own"), F.size(T.words(F.col("title"))).alias("n"), "n_chars", "at")
    rows = [(r.doc_id, r.source, set(r.own), {T.CROSS_LANGUAGE.get(w, w) for w in r.own}, r.n, r.n_chars, r.at) for r in x.collect()]
    assert sorted(r.doc_id for r in QUERIES["d6_semantic_survivors"](spark, data).collect()) == plain_survivors(rows)


def test_mentions_of_long_phrases(spark):
    docs = spark.createDataFrame([(1, "One two, three four five six seven!"), (2, "two three four five sex seven"), (3, "three"), (4, None)], "doc_id long, text string")
    phrases = spark.createDataFrame([(1, "two three four five six"), (2, "Three"), (3, "four five six seven eight"), (4, "two three four"), (5, "")], "p long, phrase string")
    from tessera.operators.matching import mentions

    got = sorted(map(tuple, mentions(docs, phrases, "doc_id", "text", "p", "phrase").collect()))
    assert got == [(1, 1), (1, 2), (1, 4), (2, 2), (2, 4), (3, 2)]


def test_contexts_overlap(spark):
    from tessera.functions import text as T

    got = spark.createDataFrame([("the a the b the",), (None,)], "t string").select(T.contexts(F.col("t"), "the", 4).alias("c")).collect()
    assert got[0].c == ["the a t", " a the b t", " b the"][:0] + ["the a t", "e a the b t", "e b the"] and got[1].c == []


def test_garbage_reasons(spark):
    from tessera.functions import noise

    cases = {
        "Skip to the main content of this page": "furniture", "Too short": "short", None: "short", "Chi siamo, la nostra storia e i valori": "scaffold", "About us: the firm invests in companies": None, "Our portfolio | Alfa | Beta | Gamma": "scaffold", "Portafoglio | Alfa | Beta | Gamma": "list",
        "Portafoglio | Alfa per 30 milioni": None, "An interview with the founder of the firm": "low_value", "An interview with the new CEO of the firm": None, "Realizzate fondo q2 Fine Sounds S.p.A.": "section", "Alfa acquires Beta for €30 million in cash": None,
        "New investment: our portfolio of the year": "placeholder", "A new portfolio exit:  Current Portfolio": "placeholder", "New investment: Alfa of our portfolio": None, "New investment portfolios of the firm": None,
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string").select("want", noise.garbage_reason(F.col("t")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_portfolio_entries(spark):
    from tessera.functions import names

    cases = {
        "Acme S.p.A.": None, "Logo Acme": "logo", "Acme: the story of a family firm": "subtitle", "Investing in the future of health": "article", "A leading maker of pumps": "description", "Acme is one of the best": "description", "INDUSTRY:": "label",
        "Newsroom": "editorial", "healthcare": "sector", "OurPortfolioCompanies": "glued", "Read more": "navigation", "photo.jpg": "navigation", "Alfa Capital": "fund", "AlfaCapital": "fund", "Alfa Fund 3": "fund", "Gruppo Alfa": "fund", "ab": "empty", "x" * 61: "long", None: "empty",
    }
    df = spark.createDataFrame(list(cases.items()), "n string, want string").select("n", "want", names.entry_reason(F.col("n"), F.lit("alfa-capital")).alias("got"))
    assert [(r.n, r.got) for r in df.collect() if r.want != r.got] == []
    raw = {"Acme logo": "Acme", "Acme | Invested by Alfa": "Acme", "Acme | Beta SGR S.p.A.": "Acme", "| Acme |": "Acme", "Acme | more": "Acme", "Acme.": "Acme", "Acme__": "Acme"}
    df = spark.createDataFrame(list(raw.items()), "n string, want string").select("want", names.clean_portfolio_name(F.col("n")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_fuzzy_matching_against_all_pairs(spark, data):
    from tessera.functions import text as T
    from tessera.operators import matching

    rnd = __import__("random").Random(3)
    words = ["acme", "beta", "gamma", "delta", "omega", "alfa", "zeta", "eta"]
    name = lambda: " ".join(rnd.choice(words) + rnd.choice(["", "", "s"]) for _ in range(rnd.randint(1, 5)))
    left = spark.createDataFrame([(i, name()) for i in range(120)] + [(900, None), (901, "")], "l long, n string")
    right = spark.createDataFrame([(i, name()) for i in range(120)] + [(900, None), (901, "")], "r long, n string")
    for least in (0.85, 0.9):
        score = T.similarity(F.col("a.n"), F.col("b.n"))
        every = left.alias("a").join(right.alias("b"), F.lit(True)).select("l", "r", score.alias("s")).where(F.col("s") >= least - 1e-9).groupBy("l").agg(F.min(F.struct((-F.round("s", 12)).alias("k"), "r"))["r"].alias("r"))
        got = matching.best_similar(left, right, "l", "r", "n", least).select("l", "r")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.collect())) and got.count() > 20


def test_names_in_text():
    from tessera.functions.names import recapitalised

    assert recapitalised("alfa capital partners and alfa capital of BURGER KING, kkr", ["Alfa Capital", "Alfa Capital Partners", "Burger King", "KKR"]) == "Alfa Capital Partners and Alfa Capital of BURGER KING, KKR"
    assert recapitalised("Beta and alfaX", ["beta", "Alfa"]) == "Beta and alfaX" and recapitalised(None, ["x"]) is None and recapitalised("x", None) == "x"


def test_signal_vectors(spark):
    from tessera import ml

    texts = ["alpha beta gamma", "alpha beta delta", "alpha omega", "alpha beta", "", None]
    rows = spark.createDataFrame([(i, t, "NEWS") for i, t in enumerate(texts)], "id long, text string, page string")
    rows = rows.withColumn("text", ml.one_line(F.col("text")))
    cols = ml.extra_features(F.col("text"), F.col("page"), F.lit(None).cast("boolean"), F.lit(None).cast("double"))
    rows = rows.select("id", "text", *(c.alias(k) for k, c in cols.items()))
    assert len(cols) == 18
    model = ml.signal_vectors(rows, list(cols), most=100, least=2.0, share=0.6)
    words = model.stages[3].vocabulary
    assert sorted(words) == ["alpha beta", "beta"]  # alpha is in two thirds of the texts, the others in one
    got = {r.id: r.vector for r in model.transform(rows).select("id", "vector").collect()}
    assert got[0].size == 20 and got[0].toArray()[2:5].tolist() == [16.0, 3.0, 16 / 3] and got[4].toArray()[:5].tolist() == [0] * 5


def test_alert_levels():
    assert folds.alert_level((10, 0.9), 0, 0.9) == ["critical"] and folds.alert_level((10, 0.9), 4, 0.9) == ["error"] and folds.alert_level((10, 0.9), 6, 0.5) == ["warning", "less_sure"] and folds.alert_level((10, 0.9), 7, 0.8) == []


def test_stratified_parts_and_report(spark):
    from tessera import ml

    rows = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(3000)], "id long, label int")
    parts = ml.stratified(rows, "id", "label")
    n = {(r.label, r.part): r["count"] for r in parts.groupBy("label", "part").count().collect()}
    assert abs(n[1, "train"] - 240) < 3 and abs(n[1, "test"] - 30) < 3 and abs(n[0, "validation"] - 270) < 10
    guess = spark.createDataFrame([("a", 1, 1)] * 3 + [("a", 1, 0)] + [("a", 0, 1)] * 2 + [("a", 0, 0)] * 4 + [("b", 2, 1)], "part string, label int, prediction int")
    got = {(r.part, r.label): (r.n, r.precision, r.recall, r.f1) for r in ml.class_report(guess, ["part"]).collect()}
    assert got == {("a", 1): (4, 0.6, 0.75, 0.6667), ("a", 0): (6, 0.8, 0.6667, 0.7273), ("b", 2): (1, None, 0.0, 0.0)}


def test_folds():
    state, seen = ("closed", 0, 0.0), []
    for failed, at in [(True, i) for i in range(5)] + [(True, 10), (True, 400), (False, 800), (True, 801), (False, 1200), (False, 1201), (True, 1202)]:
        state = folds.breaker_step(state, failed, at)
        seen.append(state[0])
    assert seen == ["closed"] * 4 + ["open", "open", "open", "half_open", "open", "half_open", "closed", "closed"]
    assert folds.next_baseline(None, 10) == (10, False) and folds.next_baseline(10, 9.5) == (9.5, False) and folds.next_baseline(10, 5) == (10, True)


def test_streams_match_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    source = streams.read(spark, f"{tmp_path}/in", events.schema, 1)
    q = streams.tumbling(source, "ts", "1 day", ["event_type"], "value", "40 days").writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = streams.tumbling(events, "ts", "1 day", ["event_type"], "value")
    key = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert key(spark.table("daily")) == key(want)
    q = streams.seen_once(source, "user_id", "ts", "60 days").writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == events.select("user_id").distinct().count()
    q = source.writeStream.foreachBatch(streams.upsert(spark, f"{tmp_path}/table", ["user_id"], ["ts", "event_id"])).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    newest = events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/table/v=2").collect()) == sorted(r.event_id for r in newest.collect())


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    write, path = streams.upsert_touched(f"{tmp_path}/t", ["k"], ["at"], buckets=8), f"{tmp_path}/t"
    rows = lambda x: spark.createDataFrame(x, "k long, at long, v string")
    write(rows([(i, 1, "a") for i in range(100)] + [(5, 0, "old")]), 0)
    before = {f: f for f in spark.read.parquet(path).inputFiles()}
    write(rows([(5, 2, "b"), (7, 0, "late")]), 1)
    write(rows([(5, 2, "b"), (7, 0, "late")]), 1)
    got = {r.k: (r["at"], r.v) for r in spark.read.parquet(path).collect()}
    assert len(got) == 100 and got[5] == (2, "b") and got[7] == (1, "a")
    assert sum(f in before for f in spark.read.parquet(path).inputFiles()) >= 6
    write(rows([]), 2)
    assert spark.read.parquet(path).count() == 100


def test_atom_and_found_arrays(spark, tmp_path):
    from tessera.sources import files, html

    (tmp_path / "a.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="text">One</title><link href="http://x/1" rel="alternate"/><updated>2024-01-02</updated><summary>s</summary></entry><entry><title>Two</title><published>2024-01-03</published></entry></feed>')
    got = sorted(map(tuple, files.atom_entries(spark, f"{tmp_path}/a.xml").collect()), key=str)
    assert got == [("One", "http://x/1", "2024-01-02", "s"), ("Two", None, "2024-01-03", None)]
    state = '{"props": {"empty": {"companies": []}, "page": {"teamMembers": [{"n": 1}], "x": {"companyList": [{"n": "è"}, 2]}}}}'
    df = spark.createDataFrame([(state,), ("{bad",), (None,), ("[1]",)], "s string").select(html.found_array(F.col("s"), ["compan"]).alias("a"))
    assert [r.a for r in df.collect()] == [['{"n":"è"}', "2"], None, None, None]


def test_change_stream(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").where("user_id < 20")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = streams.read(spark, f"{tmp_path}/in", events.schema)
    q = streams.changes(s, "user_id", "event_type", "event_id").writeStream.format("memory").queryName("changed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    last, want = {}, 0
    for r in sorted(events.collect(), key=lambda r: r.event_id):
        want += last.get(r.user_id) != r.event_type
        last[r.user_id] = r.event_type
    assert spark.table("changed").count() == want


def test_file_sources(spark, tmp_path):
    (tmp_path / "private-equity.csv").write_text("name,city\nAlfa,Milano\n")
    (tmp_path / "venture_capital.csv").write_text('name,city\nBeta,"Roma, RM"\n')
    assert sorted(map(tuple, files.csv_folder(spark, f"{tmp_path}/*.csv").collect())) == [("Alfa", "Milano", "Private Equity"), ("Beta", "Roma, RM", "Venture Capital")]
    (tmp_path / "db.json").write_text('{"funds": [{"slug": "a", "n": 1}, {"slug": "b", "n": null}], "by": {"a": [{"c": "x"}, {"c": "y"}], "b": []}}')
    assert [tuple(r) for r in files.json_documents(spark, f"{tmp_path}/db.json", "funds array<struct<slug: string, n: int>>", "funds").collect()] == [("a", 1), ("b", None)]
    by = files.json_documents(spark, f"{tmp_path}/db.json", "by map<string, array<struct<c: string>>>")
    assert [tuple(r) for r in files.map_of_arrays(by, "by", "fund").collect()] == [("a", "x"), ("a", "y")]
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>T</title><link>http://x/</link><pubDate>2024-01-02</pubDate></item><item><title>U</title></item></channel></rss>")
    assert sorted(r.title for r in files.feed_items(spark, f"{tmp_path}/feed.xml").collect()) == ["T", "U"]
    (tmp_path / "doc.md").write_text("| a | b |\n|---|---|\n| 1 | [x](https://x.it/a) |\n")
    rows = files.markdown_tables(spark, f"{tmp_path}/doc.md")
    assert [r.cells for r in rows.collect()] == [["a", "b"], ["1", "[x](https://x.it/a)"]]
    assert [tuple(r) for r in files.markdown_links(spark, f"{tmp_path}/doc.md").collect()] == [("x", "https://x.it/a")]
    assert [tuple(r) for r in files.table_rows(rows, "cells", ["Nome", "Importo"], {"name": ["name", "nome"], "amount": ["importo"], "year": ["anno"]}).collect()][1] == ("1", "[x](https://x.it/a)", None)
    assert files.first_existing(spark, [f"{tmp_path}/none", f"{tmp_path}/doc.md"], spark.read.text).count() == 3
    df = spark.createDataFrame([(None, "b"), ("a", "c")], "fullName string, name string")
    assert [tuple(r) for r in files.renamed(df, {"name": ["fullName", "name"], "url": ["url"]}).collect()] == [("b", None), ("a", None)]


def test_html_sources(spark):
    page = '<html><head><script type="application/ld+json">{"name": "Acme", "url": "https://a.it"}</script><script id="__NEXT_DATA__">{"props": {"items": [1, 2]}}</script></head><body><!-- x --><nav>menu</nav><h1>Hi  <b>you</b></h1><img alt="Logo Co"><ul><li>One</li><li><a href="/t">Two</a></li></ul></body></html>'
    c = F.lit(page)
    assert one(spark, html.page_text(c)) == "Hi you One Two"
    assert one(spark, html.json_ld(c, "name string, url string"))[0].name == "Acme"
    assert one(spark, html.at_path(html.app_state(c), "props.items[1]", "int")) == 2
    assert one(spark, html.items(c)) == ["Logo Co", "One", "Two"] and one(spark, html.links(c)) == ["/t"]
    assert one(spark, html.app_state(F.lit("nothing"))) is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, text string")
    assert sinks.append_new(df, f"{tmp_path}/t", ["id"]) == 2 and sinks.append_new(df, f"{tmp_path}/t", ["id"]) == 0
    b = sinks.blobs(df.withColumn("text", F.lit("same")), "text")
    assert b.count() == 1 and sinks.orphans(b, b.limit(0)).count() == 1
    sinks.replace(df, f"{tmp_path}/j", "json")
    assert spark.read.json(f"{tmp_path}/j").count() == 3 and sinks.summary(df).first()["text_filled"] == 1.0


def test_sequences_and_merge(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc"), (2, None, ""), (3, "s", "s")], "id long, o string, n string")
    got = {r.id: r for r in sequences.compared(df, "id", "o", "n").collect()}
    assert got[1].sentence == "1 lines added, 1 removed" and got[2].sentence == got[3].sentence == "no change" and round(got[1].ratio, 3) == 0.667
    old = spark.createDataFrame([("f", i, "o") for i in range(6)] + [("g", 1, "o")], "fund string, c int, v string")
    new = spark.createDataFrame([("f", 1, "n"), ("g", 2, "n")], "fund string, c int, v string")
    rows = {(r.fund, r.c): (r.v, r.state) for r in relational.merge_keep(old, new, ["fund", "c"], ["v"]).collect()}
    assert rows == {**{("f", i): ("o", "guarded") for i in range(6)}, ("g", 1): ("o", "exited"), ("g", 2): ("n", "added")}


def test_functions(spark):
    s = lambda x: F.lit(x)
    assert one(spark, urls.canonical(s("HTTPS://WWW.Ex.it:443//a//b/?utm_source=x&b=2&a=1#f"))) == "https://www.ex.it/a/b?a=1&b=2"
    assert one(spark, urls.canonical(s("http://ex.it:8080"))) == "http://ex.it:8080/" and one(spark, urls.canonical(F.lit(None).cast("string"))) == ""
    assert len(one(spark, urls.variants(s("http://ex.it/a")))) == 4 and one(spark, urls.is_listing(s("https://e.it/news/")))
    as_of = F.lit("2024-05-10").cast("date")
    for t, want in [("3 gennaio 2024", "2024-01-03"), ("Jan 3, 2024", "2024-01-03"), ("03.01.2024", "2024-01-03"), ("2 days ago", "2024-05-08"), ("oggi", "2024-05-10"), ("1999-01-01", None), ("2024-06-01", None), ("June 2024", None), (None, None)]:
        got = one(spark, dates.parse(F.lit(t).cast("string"), as_of))
        assert (str(got) if got else None) == want, t
    assert one(spark, money.label(s(1.5e9))) == "€1.5B" and one(spark, money.label(s(10.5e6))) == "€10M" and one(spark, money.label(s(5000.0))) == "€5K"
    assert one(spark, money.stops(s(6e7))) == [0.0, 1e7, 2.5e7, 5e7, 6e7] and one(spark, money.parse_amount(s("EUR 1.234,5"))) == 1234.5
    assert one(spark, text.norm_company(s("  ACME Holding S.r.l. "))) == "acme" and one(spark, text.slugify(s("Società Èlite & Co."))) == "societa-elite-co"
    assert one(spark, text.once_per_sentence(s("The big cat sat. The big cat sat! Other things happen."))) == "The big cat sat. Other things happen"
    assert one(spark, text.to_english(F.array(s("cede"), s("fondo")))) == ["fund", "sells"] and round(one(spark, text.similarity(s("acme"), s("acme italia"))), 3) == 0.345
    assert one(spark, text.sentence_cut(s("One two. Three four five"), 12)) == "One two."


def test_sentence_dedup_is_whole(spark, data):
    it = "The fund Azimut acquired the company Rossi for growth. Azimut acquisisce la Rossi con un accordo"
    x = [
        (it, "The fund Azimut acquired the company Rossi for growth"),
        ("The fund Azimut acquired the company Rossi. Azimut Rossi delivers steady yearly growth", "The fund Azimut acquired the company Rossi. Azimut Rossi delivers steady yearly growth"),
        ("The big cat sat there. Big cat. Cat sat big there", "The big cat sat there. Big cat"),
        ("Una società è. Nata perciò già città. Perciò già città", "Una società è. Nata perciò già città"),
        (None, ""),
    ]
    df = spark.createDataFrame([(t,) for t, _ in x], "t string")
    assert [r.x for r in df.coalesce(1).select(text.once_per_sentence(F.col("t")).alias("x")).collect()] == [want for _, want in x]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r.text for r in QUERIES["d13_sentence_dedup"](spark, data).collect()}
    assert len(got) == docs.count() and docs.where("n_chars >= 2000").count() > 0
    long = docs.orderBy(F.desc("n_chars")).first()
    kept, seen = [], set()
    for s in (s.strip(" ") for s in re.split(r"[.!?\n]+", long.text)):
        ws = set(re.findall(r"\w{3,}", s.lower()))
        old = len(ws & seen) / len(ws) if len(ws) > 2 else 0
        if s and old < 0.3 or s and old < 0.6 and not sentences.is_italian(s):
            kept.append(s)
            seen |= ws
    assert got[long.doc_id] == ". ".join(kept)


def test_line_diff_is_whole(spark, data):
    df = spark.createDataFrame([(1, "a\nb\nb", "b\nc\nc\nd"), (2, "", ""), (3, None, "x"), (4, "x\n", "x")], "id long, o string, n string")
    got = {r.id: (r.d.added, r.d.removed) for r in df.select("id", sequences.line_diff(F.col("o"), F.col("n")).alias("d")).collect()}
    assert got == {1: (3, 1), 2: (0, 0), 3: (None, None), 4: (0, 1)}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    want = {}
    for i in texts:
        if i + 1 in texts:
            a, b = texts[i].split("\n"), texts[i + 1].split("\n")
            want[i] = (len([x for x in b if x not in a]), len([x for x in a if x not in b]))
    rows = {r.doc_id: (r.added, r.removed) for r in QUERIES["f24_line_diff_whole"](spark, data).collect()}
    assert rows == want and rows == {r.doc_id: (r.added, r.removed) for r in QUERIES["f24_line_diff"](spark, data).collect()}


def test_distinct_names_are_whole(spark, data):
    want = {}
    for r in spark.read.parquet(f"{data}/lineitem.parquet").select("l_suppkey", "l_partkey").collect():
        want.setdefault(r.l_suppkey, set()).add(r.l_partkey)
    for r in spark.read.parquet(f"{data}/events.parquet").select("user_id", "event_id").collect():
        want.setdefault(r.user_id % 10, set()).add(r.event_id % 200)
    rows = {r.fund_id: r.names for r in QUERIES["u2_distinct_names_whole"](spark, data).collect()}
    assert rows == {f: sorted(ids) for f, ids in want.items()} and max(max(x) for x in rows.values()) >= 50


def test_greedy_similar_against_plain_python(spark, monkeypatch):
    """Words of very different frequency, sets of 1 to 30, and few first rows that tell which words are rare."""
    monkeypatch.setattr(dedup, "LOOKED_AT", 5)
    r = random.Random(3)
    word = lambda: f"w{int(400 * r.random() ** 3)}"
    day = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(700):
        own = {word() for _ in range(r.randint(0, r.choice([3, 30])))}
        if i % 3 == 0 and rows:
            own = {w for w in r.choice(rows)[2] if r.random() < 0.8} | {word()}
        mapped = {w if len(w) > 3 else "w" + w[1] for w in own} if i % 2 else own
        rows.append((i, r.choice("fg"), own, mapped, len(own) + i % 2, r.randint(0, 5), None if i % 6 == 0 else day + dt.timedelta(hours=r.randint(0, 700))))
    df = spark.createDataFrame([(i, s, sorted(o), sorted(m), ["x"] * n, q, t) for i, s, o, m, n, q, t in rows], "id long, s string, native array<string>, mapped array<string>, every array<string>, q int, at timestamp")
    got = dedup.greedy_similar(df, ["s"], "id", "mapped", "every", "at", [F.desc("q"), F.col("id")], native="native", whole_days=True)
    wanted = plain_survivors(rows)
    assert sorted(x.id for x in got.collect()) == wanted and 50 < len(wanted) < 650
