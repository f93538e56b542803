"""Operator 11 against a plain count of every text, and its verdicts on planted hosts."""

from __future__ import annotations

import re
from collections import Counter

from tessera.llm import quality_rules

AWKWARD = [None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "x " * 40 + "\n\n", "one two three four\none two three four\n \none two three four", "naïve #tag $5 |a| <b> % & *", "a\x0bb\x0cc\rd\x85e f　g", "日本語 テスト 日本語 テスト 日本語", "ab c a bc ab c", "w " * 60_000, "퟿ 🎉 " * 30]
SCHEMA = "doc_id long, text string, source string, w string, verdict string, n_words string"


def plain(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    found = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if found[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_counts_of_awkward_texts_with_clashing_columns(spark):
    rows = [(i, t, None if i % 3 else "h", "clash", "clash", "clash") for i, t in enumerate(AWKWARD)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(AWKWARD)
    for i, t in enumerate(AWKWARD):
        r, e = got[i], plain(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == e, t
        assert r.base_failed == (e[0] < 50 or 100 * e[4] > 50 * e[0])


def test_counts_of_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_rules.quality_rules(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(texts[r.doc_id])


def test_windows_that_share_a_hash_stay_apart(spark):
    # The sort compares words after hashes: a constant hash must change nothing.
    from unittest import mock

    from pyspark.sql import functions as F

    texts = ["a b c d e f a b c", "q r s t u v", "k k k k"]
    with mock.patch.object(quality_rules.F, "xxhash64", lambda x: F.lit(1)):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, t string").withColumn("w", quality_rules.words(F.col("t")))
        got = {r.doc_id: r.n_repeat_words for r in quality_rules.repeated_windows(df).collect()}
    assert [got[i] for i in range(3)] == [plain(t)[4] for t in texts] == [6, 0, 4]


def good(i):
    return " ".join(f"word{(i * 61 + j * 7) % 997}" for j in range(80))


def test_verdicts_shrink_small_hosts_and_spare_good_ones(spark):
    rows, n = [], 0
    for host in range(30):
        for k in range(40):
            rows.append((n := n + 1, good(n) if k else "too short", f"good{host}"))
    for k in range(300):
        rows.append((n := n + 1, "too short" if k % 20 else good(n), "bad"))
    rows += [(n + 1, "too short", "tiny"), (n + 2, good(n), "tiny"), (n + 3, good(n + 3), None), (n + 4, "too short", None)]
    n += 4
    # Two thirds of this host's documents repeat their lines: its others must pass the soft rules too.
    for k in range(300):
        body = good(n + 1)
        rows.append((n := n + 1, "\n".join([body, *["the same line again"] * 3]) if k % 3 else body + (" #" * 40 if k % 2 else ""), "loose"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality_rules.quality_rules(docs).collect()
    by = {}
    for r, (_, text, host) in zip(sorted(got, key=lambda r: r.doc_id), rows):
        by.setdefault(host, []).append((r.verdict, r.base_failed, r.kept, text))
    assert {v for v, *_ in by["bad"]} == {"reject"} and not any(k for _, _, k, _ in by["bad"])
    assert {v for v, *_ in by["tiny"]} == {"keep"} and [k for _, _, k, _ in by["tiny"]] == [False, True]
    assert {v for v, *_ in by[None]} == {"keep"} and [k for _, _, k, _ in by[None]] == [True, False]
    assert all(v == "keep" and k != b for h, x in by.items() if h and h.startswith("good") for v, b, k, _ in x)
    assert {v for v, *_ in by["loose"]} == {"strict"}
    for _, base, kept, text in by["loose"]:
        _, _, symbols, dups, _ = plain(text)
        assert kept == (not base and not dups and 10 * symbols <= len(text.split()))


def test_shrinking_moves_small_hosts_most(spark):
    counts = quality_rules.counted(spark.createDataFrame([(i, good(i) if i % 2 else "short", f"h{i % 7}" if i < 700 else "one") for i in range(701)], "doc_id long, text string, source string"))
    rates = {(r.source, r.rule): r for r in quality_rules.host_rates(counts).collect()}
    small, large = rates["one", "short"], rates["h1", "short"]
    assert small.k == 1 and abs(small.rate - 0.5) < 0.2 and abs(large.rate - large.k / large.n) < 0.1 and small.low < small.rate


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert quality_rules.quality_rules(none).count() == 0
    twice = spark.createDataFrame([(1, good(1), "a", "", "", "")] * 2 + [(None, None, None, None, None, None)], SCHEMA)
    got = quality_rules.quality_rules(twice).collect()
    assert len(got) == 3 and sum(r.kept for r in got) == 2
