"""Operator 11: quality rules with verdicts on hosts, in DataFrame functions alone.

Each whole text is counted (words, their characters, symbols, repeated lines, words in repeated three-word windows) and held against rules. Failures are
added up by host (``source``), one rate for each rule. A rate of few documents says little, so it is shrunk: all hosts together give a beta prior
for each rule by the method of moments, and a host's rate is the mean of its posterior. What the verdict uses is the lower end of that
posterior, ``SURE`` standard deviations under the mean, so a small host needs more failures than a large one:

- ``reject``: some rule surely fails on ``reject_over`` of the host's documents or more. All its documents go.
- ``strict``: some rule surely fails on ``strict_over`` or more. Its documents must pass the soft rules too.
- ``keep``: else; documents stand by their own base rules.

Null or empty texts have no words and fail the base rules. Rows without a host belong to none: they stand by their own rules and don't enter the prior.
Repeated rows count and return as often as they are there; ties can't arise, as verdicts are thresholds. Extra columns are ignored. An
empty table gives no rows. Where all hosts have the same rate the prior is as strong as ``STRONGEST`` documents.

Plan: counting is one pass within the scan's own tasks, array functions over one text at a time; a text's windows are sorted, so its
cost is that of a sort of its words. The counts are written once and read twice: for the failures by host, which combine before their shuffle, and
for the join with the hosts' verdicts. Hosts that keep everything aren't joined; the others are broadcast only when counted and few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, written

#: A word; what lies between words; runs of anything but the symbols that are counted.
WORD, SPACE, OTHER = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+", "[^#*$%&|<>]+"
#: Standard deviations of a host's posterior that a verdict stays below its mean; a prior's least and largest strength, in documents; hosts that may be broadcast.
SURE, WEAKEST, STRONGEST, FEW = 3.0, 2.0, 1_000_000.0, 100_000
#: Least words of a text; largest share of words in repeated windows, in percent.
LEAST_WORDS, REPEATED = 50, 50


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_windows(found: DataFrame, w: str = "w") -> DataFrame:
    """Adds ``n_repeat_words`` to rows with an array of words: how many lie in a window of three that is found twice or more in the row.

    Windows are sorted by (hash, words, position), so equal ones are neighbours and a hash shared by different words does no harm.
    """
    most = F.greatest(F.size(w) - 2, F.lit(0))
    window = F.arrays_zip(F.slice(w, 1, most).alias("a"), F.slice(w, 2, most).alias("b"), F.slice(w, 3, most).alias("c"))
    df = found.withColumn("_s", F.sort_array(F.transform(window, lambda x, i: F.struct(F.xxhash64(x).alias("h"), x.alias("x"), i.alias("i")))))

    def same(x: Column, at: Column) -> Column:
        other = F.get("_s", at)
        return F.coalesce((x.h == other.h) & (x.x == other.x), F.lit(False))

    starts = F.sort_array(F.transform(F.filter("_s", lambda x, j: same(x, j + 1) | same(x, j - 1)), lambda x: x.i))
    # A window brings the words that the one before it didn't hold.
    covered = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda acc, i: F.struct((acc.n + F.least(F.lit(3), i - acc.last)).alias("n"), i.alias("last")), lambda acc: acc.n)
    return df.withColumn("n_repeat_words", covered.cast("long")).drop("_s")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, source and the counts of every whole text."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", "source", text.alias("t")).withColumn("w", words(F.col("t")))
    df = df.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)))
    df = df.select(
        "doc_id", "source", "w", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", OTHER, "")).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    return repeated_windows(df).drop("w")


def rules() -> dict[str, Column]:
    """The rules by name: whether a counted text fails. The first two are the base."""
    n = F.col("n_words")
    return {
        "short": n < LEAST_WORDS,
        "repeated": 100 * F.col("n_repeat_words") > REPEATED * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "lengths": (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 10 * n),
    }


def base_failed() -> Column:
    return rules()["short"] | rules()["repeated"]


def soft_failed() -> Column:
    found = rules()
    return found["symbols"] | found["lines"] | found["lengths"]


def host_rates(counts: DataFrame) -> DataFrame:
    """A row for each host and rule: source, rule, n (documents), k (failures), rate (shrunk), low (the lower end of it)."""
    names = list(rules())
    hosts = counts.where("source is not null").groupBy("source").agg(F.count("*").alias("n"), *(F.count_if(bad).alias(name) for name, bad in rules().items()))
    each = cut(hosts.unpivot(["source", "n"], names, "rule", "k"))
    of_rule = each.groupBy("rule").agg(F.count("*").alias("hosts"), F.sum("n").alias("all_n"), F.sum("k").alias("all_k"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("squares"))
    mean, n, k = F.col("all_k") / F.col("all_n"), F.col("n"), F.col("k")
    own = mean * (1 - mean)
    # What the hosts' rates differ by beyond the chance of their samples, and the documents that the prior counts as.
    between = F.col("squares") / F.col("all_n") - mean * mean - own * F.col("hosts") / F.col("all_n")
    strength = F.when(between * STRONGEST > own, F.greatest(own / between - 1, F.lit(WEAKEST))).otherwise(STRONGEST)
    priors = cut(of_rule.select("rule", mean.alias("mean"), strength.alias("strength")))  # a row for each rule
    joined = each.join(F.broadcast(priors), "rule").withColumn("rate", (k + F.col("mean") * F.col("strength")) / (n + F.col("strength")))
    low = F.col("rate") - SURE * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (n + F.col("strength") + 1))
    return joined.select("source", "rule", "n", "k", "rate", low.alias("low"))


def host_verdicts(counts: DataFrame, reject_over: float = 0.8, strict_over: float = 0.5) -> DataFrame:
    """source, verdict of every host."""
    worst = F.max("low")
    return host_rates(counts).groupBy("source").agg(F.when(worst >= reject_over, "reject").when(worst >= strict_over, "strict").otherwise("keep").alias("verdict"))


def quality_rules(docs: DataFrame, reject_over: float = 0.8, strict_over: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, verdict of every row of ``docs(doc_id, text, source)``."""
    counts = written(counted(docs), "quality-rules")
    marked = cut(host_verdicts(counts, reject_over, strict_over).where("verdict <> 'keep'"))
    few = marked.count() <= FEW
    df = counts.join(F.broadcast(marked) if few else marked, "source", "left").withColumn("verdict", F.coalesce("verdict", F.lit("keep")))
    kept = ~base_failed() & F.when(F.col("verdict") == "reject", False).when(F.col("verdict") == "strict", ~soft_failed()).otherwise(True)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), kept.alias("kept"), "verdict")
