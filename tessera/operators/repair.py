"""Words broken in two, found by the corpus's own vocabulary and put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _words(text: Column) -> Column:
    return F.split(text, " ", -1)


def _bare(word: Column) -> Column:
    """A word's letters in lower case; null if it has anything else than letters and marks at its end."""
    return F.nullif(F.regexp_extract(F.lower(word), r"^(\p{L}+)[.,;:!?]*$", 1), F.lit(""))


def _adjacent(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, at, a, b: each word of letters alone and the one after it, across one space."""
    pairs = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.posexplode(F.arrays_zip(_words(F.col(text)).alias("w"), F.slice(_words(F.col(text)), 2, 1 << 30).alias("n"))).alias("at", "x"))
    # A mark at the end of the first word parts the two.
    return pairs.select("doc", "at", F.when(F.rlike("x.w", F.lit(r"^\p{L}+$")), _bare(F.col("x.w"))).alias("a"), _bare(F.col("x.n")).alias("b"))


def broken_words(docs: DataFrame, doc_id: str, text: str, least: int = 3, times: int = 2) -> DataFrame:
    """a, b: neighbours that are one word broken in two.

    Their letters together are a word that is counted at least ``least`` times and at least ``times`` as often as the pair, and one part of them is no word: half or more of its
    occurrences are in this pair. All texts are counted; counts combine before the shuffle, and the pairs meet the vocabulary by equi-joins on words.
    """
    words = docs.where(F.col(text).isNotNull()).select(F.explode(_words(F.col(text))).alias("w")).select(_bare(F.col("w")).alias("word")).where("word is not null").groupBy("word").agg(F.count("*").alias("n"))
    pairs = _adjacent(docs, doc_id, text).where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("n_pair"))
    whole = pairs.withColumn("word", F.concat("a", "b")).join(words.withColumnRenamed("n", "n_whole").where(F.col("n_whole") >= least), "word").where(F.col("n_whole") >= times * F.col("n_pair"))
    parts = whole.join(words.select(F.col("word").alias("a"), F.col("n").alias("n_a")), "a").join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b")
    return parts.where((F.col("n_a") <= 2 * F.col("n_pair")) | (F.col("n_b") <= 2 * F.col("n_pair"))).select("a", "b")


def repaired(docs: DataFrame, doc_id: str, text: str, least: int = 3, times: int = 2) -> DataFrame:
    """doc_id, text with broken words put together, n_repaired. Of three parts in a row the first two are joined. Ids must be unique; rows with a null text stay as they are.

    Only texts with a broken word are taken apart and joined; places of repairs are grouped by document, at most one a word.
    """
    broken = broken_words(docs, doc_id, text, least, times)
    places = _adjacent(docs, doc_id, text).where("a is not null and b is not null").join(broken, ["a", "b"], "left_semi").groupBy("doc").agg(F.collect_set("at").alias("places"))
    found = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("t")).join(places, "doc", "left")
    kept = F.filter("places", lambda p: ~F.array_contains("places", p - 1))
    spaced = F.transform(_words(F.col("t")), lambda w, i: F.concat(F.when((i == 0) | F.array_contains("kept", i - 1), "").otherwise(" "), w))
    out = found.withColumn("kept", F.coalesce(kept, F.array().cast("array<int>")))
    return out.select(F.col("doc").alias(doc_id), F.when(F.size("kept") > 0, F.array_join(spaced, "")).otherwise(F.col("t")).alias(text), F.size("kept").alias("n_repaired"))
