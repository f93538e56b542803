"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Quality classification, near-duplicate removal, benchmark decontamination, secret redaction, and byte-level encoding. All but the last
return the columns of documents; each works on all rows that its predecessor kept, and drops or changes rows by its own
operator's decisions alone.

Null and empty texts: the classifier scores them as no bytes; they are near-duplicates of nothing, hold no passage and no secret, and encode to no
ids. Rows of one doc_id: each is scored by itself; near_dedup keeps or drops them together; decontaminate drops all if one holds a passage. Rows
without a doc_id are kept by near_dedup and decontaminate. Extra columns pass through. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import byte_bpe, decontaminate, near_dedup, quality, secret_scan
from tessera.llm.common import removed, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects (score under 0.5)."""
    return quality.good(docs, table(spark, sf_dir, "labels"), per_class=700)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return near_dedup.deduplicated(docs, k=5, percent=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts by a mark; n_chars follows the text."""
    from pyspark.sql import functions as F

    clean = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each text and checks itself by decoding."""
    # Workers are reused from stage to stage, so what they remember stays small.
    return byte_bpe.round_trip(docs, remembered=50_000)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("encode", encode_stage),
]

#: SQL can't express these stages; tests/llm compares them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``. A stage's table goes once the next one's is written; the last one stays, as the rows come from it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, where = stored(stage(spark, docs, sf_dir), name)
        if before:
            removed(spark, before)
        before = where
    return STAGES[-1][1](spark, docs, sf_dir)
