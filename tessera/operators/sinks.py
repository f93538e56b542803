"""Sinks on Spark's commit protocol: replace, append what is new, content-addressed blobs, versions, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.dedup import cut
from tessera.sources.files import exists


def replace(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Writes the whole table; readers see it when the job commits."""
    df.write.mode("overwrite").format(format).save(path)


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Appends the rows whose key the table doesn't have, one of each key; gives their number."""
    spark = df.sparkSession
    fresh = df.dropDuplicates(list(keys))
    if exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    fresh = cut(fresh)
    n = fresh.count()
    fresh.write.mode("append").parquet(path)
    return n


def blobs(df: DataFrame, content: str) -> DataFrame:
    """Content-addressed form: one row of each different content, keyed by its SHA-256."""
    return df.where(F.col(content).isNotNull()).select(F.sha2(content, 256).alias("hash"), content).dropDuplicates(["hash"])


def orphans(blob: DataFrame, references: DataFrame) -> DataFrame:
    """Blobs that no row refers to."""
    return blob.join(references.select("hash"), "hash", "left_anti")


def summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Report rows: counts and, for each column, how many values it has and how complete it is."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), *(F.round(F.count(c) / F.count("*"), 4).alias(f"{c}_filled") for c in others))
