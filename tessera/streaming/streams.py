"""Structured Streaming: event-time counts, dedup with a time to live, change detection, keyed upserts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).parquet(path)


def tumbling(events: DataFrame, at: str, width: str, keys: Sequence[str], value: str, late: str | None = None) -> DataFrame:
    """start, keys, n, total per window; on a stream with ``late`` as the watermark."""
    if late:
        events = events.withWatermark(at, late)
    return events.groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def seen_once(events: DataFrame, key: str, at: str, ttl: str) -> DataFrame:
    """The first row of a key within its time to live."""
    return events.withWatermark(at, ttl).dropDuplicatesWithinWatermark([key])


def changes(events: DataFrame, key: str, value: str, id_: str) -> DataFrame:
    """Rows whose value differs from the key's last one, with state per key. Within a batch rows come in order of ``id_``."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for _, r in pd.concat(list(frames)).sort_values(id_).iterrows():
            if r[value] != last:
                out.append((int(r[id_]), str(r[value])))
                last = r[value]
        state.update((last,))
        yield pd.DataFrame(out, columns=[id_, value])

    return events.groupBy(key).applyInPandasWithState(step, f"{id_} long, {value} string", "last string", "append", GroupStateTimeout.NoTimeout)


def upsert(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str]):
    """A foreachBatch function that keeps the best row of each key in versioned folders under ``path``; the newest version is the table.
    A batch that is replayed gives the same version again."""

    def write(batch: DataFrame, number: int) -> None:
        old = f"{path}/v={number - 1}"
        every = batch if number == 0 else batch.unionByName(batch.sparkSession.read.parquet(old))
        w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
        every.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k").write.mode("overwrite").parquet(f"{path}/v={number}")

    return write


def upsert_touched(path: str, keys: Sequence[str], order: Sequence[str], buckets: int = 64):
    """A foreachBatch function that keeps the best row of each key in a table split by a hash of the key: a batch rewrites only the buckets that
    it touches, and leaves no versions behind. A batch that is replayed changes nothing."""
    from tessera.operators.dedup import cut
    from tessera.sources.files import exists

    def write(batch: DataFrame, number: int) -> None:
        rows = cut(batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
        if not touched:
            return
        if exists(rows.sparkSession, path):
            rows = rows.unionByName(rows.sparkSession.read.parquet(path).where(F.col("bucket").isin(touched)))
        best = F.max(F.struct(*order, F.struct(*(c for c in rows.columns if c not in order)).alias("_rest")))
        kept = rows.groupBy(*keys).agg(best.alias("_b")).select("_b.*").select(*order, "_rest.*")
        # Read to the end before its own buckets are replaced.
        cut(kept).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return write
