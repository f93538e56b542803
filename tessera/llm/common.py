"""Shared pieces of the training-data operators."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows put into one result batch at most.
BATCH_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's reader alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset (tests), one beside the warehouse."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialises a frame in the shared folder and cuts its lineage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes a frame as Parquet into the shared folder and reads it again; the frame and where it lies."""
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where), where


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame as Parquet into the shared folder and reads it again."""
    return stored(df, name)[0]


def removed(spark: SparkSession, where: str) -> None:
    """Deletes a stored frame that nothing needs any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Deals a scan of fewer partitions than there are cores to all of them, before costly work on each row; larger inputs and
    anything but a plain scan stay as they are."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Relation" in node.nodeName() and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def parts(b: pa.RecordBatch, size: int = 4_000_000, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of a (key, text) batch of at most so many rows and, but for single long texts, about so many bytes of text."""
    ends = np.cumsum(pc.binary_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < b.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size))
        to = min(max(at + 1, to), at + rows, b.num_rows)
        yield b.slice(at, to - at)
        at = to


def per_text(schema: str, make: Callable[[], Callable[[int, str | None], tuple]], key: str = "doc_id", text: str = "text") -> Callable[[DataFrame], DataFrame]:
    """A transform that maps each row's (key, whole text) to one row of ``schema``; ``make`` builds the worker's function once a task."""

    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(df: DataFrame) -> DataFrame:
        kinds = None

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = make()
            for b in batches:
                keys, texts = b.column(0).to_pylist(), b.column(1)
                for at in range(0, len(keys), BATCH_ROWS):
                    out = [f(k, t) for k, t in zip(keys[at : at + BATCH_ROWS], texts.slice(at, BATCH_ROWS).to_pylist())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=kinds[i]) for i, c in enumerate(zip(*out, strict=True))], names=names)

        from pyspark.sql.pandas.types import to_arrow_type
        from pyspark.sql.types import StructType

        kinds = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)]
        return spread(df.select(key, text)).mapInArrow(rows, schema)

    return run


def crc_mod(n: int):
    """crc32 of the doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def first_by_hash(rows: DataFrame, by: str, most: int) -> dict:
    """{doc_id: value of ``by``} of the ``most`` rows of ``rows(doc_id, by)`` of each value whose doc_id hashes lowest; of a doc_id with several values
    the largest. Counts by the hash's leading zeros, combined before their shuffle, tell how many zeros suffice; only rows with as many, some
    2 * ``most`` of a value, leave the scan, however many rows one value has."""
    h = F.xxhash64("doc_id")
    zeros = F.lit(64) - F.length(F.bin(h))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col(by).isNotNull()).select("doc_id", by)
    seen: dict = {}
    for r in rows.groupBy(by, zeros.alias("zeros")).count().collect():
        seen.setdefault(r[by], {})[r.zeros] = r["count"]
    if not seen:
        return {}
    least = {}
    for k, counts in seen.items():
        n = 0
        for z in range(64, -1, -1):
            n += counts.get(z, 0)
            if n >= most:
                break
        least[k] = z
    enough = F.create_map(*(F.lit(x) for pair in least.items() for x in pair))[F.col(by)]
    found: dict = {k: [] for k in least}
    for r in rows.where(zeros >= enough).select("doc_id", by, h.alias("h")).distinct().collect():
        found[r[by]].append((r.h % 2**64, r.doc_id))
    return {i: k for k in sorted(found) for _, i in sorted(found[k])[:most]}


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (long): (node, component), component the smallest node reachable; nodes without an edge get no row.

    Alternating large-star and small-star steps: each is one min-aggregation (combined before its shuffle) and one join that adaptive
    execution can split, so a node with any number of links stays spread. Each round is checkpointed.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    for _ in itertools.count():
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(small_low, "a")
        e = small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(small_low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        e = cut(e)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
