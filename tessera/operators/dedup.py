"""Greedy, order-dependent dedup. The outcome follows the order, so each pass is a fold over sorted rows.

Folds stream over partitions sorted by scope and order (``mapInArrow``), holding one scope's keys at a time. For keys that
cross scopes, rows that share a key are first brought together as connected components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_scopes(df: DataFrame, scope: Sequence[str], order: Sequence[Column], columns: Sequence[str], schema: str, fold: Callable[[Iterable[tuple]], Iterator[tuple]]) -> DataFrame:
    """Applies ``fold`` to the rows (tuples of ``columns``) of each scope in order; it yields tuples of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    n = len(scope)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out = []
        for _, group in groupby(rows, key=lambda r: r[:n]):
            for got in fold(r[n:] for r in group):
                out.append(got)
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

    placed = df.withColumns({f"_s{i}": F.col(c) for i, c in enumerate(scope)})
    keys = [f"_s{i}" for i in range(n)]
    return placed.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *columns).mapInArrow(run, schema)


def greedy_keys(df: DataFrame, scope: Sequence[str], id_: str, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows kept by the greedy pass: a row goes if any of its keys is registered; only kept rows register theirs. Null and empty keys match nothing."""

    def fold(rows: Iterable[tuple]) -> Iterator[tuple]:
        seen: list[set] = [set() for _ in keys]
        for i, *values in rows:
            if not any(v and v in s for v, s in zip(values, seen)):
                for v, s in zip(values, seen):
                    if v:
                        s.add(v)
                yield (i,)

    kept = fold_scopes(df.withColumns({f"_k{j}": F.col(k).cast("string") for j, k in enumerate(keys)}), scope, order, [id_, *(f"_k{j}" for j in range(len(keys)))], f"{id_} long", fold)
    return df.join(kept, id_, "left_semi")


def key_components(df: DataFrame, id_: str, keys: Sequence[str]) -> DataFrame:
    """(id, component) of rows that share a value of any key: every value is tied to its smallest row, then labels sink along ties until none changes."""
    tied = None
    for j, k in enumerate(keys):
        part = df.where(F.col(k).isNotNull() & (F.col(k).cast("string") != "")).select(F.col(id_).alias("a"), F.concat(F.lit(f"{j}:"), F.col(k).cast("string")).alias("k"))
        tied = part if tied is None else tied.unionByName(part)
    low = tied.groupBy("k").agg(F.min("a").alias("b"))
    edges = tied.join(low, "k").select("a", "b").distinct()
    labels = df.select(F.col(id_).alias("a")).distinct().withColumn("c", F.col("a"))
    edges = cut(edges)
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    while True:
        step = both.join(labels.withColumnsRenamed({"a": "b", "c": "d"}), "b").groupBy("a").agg(F.min("d").alias("d"))
        new = cut(labels.join(step, "a", "left").select("a", F.least("c", F.coalesce("d", "c")).alias("n"), F.col("c").alias("old")))
        if new.where("n <> old").isEmpty():
            return new.select(F.col("a").alias(id_), F.col("n").alias("component"))
        # A label's own label is as good, so paths halve.
        labels = new.select("a", F.col("n").alias("m")).join(new.select(F.col("a").alias("m"), F.col("n").alias("c")), "m").select("a", "c")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder; the session's setting, or one beside the warehouse where it is unset."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()


def greedy_merge(df: DataFrame, id_: str, keys: Sequence[str], order: Sequence[Column], gather: str) -> DataFrame:
    """Greedy pass over global keys; survivors get the sorted values of ``gather`` of the rows they absorbed as ``<gather>s``."""

    def fold(rows: Iterable[tuple]) -> Iterator[tuple]:
        owner: list[dict] = [{} for _ in keys]
        kept: dict = {}
        for i, value, *ks in rows:
            by = next((o[v] for v, o in zip(ks, owner) if v and v in o), None)
            if by is None:
                kept[i] = {value}
                for v, o in zip(ks, owner):
                    if v:
                        o[v] = i
            else:
                kept[by].add(value)
        for i, values in kept.items():
            yield i, sorted(v for v in values if v is not None)

    x = df.withColumns({f"_k{j}": F.col(k).cast("string") for j, k in enumerate(keys)}).join(key_components(df, id_, keys), id_)
    kept = fold_scopes(x, ["component"], order, [id_, gather, *(f"_k{j}" for j in range(len(keys)))], f"{id_} long, {gather}s array<string>", fold)
    return df.join(kept, id_)


#: Rows of a scope that tell which words are rare.
LOOKED_AT = 4096


def greedy_similar(
    df: DataFrame, scope: Sequence[str], id_: str, words: str, all_words: str, at: str, order: Sequence[Column], near: Sequence[tuple[float, float]] = ((3, 0.4), (7, 0.5)), unknown: float = 0.6,
    native: str | None = None, whole_days: bool = False,
) -> DataFrame:
    """Rows kept by greedy similarity within a scope. A row with fewer than three words passes and suppresses nothing; others go if a kept
    one shares enough words within enough days.

    With ``native``, ``words`` are the native ones mapped to one language: the larger of both overlaps counts, over the smaller native set.
    ``whole_days`` rounds the difference, kept row's time taken from the row's, down to days before its sign is dropped.

    Two rows whose smaller set has n words must share two of its n - k + 2 rarest, k being the least number of common words that the lowest overlap asks for, or one if k
    is 1. So kept rows are looked up by the rarest words of the smaller of both and compared when a second one leads to them; frequent words bring few of them. Which words
    are rare is told by the scope's first rows; any order of words gives the same result."""
    low = min(unknown, *(r for _, r in near))

    def fold(rows: Iterable[tuple]) -> Iterator[tuple]:
        from array import array
        from collections import Counter
        from itertools import chain, islice

        rows = iter(rows)
        first = list(islice(rows, LOOKED_AT))
        counts = Counter(w for _, ws, _, _, own in first for w in {*(ws or ()), *(own or ())})
        # Numbers in order of rarity: those of words not seen in the first rows are negative.
        number = {w: n for n, (w, _) in enumerate(sorted(counts.items(), key=lambda x: x[1]))}
        sizes, times, sets, natives = [], [], [], []
        # Kept rows by their rarest words, by their other words, and those of which one common word is enough.
        rare: dict[int, list[int]] = {}
        others: dict[int, list[int]] = {}
        single: dict[int, list[int]] = {}

        def numbers(ws: Iterable) -> list[int]:
            out = set()
            for w in ws:
                n = number.get(w)
                if n is None:
                    n = number[w] = -1 - len(number)
                out.add(n)
            return sorted(out)

        for i, ws, few, t, own in chain(first, rows):
            side = numbers(ws or ())
            mine = side if own is None else numbers(own)
            size = len(mine)
            if few or not size:
                yield (i,)
                continue
            words_of, native_of = set(side), None if own is None else set(mine)
            one = low * size - 1e-9 <= 1
            most = max(-int(-(low * size - 1e-9) // 1) - 2, 0)
            ahead = set(side[: max(len(side) - most, 0)])
            if native_of is not None:
                ahead.update(mine[: max(len(mine) - most, 0)])

            def similar(k: int) -> bool:
                other = times[k]
                if t is None or other is None:
                    least = unknown
                else:
                    days = abs((t - other).days) if whole_days else abs((t - other).total_seconds()) / 86400
                    least = min((r for limit, r in near if days <= limit), default=None)
                    if least is None:
                        return False
                n = len(words_of.intersection(sets[k]))
                if native_of is not None or natives[k] is not None:
                    n = max(n, len((words_of if native_of is None else native_of).intersection(sets[k] if natives[k] is None else natives[k])))
                return n / min(size, sizes[k]) >= least

            once: set[int] = set()
            looked: set[int] = set()

            def led_to(w: int) -> Iterator[int]:
                yield from single.get(w, ())
                for index in (rare, others) if w in ahead else (rare,):
                    if ks := index.get(w):
                        if one:
                            yield from ks
                        else:
                            yield from once.intersection(ks)
                            once.update(ks)

            def met(w: int) -> bool:
                for k in led_to(w):
                    if k not in looked:
                        looked.add(k)
                        if similar(k):
                            return True
                return False

            every = side if native_of is None else sorted(words_of | native_of)
            gone = any(met(w) for w in every)
            if not gone:
                k = len(sizes)
                for w in every:
                    (single if one else rare if w in ahead else others).setdefault(w, []).append(k)
                sizes.append(size)
                times.append(t)
                sets.append(array("i", side))
                natives.append(None if own is None else array("i", mine))
                yield (i,)

    own = F.when(~F.sort_array(native).eqNullSafe(F.sort_array(words)), F.coalesce(native, F.array().cast("array<string>"))) if native else F.lit(None).cast("array<string>")
    x = df.withColumns({"_own": own, "_few": F.coalesce(F.size(all_words), F.lit(0)) < 3})
    kept = fold_scopes(x, scope, order, [id_, words, "_few", at, "_own"], f"{id_} long", fold)
    return df.join(kept, id_, "left_semi")
