"""Sequence comparison by the standard library's matcher, in Arrow batches: where sets of lines don't say enough."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "id long, ratio double, ops array<struct<tag: string, a: int, b: int, c: int, d: int>>, sentence string"


def compared(df: DataFrame, id_: str, old: str, new: str) -> DataFrame:
    """id, ratio, ops (opcodes other than equal, by line) and a sentence that sums up the change. Null texts are empty."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, x, y in zip(*(c.to_pylist() for c in b.columns)):
                a, c = (x or "").splitlines(), (y or "").splitlines()
                m = SequenceMatcher(None, a, c, autojunk=False)
                ops = [{"tag": t, "a": i, "b": j, "c": k, "d": n} for t, i, j, k, n in m.get_opcodes() if t != "equal"]
                added, removed = sum(o["d"] - o["c"] for o in ops), sum(o["b"] - o["a"] for o in ops)
                out.append((key, m.ratio(), ops, f"{added} lines added, {removed} removed" if ops else "no change"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*out), schema)], schema=schema)

    return df.select(id_, old, new).mapInArrow(run, SCHEMA)


def line_diff(old: Column, new: Column) -> Column:
    """added, removed: lines of the one text that the other doesn't hold, repeats counted; null if a text is null. Linear in the lines."""

    @F.arrow_udf("added long, removed long")
    def counted(old: pa.Array, new: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(old, new):
            a, b = x.as_py(), y.as_py()
            if a is None or b is None:
                out.append({"added": None, "removed": None})
                continue
            a, b = a.split("\n"), b.split("\n")
            in_a, in_b = set(a), set(b)
            out.append({"added": sum(line not in in_a for line in b), "removed": sum(line not in in_b for line in a)})
        return pa.array(out, pa.struct([("added", pa.int64()), ("removed", pa.int64())]))

    return counted(old, new)
