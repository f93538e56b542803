"""Operator 13: compression of vectors to codes, entries filtered by segment-mean lower bounds.

Vectors of integer components are cut into parts, each with a codebook. A part's nearest entry is sought coarse to fine: over a segment of both, the
squared distance is at least length times the squared difference of means, plus the squared difference of the norms of what remains about
the means. Level 1 takes the whole part as one segment, level 2 cuts it into segments of a few components. An entry whose bound, with room for
rounding, exceeds an exact distance already known goes; survivors receive exact integer distances, and the least wins, ties to the lower index.

Codebooks start as the parts of the first vectors by id. Each round assigns every part and replaces each entry by the componentwise floor of
the mean of its parts; entries without parts stay. Then parts are assigned once more.

Rows with a null or empty vector, or a null or non-finite component, are dropped, as are vectors of another length than the first kept one by id.
Components are clamped to +-2^24 after scaling, so a distance fits in 64 bits; a sum of errors beyond them is null. With fewer vectors than entries, codebooks are
as short. Ids may be null (they come last) or repeat (ties by vector); repeated rows count and return as often as they are there. Lengths not
divisible by the number of parts are cut as evenly as can be. Extra columns are ignored; an empty table gives no rows.

Plan: each round is one scan whose tasks add up their own rows by entry before the shuffle, so what is shuffled and collected depends on the
codebooks' size alone, whatever the rows, labels or copies. Codebooks, of a fixed size, travel with the tasks' code. The last assignment is written once; errors by label are added
up from it and joined back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, written
from .hard_negatives import scaled

#: Components of a segment on level 2; rows handled at once; labels that may be broadcast.
SEGMENT, ROWS, FEW = 4, 2048, 100_000


def cuts(dim: int, parts: int) -> list[slice]:
    """Consecutive parts, equal where the length allows."""
    edges = [round(i * dim / parts) for i in range(parts + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def outline(x: np.ndarray, size: int) -> np.ndarray:
    """Per segment of up to ``size`` components, mean (times the root of its length) and norm of the remainder, side by side: the
    squared distance of two outlines is a lower bound of that of the rows."""
    out = []
    for at in range(0, x.shape[1], size):
        s = x[:, at : at + size].astype("f8")
        mean = s.mean(1, keepdims=True)
        out += [mean[:, 0] * np.sqrt(s.shape[1]), np.sqrt(((s - mean) ** 2).sum(1))]
    return np.stack(out, 1)


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all rows of ``a`` to all of ``b``, and how far rounding may have moved those of each row of ``a``."""
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    return aa[:, None] + bb[None, :] - 2 * (a @ b.T), 1e-9 * (aa + bb.max()) + 1e-6


class Codebook:
    """The entries of one part, with their outlines."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        if entries.shape[1]:
            self.coarse, self.fine = outline(entries, entries.shape[1]), outline(entries, SEGMENT)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of each row's nearest entry, its squared distance, and how many exact distances it took."""
        if not x.shape[1]:
            return np.zeros(len(x), "i8"), np.zeros(len(x), "i8"), 0
        every = np.arange(len(x))

        def exact(i: np.ndarray, k: np.ndarray) -> np.ndarray:
            return ((x[i] - self.entries[k]) ** 2).sum(1)

        low, room = bounds(outline(x, x.shape[1]), self.coarse)
        known = exact(every, low.argmin(1))
        alive = low <= (known + room)[:, None]
        low, room = bounds(outline(x, SEGMENT), self.fine)
        known = np.minimum(known, exact(every, np.where(alive, low, np.inf).argmin(1)))
        alive &= low <= (known + room)[:, None]
        i, k = np.nonzero(alive)  # by row, entries ascending; a row has one at least, that of its known distance
        d = exact(i, k)
        first = np.searchsorted(i, every)
        least = np.minimum.reduceat(d, first)
        hit = np.nonzero(d == least[i])[0]
        own = np.unique(i[hit], return_index=True)[1]
        return k[hit[own]], least, len(i)


def components_of(b: pa.Array, dim: int, scale: float) -> np.ndarray:
    return scaled(b.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)


def sums_of(books: list[np.ndarray], scale: float):
    """A task's rows added up: (part, entry, position, total), the count of rows at position -1."""
    dim = sum(c.shape[1] for c in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = [Codebook(c) for c in books], cuts(dim, len(books))
        total, count = [np.zeros(c.shape, "i8") for c in books], [np.zeros(len(c), "i8") for c in books]
        for b in batches:
            for start in range(0, b.num_rows, ROWS):
                x = components_of(b.slice(start, ROWS).column(0), dim, scale)
                for p, (book, s) in enumerate(zip(own, at)):
                    k = book.nearest(x[:, s])[0]
                    # Exact in double precision: at most ROWS summands of 2^24.
                    total[p] += ((np.arange(len(count[p]))[:, None] == k).astype("f8") @ x[:, s]).astype("i8")
                    count[p] += np.bincount(k, minlength=len(count[p]))
        for p in range(len(books)):
            used = np.nonzero(count[p])[0]
            whole = np.concatenate([count[p][used, None], total[p][used]], 1)
            n, width = whole.shape
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n * width, p, "i4")), pa.array(np.repeat(used, width).astype("i4")), pa.array(np.tile(np.arange(-1, width - 1), n).astype("i4")), pa.array(whole.ravel())], names=["part", "entry", "position", "total"])

    return run


def coded(books: list[np.ndarray], scale: float):
    """(row's columns before the vector, code, error) of each row."""
    dim = sum(c.shape[1] for c in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = [Codebook(c) for c in books], cuts(dim, len(books))
        for b in batches:
            for start in range(0, b.num_rows, ROWS):
                part = b.slice(start, ROWS)
                x = components_of(part.column(2), dim, scale)
                found = [book.nearest(x[:, s]) for book, s in zip(own, at)]
                codes = ["".join(f"{k:02x}" for k in row) for row in np.stack([k for k, *_ in found], 1).tolist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes, pa.string()), pa.array(sum(d for _, d, _ in found), pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def fitted(vectors: DataFrame, dim: int, parts: int, entries: int, rounds: int, scale: float) -> list[np.ndarray]:
    """The codebooks after all rounds, from ``vectors(vec_id, e)``."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "e").limit(entries).collect()
    x = scaled(np.array([r.e for r in first], "f8").reshape(len(first), dim), scale)
    books = [x[:, s].copy() for s in cuts(dim, parts)]
    for _ in range(rounds):
        sums = vectors.select("e").mapInArrow(sums_of(books, scale), "part int, entry int, position int, total long")
        totals: dict = {}
        for r in sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total")).collect():
            totals.setdefault((r.part, r.entry), {})[r.position] = r.total
        for (p, k), t in totals.items():
            books[p][k] = [t[i] // t[-1] for i in range(books[p].shape[1])]
    return books


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all entries' components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(c) for book in books for entry in book.tolist() for c in entry).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every sound row of ``vectors(vec_id, label, embedding)``."""
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    v = vectors.select("vec_id", "label", F.col("embedding").cast(f"array<{kind}>").alias("e"))
    v = v.where((F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    label = vectors.schema["label"].dataType.simpleString()
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, label {label}, code string, error long"
    first = v.orderBy(F.asc_nulls_last("vec_id"), "e").select(F.size("e").alias("dim")).first()
    dim = first.dim if first else 0
    v = v.where(F.size("e") == dim)
    books = fitted(v, dim, parts, entries, rounds, scale)
    codes = written(v.mapInArrow(coded(books, scale), schema), "vector-codes")
    errors = cut(codes.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")))
    few = errors.count() <= FEW
    out = codes.join(F.broadcast(errors) if few else errors, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
