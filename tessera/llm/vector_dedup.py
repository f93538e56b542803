"""Operator 7: near-duplicate embeddings by a subspace pigeonhole join.

Vectors are scaled to length 1 and rotated by a fixed random rotation; two of cosine ``c`` or more lie within the squared distance
2 - 2c. Split into B blocks of coordinates, they lie within 1/B of that budget in at least one block. Each block is
range-joined: vectors are laid on a grid over the block's first coordinates whose cells are twice the block's radius wide, so partners lie in the
same or a neighbouring cell; block distances are then computed exactly, and the union of candidates over the blocks is verified by
cosine in double precision on the vectors as given. A pair is counted in the first block that holds it, so never twice; block distances are
computed in one way, row by row, whatever the task, so no pair is lost.

Vectors that are null, zero, or hold null or non-finite components link with nothing and stay. Vectors of different lengths have no cosine;
those of each length are compared among themselves. Rows that repeat a vec_id are one vector if equal in all components; else each has a
row, and the links of both count. Labels are ignored; an empty table gives no rows.

Plan: equal vectors are one node with a weight, from an aggregation that combines before its shuffle, so a group of copies of any size costs
one row. A cell of any size is split into parts of bounded size, which are compared in pairs; what leaves a comparison are each node's weighted
number of links, and the links that join parts not yet joined, never all pairs. The grid has more coordinates the more vectors there are,
so cells stay about as full at any size. Placing is repeated rather than stored: only rows on their way to a comparison are shuffled, once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut

#: Blocks of coordinates, members of one part of a cell, and vectors for which the grid has two coordinates; four times as many add one; candidates verified at once.
BLOCKS, PART, TWO, CANDIDATES = 8, 16384, 50_000, 1 << 15
#: Cells of more than one part that may be broadcast; more are joined by a shuffle.
FEW = 100_000
NONE = pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "partner": pa.array([], pa.int64())})


def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(17).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def split(dim: int, blocks: int) -> list[slice]:
    """Consecutive blocks of coordinates, as even as can be."""
    edges = [round(i * dim / blocks) for i in range(blocks + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def slack(cosine: float) -> float:
    """The squared-distance budget, with room for rounding."""
    return 2 - 2 * cosine + 1e-9


def unit(raw: list[bytes], kind: str, dim: int) -> np.ndarray:
    """Vectors in double precision, scaled to length 1."""
    x = np.frombuffer(b"".join(raw), kind).reshape(-1, dim).astype("f8")
    if kind == "f8":  # squares of single-precision numbers don't overflow
        x /= np.abs(x).max(1, keepdims=True)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def gridded(dim: int, kind: str, cosine: float, axes: int):
    """Maps (node, weight, raw vector) to rows (block, cell, home, node, weight, raw): its own cell in each block, and each neighbouring cell that comes
    before its own in the grid's order and whose points may be within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, blocks = rotation(dim), split(dim, min(BLOCKS, dim))
        radius = math.sqrt(slack(cosine) / len(blocks))
        width = 2 * radius
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                ids, weight, raw = part.column(0), part.column(1), part.column(2)
                x = unit(raw.to_pylist(), kind, dim) @ turn
                rows = np.arange(len(x))
                for k, s in enumerate(blocks):
                    y = x[:, s][:, :axes] / width
                    home = np.floor(y).astype(np.int64)
                    rest = y - home
                    # per axis -1, 0 or 1; a step is possible if the border is within half a cell, that is the radius
                    for step in np.ndindex(*(3,) * y.shape[1]):
                        d = np.array(step) - 1
                        if tuple(d) > (0,) * len(d):
                            continue
                        fits = np.all(np.where(d == 0, True, np.where(d < 0, rest <= 0.5 + 1e-9, rest >= 0.5 - 1e-9)), axis=1)
                        if not fits.any():
                            continue
                        cell = home[fits] + d
                        code = np.zeros(len(cell), np.int64)
                        for c in range(cell.shape[1]):
                            code = code * 1_000_003 + cell[:, c]
                        take = pa.array(rows[fits])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), k, np.int32)), pa.array(code), pa.array(np.full(len(cell), not d.any())), ids.take(take), weight.take(take), raw.take(take)], names=["block", "cell", "home", "node", "weight", "raw"])

    return run


def off(d: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Squared lengths of differences within a block. Row by row, so that a pair has the same one in any task and batch."""
    return (np.einsum("ij,jk->ik", d, turn) ** 2).sum(1)


def matched(dim: int, kind: str, cosine: float, axes: int):
    """Compares one pair of parts of a cell: home with home, home with guests. Rows (node, links, partner): a count, or a joining link."""

    def run(t: pa.Table) -> pa.Table:
        turn, blocks = rotation(dim), split(dim, min(BLOCKS, dim))
        budget = slack(cosine) / len(blocks)
        k, ids, part, weight = t["block"][0].as_py(), t["node"].to_numpy(), t["part"].to_numpy(), t["weight"].to_numpy()
        x = unit(t["raw"].to_pylist(), kind, dim)
        # The first part is of home vectors; pairs within a part are compared where it is paired with itself.
        lo, hi = t["i"][0].as_py(), t["j"][0].as_py()
        left, right = np.nonzero(part == lo)[0], np.nonzero(part == hi)[0]
        z = (x @ turn[:, blocks[k]]).astype("f4")
        half = (z * z).sum(1, keepdims=True) / 2
        # One product gives half the squared distance, negated; both sides lie in the order of a coordinate that the grid doesn't use.
        a_side, b_side = np.hstack([z, -half, np.ones_like(half)]), np.hstack([z, np.ones_like(half), -half])
        line, reach = z[:, min(axes, z.shape[1] - 1)], np.float32(math.sqrt(budget) + 1e-4)
        left, right = left[np.argsort(line[left], kind="stable")], right[np.argsort(line[right], kind="stable")]
        along, b_side = line[right], b_side[right]
        count, label, joins = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
        for at in range(0, len(left), 256):
            own = left[at : at + 256]
            first, last = np.searchsorted(along, [line[own[0]] - reach, line[own[-1]] + reach])
            p, q = np.nonzero(a_side[own] @ b_side[first:last].T >= np.float32(-budget / 2 - 1e-5))
            for start in range(0, len(p), CANDIDATES):
                a, b = own[p[start : start + CANDIDATES]], right[first + q[start : start + CANDIDATES]]
                if lo == hi:
                    a, b = a[a < b], b[a < b]
                # The pair is this block's if no earlier block holds it.
                for n, s in enumerate((blocks[k], *blocks[:k])):
                    if len(a):
                        within = off(x[a] - x[b], turn[:, s]) <= budget
                        a, b = (a[within], b[within]) if n == 0 else (a[~within], b[~within])
                ok = ((x[a] * x[b]).sum(1) >= cosine) & (ids[a] != ids[b])
                a, b = a[ok], b[ok]
                np.add.at(count, a, weight[b])
                np.add.at(count, b, weight[a])
                while len(new := np.nonzero(label[a] != label[b])[0]):
                    a, b = a[new], b[new]
                    joins.append((int(ids[a[0]]), int(ids[b[0]])))
                    label[label == label[b[0]]] = label[a[0]]
        some = np.nonzero(count)[0]
        return pa.table({
            "node": pa.array([*ids[some].tolist(), *(p for p, _ in joins)], pa.int64()),
            "links": pa.array([*count[some].tolist(), *(None for _ in joins)], pa.int64()),
            "partner": pa.array([*(None for _ in some), *(q for _, q in joins)], pa.int64()),
        })

    return run


def compared(nodes: DataFrame, dim: int, n: int, kind: str, cosine: float) -> DataFrame:
    """Rows (node, links, partner) of all ``n`` nodes of one length: ``nodes(node, weight, e)``."""
    axes = max(1, min(-(-dim // BLOCKS), 2 + max(0, math.floor(math.log(n / TWO, 4)))))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in flat.astype(kind)], pa.binary())], names=["node", "weight", "raw"])

    raw = nodes.where(F.size("e") == dim).select("node", "weight", "e").mapInArrow(packed, "node long, weight long, raw binary")
    placed = raw.mapInArrow(gridded(dim, kind, cosine, axes), "block int, cell long, home boolean, node long, weight long, raw binary")
    homes, guests = F.ceil(F.count_if("home") / PART).alias("homes"), F.ceil(F.count_if(~F.col("home")) / PART).alias("guests")
    # All but few cells are one part of home vectors and one of guests at most; only the others need to be known.
    large = cut(placed.groupBy("block", "cell").agg(homes, guests).where("homes > 1 or guests > 1"))
    parts = placed.join(F.broadcast(large) if large.count() <= FEW else large, ["block", "cell"], "left").withColumns({"homes": F.coalesce("homes", F.lit(1)), "guests": F.coalesce("guests", F.lit(1))})
    parts = parts.withColumn("part", F.when(F.col("home"), F.pmod(F.xxhash64("node"), "homes")).otherwise(F.col("homes") + F.pmod(F.xxhash64("node"), "guests")))
    # Home parts are numbered 0..homes-1, guests' parts follow; a home part meets each part from its own on, guests meet homes alone.
    # A cell that is one part of each is one comparison.
    one = (F.col("homes") <= 1) & (F.col("guests") <= 1)
    parts = parts.withColumn("other", F.explode(F.when(one, F.array(F.lit(-1).cast("long"))).otherwise(F.expr("if(home, sequence(0L, homes + guests - 1), sequence(0L, homes - 1))"))))
    pairs = parts.withColumns({"i": F.when(F.col("other") < 0, -1).otherwise(F.least("part", "other")), "j": F.when(F.col("other") < 0, -1).otherwise(F.greatest("part", "other"))})
    # Dealt by the pair of parts: a cell of any size is spread over as many tasks as it has pairs.
    pairs = pairs.select("block", "cell", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("part").cast("long").alias("part"), "node", "weight", "raw")

    def both(t: pa.Table) -> pa.Table:
        """Of a small cell: home with home, then home with guests."""
        one = matched(dim, kind, cosine, axes)
        if t["i"][0].as_py() >= 0:
            return one(t)
        found, part = [], t["part"].to_numpy()
        for i, j in ((0, 0), (0, 1)):
            if (part == i).any() and (part == j).any():
                at = [t.schema.get_field_index("i"), t.schema.get_field_index("j")]
                u = t.set_column(at[0], "i", pa.array(np.full(len(t), i))).set_column(at[1], "j", pa.array(np.full(len(t), j)))
                found.append(one(u))
        return pa.concat_tables(found) if found else NONE

    return pairs.repartition("block", "cell", "i", "j").groupBy("block", "cell", "i", "j").applyInArrow(both, "node long, links long, partner long")


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors(vec_id, embedding)``."""
    kind = "f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "f8"
    v = vectors.select("vec_id", F.col("embedding").cast("array<float>" if kind == "f4" else "array<double>").alias("e"))
    fine = F.col("vec_id").isNotNull() & F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    # Equal vectors are one node, that of the smallest id; an id with several vectors has a node for each.
    key = [F.xxhash64("e").alias("h1"), F.hash("e", F.lit(7)).alias("h2"), F.size("e").alias("dim")]
    sound = v.where(fine).select("vec_id", "e", *key)
    keys = ["h1", "h2", "dim", "own"]
    several = sound.groupBy("vec_id").agg((F.min(F.struct("h1", "h2", "dim")) != F.max(F.struct("h1", "h2", "dim"))).alias("several"))
    rows = cut(sound.drop("e").distinct().join(several, "vec_id").select("vec_id", "h1", "h2", "dim", F.when(F.col("several"), F.col("vec_id")).alias("own")))
    nodes = rows.groupBy(*keys).agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"))
    # One row of each node brings the vector.
    lead = nodes.withColumnRenamed("node", "vec_id").select("vec_id", "h1", "h2", "dim", "weight")
    held = cut(sound.join(lead, ["vec_id", "h1", "h2", "dim"]).groupBy(F.col("vec_id").alias("node"), "h1", "h2", "dim", "weight").agg(F.first("e").alias("e")).select("node", "dim", "weight", "e"))
    sizes = held.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect()
    if not sizes:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = None
    for r in sizes:
        own = compared(held, r.dim, r.n, kind, cosine)
        found = own if found is None else found.unionByName(own)
    found = cut(found)
    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    parts_of = components(found.where("partner is not null").select(F.col("node").alias("a"), F.col("partner").alias("b")))
    of_node = nodes.join(links, "node", "left").join(parts_of, "node", "left")
    of_node = of_node.select(*keys, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    # Null-safe: most nodes have no id of their own.
    joined = rows.withColumn("own", F.coalesce("own", F.lit(-1))).join(of_node.withColumn("own", F.coalesce("own", F.lit(-1))), keys)
    # The nodes of an id with several vectors share its name, so each already has the links of all.
    by_id = joined.groupBy("vec_id").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    out = v.select("vec_id").join(by_id, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
