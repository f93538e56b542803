"""Operator 12: hard negatives by bit-sliced integer products.

Components are integers. A row's components, moved up to be non-negative, are taken apart into bit-planes, most significant first. After each plane
a pair's product is known but for the lower bits, which add between (2^j - 1) times the sum of the anchor's negative components and as much of the
positive ones: an interval that halves with every plane. A candidate goes once its interval can't qualify:

- positives: its upper end is under the k-th largest lower end among the anchor's rows of the same label;
- negatives: for none of the anchor's positives does it reach the band of allowed scores, or the k-th largest lower end of those surely in it.

Planes are matrix products over blocks while many candidates are left, then products over the pairs that remain; the last plane
makes scores exact. Ties go to the smaller id: only intervals strictly below are dropped.

Rows with a null id, label or vector, or a null or non-finite component, take no part. Of rows that share an id one takes part, that of the smallest
label and then vector. Vectors of different lengths have no product. Components are clamped to +-2^24 after scaling, so every product fits in
64 bits. Anchors without positives, and positives without negatives, give no rows; an empty table gives none. Extra columns are ignored.

Plan: the query set is held against all rows in blocks. Rows are dealt to blocks and anchors to chunks by their ids' hashes, whatever their labels, so
a frequent label loads nobody; each block meets each chunk in a group of bounded size, and what leaves a group are at most k rows for each anchor
(or anchor and positive), of which a window keeps the first k. Both passes are alike; nothing goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows of a block and anchors of a chunk, at least and at most; blocks aimed at between these; entries of a score matrix; share of candidates left at which pairs replace matrices; pairs handled at once.
LEAST, MOST, AIM, TILE, SPARSE, PAIRS = 2048, 65536, 64, 1 << 20, 1 / 16, 1 << 17
#: Largest component in absolute value.
LARGEST = 1 << 24


def scaled(flat: np.ndarray, scale: float) -> np.ndarray:
    """Integer components: floor(scale * x), x as double, clamped."""
    return np.clip(np.floor(scale * flat.astype("f8")), -LARGEST, LARGEST).astype("i8")


class Planes:
    """Bit-planes of rows of integers: row = sum of 2^j * plane j, minus 2^bits."""

    def __init__(self, x: np.ndarray):
        self.bits = int(np.abs(x).max(initial=1)).bit_length()
        self.u = x + (1 << self.bits)

    def plane(self, j: int, kind: str, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        return ((self.u[rows] >> j) & 1).astype(kind)


class Anchors:
    """Some anchors beside the planes of rows: products known so far, and what the bits not yet seen may add."""

    def __init__(self, a: np.ndarray, planes: Planes):
        self.a, self.planes, self.j = a, planes, planes.bits + 1
        self.base = -(a.sum(1) << planes.bits)
        self.negative, self.positive = np.minimum(a, 0).sum(1), np.maximum(a, 0).sum(1)
        # Products of a plane are exact: bits times components.
        self.kind = "f4" if a.shape[1] * max(1, int(np.abs(a).max(initial=1))) < 1 << 24 else "f8"

    def slack(self) -> tuple[np.ndarray, np.ndarray]:
        """Per anchor, what lower bits add at least and at most."""
        rest = (1 << self.j) - 1
        return rest * self.negative, rest * self.positive

    def matrix(self, s: np.ndarray, rows: slice) -> None:
        """Adds the next plane to the products of all anchors with all rows."""
        self.j -= 1
        s += (self.a.astype(self.kind) @ self.planes.plane(self.j, self.kind, rows).T).astype("i8") << self.j

    def pairs(self, s: np.ndarray, i: np.ndarray, k: np.ndarray) -> None:
        """Adds the next plane to the products of some pairs."""
        self.j -= 1
        for at in range(0, len(s), PAIRS):
            p, q = i[at : at + PAIRS], k[at : at + PAIRS]
            s[at : at + PAIRS] += np.einsum("ij,ij->i", self.a[p], self.planes.plane(self.j, "i8", q)) << self.j


def kth(i: np.ndarray, s: np.ndarray, k: int, n: int) -> np.ndarray:
    """For each of ``n`` anchors the k-th largest of its ``s``; the least long where it has fewer."""
    out = np.full(n, np.iinfo("i8").min)
    order = np.lexsort((-s, i))
    first = np.searchsorted(i[order], np.arange(n))
    last = np.append(first[1:], len(i))
    has = last - first >= k
    out[has] = s[order][first[has] + k - 1]
    return out


def leading(i: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of each anchor's first k pairs, larger products and then smaller ids first."""
    order = np.lexsort((ids, -s, i))
    own = i[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def nearest(a: np.ndarray, own: np.ndarray, planes: Planes, ids: np.ndarray, rows: slice, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest products of each anchor with rows of other ids: anchor, row (in the slice), product."""
    x = Anchors(a, planes)
    s = np.repeat(x.base[:, None], rows.stop - rows.start, 1)
    alive = own[:, None] != ids[None, rows]
    while x.j and alive.mean() > SPARSE:
        x.matrix(s, rows)
        if s.shape[1] > k:
            low, high = x.slack()
            bound = np.partition(np.where(alive, s, np.iinfo("i8").min // 2), -k, axis=1)[:, -k] + low
            alive &= s + high[:, None] >= bound[:, None]
    i, q = np.nonzero(alive)
    v = s[i, q]
    while x.j:
        x.pairs(v, i, q + rows.start)
        low, high = x.slack()
        fits = v + high[i] >= kth(i, v + low[i], k, len(a))[i]
        i, q, v = i[fits], q[fits], v[fits]
    best = leading(i, v, ids[rows][q], k)
    return i[best], q[best], v[best]


def banded(a: np.ndarray, label: np.ndarray, planes: Planes, labels: np.ndarray, ids: np.ndarray, floor: np.ndarray, top: np.ndarray, rows: slice, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor and band [floor, top] (as columns) the k largest products within it, of rows of other labels: anchor, band, row (in the slice), product."""
    x = Anchors(a, planes)
    s = np.repeat(x.base[:, None], rows.stop - rows.start, 1)
    alive = label[:, None] != labels[None, rows]
    open_ = floor <= top
    least = np.where(open_, floor, np.iinfo("i8").max).min(1)
    most = np.where(open_, top, np.iinfo("i8").min).max(1)
    while x.j and alive.mean() > SPARSE:
        x.matrix(s, rows)
        low, high = x.slack()
        alive &= (s + high[:, None] >= least[:, None]) & (s + low[:, None] <= most[:, None])
    i, q = np.nonzero(alive)
    v = s[i, q]
    while x.j and len(i):
        x.pairs(v, i, q + rows.start)
        low, high = v + x.slack()[0][i], v + x.slack()[1][i]
        fits = np.zeros(len(i), bool)
        for b in range(floor.shape[1]):
            within = (high >= floor[i, b]) & (low <= top[i, b])
            sure = within & (low >= floor[i, b]) & (high <= top[i, b])
            fits |= within & (high >= kth(i[sure], low[sure], k, len(a))[i])
        i, q, v = i[fits], q[fits], v[fits]
    out = []
    for b in range(floor.shape[1]):
        some = np.nonzero((v >= floor[i, b]) & (v <= top[i, b]))[0]
        some = some[leading(i[some], v[some], ids[rows][q[some]], k)]
        out.append((i[some], np.full(len(some), b), q[some], v[some]))
    return tuple(np.concatenate(c) for c in zip(*out))


def once(t: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]]:
    """Ids, labels, raw components and rows of a group's table, by length of vector; of rows that share an id the first."""
    t = t.combine_chunks()
    sizes = np.asarray(pa.compute.list_value_length(t["e"]))
    ids = t["vec_id"].to_numpy()
    if len(np.unique(ids)) < len(ids):
        lists, labels = t["e"].to_pylist(), t["label"].to_numpy()
        kept: dict = {}
        for n in range(len(ids)):
            key = (labels[n], lists[n])
            if ids[n] not in kept or key < kept[ids[n]][0]:
                kept[ids[n]] = (key, n)
        t = t.take(sorted(n for _, n in kept.values()))
        sizes, ids = np.asarray(pa.compute.list_value_length(t["e"])), t["vec_id"].to_numpy()
    out = []
    for size in np.unique(sizes):
        own = t.filter(pa.array(sizes == size)).combine_chunks()
        flat = own["e"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
        out.append((own["vec_id"].to_numpy(), own["label"].to_numpy(), flat, own))
    return out


def matched(rows: pa.Table, anchors: pa.Table, scale: float) -> Iterator[tuple]:
    """Rows and anchors of each length: (ids, labels, planes) of the rows, sorted by label, and (ids, labels, components, rows) of the anchors."""
    if not rows.num_rows or not anchors.num_rows:
        return
    of = {x[2].shape[1]: x for x in once(anchors)}
    for ids, labels, flat, _ in once(rows):
        if flat.shape[1] in of and flat.shape[1]:
            order = np.lexsort((ids, labels))
            own, own_label, own_flat, own_rows = of[flat.shape[1]]
            yield ids[order], labels[order], Planes(scaled(flat[order], scale)), own, own_label, scaled(own_flat, scale), own_rows


def positives_in(k: int, scale: float):
    """Of one group: each anchor's k largest products with rows of its label."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found: list = [[], [], []]
        for ids, labels, planes, own, own_label, a, _ in matched(rows, anchors, scale):
            for label in np.unique(own_label):
                lo, hi = np.searchsorted(labels, label), np.searchsorted(labels, label, "right")
                mine = np.nonzero(own_label == label)[0]
                step = max(1, TILE // max(1, hi - lo))
                for at in range(0, len(mine) if hi > lo else 0, step):
                    m = mine[at : at + step]
                    i, q, v = nearest(a[m], own[m], planes, ids, slice(lo, hi), k)
                    for out, x in zip(found, (own[m][i], ids[lo + q], v)):
                        out.append(x)
        return table_of(found, ["anchor_id", "positive_id", "positive_score"])

    return run


def negatives_in(k: int, scale: float, low: int, high: int):
    """Of one group: for each anchor and positive the k largest products of rows of other labels within the band of the positive's product."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found: list = [[], [], [], [], []]
        for ids, labels, planes, own, own_label, a, own_rows in matched(rows, anchors, scale):
            bands = [[(p["positive_id"], p["positive_score"]) for p in x] for x in own_rows["positives"].to_pylist()]
            width = max(map(len, bands))
            names, scores = np.zeros((len(own), width), "i8"), np.zeros((len(own), width), "i8")
            floor, top = np.ones((len(own), width), "i8"), np.zeros((len(own), width), "i8")
            for n, x in enumerate(bands):
                for b, (name, score) in enumerate(x):
                    names[n, b], scores[n, b], floor[n, b], top[n, b] = name, score, -(-low * score // 100), high * score // 100
            step = max(1, TILE // len(ids))
            for at in range(0, len(own), step):
                m = slice(at, at + step)
                i, b, q, v = banded(a[m], own_label[m], planes, labels, ids, floor[m], top[m], slice(0, len(ids)), k)
                for out, x in zip(found, (own[m][i], names[m][i, b], scores[m][i, b], ids[q], v)):
                    out.append(x)
        return table_of(found, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def table_of(columns: list[list[np.ndarray]], names: list[str]) -> pa.Table:
    return pa.table({n: pa.array(np.concatenate(c) if c else np.zeros(0, "i8"), pa.int64()) for n, c in zip(names, columns)})


def blocks(n: int) -> int:
    """Into how many blocks ``n`` rows are dealt."""
    return max(1, -(-n // min(MOST, max(LEAST, n // AIM))))


def hard_negatives(vectors: DataFrame, is_anchor: Column, scale: float = 256.0, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors among ``vectors(vec_id, label, embedding)``.

    Positives are the ``positives`` rows of an anchor's label with the largest products; negatives the first ``negatives`` rows of other labels whose product is
    from ``low`` to ``high`` percent of the positive's.
    """
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    e = F.col("embedding").cast(f"array<{kind}>")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), e.alias("e"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    v = v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # How many there are decides how many blocks; ids alone are read for it.
    sizes = vectors.select(F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors")).first()
    n_blocks, n_chunks = blocks(sizes.n), blocks(sizes.anchors)

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumns({own: F.pmod(F.xxhash64("vec_id"), F.lit(n)), other: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))})

    rows = dealt(v.select("vec_id", "label", "e"), "block", n_blocks, "chunk", n_chunks).groupBy("block", "chunk")
    anchors = v.where("is_anchor").select("vec_id", "label", "e").toDF("vec_id", "label", "e")
    met = rows.cogroup(dealt(anchors, "chunk", n_chunks, "block", n_blocks).groupBy("block", "chunk"))
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = met.applyInArrow(positives_in(positives, scale), "anchor_id long, positive_id long, positive_score long").withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    held = cut(best.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")))
    # Both sides of a group come from one table; toDF gives the anchors' columns an identity of their own.
    guided = anchors.join(held.withColumnRenamed("anchor_id", "vec_id"), "vec_id").toDF("vec_id", "label", "e", "positives")
    met = rows.cogroup(dealt(guided, "chunk", n_chunks, "block", n_blocks).groupBy("block", "chunk"))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = met.applyInArrow(negatives_in(negatives, scale, low, high), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
