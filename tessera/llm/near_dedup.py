"""Operator 1: near-duplicate documents by SetSketch registers.

A document's set is that of its distinct word shingles. Its sketch holds, for each register, the minimum of exponentially spaced,
truncated random values over the set; sketches of sets merge by maxima and collide about as often as the sets' Jaccard similarity.
Documents that agree in a band of registers are candidates; the similarity of candidates is estimated jointly by maximum likelihood
from how many registers are larger, smaller and equal, given both sizes; estimates that could still reach the threshold are
confirmed on the full sets.

Words are runs without ASCII white space, A-Z lower-cased. A text of fewer words than a shingle is one shingle; null and blank texts
have an empty set and are linked with nothing. Equal sets are one node. A doc_id that occurs in several rows is one document. Rows
without a doc_id are linked with nothing and kept. Extra columns are ignored.

Plan. Equal sets are collapsed by an aggregation that combines before its shuffle. In each bucket (band and its registers) members are
tied to the bucket's smallest one, which is linear in the bucket's size; the ties' connected components are the clusters within which links
are possible. Members of a cluster are first confirmed against its busiest member; those confirmed form the core and need no
comparison with each other. Only the rest is compared with the cluster, by blocks of bounded size; what leaves a block are links that
join parts not yet joined, never all pairs. A pair at the threshold shares no band, and so is missed, with probability
(1 - 0.8**6)**42 = 3e-6, unless other links join its documents anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, spread, written

#: Registers, bands and registers of a band; base and rate of the sketch.
M, BANDS, ROWS, BASE, RATE = 256, 42, 6, 1.02, 20.0
#: Members of a block; bits of the smallest and the largest member filter; words whose hash a worker keeps; standard errors that an estimate may fall short.
BLOCK, BITS, MOST_BITS, WORDS_KEPT, SLACK = 120, 24, 29, 300_000, 5.0
#: Elements of a set that are sketched at once.
SLICE = 1 << 16
GOLD = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """Word (bytes) to 64-bit hash; bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 1)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int, known: Hashes) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if not len(w):
        return w
    k = min(k, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mixed(h * GOLD + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def sketch(h: np.ndarray) -> np.ndarray:
    """The registers of a non-empty set of hashes.

    Each element is a Poisson process whose points fall on random registers; a register holds the first point of any element on it,
    on a logarithmic scale. Points are drawn until each element has passed the largest register, so no later one can matter.
    """
    if len(h) > SLICE:  # sketches of parts merge by maxima, so a text of any length needs the memory of one part
        return np.maximum.reduce([sketch(h[at : at + SLICE]) for at in range(0, len(h), SLICE)])
    n = max(2, int(np.ceil(M * (np.log(M) + 5) / len(h))) + 2)
    while True:
        r = mixed(h[:, None] + GOLD * np.arange(1, n + 1, dtype=np.uint64))
        x = np.cumsum(-np.log(((r >> np.uint64(11)).astype("f8") + 0.5) * 2.0**-53), axis=1)
        least = np.full(M, np.inf)
        np.minimum.at(least, (r & np.uint64(M - 1)).astype(np.int64).ravel(), x.ravel())
        if x[:, -1].min() >= least.max():
            break
        n *= 2
    return np.clip(np.floor(1 - np.log(least / (RATE * M)) / np.log(BASE)), 0, 65535).astype(np.uint16)


def bands(registers: np.ndarray) -> np.ndarray:
    """A hash for each band of each row of registers."""
    r = registers[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), r.shape[:2]).copy()
    for i in range(ROWS):
        h = mixed(h * GOLD + r[:, :, i])
    return h


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarities of pairs of sketches (rows of a and b), given both sets' sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 129)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    log = lambda n, x: np.where(n > 0, n * np.log(np.maximum(x, 1e-12)), 0)
    total = log(more, up) + log(less, down) + log(a.shape[1] - more - less, 1 - up - down)
    return j[np.arange(len(j)), total.argmax(1)]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def described(k: int):
    """A map of (doc_id, text) to the set's size, fingerprint and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                n, f1, f2, regs = [], [], [], []
                for t in part.column(1).to_pylist():
                    h = shingles(t, k, known)
                    n.append(len(h))
                    f1.append(int(mixed(h + GOLD).sum().view(np.int64)))
                    f2.append(int(mixed(h ^ GOLD).sum().view(np.int64)))
                    regs.append(sketch(h) if len(h) else np.zeros(M, np.uint16))
                flat = bands(np.stack(regs)).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(flat))],
                    names=["doc_id", "n", "f1", "f2", "bands"],
                )

    return run


def slot(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def member_filter(members: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap with the bits of all member ids set, eight a member, but 2 MB at least and 64 MB at most: built by aggregation in parts of 4 KB.
    Beyond the most, more documents pass that are no members; the result is the same."""
    bits = min(MOST_BITS, max(BITS, int(members.count() * 8).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(slot(b.column(0).to_numpy(zero_copy_only=False), bits))], names=["s"])

    rows = members.select("node").mapInArrow(slots, "s long").groupBy((F.col("s") / 32768).cast("long").alias("part")).agg(F.bitmap_construct_agg(F.col("s") % 32768).alias("bits")).collect()
    out = np.zeros(1 << bits >> 3, np.uint8)
    for r in rows:
        out[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return out, bits


def member_sets(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """doc_id, own (sorted hashes), regs of the documents that pass the member filter: all members, and few others."""
    shared = docs.sparkSession.sparkContext.broadcast(member_filter(members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (packed, bits) = Hashes(), shared.value
        for b in batches:
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            at = slot(ids, bits)
            b = b.filter(pa.array((packed[at >> 3] >> (at & 7) & 1).astype(bool) & b.column(0).is_valid().to_numpy(zero_copy_only=False)))
            for at in range(0, b.num_rows, 512):
                sets = [(i, h) for i, t in zip(b.column(0).slice(at, 512).to_pylist(), b.column(1).slice(at, 512).to_pylist()) if len(h := shingles(t, k, known))]
                if sets:
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in sets], pa.int64()), pa.array([h.tobytes() for _, h in sets], pa.binary()), pa.array([sketch(h).tobytes() for _, h in sets], pa.binary())], names=["doc_id", "own", "regs"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, own binary, regs binary")


def linked(inter, a, b, percent: int):
    return 100 * inter >= percent * (a + b - inter)


def cored(percent: int):
    """Marks the members that are confirmed against their cluster's hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            core = []
            for own, hub in zip(b.column("own").to_pylist(), b.column("hub_own").to_pylist()):
                x, y = np.frombuffer(own, np.uint64), np.frombuffer(hub, np.uint64)
                core.append(percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)) and bool(linked(common(x, y), len(x), len(y), percent)))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("cluster", "node", "hub", "own", "regs")] + [pa.array(core, pa.bool_())], names=["cluster", "node", "hub", "own", "regs", "core"])

    return run


def links_within(t: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links of one block pair that join parts not joined yet: outliers with outliers and with the core."""
    node, core, part = t["node"].to_numpy(), t["core"].to_numpy(), t["part"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in t["own"].to_pylist()]
    regs = np.stack([np.frombuffer(x, np.uint16) for x in t["regs"].to_pylist()])
    n, key = np.array([len(s) for s in sets]), bands(regs)
    alike = np.zeros((len(node), len(node)), bool)
    for c in range(BANDS):
        alike |= key[:, c][:, None] == key[:, c][None, :]
    alike &= ~(core[:, None] & core[None, :]) & (percent * np.maximum(n[:, None], n[None, :]) <= 100 * np.minimum(n[:, None], n[None, :]))
    if len(set(part)) > 1:  # pairs within one block are compared where that block is paired with itself
        alike &= part[:, None] != part[None, :]
    a, b = np.nonzero(np.triu(alike, 1))
    if not len(a):
        return []
    goal = percent / 100
    least = goal - SLACK * np.sqrt(goal * (1 - goal) / M)
    keep = np.concatenate([likely(regs[a[i : i + 4096]], regs[b[i : i + 4096]], n[a[i : i + 4096]], n[b[i : i + 4096]]) >= least for i in range(0, len(a), 4096)])
    a, b = a[keep], b[keep]
    if len(a) > 300:
        _, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), n)
        shared = uses[column] > 1
        row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
        inter = np.zeros((len(sets), len(sets)), np.float64)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
            i, j = np.searchsorted(column, [lo, lo + 8192])
            m = np.zeros((len(sets), 8192), np.float32)
            m[row[i:j], column[i:j] - lo] = 1
            inter += m @ m.T
        found = inter[a, b].astype(np.int64)
    else:
        found = np.array([common(sets[i], sets[j]) for i, j in zip(a, b)], np.int64)
    ok = linked(found, n[a], n[b], percent)
    parent = list(range(len(node)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first_core = int(np.argmax(core)) if core.any() else -1
    for i in np.nonzero(core)[0]:
        parent[i] = first_core
    out = []
    for i, j in zip(a[ok].tolist(), b[ok].tolist()):
        x, y = root(i), root(j)
        if x != y:
            parent[x] = y
            out.append((int(node[i]), int(node[j])))
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs(doc_id, text)``; documents are linked if
    100 * |intersection| >= percent * |union| of their sets of k-word shingles."""
    feats = written(spread(docs.select("doc_id", "text")).mapInArrow(described(k), "doc_id long, n long, f1 long, f2 long, bands array<long>"), "sets")
    sets = ["f1", "f2", "n"]
    real = feats.where("n > 0 and doc_id is not null")
    nodes = real.groupBy(*sets).agg(F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands"))
    keys = nodes.select("node", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("size")).where("size > 1").select("key", "low", "size")
    ties = cut(keys.join(buckets, "key").groupBy("node", "low").agg(F.sum("size").alias("busy")))
    clusters = cut(components(ties.select(F.col("node").alias("a"), F.col("low").alias("b"))).withColumnRenamed("component", "cluster"))
    busy = ties.groupBy("node").agg(F.sum("busy").alias("busy"))
    hubs = clusters.join(busy, "node").groupBy("cluster").agg(F.max(F.struct("busy", "node"))["node"].alias("hub"))
    own = cut(member_sets(docs, clusters, k).dropDuplicates(["doc_id", "own"]).withColumnRenamed("doc_id", "node"))
    members = own.join(clusters, "node")
    hub_sets = own.withColumnsRenamed({"node": "hub", "own": "hub_own"}).drop("regs").join(hubs, "hub")
    tested = cut(members.join(hub_sets, "cluster").select("cluster", "node", "hub", "own", "regs", "hub_own").mapInArrow(cored(percent), "cluster long, node long, hub long, own binary, regs binary, core boolean"))
    parts = F.ceil(F.col("size") / BLOCK)
    counts = tested.groupBy("cluster", "core").agg(F.count("*").alias("size")).groupBy("cluster").agg(F.max(F.when(F.col("core"), parts)).alias("cores"), F.max(F.when(~F.col("core"), parts)).alias("others")).where("others is not null").na.fill(0)
    # Blocks of outliers are numbered 0..others-1, those of the core follow. A pair (i, j) has i <= j and i a block of outliers.
    placed = tested.join(counts, "cluster").withColumn("part", F.when(F.col("core"), F.col("others") + F.pmod(F.xxhash64("node"), "cores")).otherwise(F.pmod(F.xxhash64("node"), "others")))
    placed = placed.withColumn("other", F.explode(F.expr("if(core, sequence(0L, others - 1), sequence(0L, others + cores - 1))"))).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})

    def compared(t: pa.Table) -> pa.Table:
        found = links_within(t, percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    more = placed.groupBy("cluster", "i", "j").applyInArrow(compared, "a long, b long")
    links = tested.where("core and node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).unionByName(more)
    final = components(links)
    of_set = nodes.select(*sets, "node").join(final, "node", "left").select(*sets, F.coalesce("component", "node").alias("component_id"))
    joined = feats.select("doc_id", *sets).join(of_set, sets, "left")
    # An empty set stands for its document alone.
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, that of the smallest doc_id."""
    gone = near_duplicates(docs, k, percent).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
