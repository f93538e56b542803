"""Operator 9: quality classification by a byte-level convolutional network in numpy.

Learned filters of six bytes slide over the whole text (stride two bytes); their responses are max-pooled over overlapping
chunks of 128 bytes, a hidden layer reads each chunk, and the maximum and mean of the hidden units over all chunks give one
probability. The network is fitted on the driver from a bounded sample, at most ``per_class`` labelled documents of each class, the
first by hash of doc_id, and of each at most ``per_document`` bytes, in windows spread over the whole text; it is shipped to the tasks, and scoring
is one pass in the scan's own tasks over whole texts.

A null text is an empty one; empty texts get the network's score of no bytes. Where labels hold fewer than two classes, all score 0.5.
Labels repeated for a document count once, the larger one. A null doc_id is not held out. Repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, first_by_hash, parts, spread

#: Filters, hidden units, bytes of a filter; positions (of two bytes) pooled together, two of which make a chunk; positions handled at once.
FILTERS, HIDDEN, WIDTH, HOP, BLOCK = 24, 16, 6, 32, 1 << 17


def padded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Byte pairs of all texts, each padded by zeros to whole hops, and the hops of each."""
    out, hops = [], []
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass") if t else b""
        n = -(-(len(raw) + WIDTH) // (2 * HOP))
        out.append(raw.ljust(n * 2 * HOP, b"\0"))
        hops.append(n)
    return np.frombuffer(b"".join(out) + bytes(WIDTH), "<u2"), np.array(hops)


class Network:
    """Weights of the filters by byte, the hidden layer, and the output."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.w = (r.standard_normal((WIDTH, 256, FILTERS)) * 0.3).astype("f4")
        self.b = np.zeros(FILTERS, "f4")
        self.a = (r.standard_normal((FILTERS, HIDDEN)) * 0.3).astype("f4")
        self.c = np.full(HIDDEN, 0.1, "f4")
        self.u = (r.standard_normal(2 * HIDDEN) * 0.2).astype("f4")
        self.d = np.zeros(1, "f4")
        self.shift, self.fitted, self.tables = 0.0, True, None

    def __getstate__(self):
        return self.__dict__ | {"tables": None}

    def ready(self) -> list[np.ndarray]:
        """The filters as tables by byte pair, built once."""
        if self.tables is None:
            self.tables = [(self.w[k][None, :, :] + self.w[k + 1][:, None, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]
        return self.tables

    def hop_maxima(self, pairs: np.ndarray, hops: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest response of each filter in each hop of texts with so many hops, and its position."""
        t0, t1, t2 = self.ready()
        n = len(pairs) - WIDTH // 2
        top, at, ends, over = [], [], np.cumsum(hops) - 1, WIDTH // 2 - 1
        for lo in range(0, n, BLOCK):
            hi = min(n, lo + BLOCK)
            h = t0[pairs[lo:hi]]
            h += t1[pairs[lo + 1 : hi + 1]]
            h += t2[pairs[lo + 2 : hi + 2]]
            h = h.reshape(-1, HOP, FILTERS)
            # The last windows of a text would reach into the next one; they, like the one before them, are of zeros alone.
            first, last = np.searchsorted(ends, [lo // HOP, hi // HOP])
            own = ends[first:last] - lo // HOP
            h[own, HOP - over :] = h[own, HOP - over - 1 : HOP - over]
            if where:
                k = h.argmax(1)
                at.append(k + (lo + np.arange(len(h)) * HOP)[:, None])
                top.append(np.take_along_axis(h, k[:, None], 1)[:, 0])
            else:
                top.append(h.max(1))
        return np.concatenate(top), np.concatenate(at) if where else None

    def logits(self, texts: list[str | None]) -> np.ndarray:
        pairs, hops = padded(texts)
        top, _ = self.hop_maxima(pairs, hops)
        first = np.cumsum(hops) - hops
        last = np.zeros(len(top), bool)
        last[first + hops - 1] = True
        x = np.where(last[:, None], top, np.maximum(top, np.roll(top, -1, 0)))
        z = np.maximum(np.maximum(x + self.b, 0) @ self.a + self.c, 0)
        doc = np.concatenate([np.maximum.reduceat(z, first), np.add.reduceat(z, first) / hops[:, None]], 1)
        return doc @ self.u + self.d[0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.logits(texts).astype("f8") + self.shift, -40, 40)))

    def gradients(self, texts: list[str | None], y: np.ndarray) -> tuple[float, dict]:
        """Log-loss of a batch and its gradients, by back-propagation through the maxima."""
        pairs, hops = padded(texts)
        self.tables = None
        top, at = self.hop_maxima(pairs, hops, where=True)
        first = np.cumsum(hops) - hops
        of = np.repeat(np.arange(len(hops)), hops)
        last = np.zeros(len(top), bool)
        last[first + hops - 1] = True
        nxt = np.minimum(np.arange(len(top)) + 1, len(top) - 1)
        other = ~last[:, None] & (top[nxt] > top)
        x = np.where(other, top[nxt], top) + self.b
        r = np.maximum(x, 0)
        pre = r @ self.a + self.c
        z = np.maximum(pre, 0)
        peak, mean = np.maximum.reduceat(z, first), np.add.reduceat(z, first) / hops[:, None]
        doc = np.concatenate([peak, mean], 1)
        p = 1 / (1 + np.exp(-np.clip(doc @ self.u + self.d[0], -40, 40)))
        loss = float(-np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)))
        g = ((p - y) / len(y)).astype("f4")
        g_doc = g[:, None] * self.u
        is_peak = z == peak[of]
        share = is_peak / np.maximum(1, np.add.reduceat(is_peak.astype("f4"), first))[of]
        g_z = g_doc[of, :HIDDEN] * share + g_doc[of, HIDDEN:] / hops[of, None]
        g_pre = g_z * (pre > 0)
        g_x = (g_pre @ self.a.T) * (x > 0)
        spot = np.where(other, at[nxt], at)
        raw = pairs.view(np.uint8)
        w = np.empty_like(self.w)
        f = np.broadcast_to(np.arange(FILTERS), spot.shape)
        for k in range(WIDTH):
            w[k] = np.bincount((raw[2 * spot + k].astype(np.int64) * FILTERS + f).ravel(), g_x.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        return loss, {"w": w, "b": g_x.sum(0), "a": r.T @ g_pre, "c": g_pre.sum(0), "u": doc.T @ g, "d": g.sum(keepdims=True)}


def fit(rows: list[tuple[str | None, int]], prior: float = 0.5, epochs: int = 14, batch: int = 48, rate: float = 0.01, seed: int = 4) -> Network:
    """Fits the network by Adam on (text, label), classes weighted alike; ``prior``, the share of label 1, shifts the scores afterwards."""
    net, r = Network(), np.random.default_rng(seed)
    by = [[t for t, y in rows if y == k] for k in (0, 1)]
    if not all(by):
        net.fitted = False
        return net
    most = max(map(len, by))
    m = {k: np.zeros_like(getattr(net, k)) for k in "wbacud"}
    v, step = {k: x.copy() for k, x in m.items()}, 0
    total = epochs * -(-2 * most // batch)
    for _ in range(epochs):
        order = [(t, y) for y in (0, 1) for t in [by[y][i % len(by[y])] for i in r.permutation(most)]]
        order = [order[i] for i in r.permutation(len(order))]
        for lo in range(0, len(order), batch):
            part = order[lo : lo + batch]
            _, g = net.gradients([t for t, _ in part], np.array([y for _, y in part], "f4"))
            step += 1
            now = rate * min(1, 2 * (1 - step / (total + 1)))
            for k, x in g.items():
                w = getattr(net, k)
                x = x.astype("f4") + (2e-5 * w if k in "wau" else 0)
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.98 * v[k] + 0.02 * x * x
                w -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.98**step)) + 1e-6)
    net.tables = None
    net.shift = math.log(min(max(prior, 1e-3), 1 - 1e-3) / (1 - min(max(prior, 1e-3), 1 - 1e-3)))
    return net


def windows_of(text: str | None, most: int) -> str:
    """The text, or, of one of over ``most`` bytes, 16 windows evenly spaced over the whole of it, ``most`` bytes together."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    if len(raw) <= most:
        return text or ""
    size = most // 16
    return b"".join(raw[k * (len(raw) - size) // 15 :][:size] for k in range(16)).decode("utf-8", "ignore")


def training_rows(docs: DataFrame, labels: DataFrame, may_learn, per_class: int, per_document: int) -> tuple[list[tuple[str | None, int]], float]:
    """(text, label) of at most ``per_class`` documents of each class, at most ``per_document`` bytes of each, and the share of label 1 among all
    labels that may be learnt. Long texts are cut to their windows in the tasks."""
    own = labels.where(may_learn).where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    own = cut(own)
    n, ones = own.agg(F.count("*"), F.sum("quality")).first()
    chosen = first_by_hash(own, "quality", per_class)
    if not chosen:
        return [], 0.5

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([windows_of(t, per_document) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    found = docs.where(F.col("doc_id").isin(sorted(chosen))).select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, text string").collect()
    return [(r.text, chosen[r.doc_id]) for r in sorted(found, key=lambda r: (r.doc_id, r.text))], (ones or 0) / max(n, 1)


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score of every row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            for part in parts(b, 2_000_000):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(net.scores(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return spread(docs.select("doc_id", "text")).mapInArrow(rows, "doc_id long, score double")


def trained(docs: DataFrame, labels: DataFrame, per_class: int = 700, per_document: int = 1 << 16) -> Network:
    """The network learnt where crc32(doc_id) mod 3 is not 1."""
    return fit(*training_rows(docs, labels, crc_mod(3) != 1, per_class, per_document))


def quality(docs: DataFrame, labels: DataFrame, per_class: int = 700, per_document: int = 1 << 16) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs(doc_id, text)``."""
    return scored(docs, trained(docs, labels, per_class, per_document)).select("doc_id", F.coalesce(crc_mod(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame, per_class: int = 700, per_document: int = 1 << 16) -> DataFrame:
    """The rows of ``docs`` whose score is 0.5 or more, with all their columns; one pass, the score beside the row."""
    from pyspark.sql.types import StructType

    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, per_class, per_document))
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            keep = [net.scores(part.column(0).to_pylist()) >= 0.5 for part in parts(pa.RecordBatch.from_arrays([b.column(at)] * 2, names=["t", "text"]), 2_000_000)]
            yield b.filter(pa.array(np.concatenate(keep) if keep else [], pa.bool_()))

    return spread(docs).mapInArrow(rows, StructType.fromJson(docs.schema.jsonValue()))
