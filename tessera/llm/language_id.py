"""Operator 5: language identification by a linear-chain conditional random field over words.

Each word has an emission score per language from hashed affix, n-gram and lexicon features; learned transitions tie
neighbouring words, so that code-switched text gets one language per word, by forward-backward over the whole text. A
document's language is the one with the highest mean marginal probability over its words, which is also its score.

A null text and one without a letter get ``und`` and score 0. A table without labelled rows teaches no language: all get
``und``. A null doc_id is neither learnt from nor held out. Repeated rows give repeated results; extra columns are ignored.
The model is fitted on the driver from a bounded sample: of each language at most ``per_language`` labelled documents, the first by hash of
doc_id, and of each of those at most ``per_document`` spans of 24 words, evenly spaced over the whole text. Prediction is one pass in the scan's
own tasks over whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, first_by_hash, parts, spread

#: Hashed features have 2**BITS buckets; lexicon words of each language; words of a training sequence; words of a segment in prediction.
BITS, LEXICON, LENGTH, SEGMENT = 15, 400, 24, 128
#: Letters of the longest word learnt from.
LONGEST = 100
WORD = re.compile(r"[^\W\d_]+")
WORDS_KEPT = 200_000
UNKNOWN = "und"


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of lower-cased words, and how many each word has: its 1- to 3-grams with marks at both ends (which hold the affixes
    up to two letters), affixes of three, and for words of a lexicon the word and the set of languages that list it."""
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    end = np.cumsum(n)
    start, owner, left = end - n, np.repeat(np.arange(len(words)), n), np.repeat(end, n) - np.arange(len(codes))
    h, found, of = np.zeros(len(codes), np.uint64), [], []
    for k in range(4):
        h = h[: len(codes) - k] * np.uint64(0x100000001B3) + codes[k:] + np.uint64(k + 1)
        fits = left[: len(h)] > k
        if k == 3:
            fits &= (np.arange(len(h)) == start[owner[: len(h)]]) | (left[: len(h)] == 4)
        found.append(h[fits])
        of.append(owner[: len(h)][fits])
    listed = [(i, m, w) for i, w in enumerate(words) if (m := lexicon.get(w))]
    found.append(np.array([x for _, m, w in listed for x in (m + (1 << 40), zlib.crc32(w.encode("utf-8", "surrogatepass")) + (1 << 41))], np.uint64))
    of.append(np.repeat(np.array([i for i, _, _ in listed], np.int64), 2))
    h, of = np.concatenate(found), np.concatenate(of)
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
    order = np.argsort(of, kind="stable")
    return h[order].astype(np.int64), np.bincount(of, minlength=len(words))


def summed(weights: np.ndarray, idx: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Emission scores of words from their feature buckets."""
    return np.add.reduceat(weights[idx], np.cumsum(sizes) - sizes) / np.sqrt(sizes)[:, None].astype("f4")


class Tagger:
    """The fitted field: emission weights by feature bucket, transitions, and the lexicon."""

    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        self.labels, self.lexicon = labels, lexicon
        self.weights = np.zeros((1 << BITS, len(labels)), np.float32)
        self.trans = np.zeros((len(labels), len(labels)), np.float32)
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(labels)), np.float32)

    def emissions(self, texts: list[list[str]]) -> np.ndarray:
        """exp of the scores of all words of the texts, scaled to a maximum of 1."""
        fresh = {w for ws in texts for w in ws if w not in self.known}
        if len(self.known) + len(fresh) > WORDS_KEPT and self.known:
            self.known, self.rows = {}, self.rows[:0]
            fresh = {w for ws in texts for w in ws}
        if fresh:
            new = list(fresh)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            e = np.concatenate([summed(self.weights, *features(new[i : i + 20_000], self.lexicon)) for i in range(0, len(new), 20_000)])
            self.rows = np.concatenate([self.rows, np.exp(e - e.max(1, keepdims=True))])
        get = self.known.__getitem__
        return self.rows[np.fromiter((i for ws in texts for i in map(get, ws)), np.int64, sum(map(len, texts)))]

    def marginals(self, e: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Sums over the words of each text of the labels' marginal probabilities. e: of all words of all texts, n: words of each, at least 1.

        Texts are cut into segments that step together; each segment's transfer matrix gives the messages at its ends, so the result is that
        of one pass over each whole text.
        """
        size, t = len(self.labels), np.exp(self.trans - self.trans.max())
        parts = -(-n // SEGMENT)
        doc = np.repeat(np.arange(len(n)), parts)
        j = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(np.cumsum(n) - n, parts) + j * SEGMENT
        words = np.minimum(SEGMENT, n[doc] - j * SEGMENT)
        order = np.argsort(-words, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        first, words, of = first[order], words[order], doc[order]
        steps = int(words[0])
        alive = np.searchsorted(-words, -np.arange(steps), side="left")  # segments with more words than this step
        p = np.eye(size, dtype=np.float32)[None] * e[first][:, None, :]
        for k in range(1, steps):
            m = alive[k]
            q = (p[:m].reshape(-1, size) @ t).reshape(m, size, size) * e[first[:m] + k][:, None, :]
            p[:m] = q / q.max((1, 2), keepdims=True)
        enter, leave = np.ones((len(doc), size), np.float32), np.ones((len(doc), size), np.float32)
        head = np.cumsum(parts) - parts
        for k in range(1, int(parts.max())):
            on = place[head[parts > k] + k - 1]
            v = np.einsum("mi,mij->mj", enter[on], p[on]) @ t
            enter[place[head[parts > k] + k]] = v / v.sum(1, keepdims=True)
        for k in range(int(parts.max()) - 1, 0, -1):
            on = place[head[parts > k] + k]
            v = np.einsum("mij,mj->mi", p[on], leave[on]) @ t.T
            leave[place[head[parts > k] + k - 1]] = v / v.sum(1, keepdims=True)
        alpha, a = np.empty_like(e), enter
        for k in range(steps):
            at = first[: alive[k]] + k
            a = a[: alive[k]] * e[at]
            a /= a.sum(1, keepdims=True)
            alpha[at] = a
            a = a @ t
        sums, b = np.zeros((len(doc), size)), leave.copy()
        for k in range(steps - 1, -1, -1):
            m = alive[k]
            at = first[:m] + k
            g = alpha[at] * b[:m]
            sums[:m] += g / g.sum(1, keepdims=True)
            x = (b[:m] * e[at]) @ t.T
            b[:m] = x / x.sum(1, keepdims=True)
        return np.stack([np.bincount(of, sums[:, c], len(n)) for c in range(size)], 1)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        got: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        live = [i for i, ws in enumerate(words) if any(c.isalpha() for w in ws for c in w)]
        if live and self.labels:
            n = np.array([len(words[i]) for i in live])
            for i, p in zip(live, self.marginals(self.emissions([words[i] for i in live]), n) / n[:, None]):
                got[i] = (self.labels[int(p.argmax())], float(min(1.0, p.max())))
        return got


def fit(rows: list[tuple[str, str]], epochs: int = 4, seed: int = 5) -> Tagger:
    """Fits the field on (text, language): sequences of words over the whole of each text, of which a third switch language midway, by Adagrad on the log-likelihood."""
    labels = sorted({lang for _, lang in rows})
    r = np.random.default_rng(seed)
    words = [(WORD.findall(t.lower()), labels.index(lang)) for t, lang in rows]
    counts = [Counter() for _ in labels]
    for ws, y in words:
        counts[y].update(ws)
    lexicon: dict[str, int] = {}
    for y, c in enumerate(counts):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon[w] = lexicon.get(w, 0) | 1 << y
    tagger = Tagger(labels, lexicon)
    if not labels:
        return tagger
    spans = [(ws[i : i + LENGTH], y) for ws, y in words for i in range(0, len(ws), LENGTH) if len(ws[i : i + LENGTH]) >= 2]
    if not spans:
        return tagger
    every = sorted({w for ws, _ in spans for w in ws})
    flat, count = features(every, lexicon)
    begin, at_word = np.cumsum(count) - count, {w: i for i, w in enumerate(every)}
    size, g_w, g_t = 256, np.full(tagger.weights.shape, 1e-2, np.float32), np.full(tagger.trans.shape, 1e-2, np.float32)
    n_labels = len(labels)
    for _ in range(epochs):
        order = r.permutation(len(spans))
        for lo in range(0, len(order), size):
            batch = [spans[i] for i in order[lo : lo + size]]
            seqs = []
            for ws, y in batch:
                other, z = spans[r.integers(len(spans))]
                k = int(r.integers(1, len(ws)))
                seqs.append(([*ws[:k], *other[: LENGTH - k]], [y] * k + [z] * len(other[: LENGTH - k])) if r.random() < 1 / 3 else (ws, [y] * len(ws)))
            ws = np.array([at_word[w] for ws, _ in seqs for w in ws])
            sizes = count[ws]
            owner = np.repeat(np.arange(len(ws)), sizes)
            idx = flat[np.arange(len(owner)) + np.repeat(begin[ws] - (np.cumsum(sizes) - sizes), sizes)]
            scale = (1 / np.sqrt(sizes)).astype("f4")
            e = summed(tagger.weights, idx, sizes)
            n = np.array([len(ws) for ws, _ in seqs])
            first, m = np.concatenate([[0], np.cumsum(n)[:-1]]), LENGTH
            mask = np.arange(m) < n[:, None]
            x = np.zeros((len(n), m, n_labels), np.float32)
            x[mask] = e
            y = np.zeros((len(n), m), int)
            y[mask] = np.concatenate([ys for _, ys in seqs])
            a = np.zeros_like(x)
            a[:, 0] = x[:, 0]
            soft = lambda v, axis: (top := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - top).sum(axis))
            for k in range(1, m):
                step = soft(a[:, k - 1, :, None] + tagger.trans, 1) + x[:, k]
                a[:, k] = np.where(mask[:, k, None], step, a[:, k - 1])
            z = soft(a[:, -1], 1)
            b = np.zeros_like(x)
            pair = np.zeros_like(tagger.trans)
            for k in range(m - 1, 0, -1):
                on = mask[:, k]
                p = np.exp(a[:, k - 1, :, None] + tagger.trans + (x[:, k] + b[:, k])[:, None, :] - z[:, None, None])
                pair += p[on].sum(0)
                np.subtract.at(pair, (y[on, k - 1], y[on, k]), 1)
                b[:, k - 1] = np.where(on[:, None], soft(tagger.trans + (x[:, k] + b[:, k])[:, None, :], 2), 0)
            post = np.exp(a + b - z[:, None, None])[mask]
            post[np.arange(len(post)), y[mask]] -= 1
            grad = (post * scale[:, None])[owner] / len(n)
            full = np.stack([np.bincount(idx, grad[:, c], 1 << BITS) for c in range(n_labels)], 1).astype("f4") + 1e-6 * tagger.weights
            g_w += full**2
            tagger.weights -= 0.3 * full / np.sqrt(g_w)
            pair /= len(n)
            g_t += pair**2
            tagger.trans -= 0.1 * pair / np.sqrt(g_t)
    return tagger


def spans_of(text: str | None, most: int) -> list[str]:
    """At most ``most`` spans of LENGTH words, evenly spaced over the whole text; words of over LONGEST letters are left out."""
    words = [w for w in WORD.findall(text.lower()) if len(w) <= LONGEST] if text else []
    starts = range(0, len(words), LENGTH)
    if len(starts) > most:
        starts = [starts[i * len(starts) // most] for i in range(most)]
    return [" ".join(words[i : i + LENGTH]) for i in starts]


def training_rows(docs: DataFrame, may_learn, per_language: int, per_document: int) -> list[tuple[str, str]]:
    """(span, lang) of at most ``per_language`` documents of each language, at most ``per_document`` spans of each. Ids are chosen from the narrow
    columns; spans are taken in the tasks, so no whole text comes to the driver."""
    learnt = docs.where(may_learn)
    ids = sorted(first_by_hash(learnt.select("doc_id", "lang"), "lang", per_language))
    if not ids:
        return []

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(i, lang, s) for i, lang, t in zip(*(c.to_pylist() for c in b.columns)) for s in spans_of(t, per_document)]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "lang", "span"), r)) for r in got], schema=pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("span", pa.string())]))

    found = learnt.where(F.col("doc_id").isin(ids) & F.col("lang").isNotNull()).select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(rows, "doc_id long, lang string, span string").collect()
    return [(r.span, r.lang) for r in sorted(found, key=lambda r: (r.doc_id, r.lang, r.span)) if r.span]


def identify(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            for part in parts(b):
                got = t.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return spread(docs.select("doc_id", "text")).mapInArrow(rows, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, per_language: int = 300, per_document: int = 24) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learns where crc32(doc_id) mod 5 is not 0, predicts every row."""
    tagger = fit(training_rows(docs, crc_mod(5) != 0, per_language, per_document))
    return identify(docs, tagger).select("doc_id", F.coalesce(crc_mod(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
