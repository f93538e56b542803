"""Operator 10: benchmark decontamination by spaced-seed hashing.

Words are lower-cased runs of letters and digits. A seed is a fixed mask laid over consecutive words: only the words under
a 1 are hashed, so a substituted word under a 0 leaves the seed as it is. Seeds of test items and of documents are
joined by hash; around each hit the two word sequences are laid over each other on the hit's diagonal, and the
best-scoring stretch (a match counts 1, a substitution -3) is kept if it has ``least`` matching words, or four fifths of a
shorter item's. The result has a row for each contaminated document and item.

Null and empty texts and items match nothing, nor do items of under 6 words, which are too little evidence. In items of 6 to 10 words some
substitutions leave no seed whole and are missed; exact copies aren't. Rows with the same doc_id count as one document: the best stretch of any.
Rows of one item_id are matched one by one. Extra columns are ignored; an empty table or benchmark gives no rows.

Plan: the seeds of all items set bits of a bitmap of fixed size, whatever the number of items; documents are hashed in the scan's own
tasks, and only words around seeds whose bit is set leave them. The join by hash and the verification follow on those alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parts, spread

#: Fixed masks, all of weight 6.
MASKS = ("111111", "1101011001", "111010011", "110010101001")
#: The bitmap has 2**BITS bits: 2 MB to broadcast at any size of the benchmark.
BITS, BUCKET = 24, 32768
#: Words kept on both sides of a hit at least, and hits' positions in one row. A row keeps as many words on both sides as the longest item has, so
#: whatever item a hit belongs to, the whole of it lies in the hit's row.
MARGIN, REGION = 96, 4096
WORD = re.compile(r"[^\W_]+")
WORDS_KEPT = 300_000


class Hashes(dict):
    """Word to 64-bit hash; bounded."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 11)
        return h


def word_hashes(text: str | None, known: Hashes) -> np.ndarray:
    words = WORD.findall(text.lower()) if text else []
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def seeds(words: np.ndarray) -> Iterator[np.ndarray]:
    """For each mask the hashes at positions 0, 1, ...; masks longer than the text give none."""
    for k, mask in enumerate(MASKS):
        n = len(words) - len(mask) + 1
        if n <= 0:
            yield np.zeros(0, np.uint64)
            continue
        h = np.full(n, 0x9E3779B97F4A7C15 * (k + 1) % 2**64, np.uint64)
        for at, bit in enumerate(mask):
            if bit == "1":
                h ^= words[at : at + n]
                h *= np.uint64(0xFF51AFD7ED558CCD)
                h ^= h >> np.uint64(29)
        yield h


def folded(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, pa.ListArray]:
    """Different hashes, and for each the list of its positions, from (positions, hashes)."""
    at, h = np.concatenate([a for a, _ in found]).astype("i4"), np.concatenate([x for _, x in found]).view(np.int64)
    order = np.argsort(h, kind="stable")
    h, start = np.unique(h[order], return_index=True)
    return h, pa.ListArray.from_arrays(pa.array(np.append(start, len(order)), pa.int32()), pa.array(at[order]))


def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Hashes()
    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = word_hashes(text, known)
            if key is None or not len(words):
                continue
            h, at = folded([(np.arange(len(x)), x) for x in seeds(words)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), key, np.int64)), at, pa.array(h), pa.array(np.full(len(h), len(words), np.int32))], names=["item_id", "at", "h", "n"])


def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Hashes()
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([word_hashes(t, known).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["item_id", "item_words"])


def bitmap(item: DataFrame) -> np.ndarray:
    """Bits set by the items' seeds, two a seed, in one array of 2**BITS bits: aggregated in parts of 4 KB, of which there are 512 at most."""
    both = F.array(F.shiftrightunsigned("h", 64 - BITS), F.shiftrightunsigned("h", 64 - 2 * BITS).bitwiseAND(F.lit((1 << BITS) - 1)))
    bit = item.select(F.explode(both).alias("bit"))
    rows = bit.select((F.col("bit") / BUCKET).cast("long").alias("part"), (F.col("bit") % BUCKET).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(1 << BITS >> 3, np.uint8)
    for r in rows:
        out[r.part * BUCKET // 8 : (r.part + 1) * BUCKET // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def may_hit(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Positions of hashes both of whose bits are set."""
    i = np.nonzero(bits[h >> np.uint64(64 - BITS)])[0]
    return i[bits[h[i] >> np.uint64(64 - 2 * BITS) & np.uint64((1 << BITS) - 1)]]


REGION_ROW = "doc_id long, first long, words binary, hits array<struct<h: long, doc_at: array<int>>>"


def regions_of(key: int, words: np.ndarray, bits: np.ndarray, margin: int) -> Iterator[tuple]:
    """The regions of one document around seeds whose bit is set: (doc_id, first word, words, hits by hash with their places relative to it)."""
    at, hashes = [], []
    for h in seeds(words):
        if len(h):
            i = may_hit(h, bits)
            at.append(i)
            hashes.append(h[i])
    if not at or not sum(map(len, at)):
        return
    at, hashes = np.concatenate(at), np.concatenate(hashes)
    order = np.argsort(at, kind="stable")
    at, hashes = at[order], hashes[order]
    for part in np.split(np.arange(len(at)), np.nonzero(np.diff(at) > 2 * MARGIN)[0] + 1):
        for start in range(at[part[0]], at[part[-1]] + 1, REGION):
            own = part[(at[part] >= start) & (at[part] < start + REGION)]
            if len(own):
                first = max(0, at[own[0]] - margin)
                end = min(len(words), at[own[-1]] + margin + 16)
                h, places = folded([(at[own] - first, hashes[own])])
                yield key, int(first), words[first:end].tobytes(), [{"h": x, "doc_at": y} for x, y in zip(h.tolist(), places.to_pylist())]


def diagonals(pairs: list[dict]) -> np.ndarray:
    """The different diagonals of hits: each place in the document less each place of the same hash in the item."""
    found = np.zeros(0, np.int64)
    for p in pairs:
        x, y = np.array(p["doc_at"], np.int64), np.array(p["at"], np.int64)
        for lo in range(0, len(x), 1024):
            found = np.union1d(found, (x[lo : lo + 1024, None] - y[None, :]).ravel())
    return found


def stretch(a: np.ndarray, b: np.ndarray, diagonal: int, least: int) -> tuple[int, int, int] | None:
    """(matching words, start in a, length) of the best stretch on a diagonal (position in a less position in b), if it suffices."""
    start, end = max(0, diagonal), min(len(a), len(b) + diagonal)
    if end <= start:
        return None
    same = a[start:end] == b[start - diagonal : end - diagonal]
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -3))])
    low = np.minimum.accumulate(total)
    to = int(np.argmax(total - low))
    begin = int(np.argmin(total[: to + 1]))
    n = int(same[begin:to].sum())
    enough = min(least, -(-4 * len(b) // 5)) if len(b) >= 6 else 1 << 30
    return (n, start + begin, to - begin) if n >= enough else None


def verified(least: int):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_match", pa.int32()), ("first_word", pa.int64()), ("n_words", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                x, y = np.frombuffer(r["words"], np.uint64), np.frombuffer(r["item_words"], np.uint64)
                best = max((s for d in diagonals(r["pairs"]).tolist() if (s := stretch(x, y, d, least))), default=None)
                if best:
                    out.append({"doc_id": r["doc_id"], "item_id": r["item_id"], "n_match": best[0], "first_word": r["first"] + best[1], "n_words": best[2]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, item_id, n_match, first_word, n_words: for each document and item that overlap, their best stretch."""
    item = cut(benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(item_seeds, "item_id long, at array<int>, h long, n int"))
    margin = max(MARGIN, item.agg(F.max("n")).first()[0] or 0)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(item))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = Hashes(), np.unpackbits(shared.value, bitorder="little").view(bool)
        hit = pa.struct([("h", pa.int64()), ("doc_at", pa.list_(pa.int32()))])
        kinds = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("words", pa.binary()), ("hits", pa.list_(hit))])
        for b in batches:
            for part in parts(b):
                found = [r for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if k is not None for r in regions_of(k, word_hashes(t, known), bits, margin)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=kinds[i].type) for i, c in enumerate(zip(*found))], schema=kinds)

    region = cut(spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(find, REGION_ROW))
    # A doc_id may have several rows, whose regions may start at the same word: the words tell them apart.
    region = region.withColumn("of", F.xxhash64("words"))
    hits = region.select("doc_id", "first", "of", F.inline("hits")).join(item.select("item_id", "at", "h"), "h")
    pairs = hits.groupBy("doc_id", "first", "of", "item_id").agg(F.collect_set(F.struct("doc_at", "at")).alias("pairs"))
    tokens = benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(tokens_of, "item_id long, item_words binary")
    both = pairs.join(region.select("doc_id", "first", "of", "words").dropDuplicates(["doc_id", "first", "of"]), ["doc_id", "first", "of"]).join(tokens, "item_id")
    found = both.mapInArrow(verified(least), "doc_id long, item_id long, n_match int, first_word long, n_words int")
    best = F.max(F.struct("n_match", (-F.col("first_word")).alias("back"), "n_words")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.n_match", (-F.col("b.back")).alias("first_word"), "b.n_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = 10) -> DataFrame:
    """``docs`` without the contaminated documents."""
    return docs.join(contaminated(docs, benchmark, least).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
