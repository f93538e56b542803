"""Operator 4: token ids in files coded by an adaptive context-mixing range coder.

Ids follow each other in ascending doc_id order (ties by text; null first), each document closed by an end id. They are cut into blocks
that are coded independently: every block starts from the same model and carries a checksum of its ids. Three orders predict an id: order 2 the
one last seen after the same two ids, order 1 the one last seen after the same one, both with a confidence, and order 0 all ids by how often they
occurred. Their predictions are mixed: each context of confidences has weights of the three orders, which follow which of them held, and an id's
probability is the weighted sum. One interval of that mixture codes an id. All arithmetic is in integers, so any machine decodes what another has
coded. The ids of a block are laid out in lanes that are coded side by side and share the block's model.

File: rows (part, row, doc_ids, lengths, coded), written and read by Spark; part ascends with doc_id and row within part. ``coded``: blocks, each
preceded by its size. A block: magic, its ids, lanes, alphabet and checksum, then the words of each lane, then all words of 32 bits, little-endian.

Null and empty texts have the end id alone. Repeated rows and tied doc_ids follow each other in the order of their texts. Extra columns are
ignored; an empty table gives no rows. A block that fails its checksum raises an error.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import UNSAFE
from .common import parts, written

VOCABULARY = "byte_bpe_50k.json"
MAGIC = b"TCM2"
#: Lanes coded side by side, ids of a lane at least (but in the smallest blocks) and ids of a block at most.
LANES, STEPS, BLOCK = 4096, 1024, 1 << 23
#: Bits of the order-2 table, highest confidence, bits of order 0's shares and of the orders' weights, and steps between recounts.
SLOTS, SURE, ZERO, SHARE, EVERY = 19, 7, 18, 10, 64
#: Pieces that a worker remembers, bytes from which on one is long, and bytes and rows of text that it encodes at once.
PIECES, LONG, BYTES, ROWS = 1_000_000, 64, 24_000_000, 8192
#: Kinds of bytes in UTF-8, 0 where the lead byte doesn't tell; a letter's further bytes take the kind of its first.
LETTER, QUOTE, OTHER, WHITE, BLANK = 1, 2, 3, 4, 5
KIND = np.array([(LETTER if chr(b).isalpha() else {"'": QUOTE, " ": BLANK}.get(chr(b), WHITE if chr(b).isspace() else OTHER)) if b < 128 else LETTER if 0xC3 <= b <= 0xC9 else 0 for b in range(256)], np.uint8)
FULL, WHOLE = np.uint64(32), np.uint64(ZERO + SHARE)
SCHEMA = "part int, row int, doc_ids array<long>, lengths array<int>, coded binary"


class Writer:
    """Range coders of all lanes: 64-bit low and range, 32-bit words out, carries added to the words before."""

    def __init__(self, lanes: int, most: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
        self.out, self.at = np.zeros((lanes, most), np.uint32), np.zeros(lanes, np.int64)

    def code(self, start: np.ndarray, size: np.ndarray) -> None:
        """Codes an interval of 2**WHOLE for each of the first lanes."""
        m = len(start)
        r = self.range[:m] >> WHOLE
        low = self.low[:m] + r * start
        r *= size
        over = np.nonzero(low < self.low[:m])[0]
        if len(over):
            self.carry(over, self.at[over] - 1)
        short = np.nonzero(r < 1 << 32)[0]
        if len(short):
            x, at = low.take(short), self.at.take(short)
            self.out[short, at] = x >> FULL
            self.at[short] = at + 1
            low[short] = x << FULL
            r[short] = r.take(short) << FULL
        self.low[:m], self.range[:m] = low, r

    def carry(self, lane: np.ndarray, at: np.ndarray) -> None:
        while len(lane):
            self.out[lane, at] += np.uint32(1)
            on = self.out[lane, at] == 0
            lane, at = lane[on], at[on] - 1

    def words(self) -> list[np.ndarray]:
        for _ in range(2):
            self.out[np.arange(len(self.at)), self.at] = self.low >> FULL
            self.low <<= FULL
            self.at += 1
        return [self.out[i, :n] for i, n in enumerate(self.at)]


class Reader:
    """The decoders of all lanes: code and range, relative to low."""

    def __init__(self, flat: np.ndarray, n: np.ndarray):
        self.flat = np.concatenate([flat, np.zeros(2, flat.dtype)]).astype(np.uint64)
        at = np.cumsum(n) - n
        self.range = np.full(len(n), 2**64 - 1, np.uint64)
        self.value = self.flat[at] << FULL | self.flat[at + 1]
        self.at = at + 2

    def peek(self, m: int) -> np.ndarray:
        """Where in 2**WHOLE the code of each of the first lanes lies."""
        return np.minimum(self.value[:m] // (self.range[:m] >> WHOLE), np.uint64((1 << int(WHOLE)) - 1)).view(np.int64)

    def code(self, start: np.ndarray, size: np.ndarray) -> None:
        m = len(start)
        r = self.range[:m] >> WHOLE
        value = self.value[:m] - r * start
        r *= size
        short = np.nonzero(r < 1 << 32)[0]
        if len(short):
            at = self.at.take(short)
            value[short] = value.take(short) << FULL | self.flat.take(at, mode="clip")
            self.at[short] = at + 1
            r[short] = r.take(short) << FULL
        self.value[:m], self.range[:m] = value, r


class Orders:
    """The model of a block, shared by its lanes: the ids last seen after the same two ids and after the same one, each with a confidence;
    how often all ids occurred; and how often either prediction held in each pair of confidences, from which the three orders' weights follow."""

    def __init__(self, alphabet: int):
        self.alphabet, self.counts = alphabet, np.zeros(alphabet, np.int64)
        self.one, self.two = np.zeros(1 << 16, np.int64), np.zeros(1 << SLOTS, np.int64)
        held = np.arange(SURE + 1)
        k2, k1, same = (x.ravel() for x in np.meshgrid(held, held, np.arange(2), indexing="ij"))
        #: By context (confidences, whether both predict the same): how often order 2 held, order 1 alone did, neither did.
        self.seen = np.stack([1 + 4 * k2, (1 + 2 * k1) * (1 - same), 4 + 0 * k2], 1).astype(np.int64) << 4
        self.recount()
        self.weigh()

    def recount(self, ids: np.ndarray | None = None) -> None:
        """Takes up the ids seen since the last call: each id's share of 2**ZERO, at least 1, the rest going to the most frequent."""
        if ids is not None:
            self.counts += np.bincount(ids, minlength=self.alphabet)
        spare = (1 << ZERO) - self.alphabet
        freq = 1 + self.counts * spare // max(1, int(self.counts.sum()))
        freq[int(freq.argmax())] += (1 << ZERO) - int(freq.sum())
        self.freq, self.cum = freq, np.cumsum(freq) - freq
        self.symbol = np.repeat(np.arange(self.alphabet), freq)

    def weigh(self) -> None:
        """Weights of the orders in each context, of 2**SHARE together; order 0 keeps at least one."""
        w = (self.seen[:, :2] << SHARE) // self.seen.sum(1)[:, None]
        self.w2, self.w1 = np.ascontiguousarray(w[:, 0]), np.ascontiguousarray(w[:, 1])
        self.w0 = (1 << SHARE) - self.w2 - self.w1

    def learn(self, outcome: np.ndarray) -> None:
        self.seen += np.bincount(outcome, minlength=self.seen.size).reshape(self.seen.shape) << 4
        self.seen -= np.where(self.seen.sum(1) > 1 << 16, self.seen.T >> 3, 0).T
        np.maximum(self.seen, 1, out=self.seen)
        self.weigh()


def coded(ids: np.ndarray, n: int, alphabet: int, coder) -> None:
    """Codes (Writer) or fills (Reader) the n ids of a block, ids[step, lane]; lane i holds the i-th stretch of the block, the last may be shorter.

    The probability of an id is the sum of the three orders' weights times what each gives it: all to its prediction for orders 2 and 1, the
    share of the id for order 0. One interval of the mixture codes one id.
    """
    reading, (steps, lanes) = isinstance(coder, Reader), ids.shape
    tail = n - (lanes - 1) * steps
    model = Orders(alphabet)
    p1, p2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    done, again = 0, 1
    for t in range(steps):
        m = lanes if t < tail else lanes - 1
        if t == again:
            model.recount(np.concatenate([ids[done:t, : lanes - 1].ravel(), ids[done : min(t, tail), lanes - 1]]))
            done, again = t, min(2 * t, t + EVERY)
        p1, p2 = p1[:m], p2[:m]
        slot = (p1 * 0x9E3779B1 + p2 * 0x85EBCA6B >> 12) & (1 << SLOTS) - 1
        e2, e1 = model.two.take(slot), model.one.take(p1)
        c2, k2, c1, k1 = e2 & 0xFFFF, e2 >> 16, e1 & 0xFFFF, e1 >> 16
        same = c1 == c2
        context = (k2 * (SURE + 1) + k1) * 2 + same
        w2, w1, w0 = model.w2.take(context) << ZERO, model.w1.take(context) << ZERO, model.w0.take(context)
        if reading:
            v = coder.peek(m)
            low2 = w0 * model.cum.take(c2) + (c1 < c2) * w1
            low1 = w0 * model.cum.take(c1) + (c2 < c1) * w2
            high2 = low2 + w0 * model.freq.take(c2) + w2 + same * w1
            high1 = low1 + w0 * model.freq.take(c1) + w1 + same * w2
            rest = v - (v >= high2) * w2 - (v >= high1) * w1
            x = model.symbol.take(rest // w0, mode="clip")
            x = np.where((v >= low2) & (v < high2), c2, np.where((v >= low1) & (v < high1), c1, x))
            ids[t, :m] = x
        else:
            x = ids[t, :m].astype(np.int64)
        hit2, hit1 = x == c2, x == c1
        start = w0 * model.cum.take(x) + (c2 < x) * w2 + (c1 < x) * w1
        size = w0 * model.freq.take(x) + hit2 * w2 + hit1 * w1
        coder.code(start.view(np.uint64), size.view(np.uint64))
        model.learn(context * 3 + np.where(hit2, 0, 2 - hit1))
        # A prediction that held is surer; one that failed loses half its confidence, or its place.
        model.two[slot] = np.where(hit2, e2 + ((k2 < SURE).astype(np.int64) << 16), np.where(k2 > 1, k2 >> 1 << 16 | c2, x))
        model.one[p1] = np.where(hit1, e1 + ((k1 < SURE).astype(np.int64) << 16), np.where(k1 > 1, k1 >> 1 << 16 | c1, x))
        p1, p2 = x, p1


def compress(ids: np.ndarray) -> bytes:
    """The coded form of one block of at most BLOCK ids."""
    n = len(ids)
    if not n:
        return MAGIC + struct.pack("<IIII", 0, 0, 0, 0)
    steps = -(-n // min(LANES, -(-n // STEPS)))
    lanes, alphabet = -(-n // steps), int(ids.max()) + 1
    laid = np.zeros(lanes * steps, np.uint16)
    laid[:n] = ids
    w = Writer(lanes, steps + 8)
    coded(np.ascontiguousarray(laid.reshape(lanes, steps).T), n, alphabet, w)
    words = w.words()
    head = struct.pack("<IIII", n, lanes, alphabet, zlib.crc32(ids.astype("<u2").tobytes()))
    return MAGIC + head + np.array([len(x) for x in words], "<u4").tobytes() + np.concatenate(words).astype("<u4").tobytes()


def decompress(data: bytes) -> np.ndarray:
    """The ids of a coded block; raises ValueError if it isn't what was written."""
    if data[:4] != MAGIC or len(data) < 20:
        raise ValueError("not a token file")
    n, lanes, alphabet, check = struct.unpack_from("<IIII", data, 4)
    if not n:
        return np.zeros(0, np.uint16)
    steps = -(-n // max(1, lanes))
    sizes = np.frombuffer(data, "<u4", min(lanes, (len(data) - 20) // 4), 20).astype(np.int64)
    if not 0 < lanes <= LANES or not 0 < alphabet <= 1 << 16 or len(data) != 20 + 4 * (lanes + int(sizes.sum())) or len(sizes) != lanes or (sizes < 2).any() or n > BLOCK:
        raise ValueError("a block's head fails its check")
    ids = np.zeros((steps, lanes), np.uint16)
    coded(ids, n, alphabet, Reader(np.frombuffer(data, "<u4", int(sizes.sum()), 20 + 4 * lanes), sizes))
    out = np.ascontiguousarray(ids.T).reshape(-1)[:n]
    if zlib.crc32(out.astype("<u2").tobytes()) != check:
        raise ValueError("a block fails its checksum")
    return out


def pieces(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """Texts of plain characters cut where the vocabulary's pattern always starts a new piece and what stands before is split as if it ended there,
    and each text's end among the pieces. Borders are: a space before what is no white space; an ASCII non-letter after a letter; a letter after an
    ASCII non-letter but a space (it joins the letter), an apostrophe (of 's) and the second of two white spaces (the first would have joined it)."""
    column = pa.array(texts, pa.string())
    if not (total := int(pc.sum(pc.binary_length(column)).as_py() or 0)):
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int32, len(texts) + 1).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8, total)
    kind = KIND[data]
    signs = np.nonzero(data == 0xC3)[0]  # multiplication and division are no letters
    kind[signs[np.isin(data[signs + 1], (0x97, 0xB7))]] = 0
    tails = np.nonzero((data & 0xC0) == 0x80)[0]
    kind[tails] = kind[tails - 1]
    letter, white = kind == LETTER, kind >= WHITE
    border = np.zeros(total, bool)
    border[:-1] = (kind[:-1] == BLANK) & (kind[1:] != 0) & ~white[1:]
    border[ends[1:][ends[1:] > 0] - 1] = False
    border[1:] |= letter[:-1] & (kind[1:] > LETTER)
    joins = letter[1:] & ((kind[:-1] == OTHER) | (kind[:-1] == WHITE))
    joins[1:] &= ~(white[1:-1] & (white[:-2] | (kind[:-2] == 0)))
    border[1:] |= joins
    border[ends[:-1][ends[:-1] < total]] = True
    at = np.append(np.nonzero(border)[0], total).astype(np.int32)
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), column.buffers()[2]), np.searchsorted(at, ends[1:])


class Known:
    """Pieces that a worker remembers with their ids, in flat arrays; past its bound, in pieces or in bytes of them, the half that was used last
    stays, but for the long ones."""

    def __init__(self, most: int):
        self.most, self.now = most, 0
        self.keys, self.flat = pa.array([], pa.string()), np.zeros(0, np.uint16)
        self.size, self.used = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def all(self, values: pa.StringArray, learn) -> np.ndarray:
        """The places of pieces; ``learn`` gives the ids of different ones not remembered."""
        if len(self.keys) > self.most or self.keys.nbytes > 2 * LONG * self.most:
            stay = np.sort(np.argsort(self.used, kind="stable")[-(self.most // 2) :])
            stay = stay[pc.binary_length(self.keys.take(pa.array(stay))).to_numpy() <= LONG]
            self.flat, self.keys = self.ids(stay), self.keys.take(pa.array(stay))
            self.size, self.used = self.size[stay], self.used[stay]
        self.now += 1
        values = values.dictionary_encode()
        different = values.dictionary
        at = pc.index_in(different, value_set=self.keys).fill_null(-1).to_numpy(zero_copy_only=False).copy()
        fresh = np.nonzero(at < 0)[0]
        if len(fresh):
            order, flat, size = learn(different.take(pa.array(fresh)).to_pylist())
            fresh = fresh[order]
            at[fresh] = len(self.keys) + np.arange(len(fresh), dtype=np.int32)
            self.keys = pa.concat_arrays([self.keys, different.take(pa.array(fresh))])
            self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
            self.used = np.concatenate([self.used, np.zeros(len(fresh), np.int32)])
        self.used[at] = self.now
        return at[values.indices.to_numpy()]

    def ids(self, index: np.ndarray) -> np.ndarray:
        """The ids of the pieces at these places, joined."""
        begin, n = np.cumsum(self.size) - self.size, self.size[index]
        ends = np.cumsum(n)
        return self.flat[np.repeat(begin[index] - (ends - n), n) + np.arange(int(n.sum()))]


class Encoder:
    """Encodes texts by the tokenizers library: each different piece once, while the worker remembers it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.known = Tokenizer.from_file(path), Known(PIECES)
        (self.line,) = self.library.encode("\n", add_special_tokens=False).ids

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of pieces, and in that order their ids, joined, and how many each has. Words are encoded some hundred at once, and told apart by
        the line ends between them."""
        word = np.array([x.isalpha() or x[:1] == " " and x[1:].isalpha() for x in fresh], bool)
        words, rest = [x for x, w in zip(fresh, word) if w], [x for x, w in zip(fresh, word) if not w]
        lines = self.ids_of(["\n".join(words[i : i + 100]) + "\n" for i in range(0, len(words), 100)])
        packed = np.concatenate([*lines, np.zeros(0, np.uint16)])
        ends, others = np.nonzero(packed == self.line)[0], self.ids_of(rest)
        if len(ends) != len(words):
            raise ValueError("a word holds a line's end")
        size = np.append(np.diff(ends, prepend=-1) - 1, np.array([len(x) for x in others], np.int64))
        return np.argsort(~word, kind="stable"), np.concatenate([packed[packed != self.line], *others]), size.astype(np.int32)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts as little-endian 16-bit integers."""
        odd = [bool(t) and (UNSAFE.search(t) is not None or "<|endoftext|>" in t) for t in texts]
        values, last = pieces([t or "" for t, o in zip(texts, odd) if not o])
        index = self.known.all(values, self.learn)
        ends = np.append(0, np.cumsum(self.known.size[index], dtype=np.int64))[last] * 2
        raw = self.known.ids(index).astype("<u2").tobytes()
        plain = iter([raw[i:j] for i, j in zip([0, *ends.tolist()], ends.tolist())])
        whole = iter(self.ids_of([t for t, o in zip(texts, odd) if o]))
        return [next(whole).astype("<u2").tobytes() if o else next(plain) for o in odd]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def packed(path: str | None, end_id: int):
    """Encodes and codes a sorted partition of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        from pyspark import TaskContext

        library, part = encoder(path or public_tokenizers.path(VOCABULARY)), TaskContext.get().partitionId()
        end, row, docs, held, size = struct.pack("<H", end_id), 0, [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(held), "<u2")
            got = [[part], [row], [[d for d, _ in docs]], [[n for _, n in docs]], [b"".join(struct.pack("<I", len(c)) + c for c in (compress(ids[i : i + BLOCK]) for i in range(0, max(1, len(ids)), BLOCK)))]]
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(got, (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()))], names=["part", "row", "doc_ids", "lengths", "coded"])

        for b in batches:
            for part_of in parts(b, BYTES, ROWS):
                for key, ids in zip(part_of.column(0).to_pylist(), library.encode(part_of.column(1).to_pylist())):
                    docs.append((key, len(ids) // 2 + 1))
                    held += [ids, end]
                    size += docs[-1][1]
                    if size >= BLOCK:
                        yield flush()
                        row, docs, held, size = row + 1, [], [], 0
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, partitions: int | None = None, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes the token file of ``docs(doc_id, text)`` into the shared folder and gives it as read again."""
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return written(ranged.mapInArrow(packed(path, end_id), SCHEMA), "tokens")


def read_ids(coded_row: bytes) -> np.ndarray:
    out, at = [], 0
    while at < len(coded_row):
        (k,) = struct.unpack_from("<I", coded_row, at)
        out.append(decompress(coded_row[at + 4 : at + 4 + k]))
        at += 4 + k
    return np.concatenate(out)


def read_tokens(file: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the file.

    A row's start is that of its part, from the parts' totals (one number a part, gathered on the driver), and of the rows before it in the part.
    """
    sized = file.withColumn("ids", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))
    totals = sorted((r.part, r.ids) for r in sized.groupBy("part").agg(F.sum("ids").alias("ids")).collect())
    starts = np.cumsum([0, *(n for _, n in totals)])
    base = file.sparkSession.createDataFrame([(p, int(s)) for (p, _), s in zip(totals, starts)] or [(-1, 0)], "part int, base long")
    rows = sized.select("part", "row", (F.sum("ids").over(Window.partitionBy("part").orderBy("row")) - F.col("ids")).alias("before")).join(base, "part").select("part", "row", (F.col("base") + F.col("before")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys, n, at = b["doc_ids"][i].as_py(), np.array(b["lengths"][i].as_py(), np.int64), b["start"][i].as_py()
                ids, ends = read_ids(b["coded"][i].as_py()).astype("<u4"), np.cumsum(n)
                if len(ids) != ends[-1]:
                    raise ValueError("a row holds another number of ids than its documents")
                crc = [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends, n)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(at + ends - n), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return file.join(rows, ["part", "row"]).select("doc_ids", "lengths", "coded", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
