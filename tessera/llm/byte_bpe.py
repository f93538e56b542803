"""Operator 3: byte-level byte-pair encoding and decoding by prefix dynamic programming over a rank file.

Each match of the published split pattern is encoded separately, special strings are ordinary text. Of each byte prefix of a piece the unique
valid last token is stored, so an addition or an edit encodes again only from the change to the end of its piece. A null text is an
empty one: no ids. Repeated rows give repeated results; extra columns are ignored; an empty table gives no rows. One pass in the scan's own
tasks; memory is bounded by what workers remember and the longest text.
"""

from __future__ import annotations

import hashlib
import re
import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import FIRST, UNSAFE, Memory, chunked, gathered, rank_file
from .common import parts, spread

RANKS = "byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern, for texts of plain characters.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Chunks of a generation that a worker remembers by default (``remembered``; it takes some 200 bytes for each of two generations of chunks and as many
#: pieces); characters that a match of the pattern looks ahead.
REMEMBERED, AHEAD = 350_000, 3


class Codec:
    """Encodes texts to ids and back. Ids of a chunk or piece are kept packed as little-endian 32-bit integers."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import public_tokenizers
        import regex

        self.merges, self.chunks, self.memory = rank_file(path), Memory(remembered), Memory(remembered)
        self.merges.limit(remembered)
        self.finditer = regex.compile(public_tokenizers.PATTERN).finditer
        self.bytes_of = {i: t for t, i in self.merges.ids.items()}

    def pieces(self, text: str) -> list[str]:
        return [m[0] for m in self.finditer(text)] if UNSAFE.search(text) else PLAIN.findall(text)

    def packed(self, piece: str) -> bytes:
        ids = self.merges.encode(piece.encode("utf-8", "surrogatepass"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def packed_all(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, each different one encoded once while the worker remembers it."""
        different = list({p for p in pieces if len(p) <= 64})
        known = dict(zip(different, self.memory.all(different, lambda fresh: [self.packed(p) for p in fresh])))
        return [known[p] if p in known else self.packed(p) for p in pieces]

    def of_chunks(self, chunks: list[str]) -> list[bytes]:
        split = [PLAIN.findall(x[1:] if x[:1] == FIRST else " " + x) for x in chunks]
        packed = iter(self.packed_all([p for ps in split for p in ps]))
        return [b"".join([next(packed) for _ in ps]) for ps in split]

    def many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts, packed: each different chunk of a batch is encoded once, while the worker remembers it."""
        odd = [bool(t) and UNSAFE.search(t) is not None for t in texts]
        index, different, counts = chunked([t or "" for t, o in zip(texts, odd) if not o])
        plain = iter(gathered(index, self.chunks.all(different, self.of_chunks), counts, 4))
        return [b"".join(self.packed_all(self.pieces(t))) if o else next(plain) for t, o in zip(texts, odd)]

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, packed."""
        return b"".join(self.packed_all(self.pieces(text))) if text else b""

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode(text), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def append(self, text: str, more: str) -> bytes:
        """Ids of text + more, packed; see ``Encoded`` for keeping an encoded text."""
        e = Encoded(self, text)
        e.append(more)
        return b"".join(e.packed)


class Encoded:
    """An encoded text that can be added to and edited: pieces that a change can't reach keep their ids, and the piece in which it begins
    keeps the prefix table of what stays of it."""

    def __init__(self, codec: Codec, text: str = ""):
        self.codec, self.text, self.starts, self.packed = codec, "", [], []
        self.last: tuple[str, list] = ("", [None])
        self.edit(0, 0, text)

    def ids(self) -> list[int]:
        return np.frombuffer(b"".join(self.packed), "<u4").tolist()

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def one(self, piece: str) -> bytes:
        """Ids of a piece, by the table of the last one where they share a prefix."""
        merges, new, (old, table) = self.codec.merges, piece.encode("utf-8", "surrogatepass"), self.last
        last = merges.edited(old, table, new) if old else merges.prefixes(new)
        self.last = (new, last)
        out, end = [], len(new)
        while end:
            out.append(merges.ids[last[end]])
            end -= len(last[end])
        return struct.pack(f"<{len(out)}I", *reversed(out))

    def edit(self, start: int, end: int, new: str) -> int:
        """Replaces text[start:end] by ``new``; the number of pieces encoded again. The pattern doesn't look behind and looks ahead three characters
        at most, so splitting starts at the last border before those, and stops where it meets an old border behind the change."""
        old, shift = self.text, len(new) - (end - start)
        keep = max(0, bisect_right(self.starts, max(0, start - AHEAD)) - 1)
        at = self.starts[keep] if keep < len(self.starts) else 0
        while keep and at > start - AHEAD:
            keep -= 1
            at = self.starts[keep]
        self.text = text = old[:start] + new + old[end:]
        if keep < len(self.starts):
            piece = old[at : self.starts[keep + 1] if keep + 1 < len(self.starts) else len(old)].encode("utf-8", "surrogatepass")
            self.last = (piece, self.codec.merges.prefixes(piece))
        starts, packed, rest = [], [], len(self.starts)
        if at < len(text):
            for m in self.codec.finditer(text, at):
                if m.start() >= start + len(new) and (k := bisect_left(self.starts, m.start() - shift)) < len(self.starts) and self.starts[k] == m.start() - shift and m.start() - shift >= end:
                    rest = k
                    break
                starts.append(m.start())
                packed.append(self.one(m[0]))
        self.starts = [*self.starts[:keep], *starts, *(x + shift for x in self.starts[rest:])]
        self.packed = [*self.packed[:keep], *packed, *self.packed[rest:]]
        return len(starts)


@lru_cache(2)
def codec(path: str | None = None, remembered: int = REMEMBERED) -> Codec:
    import public_tokenizers

    return Codec(path or public_tokenizers.path(RANKS), remembered)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of every row of ``docs(doc_id, text)``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for part in parts(b, 4_000_000, 8192):
                packed = c.many(part.column(1).to_pylist())
                ends = np.cumsum([0, *(len(x) // 4 for x in packed)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return spread(docs.select("doc_id", "text")).mapInArrow(rows, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, decoded (binary) of every row of ``ids(doc_id, ids)``; null ids decode to no bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.decode(x or ()) for x in part.column(1).to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    return ids.select("doc_id", "ids").mapInArrow(rows, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, decodes the ids and digests both, in one pass over whole texts. ``remembered`` bounds what
    a worker remembers; results don't depend on it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, remembered)
        for b in batches:
            for part in parts(b, 4_000_000, 8192):
                packed = c.many(part.column(1).to_pylist())
                ids = [hashlib.sha256(x).hexdigest() for x in packed]
                decoded = [hashlib.sha256(c.decode(np.frombuffer(x, "<u4").tolist())).hexdigest() for x in packed]
                n = pa.array([len(x) // 4 for x in packed], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return spread(docs.select("doc_id", "text")).mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
