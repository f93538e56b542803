"""Byte-pair encoding by prefix dynamic programming.

For a byte-pair vocabulary each prefix of a piece has exactly one valid last token: the token that ends the encoding of
that prefix. Given the last tokens of all shorter prefixes, the one of the next prefix is the token that ends there and
*stays apart* from the last token of what precedes it. Storing the last token (and so the token count) of each prefix
makes appends exact in one step a byte, answers "how many tokens has this prefix" at once, and lets an edit re-encode
only from the edited place on.

Two merges dialects are read: rank files, where any two neighbours whose concatenation has a rank merge, and merge
lists, where only the listed pair does and where the last symbol of a piece carries an end-of-word mark.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of the worker's caches; a full cache is emptied, so a worker's memory is bounded whatever the corpus.
PIECES, PAIRS, STEPS = 250_000, 150_000, 300_000
#: Prefixes up to this length are kept across pieces.
SHORT = 16
NEVER = 1 << 60


class Merges:
    """A vocabulary: ``ids`` of tokens (bytes or str), the rank at which each token is made, and what each was made of."""

    def __init__(self, ids: dict, ranks: dict, made_of: dict | None, empty):
        self.ids, self.ranks, self.made_of, self.empty = ids, ranks, made_of, empty
        self.longest = max(map(len, ids))
        self.halves: dict = {}
        self.pairs: dict = {}
        self.steps: dict = {}
        self.most_pairs, self.most_steps = PAIRS, STEPS

    def limit(self, remembered: int) -> None:
        """Keeps the caches of pairs and prefixes within a bound."""
        self.most_pairs, self.most_steps = min(PAIRS, remembered), min(STEPS, remembered)

    def rank(self, a, b) -> int:
        """When a and b, as neighbours, merge; NEVER if they don't."""
        t = a + b
        if self.made_of is None:
            return self.ranks.get(t, NEVER)
        return self.ranks[t] if self.made_of.get(t) == (a, b) else NEVER

    def symbols(self, piece) -> list:
        return [piece[i : i + 1] for i in range(len(piece))]

    def by_merging(self, parts: list, below: int = NEVER) -> list:
        """The defining procedure: merge the leftmost pair of least rank until none is left. Used for single tokens and in tests."""
        parts = list(parts)
        while len(parts) > 1:
            least, at = min((self.rank(a, b), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if least >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def half(self, t):
        """The two tokens whose merge makes t; () for a symbol; None if the procedure never makes t."""
        got = self.halves.get(t, 0)
        if got == 0:
            s = self.symbols(t)
            if len(s) == 1:
                got = ()
            else:
                got = self.by_merging(s, self.ranks.get(t, -1))
                got = tuple(got) if len(got) == 2 and self.rank(*got) == self.ranks[t] else None
            self.halves[t] = got
        return got

    def apart(self, a, b) -> bool:
        """Whether text a+b is encoded as a, b. The merges on both sides of the boundary are undone, the latest first; the
        two tokens that face each other must not merge before the later of them was made."""
        key = (a, b)
        known = self.pairs.get(key)
        if known is not None:
            return known
        halves, ranks, half, rank, until, ok = self.halves, self.ranks, self.half, self.rank, NEVER, True
        while True:
            if rank(a, b) < until:
                ok = False
                break
            ha, hb = halves.get(a, 0), halves.get(b, 0)
            if ha == 0:
                ha = half(a)
            if hb == 0:
                hb = half(b)
            if ha and (not hb or ranks[a] > ranks[b]):
                until, a = ranks[a], ha[1]
            elif hb:  # of equal ranks the left merge comes first, so the right one is undone first
                until, b = ranks[b] + 1, hb[0]
            else:
                break
        if len(self.pairs) >= self.most_pairs:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def last_token(self, piece, last: list, end: int, close=None):
        """The last token of piece[:end], given ``last`` for all shorter prefixes. ``close`` is the end-of-word mark, if the prefix ends the word."""
        ids, halves = self.ids, self.halves
        for at in range(end - min(end, self.longest), end):
            t = piece[at:end] if close is None else piece[at:end] + close
            if t in ids and (halves.get(t) or self.half(t) is not None) and (not at or last[at] is not None and self.apart(last[at], t)):
                return t
        return None

    def prefixes(self, piece, last: list | None = None) -> list:
        """last[i]: the last token of piece[:i]; last[0] is None. A list for a shorter prefix is continued: an exact append."""
        last = [None] if last is None else last
        steps = self.steps
        for end in range(len(last), len(piece) + 1):
            prefix = piece[:end] if end <= SHORT else None
            t = steps.get(prefix)
            if t is None:
                t = self.last_token(piece, last, end)
                if prefix is not None:
                    if len(steps) >= self.most_steps:
                        steps.clear()
                    steps[prefix] = t
            last.append(t)
        return last

    def edited(self, old, last: list, new) -> list:
        """The list for ``new``, keeping what ``old`` and ``new`` share as a prefix."""
        same = next((i for i, (x, y) in enumerate(zip(old, new)) if x != y), min(len(old), len(new)))
        return self.prefixes(new, last[: same + 1])

    def encode(self, piece) -> list:
        """Token ids of one piece, read back from the last prefix."""
        last, out, end = self.prefixes(piece), [], len(piece)
        while end:
            out.append(self.ids[last[end]])
            end -= len(last[end])
        out.reverse()
        return out


class WordMerges(Merges):
    """Merge-list dialect over mapped bytes, the last symbol of a piece carrying ``mark``."""

    mark = "</w>"

    def symbols(self, t) -> list:
        if t.endswith(self.mark):
            body = t[: -len(self.mark)]
            return [*body[:-1], body[-1] + self.mark]
        return list(t)

    def open_counts(self, piece: str) -> tuple[list, list[int]]:
        last, counts = self.prefixes(piece[:-1]), [0]
        for end in range(1, len(piece)):
            counts.append(counts[end - len(last[end])] + 1)
        return last, counts

    def closed(self, piece: str, end: int, last: list, counts: list[int]) -> int:
        """Tokens of the word piece[:end]."""
        t = self.last_token(piece, last, end, self.mark)
        return counts[end - len(t) + len(self.mark)] + 1

    def count(self, piece: str) -> int:
        """Tokens of the word."""
        return self.closed(piece, len(piece), *self.open_counts(piece))

    def counts(self, piece: str) -> list[int]:
        """Tokens of the words piece[:0], piece[:1], ... piece."""
        last, counts = self.open_counts(piece)
        return [0, *(self.closed(piece, end, last, counts) for end in range(1, len(piece) + 1))]


@lru_cache(4)
def rank_file(path: str) -> Merges:
    """Reads a rank file: base64 token, rank."""
    with open(path, "rb") as f:
        ids = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return Merges(ids, {t: r for t, r in ids.items() if len(t) > 1}, None, b"")


@lru_cache(4)
def word_file(path: str) -> WordMerges:
    """Reads the model of a tokenizer file with an end-of-word mark."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in model["merges"]]
    return WordMerges(model["vocab"], {a + b: i for i, (a, b) in enumerate(pairs)}, {a + b: (a, b) for a, b in pairs}, "")


def byte_symbols() -> str:
    """The printable stand-in of each byte in such files: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256))
    return "".join(chr(b) if b in plain else chr(256 + next(rest)) for b in range(256))


#: Texts of these characters alone take the fast patterns: in them, word characters are letters, digits and _, and both
#: the standard library and the tokenizers agree on white space and case.
UNSAFE = re.compile("[^\t\n\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]")
#: A space before a character that is none: there the split patterns always start a new piece.
BORDER = re.compile(r" (?=\S)")
#: In a text without these, and that doesn't end in a space, every space is such a border.
RUNS = ("  ", " \n", " \t", " \r", " \x0b", " \x0c", " \xa0", " \x85")
#: Marks the first chunk of a text, which has no space before it; no text of plain characters holds it.
FIRST = "\0"


def regular(text: str) -> bool:
    """Whether every space of the text is a border."""
    return text[-1:] != " " and not any(r in text for r in RUNS)


def chunked(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Texts of plain characters cut at their borders, each different chunk once: for all chunks in order its place among the different
    ones, the different ones, and the chunks of each text. A chunk stands for " " + chunk, but the first of a text, marked by FIRST, for
    itself without the mark; the pieces of a text are those of its chunks."""
    split, counts, at = [], np.zeros(len(texts), np.int64), np.array([regular(t) for t in texts], bool)
    plain = pc.split_pattern(pa.array([FIRST + t for t, ok in zip(texts, at) if ok], pa.large_string()), " ")
    counts[at] = np.diff(plain.offsets.to_numpy())
    rough = [BORDER.split(FIRST + t) for t, ok in zip(texts, at) if not ok]
    counts[~at] = [len(x) for x in rough]
    values = pa.concat_arrays([plain.flatten(), pa.array([x for xs in rough for x in xs], pa.large_string())]).dictionary_encode()
    index = values.indices.to_numpy()
    if rough:  # back into the order of the texts
        start = np.cumsum(counts[at]).tolist()
        pos = {True: iter(np.split(index[: int(counts[at].sum())], start[:-1])) if start else iter(()), False: iter(np.split(index[int(counts[at].sum()) :], np.cumsum(counts[~at])[:-1]))}
        index = np.concatenate([next(pos[bool(ok)]) for ok in at])
    return index, values.dictionary.to_pylist(), counts


def gathered(index: np.ndarray, packed: list[bytes], counts: np.ndarray, width: int) -> list[bytes]:
    """For each text its chunks' ids, joined. ``packed``: the ids of each different chunk, ``width`` bytes each."""
    if not len(counts):
        return []
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // width
    flat, begin, n = np.frombuffer(b"".join(packed), f"<u{width}"), np.cumsum(sizes) - sizes, sizes[index]
    ids = flat[np.repeat(begin[index] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    ends = np.cumsum(np.add.reduceat(n, np.cumsum(counts) - counts)) * width
    raw = ids.tobytes()
    return [raw[i:j] for i, j in zip([0, *ends.tolist()], ends.tolist())]


class Memory:
    """What a worker remembers, of the last two generations: bounded whatever the corpus, and what is frequent stays."""

    def __init__(self, most: int):
        self.most, self.known, self.before = most, {}, {}

    def all(self, keys: list, learn) -> list:
        """The values of different keys; ``learn`` gives those of keys not remembered, in order."""
        if len(self.known) > self.most:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        got, fresh = list(map(known.get, keys)), []
        for at in missing(got):
            if (kept := before.get(keys[at])) is None:
                fresh.append(at)
            else:
                got[at] = known[keys[at]] = kept
        for at, x in zip(fresh, learn([keys[at] for at in fresh])):
            got[at] = known[keys[at]] = x
        return got


def missing(got: list) -> list[int]:
    """Where a list holds None."""
    out, at = [], -1
    try:
        while True:
            at = got.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out
