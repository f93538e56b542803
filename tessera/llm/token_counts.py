"""Operator 2: exact token counts of every prefix, by prefix dynamic programming over a word-level byte-pair vocabulary.

The table of a word holds the last token, and so the token count, of each of its prefixes; words before a cut are counted once. So a text's
table answers how many tokens any prefix has, and where a budget of tokens ends, without encoding again.

Null and empty texts have no tokens. Texts are normalised, split and counted as the vocabulary's own library does by
default: its special strings inside a text are one token each. Repeated rows give repeated results; extra columns are
ignored; an empty table gives no rows. Counting and cutting are one pass in the scan's own tasks: no shuffle, and memory bounded by what
workers remember and the longest text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import UNSAFE, Memory, byte_symbols, word_file
from .common import parts, spread

VOCABULARY = "word_bpe_49k.json"
#: The pre-tokenizer's pattern, for texts of plain characters, and the special strings of the vocabulary.
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
SPECIAL = re.compile(r"<\|startoftext\|>|<\|endoftext\|>")
#: Runs between ASCII white space: neither normalisation nor the pattern reaches beyond one.
RUN = re.compile(r"[^ \t\n\r]+")
#: Runs of a generation that a worker remembers, and the longest one remembered.
RUNS, LONGEST = 400_000, 64


class Counter:
    """Counts the tokens of texts and of their prefixes."""

    def __init__(self, path: str):
        self.path, self.words, self.memory = path, word_file(path), Memory(RUNS)
        self.by_word = Memory(RUNS)
        self.map = dict(enumerate(byte_symbols()))

    @property
    @lru_cache(1)
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def mapped(self, word: str) -> str:
        return word if word.isascii() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.map)

    def of_runs(self, runs: list[str]) -> list[int]:
        """Tokens of runs of plain characters, in lower case: each different word once, while the worker remembers it."""
        split = [WORD.findall(x) for x in runs]
        words = list({w for ws in split for w in ws})
        known = dict(zip(words, self.by_word.all(words, lambda fresh: [self.words.count(self.mapped(w)) for w in fresh])))
        return [sum([known[w] for w in ws]) for ws in split]

    def of_odd(self, text: str) -> int:
        """Tokens of a text of any characters: its special strings are one each, the rest is normalised and split by the library."""
        rest, n = SPECIAL.split(text), len(SPECIAL.findall(text))
        return n + sum(self.words.count(p) for t in rest if t for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(t)))

    def many(self, texts: list[str | None]) -> list[int]:
        """Tokens of texts: each different run of a batch is counted once, while the worker remembers it."""
        odd = [bool(t) and (UNSAFE.search(t) is not None or "<|" in t) for t in texts]
        split = pc.split_pattern(pa.array([(t or "").lower() for t, o in zip(texts, odd) if not o], pa.large_string()), " ")
        values = split.flatten().dictionary_encode()
        known = np.array(self.memory.all(values.dictionary.to_pylist(), self.of_runs), np.int64)
        sums = iter(np.add.reduceat(known[values.indices.to_numpy()], split.offsets.to_numpy()[:-1]).tolist() if len(split) else [])
        return [self.of_odd(t) if o else next(sums) for t, o in zip(texts, odd)]

    def count(self, text: str | None) -> int:
        return self.many([text])[0]

    def table(self, run: str) -> list[int]:
        """counts[i]: the tokens of run[:i], for a run without ASCII white space."""
        if SPECIAL.search(run):  # prefixes that end inside a special string hold its beginning as ordinary text
            out, before, done = [0], 0, 0
            for m in SPECIAL.finditer(run):
                out += [done + n for n in self.table(run[before : m.start()])[1:]]
                out += [done + self.of_odd(run[before : m.start() + i]) for i in range(1, m.end() - m.start())]
                done, before = out[m.start()] + 1, m.end()
                out.append(done)
            return out + [done + n for n in self.table(run[before:])[1:]]
        low = "".join(c.lower() for c in run)
        if len(low) != len(run) or low != self.library.normalizer.normalize_str(run) or not unicodedata.is_normalized("NFC", run):
            return [self.of_odd(run[:i]) for i in range(len(run) + 1)]  # normalisation reaches beyond single characters
        out, done = [0], 0
        for word, (start, end) in self.library.pre_tokenizer.pre_tokenize_str(low):
            out += [done] * (start - len(out) + 1)
            if word[0] == "'" and end - start > 1 and low[start + 1].isalpha():  # the shorter prefixes of a clitic split otherwise
                out += [done + self.of_odd(low[start:i]) for i in range(start + 1, end + 1)]
            else:
                counts = self.words.counts(word)
                out += [done + counts[i] for i in accumulate(len(c.encode("utf-8", "surrogatepass")) for c in low[start:end])]
            done = out[-1]
        return out + [done] * (len(run) + 1 - len(out))

    def runs(self, text: str) -> tuple[list[re.Match], list[int]]:
        """The runs of a text, and the tokens of each."""
        found = list(RUN.finditer(text))
        return found, self.memory_of([m[0] for m in found])

    def memory_of(self, runs: list[str]) -> list[int]:
        short = list({r for r in runs if len(r) <= LONGEST})
        known = dict(zip(short, self.memory.all(["\0" + r for r in short], lambda fresh: [self.of_odd(x[1:]) for x in fresh])))
        return [known[r] if r in known else self.of_odd(r) for r in runs]

    def prefixes(self, text: str) -> list[int]:
        """counts[i]: the tokens of text[:i], for every i, from one pass: the words before position i are counted once, and
        the word that i cuts has the count of its own prefix from its table."""
        out, done = [0], 0
        for m in RUN.finditer(text):
            out += [done] * (m.start() - len(out) + 1)
            out += [done + n for n in self.table(m[0])[1:]]
            done = out[-1]
        return out + [done] * (len(text) + 1 - len(out))

    def at(self, text: str, positions: list[int]) -> list[int]:
        """Tokens of text[:i] for each of the positions; only the runs that they cut need a table."""
        found, counts = self.runs(text)
        before, starts, tables, out = [0, *accumulate(counts)], [m.start() for m in found], {}, []
        for i in positions:
            k = int(np.searchsorted(starts, i, side="left")) - 1
            if k < 0:
                out.append(0)
            elif i >= found[k].end():
                out.append(before[k + 1])
            else:
                out.append(before[k] + tables.setdefault(k, self.table(found[k][0]) if k not in tables else None)[i - starts[k]])
        return out

    def cut(self, text: str, budget: int) -> str:
        """The longest prefix of at most ``budget`` tokens."""
        return self.within(text, budget)[0]

    def within(self, text: str, budget: int) -> tuple[str, int]:
        """The longest prefix of at most ``budget`` tokens, and its tokens. A prefix that ends beyond a run has that run's tokens at least,
        so only the first run that exceeds the budget needs a table; inside it counts aren't monotone, so its last position within the budget counts."""
        found, counts = self.runs(text)
        done = 0
        for m, n in zip(found, counts):
            if done + n > budget:
                table = self.table(m[0])
                to = max((i for i, c in enumerate(table) if done + c <= budget), default=0)
                return text[: m.start() + to], done + table[to]
            done += n
        return text, done


@lru_cache(2)
def counter(path: str | None = None) -> Counter:
    import public_tokenizers

    return Counter(path or public_tokenizers.path(VOCABULARY))


def token_counts(docs: DataFrame, limit: int = 2048, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs(doc_id, text)``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            for part in parts(b, 8_000_000, 8192):
                n = np.array(c.many(part.column(1).to_pylist()), np.int64)
                size = pc.binary_length(part.column(1)).fill_null(0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return spread(docs.select("doc_id", "text")).mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def truncate(docs: DataFrame, budget: int, path: str | None = None) -> DataFrame:
    """doc_id, text, n_tokens, cut: each text's longest prefix of at most ``budget`` tokens, its tokens, and whether anything was cut off.
    A null text stays null with no tokens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            for part in parts(b, 8_000_000, 8192):
                texts = part.column(1).to_pylist()
                got = [(None, 0) if t is None else c.within(t, budget) for t in texts]
                cut = [len(x or "") < len(t or "") for (x, _), t in zip(got, texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([n for _, n in got], pa.int64()), pa.array(cut, pa.bool_())], names=["doc_id", "text", "n_tokens", "cut"])

    return spread(docs.select("doc_id", "text")).mapInArrow(rows, "doc_id long, text string, n_tokens long, cut boolean")


def prefix_counts(docs: DataFrame, every: int, path: str | None = None) -> DataFrame:
    """doc_id, counts: the tokens of each text's prefixes of ``every``, 2 * ``every``, ... code points, and of the whole. A null text has none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            for part in parts(b, 8_000_000, 8192):
                got = [None if t is None else c.at(t, [*range(every, len(t), every), len(t)]) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.list_(pa.int64()))], names=["doc_id", "counts"])

    return spread(docs.select("doc_id", "text")).mapInArrow(rows, "doc_id long, counts array<long>")


def token_report(counts: DataFrame) -> DataFrame:
    """Totals over a result of ``token_counts``."""
    return counts.agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.count_if("over_limit").alias("over"))
