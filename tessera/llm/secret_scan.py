"""Operator 6: secret scans by grammar inference.

Labelled credentials are put into a prefix tree; states that are statistically compatible (Hoeffding bound on their end and
symbol frequencies, recursively) are merged into a probabilistic automaton. Ordinary identifiers are learnt into a second one in the same way.
Candidates are all stretches of 16 or more credential characters that start at a border of a run (its start, or behind a character that is neither
letter nor digit) and end at one. All are scored: by the likelihood under the first automaton against that under the second; no rule refuses
any. A value that something is set to has a pair of automata of its own, whose credentials include bare hexadecimal tokens. Of the stretches of one start the likeliest counts; those well above the ordinary are added as spans of kind ``format``. They may reach beyond
a base span or between two, so that of a prefixed key nothing stays. Three fixed base kinds (assign, access, hex) are always kept.

Null and empty texts have no spans. Spans are in code points, end exclusive, ordered by start and then kind (assign, access, hex,
format). Repeated rows give repeated results; extra columns are ignored. One pass in the scan's own tasks over whole texts.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re
import string
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame

from .common import per_text, spread

KINDS = ("assign", "access", "hex", "format")
#: The base kinds, and the credential alphabet.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Publicly documented credential formats (prefix, alphabet, lengths), from which labelled examples are drawn.
ALNUM, LOWER_NUM, UPPER_NUM, HEXA, URL_SAFE, BASE64 = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "_-", string.ascii_letters + string.digits + "+/"
FORMATS = (
    ("ghp_", ALNUM, (36,)), ("gho_", ALNUM, (36,)), ("ghs_", ALNUM, (36,)), ("glpat-", URL_SAFE, (20,)), ("npm_", ALNUM, (36,)), ("sk_live_", ALNUM, (24, 32)), ("rk_live_", ALNUM, (24,)), ("sk_live_", HEXA, (24, 32)),
    ("sk-", ALNUM, (48,)), ("AIza", URL_SAFE, (35,)), ("AKIA", UPPER_NUM, (16,)), ("ASIA", UPPER_NUM, (16,)), ("xoxb-", "0123456789-", (12,)), ("xoxp-", "0123456789-", (12,)), ("eyJ", URL_SAFE, (60, 90)),
    ("SG.", URL_SAFE, (66,)), ("", BASE64, (40, 44)), ("", ALNUM, (32, 40)), ("dop_v1_", HEXA, (64,)), ("pypi-", URL_SAFE, (80,)),
)
#: Lengths of the hexadecimal tokens that are secrets where something is set to them; elsewhere such runs are mostly digests of content.
HEX_TOKENS = (("", HEXA, (32, 40, 64)), ("", HEXA.upper(), (32, 40)))
#: What stands before a value that something is set to.
SET_TO = re.compile(r"""[:=]\x20*["']?\Z""")
#: Symbols kept literally at the start of a candidate; later ones count by class.
LITERAL = 4


CLASS = {c: "9" if c.isdigit() else "h" if "a" <= c <= "f" else "l" if c.islower() else "U" if c.isupper() else c for c in ALNUM + "+/_.=-"}


def classes(text: str) -> list[str]:
    """Classes of characters: hexadecimal digit, number, lower and upper case, others themselves."""
    return [CLASS[c] for c in text]


def symbols(text: str) -> list[str]:
    """The automaton's symbols: the first characters themselves, digits aside, then classes."""
    kinds = classes(text)
    return [c if k != "9" else k for c, k in zip(text[:LITERAL], kinds)] + kinds[LITERAL:]


def credential(r: random.Random, fmt: tuple) -> str:
    """One credential of a format."""
    prefix, alphabet, lengths = fmt
    tail = "".join(r.choices(alphabet, k=r.choice(lengths)))
    return prefix + tail + ("-" + "".join(r.choices(ALNUM, k=24)) if prefix.startswith("xox") else "")


def ordinary(r: random.Random) -> str:
    """One ordinary long run: words, names, paths, dates, numbers, UUIDs, addresses, content ids, digests in file names, rulers."""
    parts = ["con", "ter", "ing", "the", "and", "er", "ation", "pro", "data", "file", "ment", "ver", "ly", "est", "user", "io", "sch", "ble", "st", "th", "an", "re", "schaft", "heit", "keit", "ung", "zu", "von", "und", "que", "mente", "ado", "ich", "ber", "ou", "ea", "oux", "li", "ny", "gra"]
    word = lambda: "".join(r.choices(parts, k=r.randint(2, 4)))
    draw = lambda alphabet, n: "".join(r.choices(alphabet, k=n))
    base58, date = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz", f"{r.randint(1990, 2030)}{r.choice(['', '-', '.'])}{r.randint(1, 12):02}{r.choice(['', '-', '.'])}{r.randint(1, 28):02}"
    end = r.choice([".jpg", ".png", ".html", ".tar.gz", ".txt", ".py", ""])
    return (
        lambda: "".join(word() for _ in range(r.randint(2, 9))),
        lambda: r.choice([str.lower, str.title])("".join(word() for _ in range(r.randint(2, 4)))) + r.choice(["", ".", "-", "="]),
        lambda: r.choice("-_./").join(word() for _ in range(r.randint(3, 9))) + end,
        lambda: "".join(word().title() for _ in range(r.randint(2, 7))),
        lambda: f"{date}{r.choice('.T-_')}{r.randint(0, 10**9)}{end}",
        lambda: r.choice("=-._/+") * r.randint(16, 60),
        lambda: f"{word()}_{word()}-{r.randint(0, 9999)}.{word()}/{word()}{end}",
        lambda: "-".join(draw(HEXA, n) for n in (8, 4, 4, 4, 12)),
        lambda: "0x" + draw(r.choice([HEXA, HEXA.upper()]), r.choice((14, 16, 40))),
        lambda: "Qm" + draw(base58, 44),
        lambda: "Qm" + draw(base58, 44) + r.choice(["", "/", "."]) + word(),
        lambda: "bafy" + draw("abcdefghijklmnopqrstuvwxyz234567", 55),
        lambda: "".join(draw(string.ascii_uppercase, 1) + draw(string.ascii_lowercase, r.randint(1, 5)) + draw(string.digits, r.randint(1, 4)) for _ in range(r.randint(3, 8))),
        lambda: f"{r.choice(['IMG', 'DSC', 'VID', 'PXL', 'Screenshot'])}{r.choice(['', '_', '-'])}{date}{r.choice(['', '_', 'x'])}{r.randint(0, 10**8)}{r.choice(['', 'HDR', 'HDRa9', '_edited'])}{end}",
        lambda: f"{word()}/{word()}/{draw(HEXA, r.choice((32, 40, 64)))}{end}",
        lambda: draw(string.digits, r.randint(16, 24)),
        lambda: f"{word().upper()}_{word().upper()}_{word().upper()}{r.choice(['', '_1', '_V2'])}",
        lambda: f"{word()}{r.randint(1, 999)}.{word()}.{word()}/{word()}/{r.randint(1, 99)}/{word()}{end}",
        lambda: f"{word().title()}-{word()}-{r.randint(1, 99)}.{r.randint(0, 9)}.{r.randint(0, 99)}{end}",
    )[r.randrange(19)]()


def labelled(seed: int = 7, each: int = 60, formats: tuple = FORMATS) -> list[tuple[str, int]]:
    """Labelled examples: credentials (1) drawn from the documented formats, and ordinary long runs (0)."""
    r = random.Random(seed)
    return [(credential(r, f), 1) for f in formats for _ in range(each)] + [(ordinary(r), 0) for _ in range(each * 50)]


def assigned(seed: int = 11, each: int = 60) -> list[tuple[str, int]]:
    """Labelled values of assignments: credentials of all formats and hexadecimal tokens (1); ordinary values (0), among which bare digests aren't."""
    r, out = random.Random(seed), []
    while len(out) < each * 25:
        t = ordinary(r)
        if not HEX.fullmatch(t.rpartition("/")[2].partition(".")[0].lower()):
            out.append((t, 0))
    return [(credential(r, f), 1) for f in FORMATS for _ in range(each)] + [(credential(r, f), 1) for f in HEX_TOKENS for _ in range(4 * each)] + out


class Automaton:
    """A probabilistic automaton: arcs[state][symbol] = (next state, count), ends[state] = count."""

    def __init__(self, examples: Iterable[list[str]], alpha: float = 0.05):
        self.arcs: dict[int, dict] = {0: {}}
        self.ends: Counter = Counter()
        self.alpha = alpha
        for word in examples:
            at = 0
            for s in word:
                arcs = self.arcs[at]
                to, n = arcs.get(s, (len(self.arcs), 0))
                if not n:
                    self.arcs[to] = {}
                arcs[s] = (to, n + 1)
                at = to
            self.ends[at] += 1
        self.infer()

    def total(self, state: int) -> int:
        return self.ends[state] + sum(n for _, n in self.arcs[state].values())

    def alike(self, x: int, nx: int, y: int, ny: int) -> bool:
        return abs(x / nx - y / ny) < math.sqrt(math.log(2 / self.alpha) / 2) * (1 / math.sqrt(nx) + 1 / math.sqrt(ny))

    def compatible(self, a: int, b: int) -> bool:
        """Whether two states end and continue alike, and so do the states they lead to."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.total(a), self.total(b)
            if not na or not nb:
                continue
            if not self.alike(self.ends[a], na, self.ends[b], nb):
                return False
            for s in {*self.arcs[a], *self.arcs[b]}:
                ta, ca = self.arcs[a].get(s, (None, 0))
                tb, cb = self.arcs[b].get(s, (None, 0))
                if not self.alike(ca, na, cb, nb):
                    return False
                if ca and cb and ta != tb:
                    todo.append((ta, tb))
        return True

    def fold(self, into: int, tree: int) -> None:
        """Adds the counts of a subtree to a state and to what follows it."""
        todo = [(into, tree)]
        while todo:
            into, tree = todo.pop()
            self.ends[into] += self.ends.pop(tree, 0)
            for s, (to, n) in self.arcs.pop(tree).items():
                if s in self.arcs[into]:
                    own, m = self.arcs[into][s]
                    self.arcs[into][s] = (own, m + n)
                    todo.append((own, to))
                else:
                    self.arcs[into][s] = (to, n)

    def infer(self) -> None:
        """Merges states, nearest the root first; a state that is compatible with no settled one becomes settled."""
        settled = [0]
        known = {0}
        while True:
            front = [(state, s, to) for state in settled for s, (to, _) in self.arcs[state].items() if to not in known]
            if not front:
                return
            state, s, to = max(front, key=lambda x: self.arcs[x[0]][x[1]][1])
            for other in settled:
                if self.compatible(other, to):
                    self.arcs[state][s] = (other, self.arcs[state][s][1])
                    self.fold(other, to)
                    break
            else:
                settled.append(to)
                known.add(to)

    def logs(self) -> dict[int, dict[str, tuple[int, float]]]:
        """Log-probabilities of the arcs."""
        return {a: {s: (to, math.log(n / self.total(a))) for s, (to, n) in arcs.items()} for a, arcs in self.arcs.items()}


class Model:
    """Scores candidates: log-likelihood ratio of the format automaton against that of ordinary runs, both smoothed by their symbols' frequencies."""

    #: Share of the frequencies in a step that an automaton knows; how far a ratio may fall below its best before the rest is another candidate's;
    #: symbols of a candidate, and its log-likelihood ratio, at least.
    SMOOTH, DROP, LEAST, SURE = 0.1, 8.0, 16, 10.0
    #: Characters by which starts are remembered.
    SEEN = 80

    def __init__(self, examples: list[tuple[str, int]], threshold: float = 0.3):
        self.threshold = threshold
        self.good, self.bad = (self.tables([t for t, y in examples if y == kind]) for kind in (1, 0))

    def tables(self, texts: list[str]) -> tuple[dict, dict, dict, float]:
        """Steps by state and symbol, end costs by state, fallback costs by symbol, and that of an unknown one."""
        words = [symbols(t) for t in texts]
        automaton = Automaton(words)
        seen = Counter(s for w in words for s in w)
        total = sum(seen.values()) + 64
        share = {s: (n + 1) / total for s, n in seen.items()}
        steps, ends = {}, {}
        for a, arcs in automaton.arcs.items():
            n = automaton.total(a) or 1
            steps[a] = {s: (to, math.log((1 - self.SMOOTH) * m / n + self.SMOOTH * share[s])) for s, (to, m) in arcs.items()}
            ends[a] = math.log(max(automaton.ends[a] / n, 1e-3))
        return steps, ends, {s: math.log(self.SMOOTH * p) for s, p in share.items()}, math.log(self.SMOOTH / total)

    def best(self, run: str, start: int, kinds: list[str] | None = None) -> tuple[float, int, int]:
        """(total ratio, end, reach) of the likeliest candidate from ``start``; (0, start, reach) if none is likelier than ordinary. No character from ``reach``
        on was looked at. ``kinds`` are the classes of the run's characters, which are the same from every start."""
        (s1, e1, f1, u1), (s2, e2, f2, u2) = self.good, self.bad
        kinds = kinds or classes(run)
        a = b = 0
        ratio, top, found, peak = 0.0, 0.0, start, 0.0
        n = len(run)
        for i in range(start, n):
            s = kinds[i]
            if i < start + LITERAL and s != "9":
                s = run[i]
            x = s1.get(a)
            x = x.get(s) if x else None
            y = s2.get(b)
            y = y.get(s) if y else None
            # An automaton without the step stays where it is and pays for the symbol alone.
            a, p = x if x else (a, f1.get(s, u1))
            b, q = y if y else (b, f2.get(s, u2))
            ratio += p - q
            if ratio > peak:
                peak = ratio
            elif ratio < peak - self.DROP:
                break
            if i + 1 - start >= self.LEAST and (i + 1 == n or not run[i + 1].isalnum()):
                # Where a run goes on behind a border, neither automaton has ended for sure: ends count at the run's end alone.
                whole = ratio + (e1[a] - e2[b] if i + 1 == n else 0.0)
                if whole >= max(self.SURE, self.threshold * (i + 1 - start)) and whole > top:
                    top, found = whole, i + 1
        return top, found, i + 2

    def found(self, run: str, at: int = 0) -> list[tuple[int, int]]:
        """The credentials in a run of credential characters from ``at`` on: the first likely start, its likeliest end, and so on behind it.

        Starts that are followed by the same characters, as far as a search looked, end alike; rulers, paths and tables of the same pieces are searched once.
        """
        out, n, kinds, vain = [], len(run), classes(run), set()
        while at <= n - self.LEAST:
            if (at == 0 or not run[at - 1].isalnum()) and run[at : at + self.SEEN] not in vain:
                _, end, reach = self.best(run, at, kinds)
                if end > at:
                    out.append((at, end))
                    at = end
                    continue
                if reach <= min(n, at + self.SEEN):
                    vain.add(run[at : at + self.SEEN])
            at += 1
        return out

    def score(self, text: str) -> float:
        """The best ratio of a candidate in the text, 0 if none is likelier a credential."""
        return max((self.best(text, a)[0] for a, _ in self.found(text)), default=0.0)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Models(NamedTuple):
    """A model for values that something is set to (``name = "value"``, ``name: value``), and one for all other runs."""

    bare: Model
    value: Model

    def found(self, run: str, is_value: bool) -> list[tuple[int, int]]:
        """The credentials in a run; its own start, if it is a value, and the starts behind an equals sign within it are judged as values."""
        starts = [0] * is_value + [m.end() for m in re.finditer("=", run)]
        out: list[tuple[int, int]] = []
        for at, to in zip(starts, [x - 1 for x in starts[1:]] + [len(run)]):
            if to - at >= Model.LEAST:
                _, end, _ = self.value.best(run[at:to], 0)
                if end:
                    out.append((at, at + end))
        for a, b in self.bare.found(run):
            k = bisect.bisect_left(out, (a, b))
            if not (k and out[k - 1][1] > a or k < len(out) and out[k][0] < b):
                out.insert(k, (a, b))
        return out


def spans(text: str | None, model: Model | Models) -> tuple[list, list]:
    """The base spans, and all spans: those and the stretches that the automata score as credentials, unless one base span holds them."""
    if not text:
        return [], []
    base, more = base_spans(text), []
    for m in CANDIDATE.finditer(text):
        for a, b in model.found(m[0], SET_TO.search(text, max(0, m.start() - 80), m.start()) is not None) if isinstance(model, Models) else model.found(m[0]):
            a, b = a + m.start(), b + m.start()
            if not any(s <= a and b <= e for s, _, e in base):
                more.append((a, 3, b))
    return base, sorted(base + more) if more else base


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scanner(model: Model | Models) -> Callable:
    def one(key, text):
        base, every = spans(text, model)
        n = Counter(k for _, k, _ in base)
        return key, n[0], n[1], n[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)

    return one


def trained(examples: list[tuple[str, int]] | None = None) -> Model:
    """Fits the model from labelled credentials (the documented formats' examples if none are given)."""
    return Model(labelled() if examples is None else examples)


@functools.cache
def models() -> Models:
    """The models of the documented formats, fitted once a session."""
    return Models(trained(), trained(assigned()))


def secret_scan(docs: DataFrame, model: Model | Models | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of ``docs(doc_id, text)``."""
    model = model or models()
    return docs.transform(per_text("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", lambda: scanner(model)))


def redactor(model: Model | Models, mark: str) -> Callable:
    def one(key, text):
        if not text:
            return key, text
        out, at = [], 0
        for a, _, b in spans(text, model)[1]:
            if b > at:
                out += [text[at : max(a, at)], mark]
                at = b
        return key, "".join(out) + text[at:]

    return one


def redact(docs: DataFrame, model: Model | Models | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span of its text replaced by ``mark`` (overlapping spans by one); null stays null. Other columns as they are."""
    from pyspark.sql.types import StructType

    model, names = model or models(), docs.columns
    schema = StructType.fromJson(docs.schema.jsonValue())

    def rows(batches):
        import pyarrow as pa

        one = redactor(model, mark)
        at = names.index("text")
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array([one(None, t)[1] for t in b.column(at).to_pylist()], type=b.schema.field(at).type))

    return spread(docs).mapInArrow(rows, schema)
