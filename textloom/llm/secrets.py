"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials.

For each credential format, a prefix tree of labelled strings over character classes is folded by merging states
whose outgoing and final frequencies are statistically compatible (Hoeffding's bound). What remains is a
probabilistic automaton, which also keeps how often each character stood for its class in each transition. One
more automaton is inferred from ordinary text. Every candidate of a text, which is a long run of credential
characters, is scored by its likelihood under each format against that under ordinary text.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import map_batches

#: The base patterns with the length that a match (assign: its second group) must have. Fixed values.
BASE = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 12, 2),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 18, 0),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 16, 0),
)
#: A text without any of these (in either case) has no match of the first pattern.
WORDS = ("passw", "secret", "token", "api")
KINDS = (*[x[0] for x in BASE], "grammar")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Nats per character, and in all, by which a format must beat ordinary text.
MARGIN, TOTAL = 0.9, 18.0
ALPHA = 0.02
PER_FORMAT = 120

_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALNUM = _LOWER + _UPPER + _DIGIT
#: Public credential formats: name, then pieces, each a literal or (characters, length). Fixed values.
FORMATS = (
    ("github", ("ghp_", (_ALNUM, 36))),
    ("google", ("AIza", (_ALNUM + "_-", 35))),
    ("slack", ("xoxb-", (_DIGIT, 12), "-", (_DIGIT, 12), "-", (_ALNUM, 24))),
    ("stripe", ("sk_live_", (_ALNUM, 24))),
    ("gitlab", ("glpat-", (_ALNUM + "_-", 20))),
    ("sendgrid", ("SG.", (_ALNUM + "_-", 22), ".", (_ALNUM + "_-", 43))),
    ("npm", ("npm_", (_ALNUM, 36))),
    ("jwt", ("eyJ", (_ALNUM, 33), ".eyJ", (_ALNUM + "_-", 60), ".", (_ALNUM + "_-", 43))),
    ("base64", ((_ALNUM + "+/", 40),)),
)


def labelled_credentials(per_format: int = PER_FORMAT, seed: int = 5, vary: bool = False) -> dict[str, list[str]]:
    """Made-up credentials of public formats, the same in every process; if they vary, drawn parts have half to one and a half times their length."""
    pick = random.Random(seed)
    drawn = lambda chars, size: "".join(pick.choices(chars, k=pick.randint(size // 2, size + size // 2) if vary else size))
    return {name: ["".join(p if isinstance(p, str) else drawn(*p) for p in pieces) for _ in range(per_format)] for name, pieces in FORMATS}


def ordinary_strings(count: int = 900, seed: int = 6) -> list[str]:
    """Made-up runs of the kinds that texts hold beside credentials: words, names, numbers, paths, hosts, dates."""
    pick = random.Random(seed)
    syllables = [c + v + e for c in ("", *"bcdfghjklmnprstvwz", "th", "sh", "st", "tr") for v in "aeiou" for e in ("", "n", "r", "s", "t", "l")]
    word = lambda: "".join(pick.choices(syllables, k=pick.randint(1, 4)))
    digits = lambda a, b: "".join(pick.choices(_DIGIT, k=pick.randint(a, b)))
    kinds = (
        lambda: "".join(word() for _ in range(pick.randint(2, 4))),
        lambda: "".join(word() for _ in range(pick.randint(2, 4))).upper(),
        lambda: "".join(word().capitalize() for _ in range(pick.randint(2, 4))),
        lambda: pick.choice("_-.").join(word() for _ in range(pick.randint(3, 5))),
        lambda: "/".join(word() for _ in range(pick.randint(3, 5))) + pick.choice(("", ".html", "/", ".txt")),
        lambda: digits(16, 24),
        lambda: pick.choice("-.").join(digits(2, 4) for _ in range(pick.randint(4, 6))),
        lambda: word() + digits(1, 4) + "." + word() + digits(0, 3) + "." + pick.choice(("com", "org", "example")),
        lambda: word() + "-" + digits(4, 4) + "-" + digits(2, 2) + "-" + digits(2, 2) + "." + word(),
        lambda: pick.choice("=-_.+") * pick.randint(16, 40),
        lambda: ".".join(pick.choice((word(), word().capitalize() + word().capitalize(), word().upper())) for _ in range(pick.randint(3, 6))),
        lambda: pick.choice("_-").join(pick.choice((word().capitalize(), word().upper())) for _ in range(pick.randint(3, 5))) + digits(0, 4),
        lambda: "".join(word().capitalize() for _ in range(pick.randint(3, 6))) + digits(0, 4),
        lambda: "-".join("".join(pick.choices("0123456789abcdef", k=k)) for k in (8, 4, 4, 4, 12)),
    )
    return [pick.choice(kinds)() for _ in range(count)]


def kind_of(c: str) -> str:
    """The class that stands for a character in an automaton; marks stand for themselves."""
    return "0" if c in _DIGIT else "a" if c in _LOWER else "A" if c in _UPPER else c


class Automaton:
    """A probabilistic automaton, learnt by state merging."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.passed: list[Counter] = [Counter()]  # strings that took each transition
        self.shown: list[dict[str, Counter]] = [defaultdict(Counter)]  # the characters that they showed there
        self.ended = [0]
        self.alpha = math.sqrt(0.5 * math.log(2 / alpha))
        self.lengths = (min(map(len, strings)), max(map(len, strings)))
        for s in strings:
            self._add(s)
        self._fold()
        self._weigh()

    def _state(self) -> int:
        self.next.append({})
        self.passed.append(Counter())
        self.shown.append(defaultdict(Counter))
        self.ended.append(0)
        return len(self.next) - 1

    def _add(self, s: str) -> None:
        at = 0
        for c in s:
            k = kind_of(c)
            self.passed[at][k] += 1
            self.shown[at][k][c] += 1
            if k not in self.next[at]:
                self.next[at][k] = self._state()
            at = self.next[at][k]
        self.ended[at] += 1

    def _reached(self, q: int) -> int:
        return self.ended[q] + sum(self.passed[q].values())

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(a / n - b / m) > self.alpha * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, p: int, q: int) -> bool:
        """Whether the strings that go on from two states could be of one distribution."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = self._reached(p), self._reached(q)
            if self._differ(self.ended[p], n, self.ended[q], m):
                return False
            for k in self.passed[p].keys() | self.passed[q].keys():
                if self._differ(self.passed[p][k], n, self.passed[q][k], m):
                    return False
                a, b = self.shown[p][k], self.shown[q][k]
                x, y = sum(a.values()), sum(b.values())
                if any(self._differ(a[c], x, b[c], y) for c in a.keys() | b.keys()):
                    return False
                if k in self.next[p] and k in self.next[q]:
                    todo.append((self.next[p][k], self.next[q][k]))
        return True

    def _merge(self, red: int, blue: int, parent: int, k: str) -> None:
        """Hangs what leads to ``blue`` on ``red``, and folds the tree below it in."""
        self.next[parent][k] = red
        todo = [(red, blue)]
        while todo:
            p, q = todo.pop()
            self.ended[p] += self.ended[q]
            self.passed[p].update(self.passed[q])
            for kind, shown in self.shown[q].items():
                self.shown[p][kind].update(shown)
            for kind, child in self.next[q].items():
                if kind in self.next[p]:
                    todo.append((self.next[p][kind], child))
                else:
                    self.next[p][kind] = child

    def _fold(self) -> None:
        red = [0]
        while True:
            blue = next(((q, k, c) for q in red for k, c in sorted(self.next[q].items()) if c not in red), None)
            if blue is None:
                self.states = red
                return
            parent, k, q = blue
            into = next((p for p in red if self._compatible(p, q)), None)
            if into is None:
                red.append(q)
            else:
                self._merge(into, q, parent, k)

    def _weigh(self) -> None:
        """Log-probabilities of characters by state; what was never seen keeps a little."""
        self.step: dict[int, dict[str, tuple[float, int]]] = {}
        self.end: dict[int, float] = {}
        for q in self.states:
            total = self._reached(q) + 1
            self.end[q] = math.log((self.ended[q] + 0.02) / total)
            self.step[q] = {}
            for k, n in self.passed[q].items():
                own, shown = {"0": _DIGIT, "a": _LOWER, "A": _UPPER}.get(k, k), self.shown[q][k]
                size = sum(shown.values()) + 0.5
                for c in own:
                    self.step[q][c] = (math.log(n / total * (shown[c] + 0.5 / len(own)) / size), self.next[q][k])

    def likelihood(self, s: str, floor: float = -9.0) -> float:
        """The log-likelihood of the string; a character without a transition costs ``floor`` and keeps the state."""
        at, total = 0, 0.0
        for c in s:
            if c in self.step[at]:
                w, at = self.step[at][c]
                total += w
            else:
                total += floor
        return total + self.end[at]


@lru_cache(maxsize=1)
def models() -> tuple[dict[str, Automaton], Automaton]:
    """The automata of all formats, and that of ordinary text; learnt once in a process, the same in each."""
    usual, varied = labelled_credentials(), labelled_credentials(PER_FORMAT // 2, seed=7, vary=True)
    found = {name: Automaton(usual[name] + varied[name]) for name in usual}
    for name, strings in usual.items():
        found[name].lengths = min(map(len, strings)), max(map(len, strings))
    return found, Automaton(ordinary_strings())


def format_of(run: str) -> str | None:
    """The format that a candidate most likely has, if it beats ordinary text by the margins.

    Every format scores every candidate, whatever its length; of the formats that beat ordinary text, those
    learnt at about this length are named first."""
    formats, ordinary = models()
    plain, best = ordinary.likelihood(run), None
    for name, automaton in formats.items():
        gain = automaton.likelihood(run) - plain
        if gain >= max(TOTAL, MARGIN * len(run)):
            least, most = automaton.lengths
            rank = 0.75 * least <= len(run) <= 1.5 * most, gain
            if best is None or rank > best[0]:
                best = rank, name
    return best and best[1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns' matches, in code points; ordered."""
    found = []
    lowered = text.lower()
    for kind, (_, pattern, least, group) in enumerate(BASE):
        if kind == 0 and not any(w in lowered for w in WORDS) or kind == 1 and "AKIA" not in text:
            continue
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda x: (x[0], x[2]))


_MARKS = ".=-+/_"
#: A host that a path follows; what stands behind "//" is a host and path in any case.
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+/")


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Long runs of credential characters that are not of lower-case letters alone, without marks at their ends.

    A host with its path is no run, but each part of it between slashes is one."""
    for m in CANDIDATE.finditer(text):
        run, begin = m[0], m.start()
        for part in run.split("/") if "/" in run and (run.startswith("//") or _HOST.match(run)) else (run,):
            a, b = begin + len(part) - len(part.lstrip(_MARKS)), begin + len(part.rstrip(_MARKS))
            begin += len(part) + 1
            if b - a >= 16 and (not text[a + 1 : b].islower() or any(c in _DIGIT for c in text[a:b])):
                yield a, b


def all_spans(text: str) -> list[tuple[int, int, int]]:
    """The base spans, and those of candidates beside them that have a credential's format."""
    base = base_spans(text)
    added = [(a, b, 3) for a, b in candidates(text) if not any(x < b and a < y for x, y, _ in base) and format_of(text[a:b])]
    return sorted(base + added, key=lambda x: (x[0], x[2])) if added else base


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, b, k in spans])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id column and ``spans``, an array of (start, end, kind) in code points, ordered.

    A null or empty text has none; a long one is scanned whole. Repeated rows have equal spans, null ids stay; other
    columns are left behind; an empty table gives an empty one. Spans of different base kinds may overlap; added ones never overlap base ones."""
    kind = df.schema[id_col].dataType.simpleString()
    shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in all_spans(t.as_py() or "")] for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, shape)], [id_col, "spans"])

    return map_batches(df, [id_col, text_col], f"`{id_col}` {kind}, spans array<struct<start:int,end:int,kind:string>>", kernel)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the hash of the base spans, and all spans as one string."""
    own = F.col("spans")
    count = lambda k: F.size(F.filter(own, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = joined(F.filter(own, lambda s: s["kind"] != "grammar"))
    return scanned.select(id_col, *[count(k) for k in KINDS], F.sha2(base, 256).alias("base_sha256"), joined(own).alias("spans"))


def redact_text(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span, or run of spans that overlap, replaced by the mark."""
    parts, at = [], 0
    for a, b, _ in all_spans(text):
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join([*parts, text[at:]]) if parts else text


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``df``, with the secrets in ``text_col`` replaced by a mark; nulls stay null.

    Empty texts, repeated rows and null ids stay; long texts are scanned whole; an empty table stays empty; columns
    of any other name pass through."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text_col)
        column = batch.column(at)
        clean = [None if t is None else redact_text(t) for t in column.to_pylist()]
        return batch.set_column(at, batch.schema.field(at), pa.array(clean, column.type))

    return map_batches(df, df.columns, df.schema, kernel)


def hashed(spans: list[tuple[int, int, int]]) -> str:
    """The plain form of ``base_sha256``, for tests."""
    return hashlib.sha256(listed([s for s in spans if s[2] < 3]).encode()).hexdigest()
