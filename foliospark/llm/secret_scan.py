"""Secret scans: base patterns, and formats inferred from labelled credentials as probabilistic automata.

For every format a prefix tree of its labelled credentials is built and states whose futures are
statistically compatible (Hoeffding bounds on stopping and on every symbol, checked down the subtrees)
are merged until none are left to merge. One more automaton is inferred from labelled harmless tokens.
Every candidate token of a text is scored by the log likelihood of its best format, its end included, against the harmless
automaton's. A format never ends at a length that none of its labelled credentials comes near. Where a whole run of token characters is none, the parts of it that start after a
separator or where a format can start are scored, up to every separator. How short and how long a candidate is, and where it may start inside
a run (after a separator, or at the first characters that all labelled credentials of a format share), follow from the labelled
credentials; a format whose credentials share no first character is found after separators only.

Null text counts as empty. Whole texts are searched; spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from .shared import text_batches

#: The base patterns; a match counts if its measured part has so many characters.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
_RUN = "[A-Za-z0-9+/_.=-]"
#: Labelled examples of each format to infer from, the bound's confidence, the least log likelihood ratio, and how far beyond labelled lengths a format may end.
EXAMPLES, ALPHA, MIN_SCORE, LONGER = 150, 0.05, 8.0, 0.1
#: What a base span within a candidate adds to its log likelihood ratio.
KNOWN = 20.0
#: Characters at the start of a token that stand for themselves; later ones stand for their class.
LITERAL = 4

_LOW, _UP, _DIG = string.ascii_lowercase, string.ascii_uppercase, string.digits
#: Published credential formats (universally unique ids are names, not secrets) as (fixed text | alphabet, least and most characters) parts.
FORMATS: dict[str, list] = {
    "github": ["ghp_", (_LOW + _UP + _DIG, 36, 36)],
    "slack": ["xoxb-", (_DIG, 11, 13), "-", (_DIG, 11, 13), "-", (_LOW + _UP + _DIG, 24, 24)],
    "stripe": ["sk_live_", (_LOW + _UP + _DIG, 24, 32)],
    "google": ["AIza", (_LOW + _UP + _DIG + "_-", 35, 35)],
    "npm": ["npm_", (_LOW + _UP + _DIG, 36, 36)],
    "gitlab": ["glpat-", (_LOW + _UP + _DIG + "_-", 20, 20)],
    "jwt": ["eyJ", (_LOW + _UP + _DIG + "_-", 17, 40), ".eyJ", (_LOW + _UP + _DIG + "_-", 20, 60), ".", (_LOW + _UP + _DIG + "_-", 43, 43)],
    "sendgrid": ["SG.", (_LOW + _UP + _DIG + "_-", 22, 22), ".", (_LOW + _UP + _DIG + "_-", 43, 43)],
}
#: Shapes of harmless tokens.
HARMLESS: list[list] = [
    [(_LOW, 16, 30)], [(_UP, 1, 1), (_LOW, 15, 28)], [(_DIG, 16, 19)], [(_LOW, 3, 9), ".", (_LOW, 3, 9), ".", "com"], ["mail", (_DIG, 1, 1), ".example.com"],
    [(_LOW, 3, 9), "_", (_LOW, 3, 9), "_", (_LOW, 3, 9)], [(_LOW, 3, 9), "-", (_LOW, 3, 9), "-", (_LOW, 3, 9)], [(_LOW, 3, 9), "/", (_LOW, 3, 9), "/", (_LOW, 3, 9), ".", (_LOW, 2, 4)],
    [(_DIG, 4, 4), "-", (_DIG, 2, 2), "-", (_DIG, 2, 2), "-", (_DIG, 6, 6)], ["................"], ["----------------"], ["================"], [(_UP, 16, 24)], [(_LOW, 1, 8), (_UP, 1, 1), (_LOW, 5, 9), (_UP, 1, 1), (_LOW, 5, 9)],
    [(_LOW + _UP + _DIG, 16, 160)], [(_LOW + _UP + _DIG + "_-", 16, 160)],
]

SCANNED = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_CLASS = str.maketrans({c: k for k, cs in (("d", _DIG), ("h", "abcdef"), ("l", "ghijklmnopqrstuvwxyz"), ("H", "ABCDEF"), ("U", "GHIJKLMNOPQRSTUVWXYZ")) for c in cs})


def examples(shapes: list[list], n: int, seed: int) -> list[str]:
    """n labelled tokens of the given shapes, the same ones for the same seed."""
    rng = random.Random(seed)
    return ["".join(p if isinstance(p, str) else "".join(rng.choices(p[0], k=rng.randint(p[1], p[2]))) for p in shapes[i % len(shapes)]) for i in range(n)]


def symbols(token: str) -> str:
    return token[:LITERAL] + token[LITERAL:].translate(_CLASS)


def labels(n: int = EXAMPLES) -> dict[str, list[str]]:
    """n labelled credentials of each published format, and harmless tokens under the empty name."""
    return {name: examples([shape], n, 7 + i) for i, (name, shape) in enumerate(FORMATS.items())} | {"": examples(HARMLESS, 4 * n, 5)}


class Automaton:
    """A probabilistic automaton inferred by merging compatible states of a prefix tree."""

    FLOOR = math.log(1e-6)

    def __init__(self, tokens: list[str], alpha: float = ALPHA):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.count, self.stop, self.next = [0], [0], [{}]
        for token in tokens:
            state = 0
            self.count[0] += 1
            for s in symbols(token):
                if s not in self.next[state]:
                    self.next[state][s] = len(self.count)
                    self.count.append(0)
                    self.stop.append(0)
                    self.next.append({})
                state = self.next[state][s]
                self.count[state] += 1
            self.stop[state] += 1
        self.edges = [dict.fromkeys(n, 0) for n in self.next]
        for state, following in enumerate(self.next):
            for s, to in following.items():
                self.edges[state][s] = self.count[to]
        sizes = [len(t) for t in tokens]
        self.prefix = os.path.commonprefix(tokens)[:LITERAL]  # what every labelled token begins with, and of which classes its start is
        self.starts = [{t[i : i + 1].translate(_CLASS) for t in tokens} for i in range(LITERAL)]
        self.shortest, self.longest = min(sizes, default=0), int(max(sizes, default=0) * (1 + LONGER))
        self._infer()
        self.ends = [math.log(self.stop[q] / self.count[q]) if self.stop[q] else self.FLOOR for q in range(len(self.count))]
        self.logs = [{s: (to, math.log(self.edges[q][s] / self.count[q])) for s, to in self.next[q].items()} if self.count[q] else {} for q in range(len(self.count))]

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(a / n - b / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.count[a], self.count[b]
            if self._differ(self.stop[a], n, self.stop[b], m):
                return False
            for s in self.edges[a].keys() | self.edges[b].keys():
                if self._differ(self.edges[a].get(s, 0), n, self.edges[b].get(s, 0), m):
                    return False
                if s in self.next[a] and s in self.next[b]:
                    todo.append((self.next[a][s], self.next[b][s]))
        return True

    def _fold(self, red: int, blue: int) -> None:
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            self.stop[a] += self.stop[b]
            for s, to in self.next[b].items():
                self.edges[a][s] = self.edges[a].get(s, 0) + self.edges[b][s]
                if s in self.next[a]:
                    todo.append((self.next[a][s], to))
                else:
                    self.next[a][s] = to

    def _infer(self) -> None:
        red = [0]
        while True:
            kept = set(red)
            blue = next(((q, s, to) for q in red for s, to in sorted(self.next[q].items()) if to not in kept), None)
            if blue is None:
                return
            q, s, to = blue
            for r in red:
                if self._compatible(r, to):
                    self.next[q][s] = r
                    self._fold(r, to)
                    break
            else:
                red.append(to)

    def begins(self, token: str) -> bool:
        return token.startswith(self.prefix) and all(c.translate(_CLASS) in seen for c, seen in zip(token, self.starts))

    def score(self, token: str, strict: bool = True) -> float:
        """Log likelihood of the token's symbols and of its end. A symbol that a state never saw costs FLOOR; if strict, another start
        than all labelled tokens have, or a length out of reach, costs everything."""
        if strict and not (self.begins(token) and self.shortest <= len(token) <= self.longest):
            return -math.inf
        state, total = 0, 0.0
        logs = self.logs
        for s in symbols(token):
            step = logs[state].get(s)
            if step is None:
                total += self.FLOOR
            else:
                state = step[0]
                total += step[1]
        return total + self.ends[state]

    def sums(self, tail: str, known: bool = False) -> list[float] | None:
        """The score if it ended after so many of the symbols; None if known and the start is another than all labelled tokens have."""
        if known and not self.begins(tail[:LITERAL]):
            return None
        state, total, out = 0, 0.0, [self.ends[0]]
        for s in tail:
            step = self.logs[state].get(s)
            if step is None:
                total += self.FLOOR
            else:
                state = step[0]
                total += step[1]
            out.append(total + self.ends[state])
        return out


class Scanner:
    """Automata of labelled tokens: {format: credentials}, harmless ones under the empty name; by default examples of published formats."""

    def __init__(self, labelled: dict[str, list[str]] | None = None, alpha: float = ALPHA, min_score: float = MIN_SCORE):
        labelled = dict(labelled or labels())
        self.harmless = Automaton(labelled.pop("", []), alpha)
        self.formats = {name: Automaton(tokens, alpha) for name, tokens in labelled.items()}
        self.min_score = min_score
        # how short and how long a credential may be, and where one may start within a run, follow from the labelled ones
        self.least = max(1, min((a.shortest for a in self.formats.values()), default=1))
        self.longest = max((a.longest for a in self.formats.values()), default=0)
        self.candidate = re.compile(f"{_RUN}{{{self.least},}}")
        heads = "|".join(sorted({re.escape(a.prefix) for a in self.formats.values() if a.prefix}))
        self.inner = re.compile("(?<=[+/_.=-])(?=[A-Za-z0-9])" + (f"|(?={heads})" if heads else ""))

    def format_of(self, token: str) -> tuple[str, float]:
        """The likeliest format, and the log of how much likelier it is than a harmless token."""
        least = self.harmless.score(token, strict=False)
        name, best = max(((k, a.score(token)) for k, a in self.formats.items()), key=lambda x: x[1])
        return name, best - least

    def parts(self, run: str) -> list[tuple[int, int, str]]:
        """(start, end, format) of the likeliest disjoint parts of a run that is no candidate of a format itself."""
        classes, found = run.translate(_CLASS), []
        for start in sorted({0} | {m.start() for m in self.inner.finditer(run)}):
            size = min(len(run) - start, self.longest)
            if size < self.least:
                break
            tail, ends, least = run[start : start + LITERAL] + classes[start + LITERAL : start + size], [], None
            for name, automaton in self.formats.items():
                sums = automaton.sums(tail, known=True)
                if sums is None:
                    continue
                if least is None:
                    least = self.harmless.sums(tail)
                    ends = [n for n in range(self.least, size) if not run[start + n].isalnum()] + [size]
                more = [(sums[n] - least[n], start, start + n, name) for n in ends if automaton.shortest <= n <= automaton.longest and sums[n] - least[n] >= self.min_score]
                found += [max(more)] if more else []
        out: list[tuple[int, int, str]] = []
        for _, start, end, name in sorted(found, key=lambda x: (-x[0], x[1:])):
            if not any(s < end and start < e for s, e, _ in out):
                out.append((start, end, name))
        return out

    def base(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, rank of the kind, kind, end) in order."""
        out = []
        for rank, (kind, (pattern, group, least)) in enumerate(BASE.items()):
            for m in pattern.finditer(text):
                if m.end(group) - m.start(group) >= least:
                    out.append((m.start(), rank, kind, m.end()))
        return sorted(out)

    def spans(self, text: str) -> tuple[list[tuple[int, int, str, int]], list[tuple[int, int, str, int]]]:
        """Base spans, and all spans: base ones, and what they leave of the candidates of an inferred format."""
        base = self.base(text)
        more = []
        for m in self.candidate.finditer(text) if self.formats else ():
            name, score = self.format_of(m[0])
            known = any(s < m.end() and m.start() < e for s, _, _, e in base)
            for start, end, kind in [(0, len(m[0]), name)] if score >= self.min_score - known * KNOWN else self.parts(m[0]):
                at, end = start + m.start(), end + m.start()
                for s, _, _, e in base:
                    if s < end and at < e:
                        if at < s:
                            more.append((at, len(BASE), kind, s))
                        at = e
                if at < end:
                    more.append((at, len(BASE), kind, end))
        return base, sorted(base + more)

    def row(self, text: str) -> tuple:
        base, every = self.spans(text)
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in base)
        return (*(sum(x[2] == k for x in base) for k in BASE), hashlib.sha256(joined.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for s, _, k, e in every))

    def redacted(self, text: str, mark: str) -> str:
        """The text with every stretch that spans cover replaced by mark."""
        out, at = [], 0
        for start, _, _, end in self.spans(text)[1]:
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]])


@lru_cache(maxsize=4)
def _inferred(labelled: tuple[tuple[str, tuple[str, ...]], ...] | None) -> Scanner:
    return Scanner(None if labelled is None else {name: list(tokens) for name, tokens in labelled})


def scanner(labelled: dict[str, list[str]] | None = None) -> Scanner:
    """One scanner for the same labelled tokens in each Python worker."""
    return _inferred(None if labelled is None else tuple((name, tuple(tokens)) for name, tokens in labelled.items()))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per input row: counts of base matches, the digest of base spans, and all spans as kind:start:end.

    Repeated or null document ids are rows of their own; other columns are ignored.
    """
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = scanner(labelled)
        for batch in batches:
            out = pd.DataFrame([found.row(t or "") for t in batch["text"]], columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInPandas(run, f"doc_id long, {SCANNED}")


def redact(docs: DataFrame, mark: str = "[secret]", text_col: str = "text", labelled: dict[str, list[str]] | None = None) -> DataFrame:
    """docs with every found span of the text replaced by mark; null text stays null, all columns stay."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = scanner(labelled)
        for batch in batches:
            batch[text_col] = [None if t is None else found.redacted(t, mark) for t in batch[text_col]]
            yield batch

    return docs.mapInPandas(run, docs.schema)
