"""Licence scans by a generalised suffix automaton of the words of licence templates.

Each text is streamed through the automaton, which gives for every word the length of the longest
run ending there that occurs in some template (matching statistics). Maximal runs, at every place that a template has
them, are chained per template by dynamic programming: the chain of most covered words in the order of text and template,
with gaps of less than a template's length. A template is reported if its chain covers enough of it. Base phrases are
counted beside that.

Null text counts as empty. Texts of any length are scanned whole, one pass, in bounded memory:
the automaton has at most twice as many states as the templates have words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .shared import text_batches

#: Phrases whose every place counts, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Characteristic sentences of common licences, lower case, words only.
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied",
    ],
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "licensed under the gnu general public license version 3",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ],
    "lgpl": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "licensed under the gnu lesser general public license",
    ],
    "agpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
        "licensed under the gnu affero general public license",
    ],
    "epl-2.0": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"],
    "mpl-2.0": ["licensed under the mozilla public license 2 0", "this source code form is subject to the terms of the mozilla public license v 2 0"],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license", "licensed under cc by 4 0"],
    "cc-by-sa": ["this work is licensed under a creative commons attribution sharealike 4 0 international license", "licensed under cc by sa 4 0"],
    "cc0": ["the person who associated a work with this deed has dedicated the work to the public domain"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
}
#: Shortest run that enters a chain, in words, and the share of a template that its chain must cover.
MIN_RUN, MIN_COVER = 3, 0.8

SCANNED = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label: string, template: int, start: long, end: long, cover: double>>"
)
#: Bytes to words: A-Z in lower case, ASCII that is neither letter nor digit to a space, the rest as it is.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences; every state knows where each template has it."""

    def __init__(self, templates: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, tuple[int, ...]]] = [{}]  # template -> ends of its occurrences
        for number, sequence in enumerate(templates):
            last = 0
            for position, word in enumerate(sequence):
                last = self._add(last, word)
                state = last
                while state > 0:
                    self.ends[state][number] = (*self.ends[state].get(number, ()), position + 1)
                    state = self.link[state]

    def _state(self, length: int, edges: dict[bytes, int], ends: dict[int, tuple[int, ...]]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        self.ends.append(ends)
        return len(self.next) - 1

    def _split(self, at: int, word: bytes, to: int) -> int:
        clone = self._state(self.length[at] + 1, dict(self.next[to]), dict(self.ends[to]))
        self.link[clone], self.link[to] = self.link[to], clone
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def _add(self, last: int, word: bytes) -> int:
        to = self.next[last].get(word)
        if to is not None:
            return to if self.length[to] == self.length[last] + 1 else self._split(last, word, to)
        new, at = self._state(self.length[last] + 1, {}, {}), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            to = self.next[at][word]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, word, to)
        return new

    def step(self, state: int, length: int, word: bytes) -> tuple[int, int]:
        """State and length of the longest run that ends in word, after (state, length)."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(word)
        return (to, length + 1) if to is not None else (0, 0)


def best_chains(pieces: list[tuple[int, int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """(covered template words, start, end) of the best chain that ends in each piece (start, end, low, high), ordered by start.

    A piece follows another that starts and ends before it in text and template, no more than `size` words away; what the two
    share on either side counts once. Only pieces that near are looked at, so work grows with the text.
    """
    out: list[tuple[int, int, int]] = []
    first = 0
    for j, (start, end, low, high) in enumerate(pieces):
        while pieces[first][1] + size < start and pieces[first][0] + 2 * size < start:
            first += 1
        best = (high - low, start, end)
        for i in range(first, j):
            s, e, lo, hi = pieces[i]
            if s < start and e < end and lo < low and hi < high and start - e <= size:
                gain = min(end - max(e, start), high - max(hi, low))
                if gain > 0 and (out[i][0] + gain, out[i][1]) > best[:2]:
                    best = (out[i][0] + gain, out[i][1], end)
        out.append(best)
    return out


class Scanner:
    def __init__(self, templates: dict[str, list[str]], base: dict[str, str], min_run: int, min_cover: float):
        self.names = [name for name, lines in templates.items() for _ in lines]
        self.sequences = [line.encode().split() for lines in templates.values() for line in lines]
        self.automaton = SuffixAutomaton(self.sequences)
        self.base = [(phrase.encode().split(), label) for phrase, label in base.items()]
        self.known = frozenset(w for s in [*self.sequences, *(p for p, _ in self.base)] for w in s)
        self.min_run, self.min_cover = min_run, min_cover

    def runs(self, found: list[bytes], at: list[int]) -> list[tuple[int, int, int]]:
        """Maximal matches (start, end, state) over the words at the given places, all other words being foreign."""
        out, state, length, before = [], 0, 0, -2
        for i in at:
            if i != before + 1:
                if length >= self.min_run:
                    out.append((before + 1 - length, before + 1, state))
                state = length = 0
            after, longer = self.automaton.step(state, length, found[i])
            if longer <= length and length >= self.min_run:  # the run could not be prolonged
                out.append((before + 1 - length, before + 1, state))
            state, length, before = after, longer, i
        if length >= self.min_run:
            out.append((before + 1 - length, before + 1, state))
        return out

    def chains(self, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(template, start, end, share): per template its disjoint chains that cover enough, the best ones first taken."""
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        for start, end, state in runs:
            for number, stops in self.automaton.ends[state].items():
                by.setdefault(number, []).extend((start, end, stop - (end - start), stop) for stop in stops)
        out = []
        for number, pieces in by.items():
            size = len(self.sequences[number])
            taken: list[tuple[int, int]] = []
            for covered, begin, stop in sorted(best_chains(sorted(pieces), size), key=lambda c: (-c[0], c[2] - c[1], c[1])):
                if covered < self.min_cover * size:
                    break
                if not any(begin < e and s < stop for s, e in taken):
                    taken.append((begin, stop))
                    out.append((number, begin, stop, min(1.0, covered / size)))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))

    def scan(self, text: str) -> tuple:
        found = words(text)
        known = self.known
        at = [i for i, w in enumerate(found) if w in known]
        spans = self.chains(self.runs(found, at)) if len(at) >= self.min_run else []
        places, labels = [], set()
        if len(at) > 1:
            for phrase, label in self.base:
                here = [i for i in at if found[i] == phrase[0] and found[i : i + len(phrase)] == phrase]
                places += here
                if here:
                    labels.add(label)
        every = labels | {self.names[n] for n, *_ in spans}
        score = min(1.0, max([1.0] * bool(places) + [c for *_, c in spans], default=0.0))
        return (
            len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), score,
            [{"label": self.names[n], "template": n, "start": s, "end": e, "cover": c} for n, s, e, c in spans],
        )


def scan(
    docs: DataFrame, templates: dict[str, list[str]] | None = None, base: dict[str, str] | None = None,
    min_run: int = MIN_RUN, min_cover: float = MIN_COVER, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: word and base counts, labels, score and the covered template spans (words from 0, end exclusive).

    Repeated or null document ids are kept as rows of their own; other columns are ignored.
    """
    text_batches(docs.sparkSession)
    templates, base = templates or TEMPLATES, base or BASE
    names = [c.split()[0] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, base, min_run, min_cover)
        for batch in batches:
            out = pd.DataFrame([scanner.scan(t or "") for t in batch["text"]], columns=names)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            yield out

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInPandas(run, SCANNED)
