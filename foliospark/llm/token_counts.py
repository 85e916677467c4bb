"""Edit-aware token counts: a segment tree over each document's chunks of pre-tokens.

Leaves hold the token counts of chunks (white space with the non-space run after it, which the split pattern never
crosses); inner nodes hold the sums of their subtrees. An edit re-encodes only the chunks it touches and one of
context at each side: from the chunk of the character before it to the chunk of the first character after it. The first of these
leaves takes the new count, the others become empty, and their ancestors' sums are updated.

Null text counts as empty. Edits are applied in order of their start; those that overlap an earlier one, lie outside
the text, or have nulls are left out and not counted.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load_ranks
from .pretokens import ChunkCache, chunks
from .shared import text_batches

COUNTED = "n_tokens long, n_edits long, n_tokens_after long, n_chunks long, n_reencoded long"
#: The edits of the query. Mail addresses and long digit runs are masked, runs of one symbol shortened.
MASKS = ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<mail>"), (r"[0-9][0-9 -]{5,}[0-9]", "<number>"), (r"([#*$%&|!])\1{2,}", "-"))


class CountTree:
    """Token counts of a text's chunks with the sums of all subtrees."""

    def __init__(self, text: str, counts: Callable[[str], list[int]]):
        self.text, self.counts = text, counts
        pieces = chunks(text)
        self.starts = np.concatenate(([0], np.cumsum([len(c) for c in pieces])[:-1])).astype(np.int64).tolist() if pieces else []
        leaves = np.array(counts(text), dtype=np.int64)
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.sums = np.zeros(2 * self.size, dtype=np.int64)
        self.sums[self.size : self.size + len(leaves)] = leaves
        level = self.size
        while level > 1:
            half = level // 2
            self.sums[half:level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level = half
        self.reencoded = 0

    @property
    def total(self) -> int:
        return int(self.sums[1])

    def prefix(self, n: int) -> int:
        """Tokens of the first n chunks, from the subtree sums."""
        at, out = self.size + n, 0
        if n >= len(self.starts):
            return self.total
        while at > 1:
            if at & 1:
                out += int(self.sums[at - 1])
            at //= 2
        return out

    def _set(self, leaf: int, value: int) -> None:
        at = self.size + leaf
        change = value - int(self.sums[at])
        while at and change:
            self.sums[at] += change
            at //= 2

    def apply(self, edits: list[tuple[int, int, str]]) -> int:
        """Apply (start, end, new text) edits of the original text; returns how many."""
        used, at = [], 0
        for start, end, new in sorted(edits, key=lambda e: e[:2]):
            if at <= start <= end <= len(self.text):
                used.append((start, end, new))
                at = max(end, start)
        if not self.starts:
            if used:
                changed = "".join(new for _, _, new in used)
                self._set(0, sum(self.counts(changed)))
            return len(used)
        regions: list[list] = []
        for edit in used:
            first = max(0, bisect_right(self.starts, max(0, edit[0] - 1)) - 1)
            last = bisect_right(self.starts, min(edit[1], len(self.text) - 1)) - 1
            if regions and first <= regions[-1][1]:
                regions[-1][1] = max(last, regions[-1][1])
                regions[-1][2].append(edit)
            else:
                regions.append([first, last, [edit]])
        for first, last, inside in regions:
            at, out = self.starts[first], []
            for start, end, new in inside:
                out += [self.text[at:start], new]
                at = end
            stop = self.starts[last + 1] if last + 1 < len(self.starts) else len(self.text)
            self._set(first, sum(self.counts("".join([*out, self.text[at:stop]]))))
            for leaf in range(first + 1, last + 1):
                self._set(leaf, 0)
            self.reencoded += last - first + 1
        return len(used)


@lru_cache(maxsize=2)
def counter(ranks_path: str, split: str) -> ChunkCache:
    """The counts of chunks, one cache in each Python worker."""
    import tiktoken

    encoding = tiktoken.Encoding("counts", pat_str=split, mergeable_ranks=load_ranks(ranks_path), special_tokens={})
    return ChunkCache(lambda c: len(encoding.encode_ordinary(c)))


def masking(text: str, masks: tuple[tuple[str, str], ...] = MASKS) -> list[tuple[int, int, str]]:
    return [(*m.span(), new) for pattern, new in masks for m in re.finditer(pattern, text)]


def edited_counts(docs: DataFrame, ranks_path: str, split: str, edits: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_after, n_chunks, n_reencoded), one row per input row.

    edits: (doc_id, start, end, replacement) in code points of the text; without it the mask rules make the edits.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if edits is None:
        rows = rows.withColumn("edits", F.lit(None).cast("array<struct<start:int,end:int,new:string>>"))
    else:
        told = edits.where("doc_id is not null and start is not null and end is not null").groupBy("doc_id")
        told = told.agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.coalesce("replacement", F.lit("")).alias("new"))).alias("edits"))
        rows = rows.join(told.withColumn("edits", F.coalesce("edits", F.array())), "doc_id", "left")
        rows = rows.withColumn("edits", F.coalesce("edits", F.array()))
    given = edits is not None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values = counter(ranks_path, split).values
        for batch in batches:
            out = []
            for text, found in zip(batch["text"], batch["edits"], strict=True):
                text = text or ""
                changes = [(e["start"], e["end"], e["new"]) for e in found] if given else masking(text)
                if changes:
                    tree = CountTree(text, values)
                    before = tree.total
                    n = tree.apply(changes)
                    out.append((before, n, tree.total, len(tree.starts), tree.reencoded))
                else:
                    counts = values(text)
                    out.append((sum(counts), 0, sum(counts), len(counts), 0))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in COUNTED.split(", ")])
            frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield frame

    return rows.mapInPandas(run, f"doc_id long, {COUNTED}")
