"""Packing of tokenized documents into sequences by a configuration linear program.

The lengths of all pieces form a histogram of at most `capacity` bins, which is all the driver sees. The
program (least number of sequences, one variable per way to fill a sequence, every length covered) is
solved by multiplicative weights: each round a knapsack dynamic program prices the fillings, those within `SLACK`
of the dearest one are used, and the weights of lengths fall with what was covered, until every length is covered. The
same prices give the dual bound that no packing can go below. The fractional solution is rounded, dearest use first, and what
its fractions leave is packed best-fit decreasing, again by the histogram. If best fit alone needs fewer sequences
its plan is taken. The plan's size depends on the capacity alone; pieces find their places by their rank among equal lengths.

Null text counts as empty: its document is the separator alone. Repeated or null document ids are documents
of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import load_ranks
from .pretokens import ChunkCache
from .shared import materialize, text_batches

CAPACITY, SEPARATOR, SPECIAL, SPECIAL_ID = 2048, 0, "<|endoftext|>", 50256
#: A filling is used if its price is within so much of the best one's, covers so much of a length at most in a round, and lowers weights by so much.
SLACK, STEP, RATE = 0.02, 0.5, 0.1
#: First weights are lengths to this power, so that of equally full fillings those of long pieces come first.
BEND = 1.3

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Ids:
    """Token ids of whole texts as little-endian 32-bit bytes; equal to the tokenizers library's."""

    def __init__(self, ranks_path: str, split: str):
        import tiktoken

        encoding = tiktoken.Encoding("packing", pat_str=split, mergeable_ranks=load_ranks(ranks_path), special_tokens={})
        self.chunks = ChunkCache(lambda c: np.array(encoding.encode_ordinary(c), dtype="<u4").tobytes())

    def of(self, text: str) -> bytes:
        if SPECIAL in text:  # the library reads it as one special token
            return np.array([SPECIAL_ID], dtype="<u4").tobytes().join(self.of(part) for part in text.split(SPECIAL))
        return b"".join(self.chunks.values(text))


@lru_cache(maxsize=2)
def text_ids(ranks_path: str, split: str) -> Ids:
    return Ids(ranks_path, split)


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; of longer ones the first piece takes the remainder."""
    n = len(ids) // 4
    first = n if n <= capacity else n % capacity or capacity
    start, piece = 0, 0
    while start < n:
        stop = first if not piece else start + capacity
        yield piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])
        start, piece = stop, piece + 1


def pieces(docs: DataFrame, ranks_path: str, split: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document with its separator."""
    text_batches(docs.sparkSession)
    end = np.array([SEPARATOR], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = text_ids(ranks_path, split)
        for batch in batches:
            rows = [(i, *p) for i, text in enumerate(batch["text"]) for p in cut(ids.of(text or "") + end, capacity)]
            out = pd.DataFrame(rows, columns=["row", "piece", "start", "length", "ids_crc32"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy()[out.pop("row").to_numpy(dtype=int)])
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, PIECES)


def prices(weights: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest weight of a filling of each size, and the piece it takes first (-1: one token stays free). Repeats are allowed."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if upto[c]:
            values = best[c - lengths[: upto[c]]] + weights[: upto[c]]
            k = len(values) - 1 - int(values[::-1].argmax())  # of equal ones the longest
            if values[k] > best[c]:
                best[c], choice[c] = values[k], k
    return best, choice


def filling(first: int, choice: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """The dearest filling that holds the piece `first`."""
    out, c = {first: 1}, capacity - int(lengths[first])
    while c > 0:
        k = int(choice[c])
        if k < 0:
            c -= 1
        else:
            out[k] = out.get(k, 0) + 1
            c -= int(lengths[k])
    return out


def fractional(counts: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], float]], float]:
    """A fractional cover of all counts by fillings, and the dual bound: no cover is smaller. lengths ascend.

    Every round covers the scarcest length of its dearest filling or STEP of it, so rounds are few per length at most.
    """
    left, found = counts.astype(float), {}
    bound = float(lengths @ counts) / capacity  # the weights that no filling exceeds at once
    weights = (lengths / capacity) ** BEND
    while left.any():
        here = np.flatnonzero(left > 0)
        best, choice = prices(weights[here], lengths[here], capacity)
        bound = max(bound, float(weights[here] @ counts[here]) / best[capacity])  # covered lengths count as weight 0
        value = weights[here] + best[capacity - lengths[here]]
        covered = np.zeros(len(counts))
        for i in np.lexsort((-here, -value)):
            if value[i] < (1 - SLACK) * best[capacity]:
                break
            use = {int(here[k]): n for k, n in filling(int(i), choice, lengths[here], capacity).items()}
            size = min(left[k] / n for k, n in use.items())
            size = min(size, max(1.0, min(STEP * counts[k] / n for k, n in use.items())))
            if size > 0:
                key = tuple(sorted(use.items()))
                found[key] = found.get(key, 0.0) + size
                for k, n in key:
                    left[k] -= n * size
                    covered[k] += n * size
        left[left < 1e-9] = 0
        weights = weights * np.exp(-RATE * covered / counts)
    return [(dict(key), x) for key, x in found.items()], bound


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best-fit decreasing by the histogram: each sequence takes the largest pieces that fit, as often as it can be repeated."""
    left, out = dict(left), []
    open_ = [s for s in sorted(left, reverse=True) if left[s]]
    while open_:
        use, free = {}, capacity
        for s in open_:
            n = min(free // s, left[s])
            if n:
                use[s] = n
                free -= n * s
        times = min(left[s] // n for s, n in use.items())
        out.append((times, use))
        for s, n in use.items():
            left[s] -= n * times
        open_ = [s for s in open_ if left[s]]
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(number of sequences, {length: pieces in each}) that take up the histogram exactly."""
    lengths = np.array(sorted(histogram), dtype=int)
    counts = np.array([histogram[x] for x in lengths], dtype=float)
    left, out = dict(histogram), []
    for use, x in sorted(fractional(counts, lengths, capacity)[0], key=lambda f: -f[1]) if len(lengths) else []:
        use = {int(lengths[k]): n for k, n in use.items()}
        times = min(int(np.ceil(x - 1e-9)), *(left[size] // n for size, n in use.items()))
        if times > 0:
            out.append((times, use))
            for size, n in use.items():
                left[size] -= n * times
    out += best_fit(left, capacity)
    plain = best_fit(histogram, capacity)
    return min(out, plain, key=lambda p: sum(times for times, _ in p))


def places(found: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: where ranks of a block begin, its first sequence, pieces of the length in a sequence, and their offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for times, use in found:
        offset = 0
        for size in sorted(use, reverse=True):
            begin = taken.get(size, 0)
            rows.setdefault(size, []).append((begin, sequence, use[size], offset))
            taken[size] = begin + times * use[size]
            offset += size * use[size]
        sequence += times
    return {size: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for size, r in rows.items()}


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with (sequence_id, offset). A length that very many pieces share is ranked block by block."""
    stored = materialize(found.withColumn("part", F.spark_partition_id()))
    by_part = materialize(stored.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    where = found.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begin = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    within = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = stored.withColumn("rank", F.row_number().over(within)).join(begin, ["part", "length"])
    ranked = ranked.withColumn("rank", F.col("begin") + F.col("rank") - 1).drop("part", "begin")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = where.value
        for batch in batches:
            rank, length = batch.pop("rank").to_numpy(), batch["length"].to_numpy()
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                begins, first, each, start = table[int(size)]
                k = np.searchsorted(begins, rank[at], side="right") - 1
                own = rank[at] - begins[k]
                sequence[at] = first[k] + own // each[k]
                offset[at] = start[k] + own % each[k] * size
            yield batch.assign(sequence_id=sequence, offset=offset)

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*columns, "rank").mapInPandas(run, f"{PIECES}, sequence_id long, offset long")
