"""Substring deduplication over a partitioned de Bruijn graph of words.

Every window of k words is an edge. Edges go to the smallest hash of an m-word run that they hold (their
anchor): windows of equal words have the same anchor at the same offset, and neighbouring windows that share
an anchor are a nonbranching path of the graph that is compacted to one row before the shuffle. An anchor's rows
meet in one bucket; paths whose anchor occurs in one document only are dropped, the others are
compared edge by edge, by the whole 64-bit hash of the window's 13 words, with the source coordinates of each.
Grouping by anchors stands in for joins that compact paths. An edge is repeated if a document of a smaller id has it; the words of repeated
edges are joined to long spans at their source coordinates and removed.

Edges that a smaller id of the same block of documents has are settled there and not sent, so a passage or a
copy in a third of all rows sends one row for each block. Text is shuffled once, to meet its spans.

Null text has no words. Rows with a null id, or with equal ids, never remove from one another or
themselves; a text takes only spans whose windows it has, by the sum of their 64-bit hashes. Other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free, release, spread, text_batches
from .wordhash import batch_hashes, bounded, windows, word_hashes

K, M = 13, 5
#: Words of a block of documents that are settled together in memory.
BLOCK_WORDS = 1_000_000
REMOVAL = T.StructType().add("n_words", T.LongType()).add("n_removed", T.LongType()).add("kept_sha256", T.StringType())
SPAN = "doc_id long, tag int, start int, n int, proof long"
_HEAD = np.dtype([("anchor", "<u4"), ("delta", "<i8"), ("start", "<i4"), ("tag", "<u2"), ("shape", "<u2")])


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs that begin where breaks is true (its first entry is)."""
    starts = np.flatnonzero(breaks)
    return starts, np.diff(np.append(starts, len(breaks)))


def _smallest(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For every entry, the smallest id among entries of the same key."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts, sizes = _runs(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    out = np.empty(len(ids), dtype=ids.dtype)
    out[order] = np.repeat(np.minimum.reduceat(ids[order], starts), sizes)
    return out


def edges(ids: np.ndarray, tags: np.ndarray, texts: list[bytes], buckets: int, k: int, m: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, payload) for the compacted paths of a block; bucket -1 holds spans that the block settles itself."""
    hashes, counts = batch_hashes(texts)
    begin = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(texts)), counts)
    full = windows(hashes, k)
    if not len(full):
        return
    inside = np.flatnonzero(doc[: len(full)] == doc[k - 1 :])
    grams = windows(hashes, m)
    width = k - m + 1
    low = grams[: len(full)].copy()
    for j in range(1, width):
        np.minimum(low, grams[j : j + len(full)], out=low)
    anchor = np.zeros(len(full), dtype=np.int64)
    for j in range(width - 1, -1, -1):
        anchor[grams[j : j + len(full)] == low] = j
    offset, low, full, doc = anchor[inside], low[inside], full[inside], doc[inside]
    if not len(full):
        return
    own = ids[doc]
    settled = _smallest(full, own) < own
    yield from _settled(inside, doc, settled, ids, tags, begin, full)
    at = np.flatnonzero(~settled)
    position, doc, offset, low, prints = inside[at], doc[at], offset[at], low[at], full[at].astype("<u8")
    new = np.concatenate(([True], (np.diff(position) != 1) | (np.diff(doc) != 0) | (np.diff(position + offset) != 0)))
    starts, sizes = _runs(new)
    head = np.empty(len(starts), dtype=_HEAD)
    head["anchor"] = low[starts] & np.uint64(0xFFFFFFFF)  # enough to leave out what one document has; windows are compared in full
    head["start"] = position[starts] - begin[doc[starts]]
    head["tag"] = tags[doc[starts]]
    head["shape"] = offset[starts] << 8 | sizes
    bucket = (low[starts] >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    who = ids[doc[starts]]
    for b in range(buckets):
        chosen = order[bounds[b] : bounds[b + 1]]
        if len(chosen):
            part = head[chosen]
            part["delta"] = np.diff(who[chosen], prepend=0)
            n = sizes[chosen]
            take = np.repeat(starts[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield b, np.int64(len(chosen)).tobytes() + b"".join(np.ascontiguousarray(part[c]).tobytes() for c in _HEAD.names) + prints[take].tobytes()


def _settled(position: np.ndarray, doc: np.ndarray, settled: np.ndarray, ids: np.ndarray, tags: np.ndarray, begin: np.ndarray, prints: np.ndarray) -> Iterator[tuple[int, bytes]]:
    at = np.flatnonzero(settled)
    if len(at):
        position, doc = position[at], doc[at]
        starts, sizes = _runs(np.concatenate(([True], (np.diff(position) != 1) | (np.diff(doc) != 0))))
        first = doc[starts]
        proof = np.add.reduceat(prints[at], starts).astype(np.int64)
        yield -1, np.stack([ids[first], tags[first].astype(np.int64), position[starts] - begin[first], sizes, proof]).astype("<i8").tobytes()


def _read(payload: bytes) -> tuple[dict[str, np.ndarray], np.ndarray]:
    n, at, out = int(np.frombuffer(payload, "<i8", 1)[0]), 8, {}
    for c in _HEAD.names:
        out[c] = np.frombuffer(payload, _HEAD[c], n, at)
        at += n * _HEAD[c].itemsize
    out["id"] = np.cumsum(out.pop("delta"))
    return out, np.frombuffer(payload, "<u8", -1, at)


def repeats(payloads: list[bytes]) -> np.ndarray:
    """Rows (id, tag, start, windows, sum of their hashes) of a bucket's edges that a smaller id has."""
    heads, prints = zip(*map(_read, payloads), strict=True)
    head = {c: np.concatenate([h[c] for h in heads]) for c in heads[0]}
    print_, shape = np.concatenate(prints), head["shape"].astype(np.int64)
    order = np.argsort(head["anchor"], kind="stable")
    ordered, who = head["anchor"][order], head["id"][order]
    starts, sizes = _runs(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    shared = np.repeat(np.minimum.reduceat(who, starts) != np.maximum.reduceat(who, starts), sizes)
    path = order[shared]
    if not len(path):
        return np.zeros((0, 5), dtype=np.int64)
    length = shape & 255
    from_ = np.cumsum(length) - length
    n = length[path]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    key = print_[np.repeat(from_[path], n) + step]  # equal windows have equal anchors and offsets
    own = np.repeat(head["id"][path], n)
    at = np.flatnonzero(_smallest(key, own) < own)
    if not len(at):
        return np.zeros((0, 5), dtype=np.int64)
    row, step = np.repeat(path, n)[at], step[at]
    starts, sizes = _runs(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(step) != 1))))
    row = row[starts]
    proof = np.add.reduceat(key[at], starts).astype(np.int64)
    return np.stack([head["id"][row], head["tag"][row].astype(np.int64), head["start"][row] + step[starts], sizes, proof], axis=1)


def repeated_spans(docs: DataFrame, k: int = K, m: int = M, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tag, spans): for each document with repeated windows, where they start, how many follow on, and the sum of their hashes.

    Texts of one id may share a tag; proven() tells whose spans they are.
    """
    if not 0 < m <= k < m + 255:
        raise ValueError("anchors must be shorter than windows, by less than 255 words")
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), tag_of(text_col).alias("tag"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    dealt = spread(rows, "text")
    buckets = 2 * dealt

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in bounded(batches, BLOCK_WORDS * 6, lambda b: int(b["text"].str.len().sum())):
            block = pd.concat(held)
            rows = list(edges(block["id"].to_numpy(), block["tag"].to_numpy(), [t.encode("utf-8", "surrogatepass") for t in block["text"]], buckets, k, m))
            yield pd.DataFrame({"bucket": [b for b, _ in rows], "payload": [p for _, p in rows]})
            del held, block, rows
            release()

    def meet(batch: pd.DataFrame) -> pd.DataFrame:
        if batch["bucket"].iloc[0] < 0:
            rows = np.concatenate([np.frombuffer(p, "<i8").reshape(5, -1).T for p in batch["payload"]])
        else:
            rows = repeats(list(batch["payload"]))
        del batch
        release()
        return pd.DataFrame({"doc_id": rows[:, 0], "tag": rows[:, 1].astype(np.int32), "start": rows[:, 2].astype(np.int32), "n": rows[:, 3].astype(np.int32), "proof": rows[:, 4]})

    sent = rows.mapInPandas(send, "bucket int, payload binary")
    # spans that a block settled itself are dealt out by their own hash
    sent = sent.withColumn("part", F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("payload"), F.lit(buckets))).otherwise(F.col("bucket")).cast("int"))
    found = sent.repartition(dealt, "part", F.col("bucket") < 0).groupBy("part", F.col("bucket") < 0).applyInPandas(meet, SPAN)
    return found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "n", "proof")).alias("spans"))


def tag_of(text_col: str):
    return F.pmod(F.xxhash64(F.col(text_col).cast("string")), F.lit(1 << 16)).cast("int")


def proven(spans: list[tuple[int, int, int]], text: bytes, k: int) -> list[tuple[int, int]]:
    """The spans whose windows the text has where they say: those of another text of the same id and tag are left out."""
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(windows(word_hashes(text), k))))
    return [(start, n) for start, n, proof in spans if start + n < len(sums) and int((sums[start + n] - sums[start]).astype(np.int64)) == proof]


def covered(spans: list, n_words: int, k: int) -> np.ndarray:
    """Which words the windows of the spans cover."""
    edge = np.zeros(n_words + 1, dtype=np.int32)
    for start, n in spans:
        edge[start] += 1
        edge[min(start + n + k - 1, n_words)] -= 1
    return np.cumsum(edge[:-1]) > 0


def cut(text: bytes, words: list[bytes], gone: np.ndarray) -> bytes:
    """The text without the words that are gone and the white space after them."""
    out, at = [], 0
    bounds = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False]))))
    ends, place, wanted = {}, 0, set(bounds.tolist())
    for i, w in enumerate(words):  # where the words at the bounds stand
        place = text.index(w, place)
        if i in wanted:
            ends[i] = place
        place += len(w)
    ends[len(words)] = len(text)
    for a, b in zip(bounds[::2].tolist(), bounds[1::2].tolist(), strict=True):
        out.append(text[at : ends[a]])
        at = ends[b]
    return b"".join([*out, text[at:]])


def deduplicate(docs: DataFrame, k: int = K, m: int = M, id_col: str = "doc_id", text_col: str = "text", result: str = "removal") -> DataFrame:
    """docs with their text cut, and a struct column (n_words, n_removed, kept_sha256) named by result.

    One row per input row. Documents without a repeated window keep their text unchanged. A column named as result is an error.
    """
    if result.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs have a column {result} already")
    id_, tag_, held = free(docs, "span_id_", "span_tag_", "spans_")
    spans = repeated_spans(docs, k, m, id_col, text_col).toDF(id_, tag_, held)
    joined = docs.join(spans, (F.col(id_col).cast("long") == F.col(id_)) & (tag_of(text_col) == F.col(tag_)), "left").drop(id_, tag_)
    schema = T.StructType([*docs.schema.fields, T.StructField(result, REMOVAL)])
    names = [f.name for f in schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            texts, facts = [], []
            for text, spans in zip(batch[text_col], batch[held], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                words, removed, kept = data.split(), 0, text
                left = words
                if spans is not None:
                    gone = covered(proven([(s["start"], s["n"], s["proof"]) for s in spans], data, k), len(words), k)
                    removed = int(gone.sum())
                    left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    kept = cut(data, words, gone).decode("utf-8", "surrogatepass")
                texts.append(kept)
                facts.append({"n_words": len(words), "n_removed": removed, "kept_sha256": hashlib.sha256(b" ".join(left)).hexdigest()})
            batch[text_col] = texts
            batch[result] = facts
            yield batch[names]

    return joined.mapInPandas(run, schema)
