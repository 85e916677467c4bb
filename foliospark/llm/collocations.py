"""Phrase collocations by pivot partitioning, as in MG-FSM.

1. Blocks of text of one language become sequences of word numbers with a dictionary each; exact word counts are summed
   over the dictionaries.
2. Every position of a block whose word can be frequent is the pivot of one fragment: the words around it, as far as a
   phrase can reach, that are more frequent than it (equal ones only on its right). So each n-gram is held by just one
   fragment of the corpus, that of the leftmost place of its rarest word. Words that can't be frequent are cut out.
   Equal fragments of a block are merged, and go to the bucket of their pivot.
3. Each bucket counts the n-grams that hold their fragment's pivot. A count under the limit is dropped where the
   bucket has all fragments of its pivot. The fragments of a pivot with too many occurrences for one bucket are dealt over
   several by their own hash, and those n-grams are summed once more.

"Rarer" is told by a table of 2^21 hashed counts of frequent words (ties by the word's bytes). Words that share an
entry only look more frequent than they are: the order stays total and equal everywhere, so results are exact whatever
the vocabulary; a fuller table just cuts out fewer words. Words are compared as bytes, never by hashes. The table is the only thing
sent to all tasks (16 MB); the number of buckets grows with the corpus.

Null text is empty, null language `und`. Ids aren't used: repeated rows count again. Other columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, materialize, partitions, release

#: Words of the longest phrase, least count, rows of a language.
LONGEST, LEAST, TOP = 4, 30, 2000
#: Parts of a language that are ranked apart before they are ranked together.
PARTS = 64
#: Bytes of text in a block, entries of the table of hashed counts, occurrences that one bucket takes.
BLOCK_BYTES, ENTRIES, BUCKET = 8 << 20, 1 << 21, 2_000_000
_END, _SPACE = 10, 32


def _bytes() -> bytes:
    table = bytearray(range(256))
    table[65:91] = table[97:123]
    for c in b".,;:!?\n\x0b\x0c\r":
        table[c] = _END
    table[9] = _SPACE
    return bytes(table)


_TABLE = _bytes()


def tokenized(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of the texts, and all words in order as their numbers, -1 before each piece."""
    codes = np.frombuffer(b"\n" + b"\n".join(texts).translate(_TABLE), dtype=np.uint8)
    word = (codes != _END) & (codes != _SPACE)
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(codes[word])]).dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(codes == _END), starts)
    first = np.flatnonzero(np.diff(piece, prepend=0))
    return words.dictionary, np.insert(words.indices.to_numpy(zero_copy_only=False).astype(np.int32), first, -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, texts in held.items():
            at = 0
            while at < len(texts):  # a dictionary's offsets have 32 bits, a text is never split
                stop, n = at + 1, len(texts[at])
                while stop < len(texts) and n + len(texts[stop]) < BLOCK_BYTES:
                    n, stop = n + len(texts[stop]), stop + 1
                words, ids = tokenized(texts[at:stop])
                at = stop
                counts = np.bincount(ids[ids >= 0], minlength=len(words))
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array([lang]), "words": pa.array([words.cast(pa.string())], pa.list_(pa.string())),
                        "counts": pa.array([counts], pa.list_(pa.int64())), "ids": pa.array([pa.compress(ids.tobytes(), codec="zstd", asbytes=True)]), "size": pa.array([len(ids)], pa.int64()),
                    }
                )
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= BLOCK_BYTES:
                yield from flush()
                size = 0
    yield from flush()
    release()


def _ids(payload: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(payload, decompressed_size=4 * size, codec="zstd", asbytes=True), dtype=np.int32)


def merged(columns: list[np.ndarray], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different row of the columns (numbers from -1), and how often (or by what weight) it stands there."""
    key = np.zeros(len(columns[0]), dtype=np.int64)
    top = 1
    for column in columns:
        width = int(column.max(initial=0)) + 2
        if top * width >= 1 << 62:
            key, uniques = pd.factorize(key)
            top = len(uniques) + 1
        key, top = key * width + (column + 1), top * width
    codes, uniques = pd.factorize(key)
    first = np.zeros(len(uniques), dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return first, np.bincount(codes, weights=weights, minlength=len(uniques)).astype(np.int64)


def _reach(rank: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words on the left and on the right of each pivot its fragment has; rank -1 ends it."""
    padded = np.concatenate((np.full(longest, -1), rank, np.full(longest, -1)))
    out = []
    for side in (-1, 1):
        n, going = np.zeros(len(rank), dtype=np.int64), rank >= 0
        for j in range(1, longest):
            other = padded[longest + side * j : longest + side * j + len(rank)]
            going = going & (other > rank if side < 0 else other >= rank) & (other >= 0)
            n += going
        out.append(n)
    return out[0], out[1]


def fragments(lang: str, words: list[bytes], ids: np.ndarray, table: np.ndarray, buckets: int, limit: int, longest: int) -> Iterator[tuple]:
    """(bucket, lang, words, payload) of a block; buckets from `buckets` on take parts of pivots with more than limit occurrences."""
    seed = xxhash.xxh64_intdigest(lang.encode(), seed=42)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed=seed) for w in words), dtype=np.uint64, count=len(words))
    known = table[hashes & np.uint64(len(table) - 1)]
    by_bytes = np.empty(len(words), dtype=np.int64)
    by_bytes[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((by_bytes, known))
    rank = np.empty(len(words) + 1, dtype=np.int64)
    rank[order] = np.arange(len(words))
    rank[:-1][known == 0] = -1
    rank[-1] = -1  # the start of a piece
    left, right = _reach(rank[ids], longest)
    at = np.flatnonzero(left + right > 0)
    if not len(at):
        return
    left, right = left[at], right[at]
    steps = range(1 - longest, longest)
    inside = np.concatenate((np.full(longest, -1), ids, np.full(longest, -1)))
    columns = [np.where((-left <= j) & (j <= right), inside[at + longest + j], -1) for j in steps]
    first, count = merged(columns)
    columns = [c[first] for c in columns]
    left, right, pivot = left[first], right[first], columns[longest - 1]
    shares = np.maximum(1, -(-known[pivot] // limit))
    own = np.zeros(len(first), dtype=np.uint64)
    for c in columns:  # a fragment's hash, from those of its words
        own = own * np.uint64(0x9E3779B97F4A7C15) + np.where(c >= 0, hashes[c], np.uint64(7))
    bucket = ((hashes[pivot] >> np.uint64(21)) % np.uint64(buckets)).astype(np.int64)
    dealt = shares > 1
    bucket = np.where(dealt, buckets + (bucket + ((own >> np.uint64(17)) % shares.astype(np.uint64)).astype(np.int64)) % buckets, bucket)
    order = np.argsort(bucket, kind="stable")
    bounds = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for part in np.split(order, bounds[1:]):
        grid = np.stack([c[part] for c in columns], axis=1)
        used = grid >= 0
        numbers, local = np.unique(grid[used], return_inverse=True)
        payload = pa.compress(b"".join(x.astype("<i4").tobytes() for x in (left[part], right[part], count[part], local)), codec="zstd", asbytes=True)
        yield int(bucket[part[0]]), lang, b" ".join(words[i] for i in numbers.tolist()), payload, len(part), int(used.sum())


def owned(payloads: list[tuple[bytes, bytes, int, int]], longest: int) -> Iterator[tuple[list[bytes], list[np.ndarray], np.ndarray]]:
    """For each length from 2 on: the bucket's words, the word numbers of its n-grams by place, and their counts."""
    numbers: dict[bytes, int] = {}
    grids, counts = [], []
    for words, payload, n, used in payloads:
        data = np.frombuffer(pa.decompress(payload, decompressed_size=4 * (3 * n + used), codec="zstd", asbytes=True), "<i4")
        left, right = data[:n], data[n : 2 * n]
        own = np.array([numbers.setdefault(w, len(numbers)) for w in words.split(b" ")])
        grid = np.full((n, 2 * longest - 1), -1, dtype=np.int32)
        step = np.arange(1 - longest, longest)
        grid[(-left[:, None] <= step) & (step <= right[:, None])] = own[data[3 * n :]]
        grids.append(grid)
        counts.append(data[2 * n : 3 * n].astype(np.int64))
    grid, count = np.concatenate(grids), np.concatenate(counts)
    words = list(numbers)
    for n in range(2, longest + 1):
        columns, weights = [[] for _ in range(n)], []
        for start in range(longest - n, longest):  # the pivot stands at place longest - 1
            has = (grid[:, start] >= 0) & (grid[:, start + n - 1] >= 0)
            for j in range(n):
                columns[j].append(grid[has, start + j])
            weights.append(count[has])
        whole = [np.concatenate(c) for c in columns]
        weight = np.concatenate(weights)
        if len(weight):
            first, total = merged(whole, weight)
            yield words, [c[first] for c in whole], total


def counted(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang", bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) for phrases of 1 to `longest` words found `least` times or more, and (lang, n) for all words."""
    if least < 1 or longest < 2:
        raise ValueError("phrases need two words or more, found once or more")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    blocks = materialize(rows.mapInArrow(_blocks, "lang string, words array<string>, counts array<long>, ids binary, size long"))
    held = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("phrase"), F.col("w.counts").alias("f"))
    single = materialize(held.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least))
    totals = blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    entry = F.pmod(F.xxhash64("lang", "phrase"), F.lit(ENTRIES)).cast("int").alias("entry")
    found = single.groupBy(entry).agg(F.sum("f").alias("f")).toPandas()  # at most ENTRIES rows, whatever the corpus
    filled = np.zeros(ENTRIES, dtype=np.int64)
    filled[found["entry"].to_numpy(dtype=np.int64)] = found["f"].to_numpy(dtype=np.int64)
    table = spark.sparkContext.broadcast(filled)
    buckets = max(partitions(spark), ceil(int(filled.sum()) / bucket))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, words, ids, size in zip(batch["lang"], batch["words"], batch["ids"], batch["size"], strict=True):
                sent = list(fragments(lang, [w.encode() for w in words], _ids(ids, size), table.value, buckets, bucket, longest))
                if sent:
                    yield pd.DataFrame(sent, columns=["bucket", "lang", "words", "payload", "n", "used"])
            release()

    def meet(batch: pd.DataFrame) -> pd.DataFrame:
        lang, whole = batch["lang"].iloc[0], batch["bucket"].iloc[0] < buckets
        out, counts, of = [], [], list(zip(batch["words"], batch["payload"], batch["n"], batch["used"], strict=True))
        for words, columns, total in owned(of, longest):
            kept = np.flatnonzero(total >= least) if whole else np.arange(len(total))
            out += [b" ".join(words[i] for i in row).decode() for row in np.stack([c[kept] for c in columns], axis=1).tolist()]
            counts.append(total[kept])
        release()
        return pd.DataFrame({"lang": np.full(len(out), lang, dtype=object), "phrase": np.array(out, dtype=object), "f": np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)})

    sent = blocks.select("lang", "words", "ids", "size").mapInPandas(send, "bucket int, lang string, words binary, payload binary, n int, used int")
    longer = sent.groupBy("bucket", "lang").applyInPandas(meet, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    every = materialize(single.unionByName(longer).withColumn("words", F.split("phrase", " ")))
    totals = materialize(totals)
    discard(blocks)
    discard(single)
    return every, totals


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", bucket: int = BUCKET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases by the weakest of their cuts, without those that a longer one covers."""
    every, totals = counted(docs, least, longest, text_col, lang_col, bucket)
    wide = "decimal(38,0)"
    single = every.select("lang", "phrase", "f")
    phrases = every.where(F.size("words") > 1)
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("head"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ").alias("tail"))
    cuts = cuts.join(single.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(single.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.withColumn("twice", (F.col("a").cast("decimal(25,0)") * F.lit(2_000_000).cast("decimal(7,0)")).cast(wide)).withColumn("both", (F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)")).cast(wide))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(F.expr("twice div both").alias("score"), "k", "l", "r")).alias("cut"))
    within = phrases.where(F.size("words") > 2).select("lang", "f", "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("m"))
    within = within.select("lang", "f", "words", "m", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)).alias("i"))
    within = within.groupBy("lang", F.array_join(F.slice("words", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("f").alias("longer"))
    left = scored.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(25,0)") * 100 < F.col("a").cast("decimal(25,0)") * 80))
    order = (F.desc("cut.score"), F.desc("a"), "phrase")
    # the best of each part of a language first, so that no task takes a whole language
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part")
    good = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    best = good.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))
