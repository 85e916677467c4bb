"""Line deduplication: lines that many documents have are dropped from all of them.

1. Each document's lines become 128-bit hashes of their keys (the line without ASCII white space at its ends, A-Z in lower case), with
   the place of each; how many documents have a hash is summed by Spark.
2. The distinct hashes are dealt into shards of bounded size. Each shard is indexed by a minimal perfect hash (levels of bits, each
   key at the first level where it has a place to itself, its slot being the rank of that bit) into arrays of 64-bit fingerprints and of counts.
3. The places of the documents' lines meet the arrays of their shard and probe them; what comes back are the places to drop.

A hash held by a 65,536th or more of all (document, line) pairs is told to every task instead: there are at most 65,536 such
hashes, so neither this list nor what one key adds to a shard grows without bound.

Every row is a document of its own in the counts, whatever its id (null and repeated ids too). Null text is one empty line and stays
null. A key shorter than `shortest` code points never drops. Other columns are kept; the result column must not
clash with one of them. An empty table gives no rows. Texts are shuffled once, to meet their places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, free, materialize, partitions
from .wordhash import mix

#: Code points of the shortest key, documents that make a line too common.
SHORTEST, LEAST = 1, 10
#: Distinct hashes and (document, line) pairs of a shard, most hashes told to every task, bits for a key at a level.
SHARD, PROBES, HEAVY, GAMMA = 1 << 18, 1 << 20, 1 << 16, 2
_WHITE = b" \t\n\x0b\x0c\r"
DROPPED = T.StructType().add("n_lines", T.LongType()).add("n_dropped", T.LongType()).add("kept_sha256", T.StringType())


def key_of(line: bytes) -> bytes:
    return line.strip(_WHITE).lower()  # bytes.lower folds A-Z alone


class PerfectHash:
    """A minimal perfect hash over distinct pairs of 64-bit numbers."""

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits
        self.rank = []
        base = 0
        for level in bits:
            self.rank.append(base + np.cumsum(level) - 1)
            base += int(level.sum())

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(a + np.uint64(level)) ^ mix(b - np.uint64(level * level + 1))) % np.uint64(size)

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        bits: list[np.ndarray] = []
        while len(a):
            size = 64 * ceil(GAMMA * len(a) / 64)
            at = cls._place(a, b, len(bits), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            bits.append(alone)
            left = ~alone[at]
            a, b = a[left], b[left]
            if len(bits) > 200:
                raise ValueError("keys must differ")
        return cls(bits)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each key's slot; a foreign key has any slot, or -1."""
        out, todo = np.full(len(a), -1, dtype=np.int64), np.arange(len(a))
        for level, bits in enumerate(self.bits):
            if not len(todo):
                break
            at = self._place(a[todo], b[todo], level, len(bits))
            hit = bits[at]
            out[todo[hit]] = self.rank[level][at[hit]]
            todo = todo[~hit]
        return out

    def packed(self) -> list[bytes]:
        return [np.packbits(x).tobytes() for x in self.bits]

    @classmethod
    def unpacked(cls, packed: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(x, dtype=np.uint8)).astype(bool) for x in packed])


def indexed(counts: DataFrame, shards: int) -> DataFrame:
    """(shard, levels, prints, counts) for distinct hashes (a, b) with their number n of documents."""

    def build(batch: pd.DataFrame) -> pd.DataFrame:
        a, b = batch["a"].to_numpy().view(np.uint64), batch["b"].to_numpy().view(np.uint64)
        hash_ = PerfectHash.of(a, b)
        at = hash_.slots(a, b)
        prints, number = np.empty(len(a), dtype="<u8"), np.empty(len(a), dtype="<u4")
        prints[at], number[at] = b, np.minimum(batch["n"].to_numpy(), 2**32 - 1)
        return pd.DataFrame({"shard": batch["shard"].iloc[:1], "levels": [hash_.packed()], "prints": [prints.tobytes()], "counts": [number.tobytes()]})

    return counts.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(build, "shard long, levels array<binary>, prints binary, counts binary")


def _shard(shards: int) -> Column:
    return F.pmod("a", F.lit(shards).cast("long")).alias("shard")


def _probe(least: int):
    def probe(places: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if len(places) and len(index):
            row = index.iloc[0]
            a, b = places["a"].to_numpy().view(np.uint64), places["b"].to_numpy().view(np.uint64)
            slot = PerfectHash.unpacked(row["levels"]).slots(a, b)
            prints, number = np.frombuffer(row["prints"], "<u8"), np.frombuffer(row["counts"], "<u4")
            places = places[(slot >= 0) & (prints[slot] == b) & (number[slot] >= least)]
        else:
            places = places.iloc[:0]
        return places[["id", "text_a", "text_b", "place"]]

    return probe


def _hashed(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, a, b, new = [], [], [], []
            for text in batch.column(3).cast(pa.large_binary()).to_pylist():
                keys = [key_of(x) for x in text.split(b"\n")]
                at = [i for i, k in enumerate(keys) if len(k) >= shortest and (shortest < 2 or len(k.decode()) >= shortest)]
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(keys[i]) for i in at), "<i8").reshape(-1, 2)
                first = np.zeros(len(at), dtype=bool)
                first[list({keys[i]: j for j, i in reversed(list(enumerate(at)))}.values())] = True
                place.append(np.array(at, dtype=np.int32))
                a.append(digests[:, 0])
                b.append(digests[:, 1])
                new.append(first)
            lists = (pa.array(place, pa.list_(pa.int32())), pa.array(a, pa.list_(pa.int64())), pa.array(b, pa.list_(pa.int64())), pa.array(new, pa.list_(pa.bool_())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], names=["id", "text_a", "text_b", "place", "a", "b", "new"])

    return run


def _identity(id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """What tells rows apart as far as their lines go: rows alike in all three have the same text."""
    text = F.col(text_col).cast("string")
    return F.col(id_col).cast("string"), F.xxhash64(text), F.xxhash64(F.lit(1), text)


def common_places(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, probes: int = PROBES) -> DataFrame:
    """(id, text_a, text_b, places): for each document with lines that `least` documents or more have, which these are, from 0."""
    spark = docs.sparkSession
    rows = docs.select(*_identity(id_col, text_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    lines = materialize(rows.mapInArrow(_hashed(shortest), "id string, text_a long, text_b long, place array<int>, a array<long>, b array<long>, new array<boolean>"))
    lines = lines.select("id", "text_a", "text_b", F.explode(F.arrays_zip("place", "a", "b", "new")).alias("x")).select("id", "text_a", "text_b", "x.*")
    counts = materialize(lines.groupBy("a", "b").agg(F.sum(F.col("new").cast("long")).alias("n")))
    total = counts.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs")).first()
    heavy = counts.where((F.col("n") >= least) & (F.col("n") * HEAVY >= total["pairs"]) & (F.col("n") > probes // 1024)).select("a", "b", F.lit(True).alias("heavy"))
    lines = lines.join(F.broadcast(heavy), ["a", "b"], "left")  # at most HEAVY rows, since their counts add up to the pairs at most
    shards = max(partitions(spark), ceil(total["keys"] / shard), ceil(total["pairs"] / probes))
    index = indexed(counts, shards)
    places = lines.where("heavy is null").select(_shard(shards), "a", "b", "id", "text_a", "text_b", "place")
    schema = "id string, text_a long, text_b long, place int"
    found = places.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_probe(least), schema)
    found = found.unionByName(lines.where("heavy").select("id", "text_a", "text_b", "place"))
    return found.groupBy("id", "text_a", "text_b").agg(F.collect_set("place").alias("places"))


def drop_common(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", result: str = "lines", shard: int = SHARD, probes: int = PROBES) -> DataFrame:
    """docs with their text cut, and a struct column (n_lines, n_dropped, kept_sha256) named by result. One row per input row."""
    if result.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs have a column {result} already")
    places = common_places(docs, shortest, least, id_col, text_col, shard, probes)
    names = free(docs, "id_", "text_a_", "text_b_", "places_")
    places = places.toDF(*names)
    keys = _identity(id_col, text_col)
    same = F.lit(True)
    for key, name in zip(keys, names, strict=False):
        same = key.eqNullSafe(F.col(name)) if name == names[0] else same & (key == F.col(name))
    joined = docs.join(places, same, "left").select(*docs.columns, names[3])
    schema = T.StructType([*docs.schema.fields, T.StructField(result, DROPPED)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, facts = [], []
            for text, gone in zip(batch[text_col], batch[names[3]], strict=True):
                kept, n, dropped = text or "", (text or "").count("\n") + 1, 0
                if gone is not None:
                    drop = set(gone.tolist())
                    dropped = len(drop)
                    text = kept = "\n".join(x for i, x in enumerate(kept.split("\n")) if i not in drop)
                texts.append(text)
                facts.append({"n_lines": n, "n_dropped": dropped, "kept_sha256": hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()})
            batch[text_col], batch[result] = texts, facts
            yield batch[schema.names]

    return joined.mapInPandas(run, schema)
