"""Clustering around centroids in whole numbers, with distances screened by norms of segments.

Components become floor(scale * x). A vector's and a centroid's segments have norms, and by Cauchy and Schwarz the squared distance
of two segments is at least the square of the difference of their norms. Summed over the segments, this bound is taken
from the stored norms (32-bit, with room for their rounding) for every centroid; only centroids whose bound is no more than the exact
distance to the most promising one get an exact distance in 64-bit integers. So the nearest centroid, and the smallest number among equals, is exact.

Sums of a round are taken in each task, then over all tasks as decimals; what comes to the driver is the sums and counts of
the k centroids alone.

Vectors that are null, have another dimension, or hold null or non-finite components are left out. Rows with a null id are clustered, but
start no centroid; equal ids are ordered by their components. With fewer vectors than k there are fewer centroids. Components beyond 2^27 after scaling
raise an error (their distances would not fit 64 bits). Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

K, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, "2"
#: Components of a segment, largest component, pairs of vector and centroid whose exact distances are taken at once.
SEGMENT, LARGEST, PAIRS = 8, 1 << 27, 1 << 15
#: More than the rounding of a 32-bit norm, in parts of it.
_SLACK = 1e-6


def usable(embedding: Column, dim: int) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & (F.size(embedding) == dim) & ~bad


def norms(x: np.ndarray) -> np.ndarray:
    """The norms of the segments of each row."""
    starts = np.arange(0, x.shape[1], SEGMENT)
    return np.sqrt(np.add.reduceat(x.astype(np.float64) ** 2, starts, axis=1)).astype(np.float32)


def bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lower bounds of the squared distances of all rows of norms a to all rows of norms b."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    out = np.zeros((len(a), len(b)))
    for s in range(a.shape[1]):
        gap = np.abs(a[:, s, None] - b[None, :, s]) - _SLACK * (a[:, s, None] + b[None, :, s])
        out += np.maximum(gap, 0) ** 2
    return out * (1 - _SLACK)


def nearest(x: np.ndarray, x_norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid and squared distance, and how many exact distances were taken."""
    low = bounds(x_norms, norms(centroids))
    rows = np.arange(len(x))

    def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), dtype=np.int64)
        for at in range(0, len(i), PAIRS):
            gap = x[i[at : at + PAIRS]] - centroids[j[at : at + PAIRS]]
            out[at : at + PAIRS] = (gap * gap).sum(axis=1)
        return out

    found = np.full(low.shape, np.iinfo(np.int64).max)
    first = low.argmin(axis=1)
    found[rows, first] = exact(rows, first)
    open_ = low <= found[rows, first][:, None]
    open_[rows, first] = False
    i, j = np.nonzero(open_)
    found[i, j] = exact(i, j)
    best = found.argmin(axis=1)  # the first of equal ones
    return best, found[rows, best], len(x) + len(i)


def _read(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number vectors and their norms."""
    vectors, lengths = batch.column("v"), batch.column("norms")
    return vectors.flatten().to_numpy().reshape(-1, dim).astype(np.int64), lengths.flatten().to_numpy().reshape(len(vectors), -1)


def _with_norms(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(-1, dim)
            found = norms(x) if len(x) else np.zeros((0, 1), dtype=np.float32)
            lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists], names=["vec_id", "v", "norms"])

    return run


def whole(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, norms) for the usable vectors: whole numbers, and the norms of their segments."""
    v = F.col(vector_col).cast("array<double>")
    large = F.exists(v, lambda x: F.abs(x * float(scale)) > float(LARGEST))
    told = F.when(large, F.raise_error(F.lit("a component is too large for exact distances")).cast("array<int>"))
    v = told.otherwise(F.transform(v, lambda x: F.floor(x * float(scale)).cast("int")))
    rows = vectors.where(usable(F.col(vector_col), dim)).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return materialize(rows.mapInArrow(_with_norms(dim), "vec_id long, v array<int>, norms array<float>"))


def first_centroids(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors whose ids have the smallest hashes."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.where("vec_id is not null").select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def moved(kept: DataFrame, centroids: np.ndarray, dim: int) -> np.ndarray:
    """The centroids after one round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, dtype=np.int64), np.zeros(len(centroids), dtype=np.int64)

        def partial() -> pa.RecordBatch:
            held = np.flatnonzero(counts)
            return pa.RecordBatch.from_pydict({"cluster": pa.array(held, pa.int32()), "n": pa.array(counts[held]), "sums": pa.array(list(sums[held]), pa.list_(pa.int64()))})

        seen = 0
        for batch in batches:
            x, lengths = _read(batch, dim)
            best, _, _ = nearest(x, lengths, centroids)
            np.add.at(sums, best, x)
            counts += np.bincount(best, minlength=len(centroids))
            seen += len(x)
            if seen > 1 << 34:  # sums of components up to 2^27 stay within 63 bits
                yield partial()
                sums[:], counts[:], seen = 0, 0, 0
        yield partial()

    parts = kept.mapInArrow(run, "cluster int, n long, sums array<long>")
    wide = "decimal(38,0)"
    rows = parts.select("cluster", F.col("n").cast(wide).alias("n"), F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast(wide)).alias("s")).collect()
    out = centroids.copy()
    for r in rows:  # k * dim rows at most
        out[r["cluster"], r["d"]] = int(r["s"]) // int(r["n"])
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per usable vector."""
    spark = vectors.sparkSession
    kept = whole(vectors, dim, scale, id_col, vector_col)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):  # no vector, or none with an id
        centroids = np.zeros((1, dim), dtype=np.int64)
    for _ in range(rounds):
        centroids = moved(kept, centroids, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, distance, _ = nearest(*_read(batch, dim), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    dealt = materialize(kept.mapInArrow(run, "vec_id long, cluster int, distance long"))
    sums = {r["cluster"]: int(r["s"]) for r in dealt.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    told = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    facts = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return dealt.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows at most
