"""What the operators share: tables, durable intermediates and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch of whole texts; keeps a Python worker's memory bounded.
TEXT_BATCH_ROWS = 1000
#: Characters of text whose hashes one task of a shuffle takes.
SPREAD_CHARS = 32_000_000
#: Names of the folders that materialize wrote; nothing else is ever deleted.
_OWN: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch to what whole texts allow (never raises it)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > TEXT_BATCH_ROWS:
        spark.conf.set(key, TEXT_BATCH_ROWS)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or a temporary one where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="foliospark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/foliospark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _OWN.add(path.rsplit("/", 1)[1])
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialized DataFrame that no later plan reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.rsplit("/", 1)[1] not in _OWN:  # never a folder of others
            continue
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release() -> None:
    """Give freed memory of a Python worker back to the system after a large block."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(docs: DataFrame, text_col: str) -> int:
    """The shuffle partitions, or more where the texts have over SPREAD_CHARS characters for each: blocks of a task don't grow with the input."""
    chars = docs.agg(F.sum(F.length(text_col).cast("long"))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-chars // SPREAD_CHARS))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    edges: two long columns; self loops, repeats and nulls are allowed and ignored. Returns
    (node, component), component being the smallest node reachable; nodes without an edge to
    another node are absent. Minima are found by a partially aggregated groupBy and joined back, so
    a node of a very large degree is no single task's work; each round ends in the shared folder.
    """
    edges = (
        edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    edges = materialize(edges)
    # First every node goes to its smallest neighbour; what is left are the links between these.
    parent = materialize(edges.groupBy("u").agg(F.min("v").alias("m")))
    over = edges.join(parent, "u").join(parent.select(F.col("u").alias("v"), F.col("m").alias("w")), "v", "left").select("m", F.coalesce("w", "v").alias("w"))
    heads = _stars(over.select(F.greatest("m", "w").alias("u"), F.least("m", "w").alias("v")).where("u <> v").distinct())
    nodes = parent.select(F.col("u").alias("node"), "m").unionByName(
        edges.select(F.col("v").alias("node")).distinct().join(parent, F.col("node") == F.col("u"), "left_anti").select("node", F.col("node").alias("m"))
    )
    return nodes.join(heads, "m", "left").select("node", F.coalesce("component", "m").alias("component"))


def _stars(edges: DataFrame) -> DataFrame:
    """(m, component) for the nodes of distinct links u > v."""
    current, before = materialize(edges), None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        after = materialize(small)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(current)
        current = after
        if mark == before or not mark[0]:
            break
        before = mark
    return current.select(F.col("u").alias("m"), F.col("v").alias("component"))
