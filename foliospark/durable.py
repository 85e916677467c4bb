"""Intermediate results that outlive lost executors."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame


#: Bytes of files up to which Spark may send a settled table to all executors. The ids and repeated texts here take thirty to eighty times their files in memory.
SENT_BYTES = 1 << 18
_open = threading.local()  # made: for each settled_alone() that this thread is in, the folders written on the way


def kept_apart(df: DataFrame) -> DataFrame:
    """df, joined by sorting where its files are over SENT_BYTES: Spark's estimate for a broadcast through the driver is the files' size."""
    spark = df.sparkSession
    size = 0
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        size += target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    return df.hint("merge") if size > SENT_BYTES else df


def settled(df: DataFrame) -> DataFrame:
    """df written as Parquet to the folder of spark.checkpoint.dir and read again, so plans that use it often stay small.

    A temporary folder is taken only where the setting is absent and the master is local; on a cluster its absence is an error, as
    executors would write to disks of their own. Files go when the session's JVM ends.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="foliospark-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    for made in getattr(_open, "made", [])[-1:]:
        made.append(path)
    return kept_apart(spark.read.schema(df.schema).parquet(path))


def settled_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """settled(make()), and the files of all that make() settled on the way go: nothing but its result may be read later."""
    stack = _open.made = getattr(_open, "made", [])
    stack.append([])
    try:
        found = make()
    finally:
        made = stack.pop()
    out = settled(found)
    for path in made:
        _delete(out, path)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a settled DataFrame that no later plan reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.rsplit("/", 1)[1].startswith("settled-"):
            _delete(df, path)


def _delete(df: DataFrame, path: str) -> None:
    target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
