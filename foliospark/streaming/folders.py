"""New documents as they arrive: the batch plans, once for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import stem
from ..plans.pipelines import markdown_tree


def watch_markdown(spark: SparkSession, folder: str, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Trees of Markdown files that come into a folder, appended as Parquet. Documents are independent, so no state is kept.

    A micro-batch that is run again overwrites its own part, so each document is written once.
    """

    def one(batch: DataFrame, number: int) -> None:
        markdown_tree(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    rows = files.select(stem(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("text"))
    writer = rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
