"""Counts of what plans do, without a second job: observations of each stage, written as a table."""

from __future__ import annotations

import threading
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

STAGES = "run string, step int, stage string, nodes_before long, nodes_after long, difference long, metrics map<string,string>"


class StageLog:
    """Rows and given aggregates of every watched stage, taken while the stage is computed.

    before names the stage that a stage starts from; its count and the difference stand beside the stage's own. Metrics are there once an
    action has computed the stage: call table() when all watched stages are computed, as it waits for those that aren't.
    """

    def __init__(self, run: str | None = None):
        self.run = run or uuid.uuid4().hex
        self._seen: list[tuple[str, str | None, Observation]] = []

    def watch(self, stage: str, df: DataFrame, before: str | None = None, **metrics: Column) -> DataFrame:
        seen = Observation(f"{self.run} {len(self._seen)} {stage}")
        self._seen.append((stage, before, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in metrics.items()))

    def rows(self) -> list[tuple]:
        counts: dict[str, int] = {}
        out = []
        for step, (stage, before, seen) in enumerate(self._seen):
            told = dict(seen.get)
            counts[stage] = after = int(told.pop("rows"))
            had = counts.get(before) if before else None
            out.append((self.run, step, stage, had, after, None if had is None else after - had, {k: None if v is None else str(v) for k, v in told.items()}))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), STAGES)

    def write(self, spark: SparkSession, path: str) -> None:
        """Append the stages to a Parquet table."""
        self.table(spark).coalesce(1).write.mode("append").parquet(path)


class StreamLog(StreamingQueryListener):
    """Observed metrics of streaming queries: df.observe(name, ...) of each batch, kept as rows (query, batch, at, name, metrics)."""

    ROWS = "query string, batch long, at timestamp, name string, metrics map<string,string>"

    def __init__(self) -> None:
        self._rows: list[tuple] = []
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        told = event.progress
        with self._lock:
            for name, row in (told.observedMetrics or {}).items():
                self._rows.append((str(told.id), told.batchId, datetime.now(timezone.utc), name, {k: str(v) for k, v in row.asDict().items()}))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        with self._lock:
            return spark.createDataFrame(list(self._rows), self.ROWS)
