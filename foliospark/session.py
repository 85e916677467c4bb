"""A session with the settings that the plans here expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive plans and UTC; masters and sizes are the cluster's unless given."""
    builder = SparkSession.builder.appName("foliospark")
    if master:
        builder = builder.master(master)
    for key, value in {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
