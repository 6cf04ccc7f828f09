"""A session with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "learnmill", **conf: str) -> SparkSession:
    """UTC, adaptive execution on; other settings as keywords with ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


#: Rows and bytes of an Arrow batch, so that long texts do not pile up in a Python worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches where the session has no sizes of its own; what a user has set stays."""
    given = spark.conf.getAll
    for name, value in BATCH.items():
        if name not in given:
            spark.conf.set(name, value)
