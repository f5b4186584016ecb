"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # created_at and fetched_at are zone-less UTC; epoch conversions go through the session zone.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: joins switch to broadcast on measured size, skewed partitions are split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Most of what is shuffled or spilled is text, which zstd packs tighter than lz4 for some CPU time; of use at start-up only.
    "spark.io.compression.codec": "zstd",
    # Recording the call site of every column expression takes most of the time of building a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "echolens", master: str | None = None, **settings: str) -> SparkSession:
    """Session with ``SETTINGS``; keyword settings use ``__`` for dots and win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    overrides = {key.replace("__", "."): value for key, value in settings.items()}
    for key, value in {**SETTINGS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
