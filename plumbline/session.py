"""A Spark session with the settings that the library is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "plumbline", **conf: str) -> SparkSession:
    """Adaptive execution, UTC, and checkpoints removed when nothing refers to them; conf overrides or adds settings (dots written as double underscores)."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
