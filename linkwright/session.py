"""Session settings that suit the engine's plans."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "linkwright", master: str | None = None, **settings: str) -> SparkSession:
    """Adaptive execution on (coalescing, skew splits), UTC, Arrow; anything can be set over it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
