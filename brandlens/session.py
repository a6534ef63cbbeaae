"""A session with the settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "brandlens", master: str | None = None, **conf: str) -> SparkSession:
    """A SparkSession in UTC with adaptive execution; ``conf`` overrides single settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
