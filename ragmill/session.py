"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "ragmill", **conf: str) -> SparkSession:
    """A session with adaptive plans and Arrow; ``conf`` takes underscores for dots."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()
