"""Session settings that every result depends on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "subledger", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``settings`` (dots as double underscores) come on top. On a cluster the master and sizes come from spark-submit."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
