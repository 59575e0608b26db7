"""A session with the settings that the library is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "weftline", checkpoint_dir: str | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive execution with skew handling, and a checkpoint folder that all executors share. ANSI mode stays on: what may
    fail on a row uses try_ functions."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if checkpoint_dir:
        b = b.config("spark.checkpoint.dir", checkpoint_dir)
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
