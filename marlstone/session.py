"""Session factory: UTC, adaptive execution, ANSI, microsecond timestamps, dynamic partition overwrite."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(name: str = "marlstone", master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; ``more`` adds or overrides settings (dots written as double underscores)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
