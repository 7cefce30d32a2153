"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE splits skewed join partitions, coalesces small shuffle partitions and picks
# broadcast joins from measured sizes, so the operators carry almost no hints.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "134217728",
}


def build_session(app: str = "wardline", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the recommended settings; on a cluster leave ``master`` unset."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
