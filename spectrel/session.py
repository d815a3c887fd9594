"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """UTC, ANSI mode as it is by default, adaptive execution, Arrow transfers; conf overrides."""
    b = SparkSession.builder.master(master).appName("spectrel")
    settings = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false"}
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
