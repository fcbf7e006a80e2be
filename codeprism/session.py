"""A session with the settings that the engine's results rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """UTC timestamps, adaptive execution (coalescing, skewed joins), no interactive UI."""
    b = SparkSession.builder.master(master).appName("codeprism")
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false"}
    return b.config(map=base | conf).getOrCreate()
