"""Session settings shared by the bench and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(cores: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with UTC time, AQE and small shuffles."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millrace")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
