"""A session with the settings that the library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "riverdeck", master: str | None = None, **more: str) -> SparkSession:
    """A session; ``more`` has settings with underscores for dots.  Name a shared ``spark_checkpoint_dir`` on a cluster."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | {k.replace("_", "."): v for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()
