"""Session helper for tests, the bench and notebooks; jobs on a cluster bring their own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "tallyforge", cpus: int | str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with adaptive execution, UTC and Arrow transfer."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("TALLYFORGE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
