"""One pinned session for tests, benches and the driver's smoke run."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, app: str = "recordspark") -> SparkSession:
    """A local session; under spark-submit the master and sizes that it was given are kept."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # started by spark-submit
        return SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
