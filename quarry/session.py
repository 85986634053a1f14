"""A session with the settings the operators are tuned for."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str | None = None, app: str = "quarry") -> SparkSession:
    """Session for tests and single-machine runs.

    On a cluster use the session that spark-submit provides; nothing below is required for
    correct results, only for sensible local partition counts.
    """
    cores = cores or os.environ.get("BENCH_CPUS") or "*"
    parts = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, for applications that start outside its folder. Once for each application."""
    context = spark.sparkContext
    name = f"quarry-{context.applicationId}.zip"
    if any(f.endswith(name) for f in context.listFiles):
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="quarry-"), name)  # the driver serves it to the executors until it ends
    with zipfile.ZipFile(path, "w") as packed:
        for file in sorted(top.rglob("*.py")):
            packed.write(file, file.relative_to(top.parent))
    context.addPyFile(str(path))
