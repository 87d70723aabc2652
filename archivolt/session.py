"""Session settings the engine expects; on a cluster they come from the submitter."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(name: str = "archivolt", cores: int | str = "*", shuffle: int = 8, memory: str = "8g", checkpoint: str | None = None) -> SparkSession:
    """A session on this machine: UTC, adaptive plans, few shuffle partitions."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if checkpoint:
        builder = builder.config("spark.checkpoint.dir", checkpoint)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a temporary one only on one machine, where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="archivolt-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
