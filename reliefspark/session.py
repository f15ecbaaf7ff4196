"""Session helper and table access."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "reliefspark", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster the session is usually given; nothing in the library depends on this helper.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # one block row carries up to 0.5 MB of heights: keep Arrow batches small
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("RELIEF_DRIVER_MEMORY", "12g"))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, stored as ``<sf_dir>/<name>.parquet``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staging_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that one step writes and another reads.

    It lies in the shared folder of the cluster, ``spark.checkpoint.dir``; a folder of our own is used only where
    none is configured and all tasks run on this machine (tests).
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
