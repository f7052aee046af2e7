"""Spark session for tests, benches and local runs; clusters bring their own."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

from hamsieve.sources.tables import SPREAD


def local_session(cpus: int | str = "*", name: str = "hamsieve", shuffle_partitions: int = 8, spread: int | None = None) -> SparkSession:
    """A local session. On a cluster use the session the cluster gives: nothing here is required.

    ``spread`` deals small text tables to so many tasks. A scratch folder is made where the session's
    defaults name none: all executors of a local session share it.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("HAMSIEVE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Call sites of every column expression cost more than the queries at test scale.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if spread:
        builder = builder.config(SPREAD, str(spread))
    spark = builder.getOrCreate()
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hamsieve-"))
    spark.sparkContext.setLogLevel("ERROR")
    return spark
