"""Shared scratch space and materialised intermediate tables.

A table that is read more than once (the cleaned corpus, above all) is written once as parquet to
the folder named by ``spark.checkpoint.dir`` and read back. The files outlive any executor, the
scan keeps column pruning and statistics, and the lineage is cut.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared scratch folder; nothing is created yet."""
    return f"{scratch_root(spark)}/hamsieve/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; DataFrames over them can no longer be read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/hamsieve/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
