"""Input tables and how their rows are dealt to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Session setting: deal the rows of text tables to so many tasks. Unset, tables are read as they lie.
#: For tables of one row group only, which no split size can spread over the cores.
SPREAD = "spark.hamsieve.spread"


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def text_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table whose rows are costly to process; see ``SPREAD``."""
    df = table(spark, folder, name, *columns)
    tasks = spark.conf.get(SPREAD, None)
    return df.repartition(int(tasks)) if tasks else df


def table_version(spark: SparkSession, folder: str, name: str) -> str:
    """The table's files, their sizes and times: another text whenever it is written anew."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}.parquet")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listStatus(root) if fs.getFileStatus(root).isDirectory() else [fs.getFileStatus(root)]
    return str(root) + "".join(sorted(f"|{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files))
