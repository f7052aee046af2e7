"""A table that grows by committed batches, and a log of numbered entries, on a shared folder.

Both rest on one step: a file that is made whole, and only if there is none of its name. Of two writers
that want the same name one wins and the other is told so.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = "entry-{:012d}.json"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Make the file ``path`` with ``text``, unless there is one: then nothing happens and the answer is False.

    The text is written beside it first. A local folder takes it by a hard link, any other by a renaming
    that fails where the name is taken, as it does on a distributed file system.
    """
    fs, target = _file_system(spark, path)
    fs.mkdirs(target.getParent())
    jvm = spark._jvm
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    stream = fs.create(beside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if fs.getScheme() != "file":
            return not fs.exists(target) and fs.rename(beside, target)
        names = [jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).toPath() for p in (target, beside)]
        try:
            jvm.java.nio.file.Files.createLink(*names)
            return True
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
    finally:
        fs.delete(beside, False)


def commit_batch(df: DataFrame, path: str, writer: str, batch: int | str) -> bool:
    """Add ``df`` to the table at ``path`` as this writer's ``batch``; False if that was committed before.

    An attempt is written aside, where no reader looks, and committed by one small file. A batch that is
    replayed after a crash, or written twice at once, counts once: the first commit stands and the other
    attempt is deleted. What a crash leaves uncommitted is never read.
    """
    spark = df.sparkSession
    name = f"{path}/committed/{_plain(writer)}-{_plain(str(batch))}"
    fs, mark = _file_system(spark, name)
    if fs.exists(mark):
        return False
    attempt = uuid.uuid4().hex
    df.write.parquet(f"{path}/data/attempt={attempt}")
    if create_if_absent(spark, name, json.dumps({"attempt": attempt, "writer": writer, "batch": str(batch)})):
        return True
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data/attempt={attempt}"), True)
    return False


def _plain(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9.]", lambda m: f"_{ord(m[0]):x}_", name)


def committed_batches(spark: SparkSession, path: str) -> DataFrame:
    """``attempt, writer, batch`` of every committed batch."""
    return spark.read.schema("attempt string, writer string, batch string").json(f"{path}/committed")


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all committed batches, each once. A scan of their folders; the others are pruned."""
    rows = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")
    rows = rows.withColumn("attempt", F.col("attempt").cast("string"))
    # A row per batch, so the marks are as few as the folders that the scan lists anyway.
    marks = F.broadcast(committed_batches(spark, path).select("attempt"))
    return rows.join(marks, "attempt", "left_semi").drop("attempt")


def last_entry(spark: SparkSession, path: str) -> int:
    """The highest number in the log at ``path``; 0 if it is empty."""
    fs, folder = _file_system(spark, path)
    if not fs.exists(folder):
        return 0
    numbers = [re.fullmatch(r"entry-(\d+)\.json", s.getPath().getName()) for s in fs.listStatus(folder)]
    return max((int(n[1]) for n in numbers if n), default=0)


def append_entry(spark: SparkSession, path: str, entry: dict, after: int) -> bool:
    """Make ``entry`` number ``after + 1`` of the log; False if another writer was first."""
    return create_if_absent(spark, f"{path}/{_ENTRY.format(after + 1)}", json.dumps({"version": after + 1, **entry}))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"version long, {schema}").json(path)
