"""Scoring mails as they arrive.

Cleaning, features and the linear scorer are narrow, so a stream runs the same expressions as a
batch: no state, no watermark. Each micro-batch is committed to the prediction history once, whatever is
restarted, and beside what other streams and jobs commit there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hamsieve.sources.artifacts import append_predictions
from hamsieve.sources.corpus import MAIL_GLOB


def mail_stream(
    spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None
) -> DataFrame:
    """Parquet files of mails appearing below ``path``."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def mail_file_stream(spark: SparkSession, path: str, glob: str = MAIL_GLOB) -> DataFrame:
    """Raw mail files appearing below ``path``: ``path, modificationTime, length, content``."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(path)
    )


def score_stream(
    mails: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    history: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Append every scored mail to the prediction history at ``history``.

    A micro-batch that is replayed has the number and the stream of the first try, and counts once.
    """

    def commit(batch: DataFrame, number: int) -> None:
        # The stream's identity outlives restarts from its checkpoint.
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        append_predictions(score(batch), history, f"stream:{stream}", number)

    writer = mails.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(commit)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
