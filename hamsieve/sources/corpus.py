"""Reading mail corpora and writing split tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hamsieve.functions.bytes import decode_bytes, decode_ignoring, java_charsets
from hamsieve.sources.quoted import read_records

CSV_SCHEMA = T.StructType(
    [T.StructField("file", T.StringType()), T.StructField("message", T.StringType())]
)
SPLIT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("label", T.IntegerType()),
    ]
)
MAIL_GLOB = "*.{lorien,eml,txt}"
SPLITS = ("train", "validate", "test")
_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def read_mail_csv(spark: SparkSession, path: str) -> DataFrame:
    """``file, message``; a message is a whole raw mail over many lines. A large file is read in many tasks; see ``quoted``."""
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in _CSV.items() if k != "header"}
    record = F.from_csv("record", CSV_SCHEMA.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)
    return read_records(spark, path).select(record.alias("r")).select("r.file", "r.message")


def write_mail_csv(df: DataFrame, path: str) -> None:
    df.select("file", "message").write.options(header=True, quote='"', escape='"').csv(path)


def decode_mails(df: DataFrame, charset: str | None = None, content: str = "content") -> DataFrame:
    """Replace the bytes of whole mails by ``message`` and ``latin1``.

    ``latin1`` is set where neither a given set nor UTF-8 fits: then byte n stands as character n, and
    the parts are decoded later, each by the set that it declares.
    """
    declared = F.lit(charset) if charset else None
    known = F.is_valid_utf8(F.col(content).cast("string")) | F.lit(charset is not None)
    with java_charsets(df.sparkSession):
        return df.withColumn("message", decode_bytes(F.col(content), declared)).withColumn("latin1", ~known).drop(content)


def read_mail_files(
    spark: SparkSession, path: str, glob: str = MAIL_GLOB, charset: str | None = None
) -> DataFrame:
    """``path, message, latin1``: one row per mail file below ``path``, at any depth; see ``decode_mails``."""
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(path)
    )
    return decode_mails(raw.select("path", "content"), charset)


def read_mail_files_for_scoring(spark: SparkSession, path: str, glob: str = "*.{eml,txt}") -> DataFrame:
    """As ``read_mail_files``, but read as UTF-8 with bad bytes dropped."""
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(path)
    )
    return raw.select("path", decode_ignoring(F.col("content")).alias("message"))


def write_splits(df: DataFrame, path: str) -> None:
    """Replace the split table below ``path``: one folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The table, or one split of it; only that split's folder is read."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split).drop("split")


def write_split_csv(df: DataFrame, path: str) -> None:
    """``path/train``, ``path/validate``, ``path/test``: folders of CSV files, replaced."""
    for split in SPLITS:
        part = df.where(F.col("split") == split)
        part.select("id", "subject", "body", "label").write.mode("overwrite").options(
            header=True, quote='"', escape='"'
        ).csv(f"{path}/{split}")


def read_split_csv(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split; a missing subject or body is an empty text, never the word for it."""
    df = spark.read.schema(SPLIT_SCHEMA).options(**_CSV).csv(f"{path}/{split}")
    return df.fillna("", ["subject", "body"])
