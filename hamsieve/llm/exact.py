"""Exact duplicates through an extendible-hash index on shared files, in DataFrame functions only.

A row's address is the leading bits of a 64-bit hash of its normalised text. Counts per address
decide how deep each bucket's address is: where a bucket is overfull the directory doubles, and only
that bucket splits. The index is written in the order of its buckets to the shared folder. Owner
tasks hold ranges of the key space: within a bucket, entries with one hash form a chain, and the
texts of a chain are compared byte for byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hamsieve.llm.joins import join_groups
from hamsieve.sources.scratch import materialize

#: Rows that a bucket holds before it splits, and address bits at most (2^14 directory rows, broadcast).
#: Beyond that depth a bucket keeps what it has: longer chains, same results.
CAPACITY = 4096
MAX_DEPTH = 14



def _whole(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(20,0)")


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]", "")


def _address(hash_col: str, depth: int) -> Column:
    """The leading ``depth`` bits of a 64-bit hash."""
    return F.shiftrightunsigned(hash_col, 64 - depth)


def directory(hashes: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``slot`` (2^max_depth addresses that occur), ``depth`` and ``bucket`` (first full address).

    A bucket's local depth is the smallest at which its address holds ``capacity`` rows or fewer.
    """
    counts = hashes.groupBy(_address("hash", max_depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    # Doubling read backwards: every slot under each of its shorter addresses.
    shorter = counts.select("slot", "n", F.explode(F.sequence(F.lit(1), F.lit(max_depth))).alias("depth")).withColumn(
        "address", F.expr(f"shiftright(slot, {max_depth} - depth)")
    )
    filled = shorter.withColumn("rows", F.sum("n").over(Window.partitionBy("depth", "address")))
    fits = F.min(F.when(F.col("rows") <= capacity, F.col("depth")))
    return (
        filled.groupBy("slot")
        .agg(F.coalesce(fits, F.lit(max_depth)).alias("depth"))
        .withColumn("bucket", F.expr(f"shiftleft(shiftright(slot, {max_depth} - depth), {max_depth} - depth)"))
    )


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Equal: identical after white space is deleted. The row with the most code points stays, then the
    smallest id. A null text is an empty one; all empty texts form one group; a null id sorts after
    all others; a repeated row (same id) shares its group's ``keep_id`` and counts as a row. An empty
    table gives no rows; further columns are ignored. Texts are never cut.

    Equal texts are summed in each task before anything is shuffled, so a text that is a third of
    the corpus costs one row a task. ``df`` is read three times.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = df.select(F.col(id_col).cast("long").alias(id_col), text.alias("_text"))
    norm = base.select(id_col, F.char_length("_text").alias("_chars"), without_space(F.col("_text")).alias("_norm"))
    hashed = norm.withColumn("hash", F.xxhash64("_norm"))

    entries = F.broadcast(directory(hashed.select("hash")))
    # One number orders candidates: more code points first, then the smaller id (null last).
    rank = F.col("_chars").cast("decimal(10,0)") * _whole(1 << 64) - F.coalesce(
        F.col(id_col), F.lit((1 << 63) - 1)
    ).cast("decimal(20,0)")
    # Grouping by the text itself compares bytes within each chain.
    chains = hashed.groupBy("hash", "_norm").agg(
        F.max(rank).alias("_rank"), F.count(F.lit(1)).alias("group_size")
    )
    index = (
        chains.select(
            "hash",
            F.sha2(F.col("_norm"), 256).alias("text_sha256"),
            "group_size",
            _unrank("_rank").alias("keep_id"),
            _address("hash", MAX_DEPTH).alias("slot"),
        )
        .join(entries, "slot")
        .drop("slot", "depth")
        .repartitionByRange("bucket", "hash")
        .sortWithinPartitions("bucket", "hash")
    )
    index = materialize(index, "exact-index").drop("bucket")

    rows = norm.select(id_col, F.xxhash64("_norm").alias("hash"), F.sha2(F.col("_norm"), 256).alias("text_sha256"))
    joined = join_groups(rows, index, ["hash", "text_sha256"], "group_size")
    return (
        joined
        .select(
            id_col,
            "keep_id",
            "group_size",
            F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"),
            "text_sha256",
        )
    )


def _unrank(name: str) -> Column:
    """The id in a rank, chars * 2^64 - id: back from the remainder."""
    shift = _whole(1 << 64)
    rest = F.pmod(-F.col(name), shift)
    signed = F.when(rest >= _whole(1 << 63), rest - shift).otherwise(rest).cast("long")
    return F.when(signed == F.lit((1 << 63) - 1), F.lit(None).cast("long")).otherwise(signed)
