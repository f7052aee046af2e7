"""Shard assignment by jump consistent hashing, in DataFrame functions only.

A key walks through the shard counts at which it moves: from bucket ``b`` its pseudo-random stream
names the next count above which it would live elsewhere. The last bucket below the shard count is
its shard. No ring table exists, and when a shard is appended a key stays or goes to the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The multiplier of the published algorithm's linear congruential generator.
LCG_MULTIPLIER = 2862933555777941757
_LOW = LCG_MULTIPLIER & 0xFFFFFFFF
_HIGH = LCG_MULTIPLIER >> 32
_32 = 0xFFFFFFFF

#: Rows of the table of slot offsets at most: shards x ranges. It is broadcast (24 bytes a row).
OFFSET_ROWS = 262_144


def _lit(v: int) -> Column:
    return F.lit(v).cast("long")


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The generator's next state, key * multiplier + 1 modulo 2^64, in 32-bit halves.

    Each product stays below 2^63, so it holds with ANSI overflow checks on.
    """
    first = lo.bitwiseAND(_lit(0xFFFF)) * _lit(_LOW) + _lit(1)
    second = F.shiftrightunsigned(first, 16) + F.shiftrightunsigned(lo, 16) * _lit(_LOW)
    low = F.shiftleft(second.bitwiseAND(_lit(0xFFFF)), 16).bitwiseOR(first.bitwiseAND(_lit(0xFFFF)))
    top = F.shiftleft((F.shiftrightunsigned(hi, 16) * _lit(_LOW)).bitwiseAND(_lit(0xFFFF)), 16)
    high = (
        F.shiftrightunsigned(second, 16)
        + (lo * _lit(_HIGH)).bitwiseAND(_lit(_32))
        + (hi.bitwiseAND(_lit(0xFFFF)) * _lit(_LOW)).bitwiseAND(_lit(_32))
        + top
    ).bitwiseAND(_lit(_32))
    return high, low


def jump_walk(key: Column, shards: int) -> Column:
    """Struct ``shard`` (of ``shards``) and ``grown`` (of ``shards + 1``) for a long ``key``; null as 0."""
    key = F.coalesce(key.cast("long"), _lit(0))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(_lit(_32)).alias("lo"),
        F.lit(0.0).alias("j"),
        _lit(0).alias("shard"),
        _lit(0).alias("grown"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        jump = F.floor((s["j"] + 1) * (F.lit(2147483648.0) / (F.shiftrightunsigned(hi, 1) + 1).cast("double")))
        moved = F.struct(
            hi.alias("hi"),
            lo.alias("lo"),
            jump.cast("double").alias("j"),
            F.when(s["j"] < shards, s["j"].cast("long")).otherwise(s["shard"]).alias("shard"),
            s["j"].cast("long").alias("grown"),
        )
        return F.when(s["j"] < shards + 1, moved).otherwise(s)

    # Each step goes up by one bucket at least: shards + 1 steps always reach the end.
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, step, lambda s: F.struct(s["shard"], s["grown"]))


def shard_rows(df: DataFrame, shards: int, key_col: str = "doc_id", text_col: str = "text", grow: bool = True) -> DataFrame:
    """Per row of ``df``: key, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    ``slot`` numbers the rows of a shard without gaps from 0. A shard's rows are cut into ranges of
    the key's mixed bits; each range is ordered on its own and shifted by the rows before it, so no
    task holds a shard. ``df`` is read twice, the second time for its keys alone.

    A null key walks as key 0; a null text has size 8 and checksum 0; repeated rows get a slot each;
    an empty table gives no rows; further columns are ignored, whatever their names. Text is never cut.
    """
    ranges = max(1, OFFSET_ROWS // (shards + 1))
    key = F.col(key_col).cast("long")

    def placed(columns: list[Column]) -> DataFrame:
        # The range is one of the mixed key, so that keys in sequence spread over all of them.
        return df.select(
            *columns,
            jump_walk(key, shards).alias("_walk"),
            F.pmod(F.xxhash64(F.coalesce(key, _lit(0))), _lit(ranges)).cast("int").alias("_range"),
        ).select("*", F.col("_walk.shard").cast("int").alias("shard"), F.col("_walk.grown").cast("int").alias("grown_shard")).drop("_walk")

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = placed(
        [
            key.alias(key_col),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        ]
    )
    counts = placed([]).groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_range", F.coalesce(F.sum("_n").over(before), _lit(0)).alias("_offset"))
    inside = Window.partitionBy("shard", "_range").orderBy(F.col(key_col).asc_nulls_first(), "text_crc32", "size")
    return (
        rows.withColumn("_slot", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["shard", "_range"])
        .select(
            key_col,
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("_offset") + F.col("_slot") - 1).alias("slot"),
            (F.col("grown_shard") if grow else F.lit(None).cast("int")).alias("grown_shard"),
        )
    )
