"""Labelling, union, sampling, ordering and exact splits.

Random order is the order of ``md5(seed:id)``: it is uniform, the same in every run and engine, and
makes a split a comparison of keys instead of a global sort.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hamsieve.functions import fixed
from hamsieve.sources.scratch import materialize

_HEX_PER_STEP = 3
_KEY_DIGITS = 32


def shuffle_key(id_col: str | Column, seed: int = fixed.SEED) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def with_label(df: DataFrame, label: int) -> DataFrame:
    return df.withColumn("label", F.lit(label).cast("int"))


def union_corpora(*frames: DataFrame) -> DataFrame:
    """Bag union by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def first_n(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first ``n`` rows in an explicit order; Spark has no file order of its own."""
    return df.orderBy(*order).limit(n)


def first_accepted(mails: DataFrame, n: int, judge: Callable[[DataFrame], DataFrame], order: str = "id") -> DataFrame:
    """The first ``n`` rows in the order of a column that ``judge`` keeps, as ``first_n(judge(mails), n, order)`` gives them.

    Costly judging stops early: rows are judged in steps, each as long as the share kept so far asks for, and a
    step reads only its own stretch of the order (which the table's statistics prune). ``judge`` must
    look at each row by itself. Rows without a key come first.
    """
    parts, found, seen, step = [], 0, 0, n + n // 4 + 1
    rest = mails
    while found < n:
        head = rest.select(order).orderBy(order).limit(step).agg(F.max(order).alias("last"), F.count(F.lit(1)).alias("rows")).first()
        if not head["rows"]:
            break
        own = F.col(order).isNull() if head["last"] is None else F.col(order).isNull() | (F.col(order) <= F.lit(head["last"]))
        parts.append(materialize(judge(rest.where(own)), "first"))
        found += parts[-1].count()
        seen += head["rows"]
        missing = n - found
        step = max(step, int(1.25 * missing * seen / found) + 1 if found else 2 * step)
        rest = mails.where(F.col(order).isNotNull() if head["last"] is None else F.col(order) > F.lit(head["last"]))
    if not parts:
        return judge(mails.limit(0))
    return first_n(reduce(DataFrame.unionByName, parts), n, order)


def sample_n(df: DataFrame, n: int, id_col: str = "id", seed: int = fixed.SEED) -> DataFrame:
    """``n`` rows in seeded random order; ids must be unique."""
    return first_n(df, n, shuffle_key(id_col, seed), F.col(id_col))


def _kth_key(keys: DataFrame, k: int) -> str | None:
    """The k-th smallest (from 0) of a column ``key`` of hex digests; None past the end.

    Radix selection: count by the next three digits, keep the one bucket that holds the k-th, and
    repeat until one row is left or the key is whole. No step sorts or moves more than counts.
    """
    prefix = ""
    while True:
        n = len(prefix) + _HEX_PER_STEP
        counts = (
            keys.where(F.startswith("key", F.lit(prefix)))
            .groupBy(F.substring("key", 1, n).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()  # 16 ** 3 rows at most
        )
        for row in sorted(counts, key=lambda r: r["bucket"]):
            if k < row["n"]:
                prefix, rows = row["bucket"], row["n"]
                break
            k -= row["n"]
        else:
            return None
        if n >= _KEY_DIGITS:
            # The whole key: all rows of the bucket have it.
            return prefix
        if rows == 1:
            return keys.where(F.startswith("key", F.lit(prefix))).first()["key"]


def exact_split(
    df: DataFrame,
    id_col: str = "id",
    train: float = fixed.TRAIN_RATIO,
    val: float = fixed.VAL_RATIO,
    seed: int = fixed.SEED,
) -> DataFrame:
    """Add ``split``: int(n*train) rows train, the next int(n*val) validate, the rest test.

    ``id_col`` must be unique. ``df`` is read a few times, for ids only: pass a stored table. The
    rows themselves are never sorted or shuffled: they are compared with two cut keys.
    """
    key = shuffle_key(id_col, seed)
    keys = df.select(key.alias("key"))
    n = df.count()
    train_end = int(n * train)
    val_end = train_end + int(n * val)
    ends = {}
    for end in {train_end, val_end}:
        ends[end] = _kth_key(keys, end) if 0 < end < n else None

    def before(end: int) -> Column:
        if end <= 0 or end >= n:
            return F.lit(end > 0)
        return key < F.lit(ends[end])

    return df.withColumn(
        "split",
        F.when(before(train_end), "train").when(before(val_end), "validate").otherwise("test"),
    )


def global_rank(df: DataFrame, key: Column, id_col: str = "id", digits: int = 3) -> DataFrame:
    """Add ``position``: row number from 1 by the hex digest ``key``, then id, without one big task.

    Digests spread evenly over their first digits, so each bucket is sorted on its own and shifted
    by the rows before it. More ``digits``, more and smaller buckets.
    """
    keyed = df.withColumn("_key", key)
    bucketed = keyed.withColumn("_bucket", F.substring("_key", 1, digits))
    counts = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # 16 ** digits rows at most, so one task and a broadcast are safe.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_bucket").orderBy("_key", id_col)
    return (
        bucketed.join(F.broadcast(offsets), "_bucket")
        .withColumn("position", F.col("_offset") + F.row_number().over(inside))
        .drop("_bucket", "_key", "_offset")
    )


def split_summary(df: DataFrame) -> DataFrame:
    """Mails per split and label, with totals; ``all`` and -1 stand for the totalled key."""
    return (
        df.rollup("split", "label")
        .agg(F.count(F.lit(1)).alias("mails"))
        .select(
            F.coalesce("split", F.lit("all")).alias("split"),
            F.coalesce("label", F.lit(-1)).cast("int").alias("label"),
            "mails",
        )
    )
