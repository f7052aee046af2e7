"""Joins of rows to the groups they belong to, safe for groups that hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group with more than this share of all rows is hot: there are at most 1,000 such groups.
HOT_SHARE = 0.001


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` with the columns of their group; each row's key is in ``groups`` once.

    ``size`` is the group's number of rows. The few hot groups are broadcast (their number is
    bounded by the share), so their rows meet them without a shuffle; the others join by key. Read
    ``groups`` from a stored table: it is read three times.
    """
    total = groups.agg(F.sum(size).alias("n")).collect()[0]["n"] or 0
    hot = F.col(size) > F.lit(int(total * HOT_SHARE))
    near = rows.join(F.broadcast(groups.where(hot).withColumn("_hot", F.lit(True))), keys, "left")
    done = near.where("_hot").drop("_hot")
    rest = near.where("_hot IS NULL").select(*rows.columns).join(groups.where(~hot), keys)
    return done.unionByName(rest)
