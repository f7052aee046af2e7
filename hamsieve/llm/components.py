"""Connected components of an undirected graph, by label minimum and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (smallest id reachable) of every vertex of ``edges`` (``a``, ``b``).

    In each round a vertex takes the smallest label among its neighbours, then the label of its
    label; rounds grow with the logarithm of the longest path. Labels are cut off from their lineage
    by ``checkpoint``; only the number of changes comes to the driver. No edges give no rows.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")).checkpoint()
    while True:
        around = (
            both.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(around, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        target = labels.select(F.col("id").alias("component"), F.col("component").alias("beyond"))
        new = (
            lower.join(target, "component", "left")
            .select("id", "was", F.least("component", F.coalesce("beyond", "component")).alias("component"))
            .checkpoint()
        )
        changed = new.where("component <> was").limit(1).count()
        labels = new.select("id", "component")
        if not changed:
            return labels
