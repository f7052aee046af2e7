"""Evaluation: binary metrics, confusion, ROC, losses and training history, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hamsieve.functions import fixed
from hamsieve.functions.numbers import ratio
from hamsieve.functions.text import percent
from hamsieve.sources.scratch import materialize

METRICS = ("accuracy", "precision", "recall", "f1")
_EPS = 1e-15


def binary_metrics(df: DataFrame, *by: str, label: str = "label", pred: str = "pred") -> DataFrame:
    """Accuracy, and precision, recall and F1 of class 1; 0 where undefined. One pass."""
    y, p = F.col(label), F.col(pred)
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y == p).alias("hits"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.select(
        *by,
        ratio(F.col("hits"), F.col("n")).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def metrics_report(metrics: DataFrame, *by: str) -> DataFrame:
    """``metric, value, shown``: one row per metric, with its percentage as text."""
    names = {"accuracy": "Accuracy", "precision": "Precision", "recall": "Recall", "f1": "F1 Score"}
    pairs = ", ".join(f"'{names[m]}', {m}" for m in METRICS)
    return metrics.select(
        *by, F.expr(f"stack({len(METRICS)}, {pairs}) AS (metric, value)")
    ).withColumn("shown", percent(F.col("value")))


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """``label, pred_0, pred_1``: counts by true and predicted class; both rows always present."""
    counted = df.agg(
        *[
            F.count_if((F.col(label) == y) & (F.col(pred) == p)).alias(f"c{y}{p}")
            for y in (0, 1)
            for p in (0, 1)
        ]
    )
    return counted.select(
        F.expr("stack(2, 0, c00, c01, 1, c10, c11) AS (label, pred_0, pred_1)")
    )


def normalized_confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Confusion with each row summing to 1; a class that does not occur has no row."""
    both = F.col("pred_0") + F.col("pred_1")
    return (
        confusion(df, label, pred)
        .where(both > 0)
        .select(
            "label",
            ratio(F.col("pred_0"), both).alias("pred_0"),
            ratio(F.col("pred_1"), both).alias("pred_1"),
        )
    )


def _points(df: DataFrame, label: str, prob: str) -> DataFrame:
    """``threshold, pos, neg, range``: a row per distinct score, in ranges of the falling score, stored.

    Ranges are cut where the scores lie, however they crowd at 0 and 1, so that no task has many
    more points than another. Equal scores are one point, summed in each task before anything is shuffled.
    """
    y = F.col(label)
    points = df.groupBy(F.col(prob).alias("threshold")).agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    return materialize(points.repartitionByRange(F.desc("threshold")).withColumn("range", F.spark_partition_id()), "roc-points")


def roc_curve(df: DataFrame, label: str = "label", prob: str = "spam_prob") -> DataFrame:
    """``threshold, fpr, tpr``; starts at (0, 0) with a null threshold, drops collinear points.

    Points are summed within their ranges, which are then shifted by the ranges above.
    """
    points = _points(df, label, prob)
    inside = Window.partitionBy("range").orderBy(F.desc("threshold"))
    first = F.max_by(F.struct("pos", "neg"), "threshold")
    ranges = points.groupBy("range").agg(
        F.sum("pos").alias("rpos"), F.sum("neg").alias("rneg"), first.alias("first")
    )
    # A row per range from here on, in one task.
    down = Window.orderBy("range")
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select(
        "range",
        F.coalesce(F.sum("rpos").over(above), F.lit(0)).alias("tp_above"),
        F.coalesce(F.sum("rneg").over(above), F.lit(0)).alias("fp_above"),
        F.sum("rpos").over(whole).alias("all_pos"),
        F.sum("rneg").over(whole).alias("all_neg"),
        F.lead("first").over(down).alias("next_range"),
    )
    nxt = F.coalesce(F.lead(F.struct("pos", "neg")).over(inside), F.col("next_range"))
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    curve = (
        points.join(F.broadcast(ranges), "range")
        .withColumn("next", nxt)
        .withColumn("tp", F.col("tp_above") + F.sum("pos").over(running))
        .withColumn("fp", F.col("fp_above") + F.sum("neg").over(running))
    )
    is_first = F.col("tp") + F.col("fp") == F.col("pos") + F.col("neg")
    # On a straight stretch the step into a point equals the step out of it.
    bends = (F.col("next.pos") != F.col("pos")) | (F.col("next.neg") != F.col("neg"))
    kept = curve.where(is_first | F.col("next").isNull() | bends).select(
        "threshold",
        ratio(F.col("fp"), F.col("all_neg")).alias("fpr"),
        ratio(F.col("tp"), F.col("all_pos")).alias("tpr"),
    )
    start = df.sparkSession.createDataFrame(
        [(None, 0.0, 0.0)], "threshold double, fpr double, tpr double"
    )
    return start.unionByName(kept)


def roc_auc(df: DataFrame, label: str = "label", prob: str = "spam_prob") -> DataFrame:
    """``auc`` by trapezoids, summed as rank statistics: each positive beats the negatives below it.

    A positive and a negative of one score count half. Uses the same ranges as the curve.
    """
    points = _points(df, label, prob)
    below = Window.partitionBy("range").orderBy("threshold").rowsBetween(
        Window.unboundedPreceding, -1
    )
    negatives_below = F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") / 2
    ranges = (
        points.withColumn("wins", F.col("pos") * negatives_below)
        .groupBy("range")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("wins").alias("wins"))
    )
    # A row per range.
    lower = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranges.withColumn(
            "wins", F.col("wins") + F.col("pos") * F.coalesce(F.sum("neg").over(lower), F.lit(0))
        )
        .agg(ratio(F.sum("wins"), F.sum("pos") * F.sum("neg").cast("double")).alias("auc"))
    )


# --- losses ------------------------------------------------------------------------------------


def cross_entropy(label: Column, prob: Column) -> Column:
    """-ln of the probability given to the true class."""
    p = F.when(label == 1, prob).otherwise(1.0 - prob)
    return -F.log(F.greatest(p, F.lit(_EPS)))


def log_loss(df: DataFrame, *by: str, label: str = "label", prob: str = "spam_prob") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(cross_entropy(F.col(label), F.col(prob))).alias("log_loss"))


def batched_log_loss(
    df: DataFrame, batch: Column, label: str = "label", prob: str = "spam_prob"
) -> DataFrame:
    """Mean over batches of the batch means: a short last batch weighs as much as a full one."""
    means = df.groupBy(batch.alias("batch")).agg(
        F.avg(cross_entropy(F.col(label), F.col(prob))).alias("loss")
    )
    return means.agg(F.avg("loss").alias("log_loss"))


# --- training history --------------------------------------------------------------------------

HISTORY_COLUMNS = ("epoch", "train_loss", "val_loss", "accuracy", "precision", "recall", "f1")


def best_epoch(history: DataFrame, run: str = "run_id") -> DataFrame:
    """``run_id, epoch, f1``: the earliest epoch of the highest F1; none where F1 never rises above 0."""
    return (
        history.where(F.col("f1") > 0)
        .groupBy(run)
        .agg(F.max_by(F.struct("epoch", "f1"), F.struct("f1", -F.col("epoch"))).alias("b"))
        .select(run, F.col("b.epoch").alias("epoch"), F.col("b.f1").alias("f1"))
    )


def early_stop(
    history: DataFrame, run: str = "run_id", patience: int = fixed.PATIENCE
) -> DataFrame:
    """``run_id, best_epoch, stop_epoch``: first epoch with ``patience`` epochs since the last gain.

    ``best_epoch`` looks only at the epochs up to the stop and is 0 without any gain; ``stop_epoch``
    is null for a run that was never stopped. Epochs count from 1; a run has few.
    """
    before = Window.partitionBy(run).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(run).orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    gain = F.col("f1") > F.coalesce(F.max("f1").over(before), F.lit(0.0))
    marked = (
        history.withColumn("gain_epoch", F.when(gain, F.col("epoch")))
        .withColumn("last_gain", F.coalesce(F.max("gain_epoch").over(upto), F.lit(0)))
        .withColumn("stops", F.col("epoch") - F.col("last_gain") >= patience)
    )
    stop = F.min(F.when(F.col("stops"), F.col("epoch")))
    best_at_stop = F.min_by(
        F.when(F.col("stops"), F.col("last_gain")), F.when(F.col("stops"), F.col("epoch"))
    )
    return marked.groupBy(run).agg(
        F.coalesce(best_at_stop, F.max("last_gain")).cast("int").alias("best_epoch"),
        stop.cast("int").alias("stop_epoch"),
    )
