"""Mixing to target weights by iterative proportional fitting over source, language and topic.

Tokens are summed per cell (source, language, topic). Raking scales the cells to each margin's
targets in turn until all margins hold, for a sample of a stated number of tokens. No cell gives more
than it has: cells that would are held at probability one, and the others are raked on over what
remains. So a scarce cell or value is short by itself and scales down nothing else. A document is
then drawn with its cell's probability.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hamsieve.sources.scratch import materialize

#: Raking stops at this relative distance from every target, or after so many sweeps.
TOLERANCE = 1e-6
SWEEPS = 40

#: What a margin aims at: a power of the share it has (0: uniform, 1: unchanged), or shares by value.
Target = float | Mapping[str, float]
DEFAULT_TARGETS: dict[str, Target] = {"source": 0.7, "lang": 0.8, "topic": 0.8}
#: Tokens to draw, as a share of all tokens, where the caller states none.
BUDGET = 0.5

_log = logging.getLogger(__name__)


def token_count(text: Column) -> Column:
    """Words between white space; null and blank texts have none."""
    words = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(words == "", F.lit(0)).otherwise(F.char_length(words) - F.char_length(F.replace(words, F.lit(" "), F.lit(""))) + 1).cast("long")


def topic_of(text: Column) -> Column:
    """What a text deals in, by the share of its characters: figures, mark-up, capitals, short or long prose."""
    text = F.coalesce(text, F.lit(""))
    size = F.char_length(text)

    def share(pattern: str) -> Column:
        return (size - F.char_length(F.regexp_replace(text, pattern, ""))) / F.greatest(size, F.lit(1))

    return (
        F.when(size == 0, "empty")
        .when(share("[0-9]+") > 0.1, "figures")
        .when(share(r"[#$%&*|<>{}=\\_]+") > 0.04, "markup")
        .when(share("[A-Z]+") > 0.3, "capitals")
        .when(size < 1000, "short")
        .otherwise("long")
    )


def _by_value(cells: DataFrame, targets: Mapping[str, Target], **sums: Column) -> DataFrame:
    """Sums over the cells of every value of every margin, by one aggregation: ``margin``, ``value`` and the sums."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("margin"), F.col(m).alias("value")) for m in targets)))
    return cells.select("*", each.alias("_of")).groupBy("_of.margin", "_of.value").agg(*(F.sum(c).alias(n) for n, c in sums.items()))


def _raw_goal(target: Target) -> Column:
    if isinstance(target, Mapping):
        if not target:
            return F.lit(0.0)
        wanted = F.create_map(*[F.lit(x) for kv in target.items() for x in kv])[F.col("value")]
        return F.coalesce(wanted.cast("double"), F.lit(0.0))
    return F.pow(F.col("had").cast("double"), F.lit(float(target)))


def _goals(table: DataFrame, targets: Mapping[str, Target]) -> DataFrame:
    """``margin``, ``value``, its tokens ``had`` and ``goal`` (share of the sample); only values that have tokens."""
    had = _by_value(table, targets, had=F.col("tokens"))
    raw = reduce(lambda c, m: c.when(F.col("margin") == m, _raw_goal(targets[m])), targets, F.when(F.lit(False), F.lit(0.0)))
    had = _few(had.withColumn("_raw", raw))
    whole = had.groupBy("margin").agg(F.sum("_raw").alias("_whole"))
    return had.join(F.broadcast(whole), "margin").select("margin", "value", "had", (F.col("_raw") / F.col("_whole")).alias("goal"))


#: Rows of cells or values in one task.
TASK_ROWS = 50_000
#: Cells (sums over all documents, counted before) that are raked in one task, some tens of megabytes; more are raked by
#: jobs over all of them, a step each, with the same result.
TASK_CELLS = 100_000


def _few(small: DataFrame, rows: int | None = None) -> DataFrame:
    """A stored copy of an aggregate, in as many files as its counted rows ask for, so that passes over it cost few tasks."""
    if rows is None:
        small = materialize(small, "mixing")
        rows = small.count()
    return materialize(small.coalesce(max(1, math.ceil(rows / TASK_ROWS))), "mixing")


def _wanted(values: DataFrame, targets: Mapping[str, Target], budget: float | None) -> tuple[DataFrame, float]:
    """``values`` (``margin``, ``value``, ``had``, ``goal``) with ``want``, and the tokens that are drawn in all.

    A value wants its goal of the tokens drawn. Where it has fewer it gives all of them, and the
    other values of the margin make up for it in proportion to their goals. Only sums per margin
    reach the driver.
    """
    positive = F.col("goal") > 0
    sums = values.groupBy("margin").agg(
        F.sum("had").alias("all"),
        F.sum(F.when(positive, F.col("had"))).alias("usable"),
        F.min(F.when(positive, F.col("had") / F.col("goal"))).alias("exact"),
    )
    rows = {r["margin"]: r for r in sums.collect()}
    if not rows:
        return values.withColumn("want", F.lit(0.0)), 0.0
    total = next(iter(rows.values()))["all"]
    size = (BUDGET if budget is None else budget) * total
    if budget is None:
        # Shares given by value are meant as they stand.
        size = min([size if size else 0.0, *(r["exact"] or 0.0 for m, r in rows.items() if isinstance(targets[m], Mapping))])
    size = min([float(size), *(float(r["usable"] or 0) for r in rows.values())])
    level = dict.fromkeys(rows, size)
    while True:
        at = F.create_map(*[F.lit(x) for kv in level.items() for x in kv])[F.col("margin")] * F.col("goal")
        all_of_it = F.col("had") <= at * (1 + 1e-9)
        found = values.groupBy("margin").agg(
            F.sum(F.when(all_of_it, F.col("had")).otherwise(F.lit(0))).alias("held"),
            F.sum(F.when(all_of_it, F.lit(0.0)).otherwise(F.col("goal"))).alias("free"),
            F.sum(F.greatest(F.col("goal") * size - F.col("had"), F.lit(0.0))).alias("short"),
        )
        again = {r["margin"]: (r["held"], r["free"], r["short"]) for r in found.collect()}
        new = {m: max(level[m], (size - held) / free) if free > 0 else level[m] for m, (held, free, _) in again.items()}
        if all(new[m] <= level[m] * (1 + 1e-9) for m in new):
            break
        level = new
    for m, (_, _, short) in again.items():
        if short > 0:
            _log.warning("mixing: values of %s are short of their targets by %.0f of %.0f tokens", m, short, size)
    return values.withColumn("want", F.when(all_of_it, F.col("had").cast("double")).otherwise(at)), size


class _Raking:
    """Weights of the cells as their first share of the sample times one factor per margin's value.

    Cells stay as they lie. A step sums the cells' weights by the values of one margin (partly in each
    task) and stores the new factors, a row per value; they are broadcast to the cells where their
    counted number allows it, and joined otherwise. No weight counts beyond ``bound``.
    """

    def __init__(self, cells: DataFrame, goals: DataFrame, targets: Mapping[str, Target], scale: float, bound: Column | None):
        self.cells, self.targets, self.scale, self.bound = cells, targets, scale, bound
        self.sizes = {r["margin"]: r["n"] for r in goals.groupBy("margin").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.factors = {m: goals.where(F.col("margin") == m).select(F.col("value").alias(m), "want", F.lit(1.0).alias("factor")) for m in targets}

    def weighted(self) -> DataFrame:
        """The cells with ``weight``."""
        table, weight = self.cells, F.col("tokens") * F.lit(self.scale)
        for margin, factors in self.factors.items():
            own = factors.select(margin, F.col("factor").alias(f"_factor_{margin}"))
            table = table.join(F.broadcast(own) if self.sizes.get(margin, 0) <= BROADCAST_CELLS else own, margin)
            weight = weight * F.col(f"_factor_{margin}")
        return table.select(*self.cells.columns, weight.alias("weight"))

    def step(self, margin: str) -> None:
        """Raise what falls short of the margin's targets over its free cells alone, lower what exceeds over all."""
        counted = F.col("weight") if self.bound is None else F.least("weight", self.bound)
        free = F.col("weight") if self.bound is None else F.when(F.col("weight") < self.bound, F.col("weight")).otherwise(F.lit(0.0))
        sums = self.weighted().groupBy(margin).agg(F.sum(counted).alias("_has"), F.sum(free).alias("_free"))
        want, has, open_ = F.col("want"), F.col("_has"), F.col("_free")
        raised = F.when(open_ > 0, (want - (has - open_)) / open_).otherwise(F.lit(1.0))
        change = F.when(has <= 0, F.lit(0.0)).when(want > has, raised).otherwise(want / has)
        off = F.when((has > 0) & (want > 0), F.abs(has - want) / want).otherwise(F.lit(0.0))
        new = self.factors[margin].join(sums, margin).select(margin, "want", (F.col("factor") * change).alias("factor"), off.alias("_off"))
        self.factors[margin] = _few(new, self.sizes.get(margin, 0))

    def run(self, sweeps: int, tolerance: float) -> DataFrame:
        """Sweeps over all margins until they hold. So few cells that a task can hold them are raked in one; see TASK_CELLS."""
        if self.cells.count() <= TASK_CELLS:
            raked = self._in_a_task(sweeps, tolerance)
            worst = raked.agg(F.max("_off").alias("off")).collect()[0]["off"] or 0.0
            raked = raked.drop("_off")
        else:
            worst = 0.0
            for _ in range(sweeps):
                for margin in self.targets:
                    self.step(margin)
                offs = reduce(DataFrame.unionByName, [f.select("_off") for f in self.factors.values()])
                worst = offs.agg(F.max("_off").alias("off")).collect()[0]["off"] or 0.0
                if worst <= tolerance:
                    break
            raked = self.weighted()
        if worst > tolerance:
            _log.warning("mixing: after %d sweeps a value is still off its target by a share of %.2g", sweeps, worst)
        return raked

    def _in_a_task(self, sweeps: int, tolerance: float) -> DataFrame:
        """The same steps over all cells at once; ``_off`` is how far off the last sweep began."""
        table = self.cells.withColumns({"_first": F.col("tokens") * F.lit(self.scale), "_bound": F.lit(None).cast("double") if self.bound is None else self.bound})
        for margin, factors in self.factors.items():
            table = table.join(F.broadcast(factors.select(margin, F.col("want").alias(f"_want_{margin}"))), margin)
        names, targets = self.cells.columns, list(self.targets)

        def rake_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cells = pd.concat(list(batches), ignore_index=True)
            weight, worst = cells["_first"].to_numpy(float), 0.0
            bound = cells["_bound"].fillna(np.inf).to_numpy(float)
            values = [pd.factorize(cells[m])[0] for m in targets]
            wants = [cells[f"_want_{m}"].groupby(v).first().to_numpy(float) for m, v in zip(targets, values, strict=True)]
            for _ in range(sweeps if len(cells) else 0):
                worst = 0.0
                for value, want in zip(values, wants, strict=True):
                    has = np.bincount(value, np.minimum(weight, bound))
                    free = np.bincount(value, np.where(weight < bound, weight, 0.0))
                    worst = max(worst, float(np.max(np.abs(has - want) / want, where=(has > 0) & (want > 0), initial=0.0)))
                    raised = np.where(free > 0, (want - (has - free)) / np.where(free > 0, free, 1.0), 1.0)
                    lowered = want / np.where(has > 0, has, 1.0)
                    weight = weight * np.where(has <= 0, 0.0, np.where(want > has, raised, lowered))[value]
                if worst <= tolerance:
                    break
            yield cells[names].assign(weight=weight, _off=worst)

        fields = T.StructType([*self.cells.schema.fields, T.StructField("weight", T.DoubleType()), T.StructField("_off", T.DoubleType())])
        return materialize(table.coalesce(1).mapInPandas(rake_all, fields), "mixing")


def _counted_cells(cells: DataFrame) -> tuple[DataFrame, int]:
    """The cells that have tokens, stored in few files, and their tokens."""
    table = _few(cells.where(F.col("tokens") > 0))
    return table, table.agg(F.sum("tokens").alias("n")).collect()[0]["n"] or 0


def rake(cells: DataFrame, targets: Mapping[str, Target], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (margin columns, ``tokens``) with ``weight``: the raked share of all tokens, unbounded.

    Between steps only the factors are stored, so the plan does not grow and executors may be lost.
    Where targets contradict each other (a value whose cells all have a zero goal elsewhere) the last
    margin of a sweep holds; raking stops at ``sweeps`` and the log says how far off it is.
    """
    table, total = _counted_cells(cells)
    goals = _few(_goals(table, targets).withColumnRenamed("goal", "want"))
    return _Raking(table, goals, targets, 1 / total if total else 0.0, None).run(sweeps, tolerance)


def rake_within(
    cells: DataFrame, targets: Mapping[str, Target], budget: float | None = None, sweeps: int = SWEEPS, tolerance: float = TOLERANCE
) -> tuple[DataFrame, DataFrame]:
    """``cells`` with ``weight``, the tokens drawn of each: none gives more than it has; and the goals.

    ``budget`` is the share of all tokens to draw. Without one it is BUDGET, or less if shares given by
    value need it. The second table has per ``margin`` and ``value`` the tokens it ``had``, ``asked``
    (its goal of what is drawn) and ``want`` (what is raked to, see ``_wanted``). A weight beyond the
    bound is held, and may come free again when another margin lowers it.
    """
    table, total = _counted_cells(cells)
    goals, size = _wanted(_few(_goals(table, targets)), targets, budget)
    goals = _few(goals.withColumn("asked", F.col("goal") * size))
    raked = _Raking(table, goals, targets, size / total if total else 0.0, F.col("tokens").cast("double")).run(sweeps, tolerance)
    full = F.col("weight") >= F.col("tokens") * (1 - 1e-6)
    return raked.withColumn("weight", F.when(full, F.col("tokens").cast("double")).otherwise(F.col("weight"))), goals


@dataclass(frozen=True)
class Mix:
    """Calibrated rates: per cell (``rates``: margins, ``_rate``, ``_share`` of the tokens drawn per token); of texts without
    tokens; per margin and value (``reached``) the tokens it had, asked for and gives."""

    targets: tuple[str, ...]
    rates: DataFrame
    average: float
    reached: DataFrame

    def join(self, docs: DataFrame, id_col: str, seed: int) -> DataFrame:
        """``docs`` (id, margins, ``tokens``, any others) with ``weight``, ``probability`` and ``selected``."""
        draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 13), 16, 10)
        probability = F.when(F.col("tokens") > 0, F.coalesce("_rate", F.lit(0.0))).otherwise(F.lit(self.average))
        return (
            docs.join(_sized(self.rates), list(self.targets), "left")
            .withColumn("weight", F.col("tokens") * F.coalesce("_share", F.lit(0.0)))
            .withColumn("probability", probability)
            .withColumn("selected", draw.cast("double") / float(1 << 52) < F.col("probability"))
            .drop("_rate", "_share")
        )


def _margins(targets: Mapping[str, Target], topic: Column | None, text: Column) -> dict[str, Column]:
    named = {m: F.coalesce(F.col(m).cast("string"), F.lit("(none)")) for m in targets if m != "topic"}
    if "topic" in targets:
        named["topic"] = topic if topic is not None else topic_of(text)
    return named


def calibrate(cells: DataFrame, targets: Mapping[str, Target], budget: float | None = None) -> Mix:
    """Rates for documents summed to ``cells`` (margins, ``tokens``, ``docs``)."""
    raked, goals = rake_within(cells, targets, budget)
    rated = _few(raked.withColumn("_rate", F.col("weight") / F.col("tokens")))
    sums = rated.agg((F.sum(F.col("_rate") * F.col("docs")) / F.sum("docs")).alias("mean"), F.sum("weight").alias("drawn")).collect()[0]
    share = F.col("_rate") / F.lit(sums["drawn"]) if sums["drawn"] else F.lit(0.0)
    given = _by_value(rated, targets, given=F.col("weight"))
    reached = goals.select("margin", "value", "had", "asked").join(given, ["margin", "value"])
    return Mix(tuple(targets), rated.select(*targets, "_rate", share.alias("_share")), 1.0 if sums["mean"] is None else sums["mean"], reached)


def mix(
    df: DataFrame,
    targets: Mapping[str, Target] | None = None,
    topic: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 42,
    budget: float | None = None,
) -> DataFrame:
    """Per row of ``df``: id, the margins, ``tokens``, ``weight``, ``probability``, ``selected``.

    ``budget`` is the share of all tokens to draw (see ``rake_within``). ``weight`` is the document's
    share of the tokens drawn. ``selected`` compares the probability with a digest of seed and id, so equal ids are drawn alike and a run can be repeated. A null
    margin counts as the value ``(none)``; documents without tokens (null, empty or blank texts)
    have weight 0 and are drawn as often as the average document, for they change no margin. A null
    id is drawn as the id ``null``; repeated rows count each; an empty table gives no rows; further
    columns are ignored. Texts are counted whole.
    """
    targets = dict(targets or DEFAULT_TARGETS)
    text = F.col(text_col).cast("string")
    named = _margins(targets, topic, text)
    docs = df.select(F.col(id_col).cast("long").alias(id_col), *(c.alias(m) for m, c in named.items()), token_count(text).alias("tokens"))
    # One pass over the texts; what is left of a document is narrow.
    docs = materialize(docs, "mixing-documents")
    cells = docs.groupBy(*targets).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    drawn = calibrate(cells, targets, budget).join(docs, id_col, seed)
    return drawn.select(id_col, *targets, "tokens", "weight", "probability", "selected")


def draw(
    df: DataFrame,
    targets: Mapping[str, Target] | None = None,
    topic: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 42,
    budget: float | None = None,
) -> DataFrame:
    """The rows of ``df`` that ``mix`` selects, with all their columns. Texts are judged once, stored with it, and not shuffled."""
    targets = dict(targets or DEFAULT_TARGETS)
    text = F.col(text_col).cast("string")
    named = _margins(targets, topic, text)
    whole = F.struct(*(F.col(c) for c in df.columns)).alias("_row")
    rows = df.select(F.col(id_col).cast("long").alias(id_col), *(c.alias(m) for m, c in named.items()), token_count(text).alias("tokens"), whole)
    rows = materialize(rows, "mixing-rows")
    cells = rows.groupBy(*targets).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    return calibrate(cells, targets, budget).join(rows, id_col, seed).where("selected").select("_row.*")


#: Cells up to this number are broadcast to the documents; more are joined by shuffle.
BROADCAST_CELLS = 100_000


def _sized(rates: DataFrame) -> DataFrame:
    """``rates`` with a broadcast hint if a count has shown that it is small."""
    return F.broadcast(rates) if rates.count() <= BROADCAST_CELLS else rates


def margins(df: DataFrame, columns: list[str], weight: Column) -> DataFrame:
    """Shares of ``weight`` per value of each column: ``margin``, ``value``, ``share``."""
    parts = [df.groupBy(F.col(c).alias("value")).agg(F.sum(weight).alias("w")).withColumn("margin", F.lit(c)) for c in columns]
    both = reduce(DataFrame.unionByName, parts)
    return both.select("margin", "value", (F.col("w") / F.sum("w").over(Window.partitionBy("margin"))).alias("share"))
