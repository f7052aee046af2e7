"""Jaccard self-join on word shingles, by prefixes of single tokens and token combinations.

Shingles (the tokens here) have one global order: rare ones first, then frequent ones by class. Two
sets that link share tokens early in that order. If the first shared token is rare, it is in both
plain prefixes: rare tokens are indexed singly. If it is frequent, no rare token is shared, and the
prefixes extended by one share two frequent tokens at least: frequent ones are indexed in pairs.
Candidates are verified on the whole sets.

Frequency classes come from a sketch of fixed size over all texts. It only sets the order, which
any values would serve: a coarse sketch costs time, never a link.

No bucket is expanded into all its pairs. First every member is verified against its bucket's
centre (the member with the fewest rare tokens); then only members of different components meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hamsieve.llm.components import connected_components
from hamsieve.llm.joins import join_groups
from hamsieve.llm.kernels import mix, shingle_hashes, words
from hamsieve.sources.scratch import materialize

#: Counters of the frequency sketch (4 bytes each, one table per task and one broadcast), in slices.
SKETCH = 1 << 20
_SLICES = 16
#: Tables of tasks that are summed in one group; more are summed in rounds.
FAN = 64
#: A token is frequent if its counter stands so far above the mean counter.
FREQUENT = 32
#: Sets beyond this size index frequent tokens singly: pairs would grow with the square of the prefix.
#: Sets near this size do both, so that no link crosses the border unseen.
PAIRED_SIZE = 512

#: Ids up to this number (8 bytes each) are broadcast to find their texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000

_SEEDS = (np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3))


def _signature(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set: equal sets, equal signatures."""
    return tuple(int(mix(s ^ seed).sum(dtype=np.uint64).astype(np.int64)) for seed in _SEEDS)  # type: ignore[return-value]


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for first, h, bounds in words(column):
        s, ends = shingle_hashes(h, bounds, k)
        for d in range(len(ends) - 1):
            yield first + d, np.unique(s[ends[d] : ends[d + 1]])


def least_overlap(n, percent: int):
    """Tokens that a set of ``n`` shares with any set it links to, at least."""
    return (percent * n + 99) // 100


def _index(s: np.ndarray, sketch: np.ndarray, limit: float, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Keys, positions of their first token, the prefix in order, and the number of rare tokens, for one set.

    The prefix holds order values: class in the leading six bits, then the token's leading bits.
    """
    n = len(s)
    least = least_overlap(n, percent)
    plain, extended = n - least + 1, min(n, n - least + 2)
    counts = sketch[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
    common = counts > limit
    rare = s[~common]
    keys, at = [mix(rare[:plain])], [np.arange(min(plain, len(rare)))]
    prefix = [rare[:extended] >> np.uint64(6)]
    left = extended - len(rare)
    if left > 0:
        often, level = s[common], np.minimum(np.log2(counts[common] / limit), 30).astype(np.int64)
        order = np.lexsort((often, level))[:left]
        often = often[order]
        prefix.append((np.minimum(level[order] + 1, 31).astype(np.uint64) << np.uint64(58)) | (often >> np.uint64(6)))
        first = plain - len(rare)
        if n <= PAIRED_SIZE:
            i, j = np.triu_indices(len(often), 1)
            i, j = i[i < first], j[i < first]
            keys.append(mix(often[i] * np.uint64(0xD6E8FEB86659FD93) + mix(often[j])))
            at.append(i + len(rare))
        if 100 * n >= percent * PAIRED_SIZE or least < 2:
            single = often[: max(first, 0)]
            keys.append(mix(single ^ _SEEDS[0]))
            at.append(np.arange(len(single)) + len(rare))
    return np.concatenate(keys), np.concatenate(at), np.concatenate(prefix), len(rare)


def _classes_and_sketch(docs: DataFrame, id_col: str, k: int) -> tuple[DataFrame, np.ndarray]:
    """Per row: id, ``row``, ``n``, signature ``s1``, ``s2`` (stored); and the summed sketch."""
    schema = f"`{id_col}` long, row long, n int, s1 long, s2 long, slice int, counts binary"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.uint32)

        def flush(seen: list[np.ndarray]) -> None:
            if seen:
                at = (np.concatenate(seen) & np.uint64(SKETCH - 1)).astype(np.int64)
                np.add(sketch, np.bincount(at, minlength=SKETCH).astype(np.uint32), out=sketch)

        for batch in batches:
            n = np.zeros(batch.num_rows, np.int32)
            s1, s2 = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            seen, held = [], 0
            for row, s in _sets(batch.column(1), k):
                n[row] = len(s)
                s1[row], s2[row] = _signature(s)
                seen.append(s)
                held += len(s)
                if held > 1_000_000:
                    flush(seen)
                    seen, held = [], 0
            flush(seen)
            none = pa.nulls(batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n), pa.array(s1), pa.array(s2), none, pa.nulls(batch.num_rows, pa.binary())],
                names=[id_col, "row", "n", "s1", "s2", "slice", "counts"],
            )
        if sketch.any():
            parts = [p.tobytes() for p in np.split(sketch, _SLICES)]
            none = pa.nulls(_SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, pa.nulls(_SLICES, pa.int32()), none, none, pa.array(range(_SLICES), pa.int32()), pa.array(parts, pa.binary())],
                names=[id_col, "row", "n", "s1", "s2", "slice", "counts"],
            )

    stored = materialize(docs.mapInArrow(scan, schema), "jaccard-classes")

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SKETCH // _SLICES, np.uint64)
        for c in pdf["counts"]:
            total += np.frombuffer(c, np.uint32)
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "part": pdf["part"].iloc[:1], "counts": [np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()]})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for pdf in batches:
            for at, c in zip(pdf["slice"], pdf["counts"], strict=True):
                held = totals.setdefault(int(at), np.zeros(SKETCH // _SLICES, np.uint64))
                held += np.frombuffer(c, np.uint32)
        for at, held in totals.items():
            yield pd.DataFrame({"slice": [at], "counts": [np.minimum(held, 0xFFFFFFFF).astype(np.uint32).tobytes()]})

    # Tables of tasks are folded where they lie, then FAN at a time: _SLICES rows of fixed size reach the driver.
    parts = stored.where("slice IS NOT NULL").select("slice", "counts").mapInPandas(fold, "slice int, counts binary")
    parts = materialize(parts.withColumn("part", F.spark_partition_id()), "jaccard-sketch")
    left = (parts.agg(F.max("part").alias("n")).collect()[0]["n"] or 0) + 1
    while left > FAN:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("slice", "part").applyInPandas(add, "slice int, counts binary, part int")
        left = math.ceil(left / FAN)
    rows = parts.groupBy("slice").applyInPandas(add, "slice int, counts binary, part int").collect()
    sketch = np.zeros((_SLICES, SKETCH // _SLICES), np.uint32)
    for r in rows:
        sketch[r["slice"]] = np.frombuffer(r["counts"], np.uint32)
    return stored.where("slice IS NULL").drop("slice", "counts"), sketch.reshape(-1)


def _entries(docs: DataFrame, k: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """Per row with two shingles or more: ``row``, ``s1``, ``s2``, ``n``, ``rare``, ``prefix``, ``keys``, ``at`` (their positions)."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    limit = FREQUENT + 2.0 * float(sketch.mean())

    def lists(parts: list[np.ndarray], kind: np.dtype) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(kind, copy=False)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value

        def pack(rows: list) -> pa.RecordBatch:
            marks, n, rare, prefix, keys, at = zip(*rows, strict=True)
            columns = [pa.array(c, pa.int64()) for c in zip(*marks, strict=True)] + [pa.array(n, pa.int32()), pa.array(rare, pa.int32())]
            columns += [lists([p.view(np.int64) for p in prefix], np.int64), lists([x.view(np.int64) for x in keys], np.int64), lists(list(at), np.int32)]
            return pa.RecordBatch.from_arrays(columns, names=["row", "s1", "s2", "n", "rare", "prefix", "keys", "at"])

        for batch in batches:
            ids = batch.column(2)
            rows, held = [], 0
            for row, s in _sets(batch.column(1), k):
                if len(s) < 2:
                    continue
                keys, at, prefix, rare = _index(s, table, limit, percent)
                rows.append(((ids[row].as_py(), *_signature(s)), len(s), rare, prefix, keys, at))
                held += len(keys)
                if held > 200_000:
                    yield pack(rows)
                    rows, held = [], 0
            if rows:
                yield pack(rows)

    return docs.mapInArrow(emit, "row long, s1 long, s2 long, n int, rare int, prefix array<long>, keys array<long>, at array<int>")


def _possible(n_a: Column, at_a: Column, n_b: Column, at_b: Column, percent: int) -> Column:
    """Can sets of these sizes link whose first shared token stands at these positions?"""
    most = F.least(n_a - at_a, n_b - at_b)
    return (100 + percent) * most >= percent * (n_a + n_b)


def _verified(pairs: DataFrame, entries: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that link.

    First by prefixes alone: up to where the shorter one ends both are known whole, and what differs
    there must not exceed what may differ in all. The rest is decided on whole sets, which are worked
    out for the ids that are left.
    """
    part = {c: entries.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("prefix").alias(f"p{c}")) for c in "ab"}
    end = F.least(F.element_at("pa", -1), F.element_at("pb", -1))
    upto = pairs.join(part["a"], "a").join(part["b"], "b").withColumn("end", end)
    upto = upto.withColumn("pa", F.filter("pa", lambda v: v <= F.col("end"))).withColumn("pb", F.filter("pb", lambda v: v <= F.col("end")))
    apart = F.size("pa") + F.size("pb") - 2 * F.size(F.array_intersect("pa", "pb"))
    near = materialize(
        upto.where((100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b"), "jaccard-near"
    )
    ids = near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "row", "s1", "s2"), "node")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found = batch.column(0).to_pylist()
            signed = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for row, s in _sets(batch.column(3), k):
                # The row key is a hash: the set itself says whether it is the node's.
                if found[row] not in seen and len(s) and _signature(s) == signed[row]:
                    seen.add(found[row])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([found[row]], pa.int64()), pa.array([s.view(np.int64)], pa.list_(pa.int64()))], names=["id", "tokens"]
                    )

    sets = docs.join(ids, "row").select("node", "s1", "s2", "text").mapInArrow(whole, "id long, tokens array<long>")
    sets = materialize(sets, "jaccard-tokens")
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    links = (
        near.join(left, "a")
        .join(right, "b")
        .select("a", "b", both.alias("both"), (F.size("ta") + F.size("tb")).alias("all"))
        .where((100 + percent) * F.col("both") >= percent * F.col("all"))
        .select("a", "b")
    )
    return materialize(links, "jaccard-links")


def row_key(id_: Column, text: Column) -> Column:
    """A number for the id and text of a row: rows of one id and different texts have different ones."""
    return F.xxhash64(id_.cast("long").isNull(), F.coalesce(id_.cast("long"), F.lit(0)), F.coalesce(text.cast("string"), F.lit("")))


def near_groups(
    df: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``df``: id, ``n_shingles``, ``component_id``.

    Sets of ``k``-word shingles link when ``100 * both >= percent * either``. ``component_id`` is the
    smallest id reachable by links. Texts without words (null, empty, blank) have no shingles and
    are alone; texts of fewer than ``k`` words have one shingle and link to their equals. Repeated
    rows share their class; a null id is none: such a row has the smallest id of the others, or null; different texts under one id (or under none) are
    members of their own, so rows of one id can have different components; an empty table gives no rows;
    further columns are ignored. Texts are read whole. Equal sets are one member of the join, whatever
    their number.
    """
    found = _grouped(df, k, percent, id_col, text_col)
    return found.select(id_col, F.col("n").cast("long").alias("n_shingles"), "component_id")


def first_of_groups(
    df: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of ``df`` per component of ``near_groups``, that of the smallest id, with all its columns.

    Components are told apart by their sets, not by ids: different texts without an id, or under one
    id, all stay. Texts without words stay once per id and text.
    """
    found = _grouped(df, k, percent, id_col, text_col)
    # Rows without an id come after all others.
    key = {"_none": F.col(id_col).isNull(), "_id": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "_row": F.col("row")}
    found = found.withColumns(key)
    some = found.where("n > 0").groupBy("component").agg(F.min(F.struct(*key)).alias("f")).select("f.*")
    first = some.unionByName(found.where("n = 0").select(*key)).distinct()
    keyed = df.withColumns(key | {"_row": row_key(F.col(id_col), F.col(text_col))})
    # A row that stands in the table twice is a group, too. Both steps share one shuffle.
    return keyed.join(first, list(key), "left_semi").dropDuplicates(list(key)).select(*df.columns)


def _grouped(df: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per row of ``df``: id, ``row``, ``n``, ``component`` (a number of its own; null without shingles), ``component_id``."""
    docs = df.select(
        F.col(id_col).cast("long").alias(id_col),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        row_key(F.col(id_col), F.col(text_col)).alias("row"),
    )
    rows, sketch = _classes_and_sketch(docs, id_col, k)
    # Each distinct set is a node of the graph; its text is read from one row that has it.
    classes = materialize(
        rows.where("n > 0")
        .groupBy("s1", "s2")
        .agg(F.min(id_col).alias("id"), F.min("row").alias("row"), F.count(F.lit(1)).alias("rows"))
        .withColumn("node", F.monotonically_increasing_id()),
        "jaccard-sets",
    )

    # One entry per node. From here on an id is a node.
    entries = _entries(docs, k, percent, sketch).join(classes.select("row", "s1", "s2", F.col("node").alias("id")), ["row", "s1", "s2"])
    entries = materialize(entries.drop("row", "s1", "s2"), "jaccard-entries")

    key = Window.partitionBy("key")
    smallest = F.greatest(F.col("_least"), F.floor((percent * F.col("n") + 99) / 100))
    met = (
        entries.select("id", "n", "rare", F.explode(F.arrays_zip("keys", "at")).alias("e"))
        .select(F.col("e.keys").alias("key"), "id", "n", F.col("e.at").alias("at"), "rare")
        .select("*", F.min("id").over(key).alias("_lo"), F.max("id").over(key).alias("_hi"), F.min("n").over(key).alias("_least"))
        .where("_lo <> _hi")
        .where((100 + percent) * (F.col("n") - F.col("at")) >= percent * (F.col("n") + smallest))
        .select("key", "id", "n", "at", "rare")
    )
    met = materialize(met, "jaccard-met")

    order = Window.partitionBy("key").orderBy("rare", "id")
    centre, before = F.first(F.struct("id", "n", "at")).over(order), F.lag(F.struct("id", "n", "at")).over(order)
    around = met.select("id", "n", "at", centre.alias("_c"), before.alias("_b")).select("id", "n", "at", F.explode(F.array("_c", "_b")).alias("o"))
    pairs = _pairs(
        around.where("o IS NOT NULL AND o.id <> id").where(
            _possible(F.col("n"), F.col("at"), F.col("o.n"), F.col("o.at"), percent)
        ).select(F.col("id").alias("x"), F.col("o.id").alias("y"))
    )
    pairs = materialize(pairs, "jaccard-pairs")
    links = _verified(pairs, entries, docs, classes, k, percent)
    joined = connected_components(links)

    # What is left: members of one bucket that are still apart.
    apart = (
        met.join(joined, "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
        .withColumn("_lo", F.min("component").over(key))
        .withColumn("_hi", F.max("component").over(key))
        .where("_lo <> _hi")
        .drop("_lo", "_hi", "rare")
    )
    apart = materialize(apart, "jaccard-apart")
    l, r = apart.alias("l"), apart.alias("r")
    crossing = l.join(
        r,
        (F.col("l.key") == F.col("r.key"))
        & (F.col("l.component") != F.col("r.component"))
        & (F.col("l.id") < F.col("r.id"))
        & _possible(F.col("l.n"), F.col("l.at"), F.col("r.n"), F.col("r.at"), percent),
    ).select(F.col("l.id").alias("x"), F.col("r.id").alias("y"))
    more = _verified(_pairs(crossing).join(pairs, ["a", "b"], "left_anti"), entries, docs, classes, k, percent)
    final = connected_components(links.unionByName(more))

    named = classes.join(final.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named.select("s1", "s2", "rows", "id", "component"), "jaccard-named")
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    groups = materialize(named.drop("id").join(least, "component"), "jaccard-groups")
    some = join_groups(rows.where("n > 0"), groups, ["s1", "s2"], "rows")
    return some.select(id_col, "row", "n", "component", "component_id").unionByName(
        rows.where("n = 0").select(id_col, "row", "n", F.lit(None).cast("long").alias("component"), F.col(id_col).alias("component_id"))
    )


def _pairs(df: DataFrame) -> DataFrame:
    """``x``, ``y`` as distinct pairs ``a`` < ``b``."""
    return df.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
