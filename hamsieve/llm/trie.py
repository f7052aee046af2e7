"""Prefix trie of conversations by ROLLUP over positional turn ids.

A conversation lies in blocks of WIDTH columns, one turn id per position. ``GROUP BY prior node, ROLLUP
(t1 .. tW)`` gives every prefix that ends in a block at once, ``grouping_id`` its depth; longer
conversations go on in further blocks, grouped by the node that the prior block ends in. A node's name is
the exclusive or of 128-bit hashes of (position, turn id) along its path, so the prior node of every block is
a running aggregate and needs no round per block.

Sums over subtrees come from members alone. Of the members of a node the one with the smallest id owns
it, and then all its nodes below: every conversation owns the end of its path from some depth on, or
nothing. So the distinct turns below a node are what its members own, less what its owner has above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hamsieve.llm.joins import join_groups
from hamsieve.sources.scratch import materialize

#: Positions per block of columns: one row of ROLLUP holds so many turns.
WIDTH = 8
#: Blocks of one conversation whose running sums are taken in one group; longer conversations are cut.
BLOCKS = 1024
#: Ids that are joined to one string before a node's member ids are hashed in order: 2 ** ID_BITS.
ID_BITS = 12

_EMPTY = hashlib.sha256(b"").hexdigest()


def number_turns(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id``, ``position`` (1 .. length), ``turn`` (struct of ``id``: 128 bits of role and text, ``bytes`` of the text).

    Turns are ordered by number, null first, equal numbers by their ids; a repeated row is a turn of
    its own. A null role or text is empty. Rows without a conversation id belong to none and give no
    turn. The order is that of sorted ranges, so a conversation that holds a third of all turns lies in
    as many tasks as its share asks for.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("_turn"),
        F.struct(digest.alias("id"), F.octet_length(text).cast("long").alias("bytes")).alias("turn"),
    ).where("conv_id IS NOT NULL")
    order = [F.col("_turn").asc_nulls_first(), F.col("turn.id").asc()]
    pieces = turns.repartitionByRange(F.col("conv_id").asc(), *order).withColumn("_piece", F.spark_partition_id())
    pieces = materialize(pieces, "trie-pieces")
    # Where a conversation goes on from the piece before; there is one such row per piece at most.
    before = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    spans = pieces.groupBy("conv_id", "_piece").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", before).drop("_n")
    numbered = pieces.withColumn("_k", F.row_number().over(Window.partitionBy("_piece", "conv_id").orderBy(*order)))
    numbered = numbered.join(F.broadcast(spans.where("_before > 0")), ["conv_id", "_piece"], "left")
    position = (F.col("_k") + F.coalesce("_before", F.lit(0))).cast("long")
    return materialize(numbered.select("conv_id", position.alias("position"), "turn"), "trie-turns")


def measured(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``turns`` of ``number_turns`` with each conversation's ``length`` and ``total`` bytes; and its members."""
    members = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"), F.sum("turn.bytes").alias("total"))
    members = materialize(members, "trie-members")
    return join_groups(turns, members, ["conv_id"], "length"), members


def graft(turns: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``head`` turns (at most ``most``) are replaced by those of conversation ``base``.

    ``base`` and ``head`` are computed from ``conv_id``. A base that is too short gives all it has, one
    that is absent nothing. Returns turns and members as ``measured`` does; a conversation may be left without turns.
    """
    own = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("_own"),
        F.sum(F.when(F.col("position") > head, F.col("turn.bytes")).otherwise(F.lit(0))).alias("_tail"),
        F.sort_array(F.collect_list(F.when(F.col("position") <= most, F.struct("position", "turn")))).alias("_first"),
    )
    own = materialize(own.withColumns({"_base": base, "_head": head}), "trie-own")
    heads = own.select(F.col("conv_id").alias("_base"), F.col("_first.turn").alias("_given"))
    given = F.expr("coalesce(slice(_given, 1, CAST(_head AS INT)), array())")
    members = own.join(heads, "_base", "left").withColumn("_given", given)
    n = F.size("_given").cast("long")
    members = members.select(
        "conv_id",
        "_own",
        "_head",
        "_given",
        (n + F.greatest(F.col("_own") - F.col("_head"), F.lit(0))).alias("length"),
        (F.col("_tail") + F.aggregate("_given", F.lit(0).cast("long"), lambda s, t: s + t["bytes"])).alias("total"),
    )
    members = materialize(members, "trie-members")
    kept = join_groups(turns.where(F.col("position") > head), members.select("conv_id", "_own", "_head", n.alias("_n"), "length", "total"), ["conv_id"], "_own")
    position = F.col("position") - F.col("_head") + F.col("_n")
    kept = kept.select("conv_id", position.alias("position"), "turn", "length", "total")
    front = members.select("conv_id", F.posexplode("_given").alias("_at", "turn"), "length", "total")
    front = front.select("conv_id", (F.col("_at") + 1).cast("long").alias("position"), "turn", "length", "total")
    return front.unionByName(kept), members.select("conv_id", "length", "total")


def _lanes(width: int, seed: int) -> list[Column]:
    """Hash of (position, turn) of each column; 0 where there is no turn."""
    at = F.col("block") * width
    return [F.when(F.col(f"t{k}").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(seed), at + k, F.col(f"t{k}"))) for k in range(1, width + 1)]


def _xor(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), columns)


def _in_blocks(turns: DataFrame, members: DataFrame, width: int, blocks: int) -> DataFrame:
    """A row per conversation and block: ``t1`` .., prior node (``pa``, ``pb``), ``length``, bytes from the block's start (``tail``)."""
    rows = turns.groupBy("conv_id", F.floor((F.col("position") - 1) / width).cast("long").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("position", "turn"))).alias("_turns"), F.max("length").alias("length"), F.max("total").alias("total")
    )
    slots = {f"t{k}": F.get("_turns", F.lit(k - 1))["turn"] for k in range(1, width + 1)}
    rows = rows.withColumns(slots).withColumns({"_bytes": F.aggregate("_turns.turn.bytes", F.lit(0).cast("long"), lambda s, b: s + b)}).drop("_turns")
    rows = materialize(rows, "trie-rows")
    none = F.lit(0).cast("long")
    short = rows.where(F.col("length") <= width).withColumns({"pa": none, "pb": none, "_before": none})
    # Conversations of several blocks: running sums within a chunk of blocks, and over the chunks before.
    long = rows.where(F.col("length") > width).withColumns(
        {"_chunk": F.floor(F.col("block") / blocks), "_a": _xor(_lanes(width, 1)), "_b": _xor(_lanes(width, 2))}
    )
    sums = {"pa": F.bit_xor("_a"), "pb": F.bit_xor("_b"), "_before": F.sum("_bytes")}

    def running(by: list[str], order: str) -> dict[str, Column]:
        over = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return {name: F.coalesce(total.over(over), none) for name, total in sums.items()}

    chunks = long.where(F.col("length") > width * blocks).groupBy("conv_id", "_chunk").agg(F.bit_xor("_a").alias("_a"), F.bit_xor("_b").alias("_b"), F.sum("_bytes").alias("_bytes"))
    chunks = chunks.select("conv_id", "_chunk", *(c.alias(f"_{name}") for name, c in running(["conv_id"], "_chunk").items()))
    long = long.withColumns(running(["conv_id", "_chunk"], "block")).join(chunks, ["conv_id", "_chunk"], "left")
    long = long.withColumns(
        {
            "pa": F.col("pa").bitwiseXOR(F.coalesce("_pa", none)),
            "pb": F.col("pb").bitwiseXOR(F.coalesce("_pb", none)),
            "_before": F.col("_before") + F.coalesce("__before", none),
        }
    ).select(*short.columns)
    turnless = members.where("length = 0").select("conv_id", none.alias("block"), "length", none.alias("total"), none.alias("pa"), none.alias("pb"), none.alias("_before"))
    whole = short.unionByName(long).unionByName(turnless, allowMissingColumns=True)
    slots = [f"t{k}" for k in range(1, width + 1)]
    return materialize(whole.select("conv_id", "block", "length", "pa", "pb", *slots, (F.col("total") - F.col("_before")).alias("tail")), "trie-blocks")


def _prefixes(rows: DataFrame, width: int, aggregates: str) -> DataFrame:
    """All prefixes that end in each block: ``depth``, name (``a``, ``b``), parent's name, bytes of the last turn, and sums."""
    slots = ", ".join(f"t{k}" for k in range(1, width + 1))
    prefixes = rows.sparkSession.sql(
        f"SELECT block, pa, pb, {slots}, {width} - bit_count(grouping_id()) AS _d, {aggregates} FROM {{rows}} GROUP BY block, pa, pb, ROLLUP({slots})",
        rows=rows,
    )
    last = F.get(F.array(*(F.col(f"t{k}") for k in range(1, width + 1))), F.col("_d") - 1)
    # A prefix longer than its conversation is none; a block's own start is the prior block's node.
    prefixes = prefixes.where(F.when(F.col("_d") == 0, F.col("block") == 0).otherwise(last.isNotNull()))
    lanes = {lane: _lanes(width, seed) for lane, seed in (("a", 1), ("b", 2))}
    named = {lane: F.col(f"p{lane}").bitwiseXOR(_xor(hashes)) for lane, hashes in lanes.items()}
    ends = {lane: F.coalesce(F.get(F.array(*hashes), F.col("_d") - 1), F.lit(0).cast("long")) for lane, hashes in lanes.items()}
    return prefixes.withColumns(
        {
            "depth": F.col("block") * width + F.col("_d"),
            "a": named["a"],
            "b": named["b"],
            "up_a": named["a"].bitwiseXOR(ends["a"]),
            "up_b": named["b"].bitwiseXOR(ends["b"]),
            "bytes": F.coalesce(last["bytes"], F.lit(0).cast("long")),
        }
    )


def _bytes_before(width: int, first: Column) -> Column:
    """Bytes of a prefix's turns in this block, from column ``first`` on and without the last one."""
    parts = [F.when((F.lit(k) < F.col("_d")) & (F.lit(k) >= first), F.col(f"t{k}.bytes")).otherwise(F.lit(0).cast("long")) for k in range(1, width + 1)]
    return reduce(lambda a, b: a + b, parts)


def _hash_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's strings of ids, comma between them; rows come sorted by node and id."""
    names = ["depth", "a", "b", "ends_sha256", "n_ends"]
    node, state, n = None, None, 0
    for batch in batches:
        done = []
        for *at, ids, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != node:
                if node is not None:
                    done.append((*node, state.hexdigest(), n))
                node, state, n = at, hashlib.sha256(), 0
            elif n:
                state.update(b",")
            state.update(ids.encode())
            n += more
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=names)
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, state.hexdigest(), n)], names=names)


def _ends(rows: DataFrame, width: int, id_bits: int) -> DataFrame:
    """Digest and number of the conversations that end at each node.

    Ids are distinct, so a string of neighbouring ids is bounded; a node's strings pass through one task in
    order, as the digest of one long string demands, and are not held there.
    """
    last = rows.where((F.col("length") > F.col("block") * width) & (F.col("length") <= (F.col("block") + 1) * width) | (F.col("length") == 0))
    named = last.select(
        F.col("length").alias("depth"),
        F.col("pa").bitwiseXOR(_xor(_lanes(width, 1))).alias("a"),
        F.col("pb").bitwiseXOR(_xor(_lanes(width, 2))).alias("b"),
        "conv_id",
        F.shiftright("conv_id", id_bits).alias("_part"),
    )
    parts = named.groupBy("depth", "a", "b", "_part").agg(F.sort_array(F.collect_list("conv_id")).alias("_ids"))
    strings = parts.select("depth", "a", "b", "_part", F.array_join(F.col("_ids").cast("array<string>"), ",").alias("ids"), F.size("_ids").cast("long").alias("n"))
    in_order = strings.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "_part").drop("_part")
    return in_order.mapInArrow(_hash_members, "depth long, a long, b long, ends_sha256 string, n_ends long")


def prefix_trie(turns: DataFrame, members: DataFrame, width: int = WIDTH, blocks: int = BLOCKS, id_bits: int = ID_BITS) -> DataFrame:
    """The nodes of the trie of ``turns`` and ``members`` (see ``measured`` and ``graft``).

    Per node: ``conv_id`` (smallest member; the node's turn is that conversation's turn ``depth``),
    ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes
    in its subtree), ``saved_tokens`` (bytes that sharing saves in its subtree), ``n_ends`` (members that
    end here) and ``ends_sha256`` of their ids. Subtrees include their top. No conversations give no rows.
    """
    key = ["depth", "a", "b"]
    rows = _in_blocks(turns, members, width, blocks)
    nodes = _prefixes(rows, width, "count(*) AS n_convs, min(conv_id) AS conv_id, sum(tail) AS _tails")
    nodes = nodes.select(
        *key, "up_a", "up_b", "bytes", "n_convs", "conv_id", (F.col("_tails") - F.col("n_convs") * _bytes_before(width, F.lit(1))).alias("_all")
    )
    nodes = materialize(nodes, "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-nodes")
    # What each conversation owns: from which depth on, how many bytes, and a leaf or none.
    owners = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("_from"),
        F.sum("bytes").alias("_owned"),
        F.sum((F.col("n_children") == 0).cast("long")).alias("_leaf"),
        F.ceil(F.greatest(F.max("depth"), F.lit(1)) / width).alias("_rows"),
    )
    owned = join_groups(rows, materialize(owners, "trie-owners"), ["conv_id"], "_rows")
    below = _prefixes(
        owned.withColumn("_above", F.greatest(F.col("_owned") - F.col("tail"), F.lit(0))),
        width,
        "sum(_leaf) AS n_leaves, sum(_owned) AS _owned, sum(_above) AS _above, min(_from) AS _from",
    )
    above = F.col("_above") + _bytes_before(width, F.col("_from") - F.col("block") * width)
    below = below.select(*key, "n_leaves", (F.col("_owned") - above).alias("_distinct"))
    whole = nodes.join(below, key).join(_ends(rows, width, id_bits), key, "left")
    whole = whole.select(
        *key,
        "up_a",
        "up_b",
        "conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("_all") - F.col("_distinct")).alias("saved_tokens"),
        F.coalesce("n_ends", F.lit(0).cast("long")).alias("n_ends"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )
    parents = nodes.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n")
    )
    inner = join_groups(whole.where("depth > 0"), parents, ["depth", "up_a", "up_b"], "_n")
    root = whole.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "n_ends"]
    return root.select(*columns).unionByName(inner.select(*columns))


def conversation_trie(conversations: DataFrame, width: int = WIDTH, **columns: str) -> DataFrame:
    """The trie of whole ``conversations`` (conversation, turn, role, text); see ``number_turns`` and ``prefix_trie``."""
    return prefix_trie(*measured(number_turns(conversations, **columns)), width=width)
