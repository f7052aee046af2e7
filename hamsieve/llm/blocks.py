"""Questions from blocks of texts to a table of keys that no single task could hold.

Texts are dealt into blocks of bounded size. Each block asks for its distinct keys, with what it
contributes to each; owners of key ranges add up what all blocks have said and answer every block.
Keys travel as the gaps of sorted arrays, answers as arrays in the same order, so a key costs some six
bytes one way and a small number back, whatever its frequency. A key found everywhere is asked for once per
block, and a block asks an owner in one row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block. A block is one task's memory: its arrays take some 20 times as much. Each block
#: asks each owner in one row, so a larger corpus wants larger blocks: at 100 TB some 1 GB, for 100,000 blocks.
BLOCK_BYTES = 10 << 20

_ASK = "block int, owner int, kind int, keys binary, counts binary"
_ANSWER = "block int, owner int, kind int, counts binary, more binary"
#: Stands for a sum that takes more than 32 bits; those follow in ``more``, in order, as 64-bit numbers.
_LARGE = 0xFFFFFFFF

Keys = dict[int, tuple[np.ndarray, np.ndarray]]


def in_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """``docs`` with ``block``, partitioned by it, and the number of blocks. Rows of one id are dealt by their texts."""
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).collect()[0]["n"] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    block = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(blocks)).cast("int")
    return docs.withColumn("block", block).repartition(blocks, "block"), blocks


def owners_of(keys: np.ndarray, owners: int) -> np.ndarray:
    """Owner of each 64-bit key: ranges of equal width, in the keys' order."""
    return ((keys >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as the first one, the width of a gap in bytes, and the gaps."""
    gaps = np.diff(keys)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return keys[:1].tobytes() + bytes([width]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(packed: bytes) -> np.ndarray:
    width = packed[8]
    gaps = np.frombuffer(packed, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(gaps) + 1, 8), np.uint8)
    steps[1:, :width] = gaps
    steps[0] = np.frombuffer(packed, np.uint8, 8)
    return np.cumsum(steps.view("<u8").reshape(-1), dtype=np.uint64)


def ask(blocked: DataFrame, keys_of: Callable[[pa.Table], Keys], owners: int) -> DataFrame:
    """One row per block, kind and owner. ``keys_of`` gives sorted distinct keys and counts by kind."""

    def per_block(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        rows: dict[str, list] = {"block": [], "owner": [], "kind": [], "keys": [], "counts": []}
        for kind, (keys, counts) in sorted(keys_of(table).items()):
            own = owners_of(keys, owners).astype(np.int64)
            cuts = np.flatnonzero(np.diff(own)) + 1
            for k, c in zip(np.split(keys, cuts), np.split(counts.astype(np.uint32), cuts), strict=True):
                if len(k):
                    rows["owner"].append(int(owners_of(k[:1], owners)[0]))
                    rows["block"].append(block)
                    rows["kind"].append(kind)
                    rows["keys"].append(pack(k))
                    rows["counts"].append(c.tobytes())
        return pa.table(
            {
                "block": pa.array(rows["block"], pa.int32()),
                "owner": pa.array(rows["owner"], pa.int32()),
                "kind": pa.array(rows["kind"], pa.int32()),
                "keys": pa.array(rows["keys"], pa.binary()),
                "counts": pa.array(rows["counts"], pa.binary()),
            }
        )

    return blocked.groupBy("block").applyInArrow(per_block, _ASK)


def answer_sums(asks: DataFrame) -> DataFrame:
    """Per ask the sum of all blocks' counts for each of its keys: 32 bits each, and 64 for the few that need them."""

    def per_owner(table: pa.Table) -> pa.Table:
        kinds = np.asarray(table.column("kind"))
        out: list[bytes] = [b""] * table.num_rows
        more: list[bytes | None] = [None] * table.num_rows
        for kind in np.unique(kinds):
            at = np.flatnonzero(kinds == kind)
            keys = [unpack(table.column("keys")[int(i)].as_py()) for i in at]
            counts = [np.frombuffer(table.column("counts")[int(i)].as_py(), np.uint32) for i in at]
            known, where = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(where, np.concatenate(counts), len(known)).astype(np.uint64)
            told = np.minimum(sums, np.uint64(_LARGE)).astype(np.uint32)[where]
            edges = np.cumsum([len(k) for k in keys])[:-1]
            for i, part, places in zip(at, np.split(told, edges), np.split(where, edges), strict=True):
                out[int(i)] = part.tobytes()
                large = part == _LARGE
                if large.any():
                    more[int(i)] = sums[places[large]].tobytes()
        return pa.table(
            {
                "block": table.column("block"),
                "owner": table.column("owner"),
                "kind": table.column("kind"),
                "counts": pa.array(out, pa.binary()),
                "more": pa.array(more, pa.binary()),
            }
        )

    return asks.groupBy("owner").applyInArrow(per_owner, _ANSWER)


def told(answers: pa.Table) -> dict[int, np.ndarray]:
    """A block's answers by kind, in the order of its sorted keys."""
    rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("kind", "owner", "counts", "more")), strict=True), key=lambda r: r[:2])
    out: dict[int, list[np.ndarray]] = {}
    for kind, _, counts, more in rows:
        sums = np.frombuffer(counts, np.uint32)
        if more:
            sums = sums.astype(np.uint64)
            sums[sums == _LARGE] = np.frombuffer(more, np.uint64)
        out.setdefault(kind, []).append(sums)
    return {kind: np.concatenate(parts) for kind, parts in out.items()}
