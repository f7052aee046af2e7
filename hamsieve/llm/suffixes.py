"""Repeated substrings across documents, by grouping the strings at a cover of the texts.

A difference cover samples positions so that any two suffixes meet at samples after the same short
distance; the samples' order then settles all other suffixes. Here the cover is chosen by content
instead of by position: the position of the smallest hash of ``GRAM`` bytes in every string of the
wanted length. Equal strings choose the same place, so they meet at it, wherever they stand, and a
sample whose gram is met once in the corpus settles that its strings are not repeated: nothing
near it is looked at again. (A cover by position would have every suffix of the corpus sorted.)

1. Name the samples: count each sample's gram over the corpus (``blocks``).
2. Around each repeated sample, send the strings it stands for, as one stretch of bytes, to the
   owner of its name; equal stretches of a block go once, with the smallest id.
3. The owner puts the strings in the order of a 64-bit hash of their ``length`` bytes, compares
   neighbours byte for byte (those of one hash that differ are put in the order of their bytes), and
   marks the strings that begin in a document with a larger id than the smallest.
4. Each block takes back the marks and removes what the marked strings cover.

The strings are compared up to the wanted length, so names never have to be refined by recursion. Around
a name that is met very often (a template with a changing field, in a large share of all documents) each
string goes by itself, to an owner that its own bytes choose.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hamsieve.llm.blocks import BLOCK_BYTES, Keys, answer_sums, ask, in_blocks, owners_of, told
from hamsieve.llm.kernels import mix, power_table, text_bytes

#: Bytes that a sample is named by.
GRAM = 16
#: Bytes that are hashed at once: small enough for the arrays to stay in a core's cache.
PIECE = 1 << 16
#: Occurrences of a name from which its strings go to owners of their own, not all to the name's.
HOT = 100_000
#: Owners per block in step 3, whose suffixes take ten times their bytes while they are sorted.
OWNERS_PER_BLOCK = 4

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(71).integers(1, 1 << 63, 256, np.uint64)


def _rolling(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from each position on, by doubling."""
    powers = {1: _TABLE[data]}
    size = 1
    while size * 2 <= length:
        h = powers[size]
        powers[size * 2] = h[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:] if len(h) > size else h[:0]
        size *= 2
    out, done = powers[size], size
    while done < length:
        size = 1 << (length - done).bit_length() - 1
        tail = powers[size][done : done + max(0, len(data) - done - size + 1)]
        out = out[: len(tail)] * np.uint64(pow(_BASE, size, 1 << 64)) + tail
        done += size
    return out


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each run of ``width`` values."""
    if len(values) < width:
        return values[:0]
    out, size = values, 1
    while size * 2 <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


@dataclass
class _Samples:
    """Samples of a stretch of bytes: places and names; and per string that exists the hash it is sampled by (else 0)."""

    place: np.ndarray
    name: np.ndarray
    least: np.ndarray


def _samples(data: np.ndarray, ends: np.ndarray, length: int) -> _Samples:
    """``ends``: for each byte the end of its text. Strings never cross an end."""
    width = length - GRAM + 1
    if len(data) < length:
        return _Samples(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    # Zero is kept for strings that do not exist.
    grams = np.maximum(mix(_rolling(data, GRAM)), np.uint64(1))
    least = _sliding(grams, width, np.minimum)
    least[np.arange(length, length + len(least), dtype=ends.dtype) > ends[: len(least)]] = 0
    reach = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    place = np.flatnonzero(_sliding(reach, width, np.maximum)[: len(grams)] == grams)
    return _Samples(place, mix(grams[place] ^ np.uint64(_BASE)), least)


def _runs(s: _Samples, repeated: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of repeated samples, each with the first and last string that it stands for (a run each)."""
    none = np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(repeated, s.name), max(len(repeated) - 1, 0))
    again = repeated[at] == s.name if len(repeated) else np.zeros(len(s.name), bool)
    if not again.any():
        return np.zeros(0, np.uint64), none, none
    width = length - GRAM + 1
    # Only strings that hold a repeated sample can be sampled by one.
    near = np.zeros(len(s.least) + 2 * width, np.int32)
    near[s.place[again]] += 1
    near[s.place[again] + width] -= 1
    strings = np.flatnonzero((np.cumsum(near)[width - 1 : width - 1 + len(s.least)] > 0) & (s.least > 0))
    if not len(strings):
        return np.zeros(0, np.uint64), none, none
    before = np.zeros(len(s.least) + width + 1, np.int32)
    before[s.place + 1] = 1
    # The first place in each string where its smallest gram stands.
    which = np.cumsum(before)[strings].astype(np.int64)
    wanted = mix(s.least[strings] ^ np.uint64(_BASE))
    waiting = np.flatnonzero(s.name[which] != wanted)
    while len(waiting):
        which[waiting] += 1
        waiting = waiting[s.name[which[waiting]] != wanted[waiting]]
    mine = again[which]
    strings, which = strings[mine], which[mine]
    if not len(strings):
        return np.zeros(0, np.uint64), none, none
    cuts = np.flatnonzero((np.diff(which) != 0) | (np.diff(strings) != 1)) + 1
    begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(strings)]]) - 1
    return s.name[which[begin]], strings[begin], strings[end]


def _pieces(table: pa.Table, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes in chunks; per byte its text's end; per text its row and where the chunk starts in it.

    A text longer than a chunk comes in pieces that overlap by ``length - 1`` bytes.
    """
    data, offsets = text_bytes(table.column("text"))
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        if offsets[j] - offsets[i] > PIECE:
            for at in range(int(offsets[i]), int(offsets[j]), PIECE):
                part = data[at : min(at + PIECE + length - 1, int(offsets[j]))]
                yield part, np.full(len(part), len(part), np.int32), np.array([0]), np.array([[i, at - int(offsets[i])]])
        else:
            bounds = offsets[i : j + 1] - offsets[i]
            rows = np.stack([np.arange(i, j), np.zeros(j - i, np.int64)], 1)
            yield data[offsets[i] : offsets[j]], np.repeat(bounds[1:].astype(np.int32), np.diff(bounds)), bounds[:-1], rows
        i = j


def _sampled(table: pa.Table, length: int) -> list[_Samples]:
    return [_samples(data, ends, length) for data, ends, _, _ in _pieces(table, length)]


def _names(sampled: list[_Samples]) -> Keys:
    names, counts = np.unique(np.concatenate([s.name for s in sampled]) if sampled else np.zeros(0, np.uint64), return_counts=True)
    return {1: (names, counts)}


def _stretch_hash(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of ``size`` bytes from ``first`` on, by running sums."""
    powers, inverse = power_table(_BASE, len(data) + 1), power_table(_BACK, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[first + size] - sums[first]) * inverse[first] + size.astype(np.uint64))


def _singly(
    name: np.ndarray, first: np.ndarray, last: np.ndarray, hot: np.ndarray, data: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of hot names as single strings, each named by its own bytes: they spread over all owners, and equal ones still meet."""
    at = np.minimum(np.searchsorted(hot, name), len(hot) - 1)
    split = hot[at] == name
    if not split.any():
        return name, first, last
    n = (last - first + 1)[split]
    place = np.repeat(first[split], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    own = _stretch_hash(data, place, np.full(len(place), length))
    whole = ~split
    return np.concatenate([name[whole], own]), np.concatenate([first[whole], place]), np.concatenate([last[whole], place])


class _Stretches:
    """Repeated samples of a block: each occurrence, and the distinct stretches of bytes they have.

    A stretch is known by its sample's name and a hash of all its bytes. The order of the distinct ones depends on
    what the block holds alone, not on the order of its rows, so that it can be worked out again.
    """

    def __init__(self, table: pa.Table, id_col: str, replies: pa.Table, length: int, hot_from: int):
        sampled = _sampled(table, length)
        names, _ = _names(sampled)[1]
        times = told(replies)[1] if len(names) else np.zeros(0, np.uint32)
        repeated, hot = names[times > 1], names[times > hot_from]
        ids = table.column(id_col).to_numpy()
        cols: dict[str, list[np.ndarray]] = {c: [] for c in ("name", "hash", "row", "start", "count")}
        bodies: list[np.ndarray] = []
        picks: list[np.ndarray] = []
        seen = 0
        for (data, _, bounds, rows), s in zip(_pieces(table, length), sampled, strict=True):
            name, first, last = _runs(s, repeated, length)
            if not len(name):
                continue
            if len(hot):
                name, first, last = _singly(name, first, last, hot, data, length)
            text = np.searchsorted(bounds, first, "right") - 1
            count = last - first + 1
            cols["name"].append(name)
            cols["hash"].append(_stretch_hash(data, first, count + length - 1))
            cols["row"].append(rows[text, 0])
            cols["start"].append(first - bounds[text] + rows[text, 1])
            cols["count"].append(count)
            bodies.append(data)
            picks.append(first + seen)
            seen += len(data)
        if not bodies:
            bodies, picks = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
            cols = {c: [np.zeros(0, np.uint64 if c in ("name", "hash") else np.int64)] for c in cols}
        self.row, self.start = np.concatenate(cols["row"]), np.concatenate(cols["start"])
        count = np.concatenate(cols["count"])
        name, hashed = np.concatenate(cols["name"]), np.concatenate(cols["hash"])
        at = np.concatenate(picks)
        order = np.lexsort((hashed, name))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(name[order]) != 0) | (np.diff(hashed[order]) != 0)
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        lead = order[new]
        self.name, self.count = name[lead], count[lead]
        self.least = np.full(len(lead), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.which, ids[self.row])
        self._bodies, self._at, self._length = bodies, at[lead], length

    def body(self) -> np.ndarray:
        """Bytes of the distinct stretches, one after another."""
        size = self.count + self._length - 1
        data = np.concatenate(self._bodies)
        step = np.ones(int(size.sum()), np.int64)
        if not len(step):
            return np.zeros(0, np.uint8)
        ends = np.cumsum(size)[:-1]
        step[0] = self._at[0]
        step[ends] = self._at[1:] - (self._at[:-1] + size[:-1] - 1)
        return data[np.cumsum(step)]


def _marks(ids: np.ndarray, counts: np.ndarray, body: np.ndarray, length: int) -> np.ndarray:
    """For each string (``counts`` per stretch) whether an equal one has a smaller id."""
    size = counts + length - 1
    base = np.cumsum(size) - size
    total = int(counts.sum())
    inner = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(base, counts) + inner
    who = np.repeat(ids, counts)
    h = _rolling(body, length)[at]
    order = np.argsort(h)
    new = np.ones(total, bool)
    new[1:] = np.diff(h[order]) != 0
    # Neighbours under one hash are compared byte for byte, eight at a time.
    eights = np.ndarray((max(len(body) - 7, 0),), "<u8", body, strides=(1,))
    right = np.flatnonzero(~new)
    left, right = at[order[right - 1]], at[order[right]]
    differ = np.zeros(len(left), bool)
    for shift in sorted({*range(0, length - 7, 8), length - 8}):
        differ |= eights[left + shift] != eights[right + shift]
    if differ.any():
        # Two strings under one hash: the strings of such a hash are put in the order of their bytes.
        run = np.cumsum(new) - 1
        for k in np.unique(run[np.flatnonzero(~new)[differ]]).tolist():
            lo, hi = np.searchsorted(run, [k, k + 1])
            texts = [body[p : p + length].tobytes() for p in at[order[lo:hi]].tolist()]
            by_bytes = sorted(range(hi - lo), key=texts.__getitem__)
            order[lo:hi] = order[lo:hi][by_bytes]
            new[lo + 1 : hi] = [texts[a] != texts[b] for a, b in itertools.pairwise(by_bytes)]
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(who[order], np.flatnonzero(new)) if total else who
    marked = np.zeros(total, bool)
    marked[order] = who[order] > least[group]
    return marked


def remove_repeats(
    df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hot: int = HOT
) -> DataFrame:
    """Per row of ``df``: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    Removed is each byte that is covered by a string of ``length`` bytes which also starts in a
    document of a smaller id; overlaps count, and only the input decides. A null text is an empty one;
    texts shorter than ``length`` stay whole; equal ids never remove each other's text, so repeated
    rows are treated alike; a null id counts as the largest; an empty table gives no rows; further
    columns are ignored. Texts of any length are read whole.
    """
    last = (1 << 63) - 1
    docs = df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias(id_col),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    blocked, blocks = in_blocks(docs, id_col, "text", block_bytes)
    owners = blocks * OWNERS_PER_BLOCK
    counted = answer_sums(ask(blocked, lambda table: _names(_sampled(table, length)), blocks))

    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        s = _Stretches(table, id_col, replies, length, hot)
        own = owners_of(s.name, owners).astype(np.int64)
        cuts = np.flatnonzero(np.diff(own)) + 1
        body, size = s.body(), s.count + length - 1
        edges = np.cumsum(size)[cuts - 1] if len(cuts) else cuts
        parts = list(zip(np.split(own, cuts), np.split(s.least, cuts), np.split(s.count, cuts), np.split(body, edges), strict=True))
        parts = [p for p in parts if len(p[0])]
        block = table.column("block")[0].as_py()
        return pa.table(
            {
                "block": pa.array([block] * len(parts), pa.int32()),
                "owner": pa.array([int(p[0][0]) for p in parts], pa.int32()),
                "ids": pa.array([p[1].tobytes() for p in parts], pa.binary()),
                "counts": pa.array([p[2].astype(np.uint8).tobytes() for p in parts], pa.binary()),
                "body": pa.array([p[3].tobytes() for p in parts], pa.binary()),
            }
        )

    def mark(table: pa.Table) -> pa.Table:
        ids = [np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()]
        counts = [np.frombuffer(x, np.uint8).astype(np.int64) for x in table.column("counts").to_pylist()]
        body = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("body").to_pylist()])
        marked = _marks(np.concatenate(ids), np.concatenate(counts), body, length)
        edges = np.cumsum([int(c.sum()) for c in counts])[:-1]
        return pa.table(
            {
                "block": table.column("block"),
                "owner": table.column("owner"),
                "kind": pa.array([2] * table.num_rows, pa.int32()),
                "counts": pa.array([np.packbits(m).tobytes() for m in np.split(marked, edges)], pa.binary()),
            }
        )

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        kinds = np.asarray(replies.column("kind"))
        s = _Stretches(table, id_col, replies.filter(pa.array(kinds == 1)), length, hot)
        own = owners_of(s.name, owners).astype(np.int64)
        bits = np.zeros(int(s.count.sum()), bool)
        begin = np.cumsum(s.count) - s.count
        for owner, packed in zip(*(replies.filter(pa.array(kinds == 2)).column(c).to_pylist() for c in ("owner", "counts")), strict=True):
            i, j = np.searchsorted(own, [owner, owner + 1])
            n = int(s.count[i:j].sum())
            bits[begin[i] : begin[i] + n] = np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)
        ids = table.column(id_col).to_numpy()
        data, offsets = text_bytes(table.column("text"))
        # +1 where a marked string begins, -1 behind its end: running sums tell what is covered.
        # Sums run over one text at a time, so memory is that of the block's bytes.
        n = s.count[s.which]
        every = np.repeat(ids[s.row] > s.least[s.which], n)
        inner = np.arange(len(every)) - np.repeat(np.cumsum(n) - n, n)
        hit = every | bits[np.repeat(begin[s.which], n) + inner]
        row, start = np.repeat(s.row, n)[hit], (np.repeat(s.start, n) + inner)[hit]
        del every, inner, hit
        order = np.argsort(row, kind="stable")
        row, start = row[order], start[order]
        edges = np.searchsorted(row, np.arange(table.num_rows + 1))
        out: dict[str, list] = {"n_removed": [], "n_spans": [], "kept_sha256": []}
        for r in range(table.num_rows):
            text = data[offsets[r] : offsets[r + 1]]
            if edges[r] == edges[r + 1]:
                removed, spans, kept = 0, 0, text
            else:
                steps = np.zeros(len(text) + 1, np.int32)
                at = start[edges[r] : edges[r + 1]]
                np.add.at(steps, at, 1)
                np.add.at(steps, at + length, -1)
                gone = np.cumsum(steps)[:-1] > 0
                removed, kept = int(gone.sum()), text[~gone]
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out["n_removed"].append(removed)
            out["n_spans"].append(spans)
            out["kept_sha256"].append(hashlib.sha256(kept.tobytes()).hexdigest())
        return pa.table(
            {
                id_col: table.column(id_col),
                "n_bytes": pa.array(np.diff(offsets), pa.int64()),
                "n_removed": pa.array(out["n_removed"], pa.int64()),
                "n_spans": pa.array(out["n_spans"], pa.int64()),
                "kept_sha256": pa.array(out["kept_sha256"], pa.string()),
            }
        )

    by_block = blocked.groupBy("block")
    stretches = by_block.cogroup(counted.groupBy("block")).applyInArrow(send, "block int, owner int, ids binary, counts binary, body binary")
    marks = stretches.groupBy("owner").applyInArrow(mark, "block int, owner int, kind int, counts binary")
    cut_out = by_block.cogroup(counted.unionByName(marks, allowMissingColumns=True).groupBy("block")).applyInArrow(
        cut, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
    return cut_out.withColumn(id_col, F.when(F.col(id_col) != last, F.col(id_col)))
