"""Alignment of two tokenizers over the same bytes.

Both end lists of a text are sorted byte offsets. The shorter one drives: each of its ends gallops into
the longer list (steps that double, then binary search) from where the end before it was found. Ends
that both lists hold cut the tokens into groups; the differences of their ranks give the ranges of tokens
that share a group, and every pair of ranges links its tokens.

How many documents hold an id pair linked is counted over the whole corpus. Texts are encoded once, in
blocks: a block stores per document which of the block's distinct pairs it holds, and asks for their
counts; counts are summed by pair, and go back to the blocks that asked.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hamsieve.llm.blocks import pack, unpack
from hamsieve.sources.scratch import materialize

#: Bytes of text in a block, and in a piece of it that is encoded and aligned at once. A longer text is a piece of its own.
BLOCK_BYTES = 12 << 20
PIECE_BYTES = 1 << 19
#: Ends of the shorter list that are searched from the list's start; those between gallop on from them.
ANCHOR = 32
#: Links that are expanded at once; a group with more is taken by its distinct ids.
LINKS = 1 << 20

# How the byte-level vocabulary spells bytes, and the pattern that splits a text before merges.
_SPELT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes all libraries agree on, whatever version of the character table they carry.
_SETTLED = re.compile("[\u0000-\u036f\u2000-\u206f]*")
_ID_BITS = 20


class Tokens:
    """Bytes of every id of a vocabulary, and its encoder."""

    def __init__(self, pieces: list[bytes]):
        if len(pieces) >= 1 << _ID_BITS:
            raise ValueError(f"a vocabulary of {len(pieces)} ids is too large")
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, joined."""
        sizes = self.sizes[ids]
        shift = self.starts[ids] - np.concatenate([[0], np.cumsum(sizes)])[:-1]
        return self.bytes[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]


class ByteTokens(Tokens):
    """A byte-level vocabulary with merges; encodes space + text. Special tokens' strings are plain text."""

    def __init__(self, model: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        told = json.loads(model)
        spelt = {chr(b): b for b in _SPELT} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _SPELT)}
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        size = max([*told["model"]["vocab"].values(), *special.values()]) + 1
        pieces = [b""] * size
        for piece, i in told["model"]["vocab"].items():
            pieces[i] = piece.encode() if piece in special else bytes(spelt[c] for c in piece)
        super().__init__(pieces)
        self.slow = Tokenizer.from_str(model.decode())
        self.slow.encode_special_tokens = True
        # Ids grow in the order of the merges, so they are the ranks that the quicker encoder wants.
        ranks = {p: i for i, p in enumerate(pieces) if p and i not in special.values()}
        self.fast = tiktoken.Encoding("bytes", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            text = " " + text
            if _SETTLED.fullmatch(text):
                out.append(self.fast.encode_ordinary(text))
            else:
                out.append(self.slow.encode(text, add_special_tokens=False).ids)
        return out


class PieceTokens(Tokens):
    """A vocabulary of pieces with byte fallback; the encoder adds the space itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        super().__init__([bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-Fa-f]{2}>", p) else p.replace("▁", " ").encode() for p in pieces])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def vocabularies(a: bytes, b: bytes) -> tuple[ByteTokens, PieceTokens]:
    """Built once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteTokens(a), PieceTokens(b)


def gallop(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """First place in ``low`` .. ``high`` of sorted ``values`` that isn't below ``wanted``, for all of them side by side."""
    left, right = low.copy(), high.copy()
    active = np.flatnonzero(left < right)
    step = 1
    while len(active):
        at = left[active] + (step - 1)
        inside = at < high[active]
        below = inside & (values[np.minimum(at, len(values) - 1)] < wanted[active])
        stop = inside & ~below
        right[active[stop]] = at[stop]
        left[active[below]] = at[below] + 1
        active = active[below]
        step *= 2
    active = np.flatnonzero(left < right)
    while len(active):
        middle = (left[active] + right[active]) >> 1
        below = values[middle] < wanted[active]
        left[active[below]] = middle[below] + 1
        right[active[~below]] = middle[~below]
        active = active[left[active] < right[active]]
    return left


def common_ends(a: np.ndarray, cuts_a: np.ndarray, b: np.ndarray, cuts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the ends that both hold. ``cuts`` bound the texts; ends grow through all texts."""
    size_a, size_b = np.diff(cuts_a), np.diff(cuts_b)
    found = []
    for short, cuts, long, long_cuts, texts in ((a, cuts_a, b, cuts_b, size_a <= size_b), (b, cuts_b, a, cuts_a, size_a > size_b)):
        sizes = np.diff(cuts) * texts
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = place + np.repeat(cuts[:-1], sizes)
        low, high = np.repeat(long_cuts[:-1], sizes), np.repeat(long_cuts[1:], sizes)
        anchor = place % ANCHOR == 0
        where = np.empty(len(at), np.int64)
        where[anchor] = gallop(long, low[anchor], high[anchor], short[at[anchor]])
        rest = np.flatnonzero(~anchor)
        where[rest] = gallop(long, where[rest - place[rest] % ANCHOR], high[rest], short[at[rest]])
        hit = where < high
        hit[hit] = long[where[hit]] == short[at[hit]]
        found.append((at[hit], where[hit]))
    (a1, b1), (b2, a2) = found
    in_a, in_b = np.concatenate([a1, a2]), np.concatenate([b1, b2])
    order = np.argsort(in_a, kind="stable")
    return in_a[order], in_b[order]


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between each two bounds."""
    return np.diff(_bounds(values)[bounds])


@lru_cache(maxsize=4)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 .. n-1, left-justified with room for one more character, and their number."""
    told = np.arange(n).astype("S")
    sizes = np.char.str_len(told).astype(np.int64)
    table = np.zeros((n, int(sizes.max()) + 1), np.uint8)
    table[:, :-1] = told.view(np.uint8).reshape(n, -1)[:, : table.shape[1] - 1]
    return table, sizes


def _arange(sizes: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each size."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of their times."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times[order], first) if len(first) else times[:0]


class Alignment:
    """Tokens of some texts, cut into groups at their common ends. Empty texts, and those that a
    vocabulary doesn't spell byte by byte, have no tokens."""

    def __init__(self, texts: list[str], a: Tokens, b: Tokens):
        told = [t.encode() for t in texts]
        n_bytes = np.array([len(t) + 1 if t else 0 for t in told], np.int64)
        raw = np.frombuffer(b"".join(b" " + t for t in told if t), np.uint8)
        ids, sizes, good = [], [], n_bytes > 0
        for tokens in (a, b):
            found = [f if k else [] for f, k in zip(tokens.encode(texts), n_bytes.tolist(), strict=True)]
            n = np.array([len(f) for f in found], np.int64)
            ids.append(np.fromiter(itertools.chain.from_iterable(found), np.int64, int(n.sum())))
            sizes.append(n)
            good &= _sums(tokens.sizes[ids[-1]], _bounds(n)) == n_bytes
        # Of the texts whose lengths agree, those whose bytes do.
        kept = raw[np.repeat(good, n_bytes)]
        same = np.ones(len(kept), bool)
        for tokens, own, n in zip((a, b), ids, sizes, strict=True):
            same &= tokens.spell(own[np.repeat(good, n)]) == kept
        good[np.repeat(np.arange(len(good)), n_bytes * good)[~same]] = False
        self.n_texts = len(texts)
        self.a, self.b = (i[np.repeat(good, s)] for i, s in zip(ids, sizes, strict=True))
        self.n_a, self.n_b = (s * good for s in sizes)
        self.cuts_a, self.cuts_b = _bounds(self.n_a), _bounds(self.n_b)
        ends_a, ends_b = np.cumsum(a.sizes[self.a]), np.cumsum(b.sizes[self.b])
        last_a, last_b = common_ends(ends_a, self.cuts_a, ends_b, self.cuts_b)
        #: Tokens of each group, and the groups of each text.
        self.in_a, self.in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        self.from_a, self.from_b = last_a + 1 - self.in_a, last_b + 1 - self.in_b
        self.cuts = np.searchsorted(last_a, self.cuts_a)
        self.n_groups = np.diff(self.cuts)
        self.n_links = _sums(self.in_a * self.in_b, self.cuts)

    def spans(self) -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
        """Per text its groups as ranges of tokens of the text: first and end in A, first and end in B."""
        for t in range(self.n_texts):
            g = slice(self.cuts[t], self.cuts[t + 1])
            a, b = self.from_a[g] - self.cuts_a[t], self.from_b[g] - self.cuts_b[t]
            yield t, list(zip(a.tolist(), (a + self.in_a[g]).tolist(), b.tolist(), (b + self.in_b[g]).tolist(), strict=True))

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups, as ``a1,a2|b1;a3|b2,b3``; nothing for a text without tokens."""
        group_a, group_b = np.repeat(np.arange(len(self.in_a)), self.in_a), np.repeat(np.arange(len(self.in_b)), self.in_b)
        total = len(self.a) + len(self.b)
        ids, sign = np.empty(total, np.int64), np.empty(total, np.uint8)
        # A group's A tokens stand before its B tokens.
        for own, group, other, last, end in (
            (self.a, group_a, self.from_b, self.from_a + self.in_a - 1, b"|"),
            (self.b, group_b, self.from_a + self.in_a, self.from_b + self.in_b - 1, b";"),
        ):
            place = np.arange(len(own)) + other[group]
            ids[place], sign[place] = own, ord(",")
            sign[place[last]] = ord(end)
        table, sizes = _decimals(1 << int(ids.max()).bit_length() if total else 1)
        rows, size = table[ids], sizes[ids]
        rows[np.arange(total), size] = sign
        text = rows[np.arange(rows.shape[1]) <= size[:, None]]
        bounds = _bounds(size + 1)[self.cuts_a + self.cuts_b]
        return [hashlib.sha256(text[s : e - 1]).hexdigest() if e > s else "" for s, e in itertools.pairwise(bounds.tolist())]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, id pair and number of links, for every distinct pair of every text; sorted by text and pair."""
        links = self.in_a * self.in_b
        text_of = np.repeat(np.arange(self.n_texts), self.n_groups)
        keys, times = [], []
        small = np.flatnonzero(links <= LINKS)
        cuts = np.searchsorted(np.cumsum(links[small]), np.arange(0, int(links[small].sum()) + LINKS, LINKS), "right")
        for g in (small[s:e] for s, e in itertools.pairwise(cuts.tolist()) if e > s):
            at = _arange(links[g])
            width = np.repeat(self.in_b[g], links[g])
            a = self.a[np.repeat(self.from_a[g], links[g]) + at // width]
            b = self.b[np.repeat(self.from_b[g], links[g]) + at % width]
            keys_here, n = _counted((np.repeat(text_of[g], links[g]) << (2 * _ID_BITS)) | (a << _ID_BITS) | b, np.ones(len(at), np.int64))
            keys.append(keys_here)
            times.append(n)
        for g in np.flatnonzero(links > LINKS).tolist():
            a, n_a = np.unique(self.a[self.from_a[g] : self.from_a[g] + self.in_a[g]], return_counts=True)
            b, n_b = np.unique(self.b[self.from_b[g] : self.from_b[g] + self.in_b[g]], return_counts=True)
            keys.append(((int(text_of[g]) << (2 * _ID_BITS)) | (a[:, None] << _ID_BITS) | b).ravel())
            times.append((n_a[:, None] * n_b).ravel())
        if not keys:
            return (np.zeros(0, np.int64),) * 3
        key, n = _counted(np.concatenate(keys), np.concatenate(times))
        return key >> (2 * _ID_BITS), key & ((1 << (2 * _ID_BITS)) - 1), n


_BLOCKS = (
    "block long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "places binary, times binary, pairs array<long>, docs array<long>"
)
_ALIGNED = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _packed(values: np.ndarray) -> bytes:
    return values.astype(np.uint8 if not len(values) or values.max() < 256 else np.int64).tobytes()


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, np.uint8 if len(packed) == n else np.int64).astype(np.int64)


class _Block:
    """Documents of a block, as they come, and their distinct pairs."""

    def __init__(self, number: int):
        self.number = number
        self.size = 0
        self.ids: list[int | None] = []
        self.columns: dict[str, list] = {c: [] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: list[int | None], found: Alignment) -> None:
        text, pair, times = found.pairs()
        self.parts.append((text + len(self.ids), pair, times.astype(np.int32) if not len(times) or times.max() < 1 << 31 else times))
        self.ids += ids
        for name in ("n_a", "n_b", "n_groups", "n_links"):
            self.columns[name] += getattr(found, name).tolist()
        self.columns["groups_sha256"] += found.digests()

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The documents, each with the places of its pairs among the block's, and one row that asks for those."""
        text, pair, times = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        known, place, docs = np.unique(pair, return_inverse=True, return_counts=True)
        bounds = np.searchsorted(text, np.arange(len(self.ids) + 1)).tolist()
        spans = list(itertools.pairwise(bounds))
        place = place.astype(np.uint64)
        rows = {
            "block": pa.array([self.number] * len(self.ids), pa.int64()),
            "id": pa.array(self.ids, pa.int64()),
            **{n: pa.array(v, pa.string() if n == "groups_sha256" else pa.int64()) for n, v in self.columns.items()},
            "places": pa.array([pack(place[s:e]) if e > s else b"" for s, e in spans], pa.binary()),
            "times": pa.array([_packed(times[s:e]) for s, e in spans], pa.binary()),
            "pairs": pa.nulls(len(self.ids), pa.list_(pa.int64())),
            "docs": pa.nulls(len(self.ids), pa.list_(pa.int64())),
        }
        documents = pa.RecordBatch.from_pydict(rows)
        yield documents
        asked = {n: pa.nulls(1, t) for n, t in zip(documents.schema.names, documents.schema.types, strict=True)}
        asked["block"] = pa.array([self.number], pa.int64())
        asked["pairs"], asked["docs"] = pa.array([known], pa.list_(pa.int64())), pa.array([docs], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_pydict(asked)


def _settle(documents: pa.Table, answers: pa.Table) -> pa.Table:
    """A block's documents with the sums over their links; the answers, in order of the pairs, are in the order of the places."""
    order = np.argsort(np.asarray(answers.column("pair")))
    count = np.asarray(answers.column("n"))[order]
    best = np.asarray(answers.column("best"))[order]
    n_best, count_sum = [], []
    for packed, told in zip(documents.column("places").to_pylist(), documents.column("times").to_pylist(), strict=True):
        place = unpack(packed).astype(np.int64) if packed else np.zeros(0, np.int64)
        times = _unpacked(told, len(place))
        n_best.append(int(times[best[place]].sum()))
        count_sum.append(int((times * count[place]).sum()))
    documents = documents.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
    return documents.select(["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def _models(docs: DataFrame, folder: str, a: str, b: str):
    """Both vocabulary files, read once and broadcast: a few megabytes, whatever the corpus."""
    told = []
    for name in (a, b):
        with open(os.path.join(folder, name), "rb") as f:
            told.append(f.read())
    return docs.sparkSession.sparkContext.broadcast(tuple(told))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str], int]]:
    """Ids and texts in pieces of bounded size, and their bytes."""
    ids: list[int | None] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(text)
                size += len(text) + 64
                if size >= PIECE_BYTES:
                    yield ids, texts, size
                    ids, texts, size = [], [], 0
    if ids:
        yield ids, texts, size


def align(
    docs: DataFrame,
    folder: str,
    a: str = "byte_bpe_50k.json",
    b: str = "piece_bpe_32k.model",
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per row of ``docs``: id, tokens (``n_a``, ``n_b``), ``n_groups``, ``n_links``, ``n_best`` (links whose pair is held by as many
    documents as any of its A id), ``count_sum`` (documents that hold a link's pair, over links), ``groups_sha256``.

    ``folder`` holds the vocabularies. A null or empty text, and one that a vocabulary cannot spell, has
    no tokens: zeros and ''. Each row is a document: equal ids and repeated rows count each, a null id is
    kept. An empty table gives no rows; further columns are ignored. Texts are encoded whole and once, and
    are not shuffled; what is shuffled is, per block of ``block_bytes``, its distinct pairs, and some two
    bytes per distinct pair of a document.
    """
    shared = _models(docs, folder, a, b)

    def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = vocabularies(*shared.value)
        number = TaskContext.get().partitionId() << 32
        block = _Block(number)
        for ids, texts, size in _pieces(batches):
            block.add(ids, Alignment(texts, *both))
            block.size += size
            if block.size >= block_bytes:
                yield from block.batches()
                number += 1
                block = _Block(number)
        if block.ids:
            yield from block.batches()

    blocks = materialize(_texts(docs, id_col, text_col).mapInArrow(in_blocks, _BLOCKS), "align-blocks")
    asks = blocks.where("pairs IS NOT NULL").select("block", F.explode(F.arrays_zip("pairs", "docs")).alias("_ask"))
    asks = asks.select("block", F.col("_ask.pairs").alias("pair"), F.col("_ask.docs").alias("n"))
    counts = asks.groupBy("pair").agg(F.sum("n").alias("n"))
    # An A id has at most as many pairs as B has ids.
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", _ID_BITS)))
    counts = counts.withColumn("best", F.col("n") == most)
    answers = asks.select(F.col("block").alias("asker"), "pair").join(counts, "pair")
    documents = blocks.where("pairs IS NULL").drop("pairs", "docs")
    settled = documents.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(_settle, f"id long, {_ALIGNED}")
    return settled.withColumnRenamed("id", id_col)


def token_groups(
    docs: DataFrame, folder: str, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: id, ``a`` and ``b`` (token ids), and ``groups``, ranges of places in both that cover the same bytes."""
    shared = _models(docs, folder, a, b)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = vocabularies(*shared.value)
        for ids, texts, _ in _pieces(batches):
            told = Alignment(texts, *both)
            groups = [[dict(zip(("a_from", "a_to", "b_from", "b_to"), g, strict=True)) for g in spans] for _, spans in told.spans()]
            tokens = ([own[s:e] for s, e in itertools.pairwise(cuts.tolist())] for own, cuts in ((told.a, told.cuts_a), (told.b, told.cuts_b)))
            ranges = pa.list_(pa.struct([(n, pa.int32()) for n in ("a_from", "a_to", "b_from", "b_to")]))
            columns = [pa.array(ids, pa.int64()), *(pa.array(t, pa.list_(pa.int32())) for t in tokens), pa.array(groups, ranges)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "a", "b", "groups"])

    schema = "id long, a array<int>, b array<int>, groups array<struct<a_from:int,a_to:int,b_from:int,b_to:int>>"
    return _texts(docs, id_col, text_col).mapInArrow(found, schema).withColumnRenamed("id", id_col)
