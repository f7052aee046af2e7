"""Language-model scores by a weighted backoff automaton.

States are the contexts that training has seen; an arc reads a word and carries its smoothed log10
probability; a failure arc leads to the next shorter context and carries what backing off costs. A
text is read once from left to right, carrying its state: each word takes the state's arc, after as many
failure arcs as it takes to come to one, and the weights add up.

Counts are gathered over the whole corpus (see ``blocks``): each block of texts receives the counts
of its own n-grams and builds just the part of the automaton that its texts can enter. Nothing that
grows with the corpus is broadcast or collected.

Smoothing. Words: absolute discounting, D = n1 / (n1 + 2 n2), what is taken away goes to the one
class of unknown words. Longer n-grams: interpolation with the next shorter one; its share depends
on the context's count c as FLOOR + (1 - FLOOR) * HALF / (HALF + c). All probabilities after a
context sum to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hamsieve.llm.blocks import BLOCK_BYTES, Keys, answer_sums, ask, in_blocks, owners_of, pack, told, unpack
from hamsieve.llm.kernels import mix, words

#: The least share of the shorter context, and the count at which the rest is halved.
FLOOR = 0.3
HALF = 4.0
#: Added to counts by the base score.
BASE_ADD = 0.1

_END = np.uint64(0x1F83D9ABFB41BD6B)
_BEGIN = np.uint64(0x5BE0CD19137E2179)
_STEP = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Totals:
    """Training tokens, distinct ones, those met once and twice, and texts."""

    tokens: int
    distinct: int
    once: int
    twice: int
    texts: int

    @property
    def discount(self) -> float:
        return min(max(self.once / (self.once + 2 * self.twice), 0.1), 0.9) if self.once + self.twice else 0.5


def _sequence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts, each text closed by an end, and the bounds of the texts."""
    parts: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    for _, h, bounds in words(column):
        n = len(bounds) - 1
        out = np.empty(len(h) + n, np.uint64)
        ends = bounds[1:] + np.arange(n)
        inside = np.ones(len(out), bool)
        inside[ends] = False
        out[ends] = _END
        out[inside] = h
        parts.append(out)
        sizes.append(np.diff(bounds) + 1)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _grams(seq: np.ndarray, bounds: np.ndarray, order: int) -> list[np.ndarray]:
    """Per length 1.. ``order`` the hash of the n-gram that ends at each word.

    A text is preceded by one begin mark. Where a longer n-gram would reach beyond it, there is none (0).
    """
    grams = [seq]
    place = np.arange(len(seq)) - np.repeat(bounds[:-1], np.diff(bounds))
    for k in range(2, order + 1):
        before = np.empty(len(seq), np.uint64)
        before[1:] = grams[-1][:-1]
        if k == 2:
            before[place == 0] = _BEGIN
        g = mix(before * _STEP + seq)
        g[place < k - 2] = 0
        grams.append(g)
    return grams


def _training(table: pa.Table, bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.asarray(table.column("train").combine_chunks().to_numpy(zero_copy_only=False), bool), np.diff(bounds))


def _keys(table: pa.Table, order: int) -> Keys:
    seq, bounds = _sequence(table.column("text"))
    train = _training(table, bounds)
    out: Keys = {}
    for k, g in enumerate(_grams(seq, bounds, order), 1):
        keys, where = np.unique(g, return_inverse=True)
        out[k] = (keys, np.bincount(where, train, len(keys)))
    return out


#: Words of a text that are read one after another by one lane; a longer text takes several, each entered at its state.
LANE = 512


class BackoffAutomaton:
    """The part of the model that a block's texts can enter.

    State 0 is the empty context, all others are contexts that training has seen: n-grams of up to ``order - 1``
    words, the begin of a text among them. ``failure`` leads from a state to its context without the first
    word and costs ``paid``. An arc is found by its state and word (``arc``: sorted numbers of both), costs
    ``weight`` and leads to ``target``, the longest context that ends in the word. ``counts[k]`` belongs to ``keys[k]``.
    """

    def __init__(self, seq: np.ndarray, bounds: np.ndarray, order: int, counts: dict[int, np.ndarray], totals: Totals):
        self.bounds = bounds
        n, starts = len(seq), bounds[:-1]
        total, discount = max(totals.tokens, 1), totals.discount
        unknown = discount * totals.distinct / total if totals.tokens else 1.0
        vocabulary, word = np.unique(seq, return_inverse=True)
        self.word, self.words = word.astype(np.int32), len(vocabulary)
        # Per position the state of the longest context that ends there, and of that of the length before.
        self.entered = np.zeros(n, np.int32)
        begin = 1 if totals.texts and order > 1 else 0
        self.failure, self.paid = [np.zeros(1 + begin, np.int32)], [np.zeros(1)]
        if begin:
            self.paid.append(np.log10([_share(np.array([totals.texts]))[0]]))
        states = 1 + begin
        arcs: list[np.ndarray] = []
        weights: list[np.ndarray] = []
        targets: list[np.ndarray] = []
        below = before = None
        shorter = np.zeros(n, np.int32)
        for k, g in enumerate(_grams(seq, bounds, order), 1):
            _, first, where = np.unique(g, return_index=True, return_inverse=True)
            c = counts[k].astype(np.float64)[where]
            c[g == 0] = 0
            seen = c[first] > 0
            if k == 1:
                self.known = c
                below = np.where(c > 0, np.maximum(c - discount, 0) / total, unknown)
                source = np.zeros(n, np.int32)
            else:
                context = np.zeros(n)
                context[1:] = before[:-1]
                source = np.zeros(n, np.int32)
                source[1:] = shorter[:-1]
                if k == 2:
                    context[starts], source[starts] = totals.texts, begin
                context[g == 0] = 0
                share = _share(context)
                below = (1 - share) * c / np.maximum(context, 1) + share * below
                del share, context
            if k < order:
                # Contexts that training has seen become states; the failure arc leads to the same without its first word.
                state = np.where(seen, np.cumsum(seen) - 1 + states, 0).astype(np.int32)
                self.failure.append(shorter[first[seen]])
                self.paid.append(np.log10(_share(c[first[seen]])))
                states += int(seen.sum())
                shorter = state[where]
                self.entered = np.where(shorter > 0, shorter, self.entered)
                reached = shorter
            else:
                reached = self.entered if order > 1 else np.zeros(n, np.int32)
            # The empty context has an arc for every word, any other one for the words that training has seen after it.
            at = first if k == 1 else first[seen]
            arcs.append(source[at].astype(np.int64) * self.words + self.word[at])
            weights.append(np.log10(below[at]))
            targets.append(reached[at])
            before = c
            del where, source
        arc = np.concatenate(arcs)
        order_ = np.argsort(arc)
        self.arc, self.weight, self.target = arc[order_], np.concatenate(weights)[order_], np.concatenate(targets)[order_]
        self.failure, self.paid = np.concatenate(self.failure), np.concatenate(self.paid)
        self.begin = begin

    def traverse(self) -> np.ndarray:
        """Log10 probability of each word. Texts are read from left to right side by side, each lane carrying its state.

        A lane whose state has no arc for its word follows failure arcs until one has; the empty context has all.
        """
        out = np.zeros(len(self.word))
        sizes = np.diff(self.bounds)
        lanes = -(-sizes // LANE)
        inner = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = np.repeat(self.bounds[:-1], lanes) + inner * LANE
        length = np.minimum(np.repeat(self.bounds[1:], lanes) - start, LANE)
        state = np.where(inner > 0, self.entered[np.maximum(start - 1, 0)], self.begin).astype(np.int64)
        longest = np.argsort(-length, kind="stable")
        start, length, state = start[longest], length[longest], state[longest]
        for t in range(int(length[0]) if len(length) else 0):
            active = int(np.searchsorted(-length, -t, "left"))
            at = start[:active] + t
            now, word, paid = state[:active].copy(), self.word[at], np.zeros(active)
            place = np.empty(active, np.int64)
            left = np.arange(active)
            while len(left):
                wanted = now[left] * self.words + word[left]
                found = np.minimum(np.searchsorted(self.arc, wanted), len(self.arc) - 1)
                hit = self.arc[found] == wanted
                place[left[hit]] = found[hit]
                left = left[~hit]
                paid[left] += self.paid[now[left]]
                now[left] = self.failure[now[left]]
            out[at] = paid + self.weight[place]
            state[:active] = self.target[place]
        return out


def _share(context: np.ndarray) -> np.ndarray:
    """What a context of so many occurrences leaves to the next shorter one; all, where training has not seen it."""
    return np.where(context > 0, FLOOR + (1 - FLOOR) * HALF / (HALF + context), 1.0)


def corpus_totals(docs: DataFrame, owners: int) -> Totals:
    """Totals of the training words: counted per task, added up by ranges of the word hash."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            seq, bounds = _sequence(table.column("text"))
            seq = seq[_training(table, bounds)]
            both = np.concatenate([keys, seq])
            weights = np.concatenate([counts, np.ones(len(seq), np.int64)])
            keys, where = np.unique(both, return_inverse=True)
            counts = np.bincount(where, weights, len(keys)).astype(np.int64)
        own = owners_of(keys, owners).astype(np.int32)
        cuts = np.flatnonzero(np.diff(own)) + 1
        for k, c in zip(np.split(keys, cuts), np.split(counts, cuts), strict=True):
            if len(k):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owners_of(k[:1], owners).astype(np.int32)), pa.array([pack(k)], pa.binary()), pa.array([c.tobytes()], pa.binary())],
                    names=["owner", "keys", "counts"],
                )

    def add(table: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack(x) for x in table.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()])
        known, where = np.unique(keys, return_inverse=True)
        sums = np.bincount(where, counts, len(known))
        values = [int(sums.sum()), len(known), int((sums == 1).sum()), int((sums == 2).sum())]
        return pa.table({n: pa.array([v], pa.int64()) for n, v in zip(("tokens", "known", "once", "twice"), values, strict=True)})

    parts = (
        docs.select("text", "train")
        .mapInArrow(scan, "owner int, keys binary, counts binary")
        .groupBy("owner")
        .applyInArrow(add, "tokens long, known long, once long, twice long")
    )
    sums = parts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "known", "once", "twice"))).collect()[0]
    texts = docs.where("train").count()
    return Totals(sums["tokens"], sums["known"], sums["once"], sums["twice"], texts)


def score_texts(
    df: DataFrame,
    train: Column,
    order: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per row of ``df``: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``train`` tells which rows the model learns from; all are scored, on the whole text. Words are
    runs outside white space, A-Z lower-cased; each text ends in one more token. A null or empty text
    is that token alone. A null id is kept; repeated rows count and score each; without any training
    rows every word is unknown and scores 0; an empty table gives no rows; further columns are ignored.
    """
    docs = df.select(
        F.col(id_col).cast("long").alias(id_col),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
    )
    blocked, blocks = in_blocks(docs, id_col, "text", block_bytes)
    totals = corpus_totals(docs, blocks)
    answers = answer_sums(ask(blocked, lambda table: _keys(table, order), blocks))

    def score(table: pa.Table, replies: pa.Table) -> pa.Table:
        seq, bounds = _sequence(table.column("text"))
        automaton = BackoffAutomaton(seq, bounds, order, told(replies), totals)
        known = automaton.known
        space = totals.tokens + BASE_ADD * (totals.distinct + 1)
        starts = bounds[:-1]
        return pa.table(
            {
                id_col: table.column(id_col),
                "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                "n_known": pa.array(np.add.reduceat((known > 0).astype(np.int64), starts), pa.int64()),
                "train_tokens": pa.array(np.full(len(starts), totals.tokens), pa.int64()),
                "base_score": pa.array(np.add.reduceat(np.log10((known + BASE_ADD) / space), starts)),
                "score": pa.array(np.add.reduceat(automaton.traverse(), starts)),
            }
        )

    schema = f"`{id_col}` long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)
