"""Toxicity by bags of subword embeddings.

A word is the mean of the embeddings of its character n-grams, its ends included, so a misspelling that
was never seen shares most of its vector with the word it stands for. A text is the mean of its distinct
words (one that is said a thousand times says it once), damped for short texts, and goes through a linear
softmax. Embeddings and softmax are trained jointly in numpy on a bounded sample of labelled rows. What
tasks need is one number per n-gram bucket, a table of fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled rows that are learned from, at most, and of one label at most half where the other has as many;
#: their texts' characters in all, and in one text. Longer ones are scored, not learned from.
SAMPLE = 3000
SAMPLE_CHARS = 10_000_000
LONGEST = 65_536
#: Lengths of n-grams, their buckets, dimensions of an embedding.
SHORTEST_GRAM, LONGEST_GRAM = 3, 6
BITS = 20
DIMENSIONS = 4
#: Words without a say that each text's mean includes.
DAMPING = 10
#: Rounds over all buckets, passes over those that count in each; shrinkage of embeddings as a share of the first
#: gradient's largest value.
ROUNDS = 8
PASSES = 200
SHRINKAGE = 0.007
#: Score from which a text counts as toxic.
THRESHOLD = 0.5
#: Characters of words whose n-grams are taken at once, and of a long text that is cut into words at once.
PIECE = 1 << 17

_SPACE = re.compile(r"\s")


def distinct_words(text: str) -> list[str]:
    """Lower-cased words between white space, each once, in order. A long text is cut at white space."""
    if len(text) <= PIECE:
        return list(dict.fromkeys(text.lower().split()))
    found: dict[str, None] = {}
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        found.update(dict.fromkeys(text[at:end].lower().split()))
        at = end
    return list(found)


def grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per n: the bucket of each n-gram, and its word. A word has a space before and behind it."""
    line = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    space = line == 32
    word = np.cumsum(space) - 1
    spread = line * np.uint64(0x9E3779B97F4A7C15)
    key, inside = spread, np.ones(len(line), bool)
    for n in range(2, LONGEST_GRAM + 1):
        size = len(line) - n + 1
        if size <= 0:
            return
        key = key[:size] * np.uint64(0xD6E8FEB86659FD93) + spread[n - 1 :]
        # A space is met at an end only.
        inside = inside[:size] & ~space[n - 2 : n - 2 + size] if n > 2 else inside[:size]
        if n >= SHORTEST_GRAM:
            at = np.flatnonzero(inside)
            h = key[at]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield (h >> np.uint64(64 - BITS)).astype(np.int32), word[at]


def _pieces(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Distinct words of the texts and the text of each, in pieces of bounded size."""
    words: list[str] = []
    owners: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        for word in distinct_words(text):
            words.append(word)
            owners.append(k)
            size += len(word) + 1
            if size >= PIECE:
                yield words, owners
                words, owners, size = [], [], 0
    if words:
        yield words, owners


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, bucket and weight, for every bucket of every text: the weights by which embeddings are averaged."""
    parts = []
    n_words = np.zeros(len(texts))
    for words, owners in _pieces(texts):
        own = np.array(owners)
        n_words += np.bincount(own, minlength=len(texts))
        found = list(grams(words))
        if not found:
            continue
        bucket, word = (np.concatenate(c) for c in zip(*found, strict=True))
        share = 1 / np.bincount(word, minlength=len(words))[word]
        key, inverse = np.unique((own[word] << BITS) | bucket, return_inverse=True)
        parts.append(((key >> BITS).astype(np.int32), (key & ((1 << BITS) - 1)).astype(np.int32), np.bincount(inverse, share).astype(np.float32)))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)
    # A text that lies in two pieces may have a bucket in both: that adds up where it is used.
    text, bucket, share = (np.concatenate(c) for c in zip(*parts, strict=True))
    return text, bucket, share / (n_words + DAMPING).astype(np.float32)[text]


@dataclass
class SubwordModel:
    """Embeddings of the buckets that count, softmax weights and bias per class."""

    buckets: np.ndarray
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def __post_init__(self) -> None:
        self.table = np.zeros(1 << BITS, np.float32)
        self.table[self.buckets] = self.embeddings @ (self.weights[1] - self.weights[0])

    def vectors(self, words: list[str]) -> np.ndarray:
        """Embedding of each word, seen or not."""
        out = np.zeros((len(words), self.embeddings.shape[1]))
        n = np.zeros(len(words))
        place = np.full(1 << BITS, -1)
        place[self.buckets] = np.arange(len(self.buckets))
        for bucket, word in grams(words):
            known = place[bucket] >= 0
            np.add.at(out, word[known], self.embeddings[place[bucket[known]]])
            n += np.bincount(word, minlength=len(words))
        return out / np.maximum(n, 1)[:, None]

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 of each text."""
        total, n_words = np.zeros(len(texts)), np.zeros(len(texts))
        for words, owners in _pieces(texts):
            said, n = np.zeros(len(words)), np.zeros(len(words))
            for bucket, word in grams(words):
                said += np.bincount(word, self.table[bucket], len(words))
                n += np.bincount(word, minlength=len(words))
            own = np.array(owners)
            total += np.bincount(own, said / np.maximum(n, 1), len(texts))
            n_words += np.bincount(own, minlength=len(texts))
        margin = total / (n_words + DAMPING) + (self.bias[1] - self.bias[0])
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _curvature(text: np.ndarray, column: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int) -> float:
    """Largest eigenvalue of the weighted product of the features with themselves, by power iteration, and a tenth more."""
    v = np.bincount(column, value, n)
    size = 1.0
    for _ in range(15):
        size = float(np.linalg.norm(v))
        if size == 0:
            return 1.0
        v = np.bincount(column, value * (np.bincount(text, value * (v / size)[column], len(weight)) * weight)[text], n)
    return 1.1 * float(np.linalg.norm(v))


def train(texts: list[str], labels: np.ndarray, rounds: int = ROUNDS, passes: int = PASSES, seed: int = 0) -> SubwordModel:
    """Embeddings and softmax by accelerated gradient steps on the log loss, both labels weighing the same.

    All embeddings start at nothing and rows of the table are shrunk as wholes, so a bucket speaks only
    if many texts ask for it. With no rows, or rows of one label, the bias alone tells the label's share.
    """
    random = np.random.default_rng(seed)
    weights = random.normal(size=(2, DIMENSIONS))
    weights /= np.linalg.norm(weights[1] - weights[0])
    share = float(labels.mean()) if len(labels) else 0.5
    if not 0 < share < 1:
        odds = (share * len(labels) + 0.5) / ((1 - share) * len(labels) + 0.5)
        return SubwordModel(np.zeros(0, np.int64), np.zeros((0, DIMENSIONS)), weights, np.array([0.0, np.log(odds)]))
    text, bucket, value = features(texts)
    # What one text alone holds teaches nothing about others.
    common = np.bincount(bucket, minlength=1 << BITS) >= 2
    kept = common[bucket]
    buckets = np.flatnonzero(common)
    text, value = text[kept], value[kept]
    column = (np.cumsum(common) - 1).astype(np.int32)[bucket[kept]]
    importance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / len(labels)
    step = 1 / _curvature(text, column, value, importance / 4, len(buckets))
    embeddings, bias, limit = np.zeros((len(buckets), DIMENSIONS)), np.zeros(2), 0.0
    for k in range(rounds):
        margin = np.bincount(text, value * (embeddings @ (weights[1] - weights[0]))[column], len(texts)) + (bias[1] - bias[0])
        wrong = (1 / (1 + np.exp(-margin)) - labels) * importance
        asked = np.abs(np.bincount(column, value * wrong[text], len(buckets)))
        limit = limit or SHRINKAGE * float(asked.max(initial=0))
        # Between two looks at all buckets, steps touch those that speak, or that enough texts ask for.
        active = embeddings.any(axis=1) | (asked > limit)
        taken = active[column]
        t, c, v = text[taken].astype(np.int64), (np.cumsum(active) - 1)[column[taken]], value[taken].astype(np.float64)
        now = ahead = embeddings[active]
        momentum = 1.0
        for _ in range(passes):
            direction = weights[1] - weights[0]
            margin = np.bincount(t, v * (ahead @ direction)[c], len(texts)) + (bias[1] - bias[0])
            wrong = (1 / (1 + np.exp(-margin)) - labels) * importance
            asked = np.bincount(c, v * wrong[t], len(now))
            moved = ahead - step * asked[:, None] * direction
            size = np.linalg.norm(moved, axis=1, keepdims=True)
            moved *= np.maximum(0, 1 - step * limit / np.maximum(size, 1e-12))
            # The softmax rows learn from the sums of the embeddings, with opposite signs, and are kept at one length.
            turn = asked @ ahead
            weights = weights - 0.1 * np.stack([-turn, turn])
            weights /= np.linalg.norm(weights[1] - weights[0])
            after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
            ahead = moved + (momentum - 1) / after * (moved - now)
            now, momentum = moved, after
            bias = bias + np.array([1.0, -1.0]) * wrong.sum()
        embeddings[active] = now
    spoken = np.abs(embeddings).any(axis=1)
    return SubwordModel(buckets[spoken], embeddings[spoken], weights, bias)


def fit_subwords(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE
) -> SubwordModel:
    """Trained on at most ``sample`` rows of ``labels`` (id, 0/1), those with the smallest hashes.

    Null labels and ids, ids without a text and texts beyond LONGEST are left out; where an id has several
    texts, the smallest counts. The sample and its characters are bounded, so the driver can hold them.
    """
    ids = F.col(id_col).cast("long").alias("id")
    rows = labels.select(ids, F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").dropDuplicates(["id"])
    drawn = {y: [r["id"] for r in rows.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(sample).collect()] for y in (0, 1)}
    ones = drawn[1][: max(sample // 2, sample - len(drawn[0]))]
    chosen = [(i, 1) for i in ones] + [(i, 0) for i in drawn[0][: sample - len(ones)]]
    known = docs.sparkSession.createDataFrame(chosen, "id long, label int")
    texts = docs.select(ids, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.char_length("text") <= LONGEST)
    found = texts.join(F.broadcast(known), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    so_far = F.sum(F.char_length("text")).over(Window.orderBy(F.xxhash64("id"), "id"))
    learned = sorted((r["id"], r["label"], r["text"]) for r in found.withColumn("_n", so_far).where(F.col("_n") <= SAMPLE_CHARS).collect())
    return train([t for _, _, t in learned], np.array([y for _, y, _ in learned], np.float64))


def score_toxicity(docs: DataFrame, model: SubwordModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``score`` (0 to 1) and ``predicted`` (1 from THRESHOLD on).

    Texts are judged whole. A null text is an empty one, and a text without words has the score of the
    bias; repeated rows are scored each; a null id is kept; an empty table gives no rows; further columns
    are ignored. No rows are shuffled; the model's size doesn't depend on the corpus.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = SubwordModel.__new__(SubwordModel)
        judge.table, judge.bias = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                s = judge.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["id", "score", "predicted"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(score, "id long, score double, predicted int").withColumnRenamed("id", id_col)
