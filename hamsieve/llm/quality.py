"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are the shapes of its bytes in threes (lower case, capital, figure, each sign, white
space ...) and how often its words repeat those just before them; neither names a language or a
source. A bounded sample of labelled rows fixes the term weights and, by a truncated singular value
decomposition, the latent space. Their vectors are broadcast; each text is compared with all of them
by blocked exact cosine products, and the labels of the nearest vote by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hamsieve.llm.kernels import CHUNK, text_bytes, words

#: Labelled rows that the space is fitted on, at most: those with the smallest hash of their id.
SAMPLE = 3000
#: Dimensions of the latent space, neighbours that vote, and the power of the similarity as weight.
RANK = 32
NEIGHBOURS = 15
SHARPNESS = 8
#: Score from which a text counts as good.
THRESHOLD = 0.7
#: Texts per block of cosine products.
BLOCK = 512

_BUCKETS = 1536
_LAGS = 4


def _classes() -> np.ndarray:
    """Class of each byte: case, figure, each sign of its own, line end, other white space, beyond ASCII."""
    out = np.zeros(256, np.int64)
    next_class = 6
    for b in range(256):
        if 97 <= b <= 122:
            out[b] = 0
        elif 65 <= b <= 90:
            out[b] = 1
        elif 48 <= b <= 57:
            out[b] = 2
        elif b == 10:
            out[b] = 3
        elif b <= 32:
            out[b] = 4
        elif b >= 128:
            out[b] = 5
        else:
            out[b] = next_class
            next_class += 1
    return out


_CLASS = _classes()
_N = int(_CLASS.max()) + 1
#: Shapes of three hashed into a fixed number of terms.
_TERM = (np.arange(_N**3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % _BUCKETS
TERMS = _BUCKETS + _LAGS + 1


def term_rows(column: pa.Array) -> np.ndarray:
    """One row of term weights per text: square roots of shares, shapes and repeats weighing the same."""
    out = np.zeros((len(column), TERMS), np.float32)
    data, offsets = text_bytes(column)
    for row in range(len(column)):
        # A long text is counted in pieces; the shapes across a seam are counted by the overlap.
        for at in range(int(offsets[row]), int(offsets[row + 1]), CHUNK):
            c = _CLASS[data[at : min(at + CHUNK + 2, int(offsets[row + 1]))]]
            if len(c) > 2:
                out[row, :_BUCKETS] += np.bincount(_TERM[(c[:-2] * _N + c[1:-1]) * _N + c[2:]], minlength=_BUCKETS)
    for first, h, bounds in words(column):
        sizes = np.diff(bounds)
        place = np.arange(len(h)) - np.repeat(bounds[:-1], sizes)
        for lag in range(1, _LAGS + 1):
            same = np.zeros(len(h) + 1)
            if len(h) > lag:
                np.cumsum((h[lag:] == h[:-lag]) & (place[lag:] >= lag), out=same[lag + 1 :])
            out[first : first + len(sizes), _BUCKETS + lag - 1] = same[bounds[1:]] - same[bounds[:-1]]
        out[first : first + len(sizes), -1] = sizes
    for part in (slice(0, _BUCKETS), slice(_BUCKETS, TERMS)):
        total = out[:, part].sum(1, keepdims=True)
        out[:, part] = np.sqrt(out[:, part] / np.maximum(total, 1))
    return out


class NeighbourModel:
    """Term weights, basis and labelled vectors; small arrays of a size fixed by the parameters."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray, rank: int = RANK):
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        # Terms that stand in every text say less.
        self.weights = (np.log((1 + len(terms)) / (1 + (terms > 0).sum(0))) + 1).astype(np.float32)
        weighted = terms * self.weights
        if len(terms):
            values, vectors = np.linalg.eigh(weighted.T.astype(np.float64) @ weighted)
            top = np.argsort(values)[::-1][:rank]
            self.basis = vectors[:, top].astype(np.float32)
        else:
            self.basis = np.zeros((TERMS, 0), np.float32)
        self.vectors = self._unit(weighted @ self.basis)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def scores(self, terms: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 in the vote. A text without terms, or without neighbours, has the sample's share."""
        out = np.full(len(terms), self.prior)
        k = min(neighbours, len(self.labels))
        if not k:
            return out
        for at in range(0, len(terms), BLOCK):
            block = self._unit((terms[at : at + BLOCK] * self.weights) @ self.basis)
            cosine = block @ self.vectors.T
            near = np.argpartition(cosine, len(self.labels) - k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARPNESS
            total = weight.sum(1)
            voted = total > 1e-9
            out[at : at + BLOCK][voted] = ((weight * self.labels[near]).sum(1)[voted] / total[voted]).clip(0, 1)
        return out


def fit_neighbours(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> NeighbourModel:
    """Fit on at most ``sample`` rows of ``labels`` (id, 0/1). Null labels and ids, and ids without a text, are left out."""
    ids = F.col(id_col).cast("long").alias(id_col)
    chosen = (
        labels.select(ids, F.col(label_col).cast("int").alias("label"))
        .where(f"`{id_col}` IS NOT NULL AND label IN (0, 1)")
        .dropDuplicates([id_col])
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(sample)
    )
    texts = docs.select(ids, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), id_col)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = term_rows(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), batch.column("label"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "label", "terms"]
            )

    # One row a labelled id: repeated rows of documents do not vote twice.
    found: dict[int, tuple[int, bytes]] = {}
    for r in texts.mapInArrow(terms, "id long, label int, terms binary").dropDuplicates(["id"]).collect():
        found[r["id"]] = (r["label"], bytes(r["terms"]))
    rows = [found[i] for i in sorted(found)]
    matrix = np.stack([np.frombuffer(t, np.float32) for _, t in rows]) if rows else np.zeros((0, TERMS), np.float32)
    return NeighbourModel(matrix, np.array([y for y, _ in rows], np.float32))


def score_quality(docs: DataFrame, model: NeighbourModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``score`` (0 to 1) and ``predicted`` (1 from THRESHOLD on).

    Texts are judged whole. A null text is an empty one, and an empty one has the sample's share of
    label 1; repeated rows are scored each; a null id is kept; an empty table gives no rows; further
    columns are ignored. No rows are shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2 * BLOCK):
                part = batch.slice(at, 2 * BLOCK)
                s = shared.value.scores(term_rows(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[id_col, "score", "predicted"]
                )

    texts = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(score, f"`{id_col}` long, score double, predicted int")


def keep_good(docs: DataFrame, model: NeighbourModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns; see ``score_quality``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2 * BLOCK):
                part = batch.slice(start, 2 * BLOCK)
                s = shared.value.scores(term_rows(part.column(at).fill_null("")))
                yield part.filter(pa.array(s >= THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
