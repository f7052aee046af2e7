"""Classifiers: naive Bayes by aggregation, logistic regression and a dense head by Spark ML.

Both text models are linear in the features, so one scorer serves both: an intercept and a weight
per term, applied inside the row.
"""

from __future__ import annotations

import itertools
import math
import uuid
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hamsieve.functions import fixed
from hamsieve.functions.let import let
from hamsieve.functions.rows import struct_rows
from hamsieve.operators.features import sparse_entries


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``label, mails, weight``: balanced weights n / (classes x mails of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("mails"))
    totals = counts.agg(
        F.sum("mails").cast("double").alias("n"), F.count(F.lit(1)).alias("k")
    )
    n, k = totals.select("n").scalar(), totals.select("k").scalar()
    return counts.withColumn("weight", n / (k * F.col("mails")))


# --- naive Bayes -------------------------------------------------------------------------------


def class_term_sums(df: DataFrame, label: str = "label", vector: str = "features") -> DataFrame:
    """``label, term_id, total``: summed feature weight per class and term."""
    return (
        struct_rows(df, [label], sparse_entries(vector), "term_id")
        .groupBy(label, "term_id")
        .agg(F.sum("weight").alias("total"))
    )


def fit_naive_bayes(
    df: DataFrame,
    vocab_size: int,
    label: str = "label",
    vector: str = "features",
    alpha: float = fixed.NB_ALPHA,
) -> "NaiveBayes":
    """Multinomial naive Bayes on real-valued features; additive smoothing of terms, not of priors.

    What reaches the driver is 2 x vocabulary numbers.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # Three rows tell whether there are more than two classes; a wrong column is not collected.
    priors = {r[label]: r["n"] for r in counts.limit(3).collect()}
    if not priors or set(priors) - {0, 1}:
        raise ValueError(f"labels must be 0 and 1, found {sorted(priors)}")
    sums = {c: [0.0] * vocab_size for c in (0, 1)}
    for r in class_term_sums(df, label, vector).collect():
        sums[r[label]][r["term_id"]] = r["total"]
    n = sum(priors.values())
    theta, prior = {}, {}
    for c in (0, 1):
        whole = math.fsum(sums[c]) + alpha * vocab_size
        theta[c] = tuple(math.log((x + alpha) / whole) for x in sums[c])
        prior[c] = math.log(priors[c] / n) if priors.get(c) else -math.inf
    return NaiveBayes((prior[0], prior[1]), theta[0], theta[1])


@dataclass(frozen=True)
class LinearModel:
    """Spam log-odds = intercept + sum of weight x feature."""

    intercept: float
    weights: tuple[float, ...]

    def with_margin(self, df: DataFrame, vector: str = "features", out: str = "margin") -> DataFrame:
        """Add the spam log-odds. Narrow: the weights travel with the tasks, not in the plan."""
        if math.isinf(self.intercept):
            return df.withColumn(out, F.lit(self.intercept))
        product = ElementwiseProduct(
            scalingVec=Vectors.dense(self.weights), inputCol=vector, outputCol="_product"
        )
        values = F.unwrap_udt(F.col("_product"))["values"]
        dot = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
        return product.transform(df).withColumn(out, dot + F.lit(self.intercept)).drop("_product")

    def score(self, df: DataFrame, vector: str = "features") -> DataFrame:
        """Add ``spam_prob``. Narrow."""
        prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_margin")))
        scored = self.with_margin(df, vector, "_margin")
        return scored.withColumn("spam_prob", prob).drop("_margin")

    def contributions(self, df: DataFrame, model, id_col: str = "id", vector: str = "features") -> DataFrame:
        """``id, term, contribution``: what each term adds to the spam log-odds."""
        rows = [(i, t, w) for i, (t, w) in enumerate(zip(model.vocabulary, self.weights))]
        table = df.sparkSession.createDataFrame(rows, "term_id int, term string, w double")
        return (
            struct_rows(df, [id_col], sparse_entries(vector), "term_id")
            .join(F.broadcast(table), "term_id")  # one row per vocabulary term
            .select(id_col, "term", (F.col("weight") * F.col("w")).alias("contribution"))
        )

    def table(self, spark: SparkSession) -> DataFrame:
        """``term_id, weight``; the intercept is row -1."""
        rows = [(-1, float(self.intercept))] + list(enumerate(map(float, self.weights)))
        return spark.createDataFrame(rows, "term_id int, weight double")


class NaiveBayes(LinearModel):
    """A linear model that also keeps its log priors and log likelihoods."""

    def __init__(self, prior, theta0, theta1):
        super().__init__(prior[1] - prior[0], tuple(b - a for a, b in zip(theta0, theta1)))
        object.__setattr__(self, "prior", prior)
        object.__setattr__(self, "theta", (theta0, theta1))

    def theta_table(self, spark: SparkSession, vocabulary) -> DataFrame:
        """``label, term, log_likelihood, log_prior``."""
        rows = [
            (c, t, w, self.prior[c])
            for c in (0, 1)
            for t, w in zip(vocabulary, self.theta[c])
        ]
        return spark.createDataFrame(
            rows, "label int, term string, log_likelihood double, log_prior double"
        )


# --- logistic regression -----------------------------------------------------------------------


def fit_logistic(
    df: DataFrame,
    vocab_size: int,
    label: str = "label",
    vector: str = "features",
    c: float = fixed.LR_C,
    max_iter: int = fixed.LR_MAX_ITER,
    tol: float = 1e-10,
) -> LinearModel:
    """Balanced, L2-regularised logistic regression by Spark ML; the intercept is not penalised.

    Minimises C x weighted log loss + |w|^2 / 2: balanced weights add up to the number of mails, by which
    Spark ML divides the loss, so its penalty is 1 / (C x mails). Warns if ``max_iter`` ends the fit.
    """
    # Three rows tell whether there are two classes; a wrong column is not collected.
    stats = {r[label]: r["mails"] for r in class_weights(df, label).limit(3).collect()}
    if set(stats) != {0, 1}:
        raise ValueError(f"two classes 0 and 1 are needed, found {sorted(stats)}")
    n = sum(stats.values())
    weight = F.when(F.col(label) == 1, n / (2 * stats[1])).otherwise(n / (2 * stats[0]))
    train = df.select(F.col(label).cast("double").alias("_y"), F.col(vector).alias("_x"), weight.alias("_w"))
    model = LogisticRegression(
        featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1.0 / (c * n), elasticNetParam=0.0,
        standardization=False, maxIter=max_iter, tol=tol,
    ).fit(train)
    if model.summary.totalIterations >= max_iter:
        warnings.warn(f"logistic regression stopped after {max_iter} passes before it converged", stacklevel=2)
    return LinearModel(float(model.intercept), tuple(map(float, model.coefficients.toArray())))


def logistic_gradient(
    df: DataFrame, model: LinearModel, label: str = "label", vector: str = "features", c: float = fixed.LR_C
) -> DataFrame:
    """``term_id, gradient`` of that loss at ``model``, by one aggregation; the intercept is -1.

    At the optimum all are zero. Terms without any occurrence in ``df`` are left out.
    """
    counts = F.broadcast(class_weights(df, label).select(label, F.col("weight").alias("_w")))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_m")))
    residual = F.lit(c) * F.col("_w") * (p - F.col(label))
    scored = model.with_margin(df.join(counts, label), vector, "_m").withColumn("_r", residual)
    entries = F.concat(
        F.transform(
            sparse_entries(vector),
            lambda e: F.struct(e["term_id"].alias("term_id"), (e["weight"] * F.col("_r")).alias("g")),
        ),
        F.array(F.struct(F.lit(-1).alias("term_id"), F.col("_r").alias("g"))),
    )
    sums = struct_rows(scored, [], entries, "term_id").groupBy("term_id").agg(F.sum("g").alias("g"))
    penalty = F.when(F.col("term_id") >= 0, F.col("weight")).otherwise(0.0)
    return sums.join(F.broadcast(model.table(df.sparkSession)), "term_id").select(
        "term_id", (F.col("g") + penalty).alias("gradient")
    )


def fit_dense_head(
    df: DataFrame, embedding: str = "embedding", label: str = "label", reg: float = 1e-3,
    max_iter: int = 100,
) -> LogisticRegressionModel:
    """Softmax classifier over dense vectors: the last layer of an encoder."""
    data = df.select(
        array_to_vector(F.col(embedding).cast("array<double>")).alias("features"),
        F.col(label).cast("double").alias("label"),
    )
    return LogisticRegression(
        family="multinomial", regParam=reg, standardization=False, maxIter=max_iter, tol=1e-8
    ).fit(data)


def dense_logits(df: DataFrame, model: LogisticRegressionModel, embedding: str = "embedding") -> DataFrame:
    """Add ``logits array<double>``."""
    features = df.withColumn("features", array_to_vector(F.col(embedding).cast("array<double>")))
    scored = model.setRawPredictionCol("_raw").transform(features)
    extra = [c for c in ("features", "_raw", "probability", "prediction") if c not in df.columns]
    return scored.withColumn("logits", vector_to_array("_raw")).drop(*extra)


# --- class probabilities and decisions ---------------------------------------------------------


def softmax(logits: Column) -> Column:
    """Class probabilities of an array of logits."""

    def shifted(z: Column) -> Column:
        return let(
            F.transform(z, lambda x: F.exp(x - F.array_max(z))),
            lambda e: let(
                F.aggregate(e, F.lit(0.0), lambda a, x: a + x),
                lambda total: F.transform(e, lambda x: x / total),
            ),
        )

    return let(logits, shifted)


def argmax(values: Column) -> Column:
    """Place of the largest entry from 0; the first of equals."""
    return let(values, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def decide(df: DataFrame, threshold: float = fixed.THRESHOLD, prob: str = "spam_prob") -> DataFrame:
    """Add ``prediction`` and ``confidence``; spam from the threshold upwards."""
    p = F.col(prob)
    spam = p >= F.lit(threshold)
    return df.withColumn("prediction", F.when(spam, "spam").otherwise("ham")).withColumn(
        "confidence", F.when(spam, p).otherwise(1.0 - p)
    )


def predicted_class(prob: str = "spam_prob") -> Column:
    """1 where spam is more probable than ham; a tie is ham, as in a first-of-equals argmax."""
    return (F.col(prob) > 0.5).cast("int")


# --- scorers that live as long as a worker ---------------------------------------------------------

TextScorer = Callable[[list[str]], "list[list[float]]"]

_loaded: dict[str, object] = {}


class PerWorker:
    """A factory whose product is made once per Python worker: workers outlive tasks, and so does what they load.

    One ``PerWorker`` may serve many queries. A worker keeps the few products it has met last.
    """

    def __init__(self, make: Callable[[], object]):
        self.make, self.key = make, uuid.uuid4().hex

    def get(self) -> object:
        if self.key not in _loaded:
            while len(_loaded) >= 4:
                _loaded.pop(next(iter(_loaded)))
            _loaded[self.key] = self.make()
        return _loaded[self.key]


def per_worker(factory: "Callable[[], object] | PerWorker") -> PerWorker:
    return factory if isinstance(factory, PerWorker) else PerWorker(factory)


def score_with(df: DataFrame, factory: Callable[[], TextScorer] | PerWorker, text: str = "text") -> DataFrame:
    """Add ``spam_prob`` from a function of texts to rows (ham, spam), which ``factory`` loads once per worker."""
    schema = T.StructType(df.schema.fields + [T.StructField("spam_prob", T.DoubleType())])
    model = per_worker(factory)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = model.get()
        for pdf in batches:
            if len(pdf):
                probs = scorer(pdf[text].fillna("").tolist())
                yield pdf.assign(spam_prob=[float(p[1]) for p in probs])

    return df.mapInPandas(run, schema)


class LinearNeighbours:
    """Scores all neighbours of a mail by a linear model over TF-IDF, as one product of counts and weights."""

    def __init__(self, vocabulary: tuple[str, ...], idf: tuple[float, ...], weights: tuple[float, ...], intercept: float):
        self.idf, self.weights, self.intercept = np.array(idf), np.array(weights), intercept
        parts = [t.split(" ") for t in vocabulary]
        self.token = {w: k for k, w in enumerate(dict.fromkeys(itertools.chain.from_iterable(parts)))}
        self.single = np.full(len(self.token) + 1, -1)
        pairs = []
        for term, part in enumerate(parts):
            if len(part) == 1:
                self.single[self.token[part[0]]] = term
            else:
                pairs.append((self.token[part[0]], self.token[part[1]], term))
        first, second, term = np.array(sorted(pairs), np.int64).reshape(-1, 3).T
        self.first, self.second, self.term = first, second, term
        self.term_weight, self.term_square = self.weights * self.idf, self.idf**2

    def score_neighbours(self, mail) -> np.ndarray:
        """Spam probability of each sample. Counts of terms that the samples hold, never a text."""
        unknown = len(self.token)
        flat = np.array([self.token.get(t, unknown) for t in mail.flat_tokens], np.int64)
        sizes = mail.token_counts
        starts = np.cumsum(sizes) - sizes
        n = sizes[mail.order]
        at = np.repeat(starts[mail.order] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        token, word = flat[at], np.repeat(mail.order, n)
        local, token, times = np.unique(token, return_inverse=True, return_counts=True)
        total, square = self._singles(mail, flat)
        # The model's pairs of tokens that the mail has.
        own = np.full(unknown + 1, -1)
        own[local] = np.arange(len(local))
        own[unknown] = -1
        lows, highs = (np.searchsorted(self.first, local, side) for side in ("left", "right"))
        spans = highs - lows
        pair = np.repeat(lows - (np.cumsum(spans) - spans), spans) + np.arange(int(spans.sum()))
        pair = pair[own[self.second[pair]] >= 0]
        if len(pair):
            first, second, term = own[self.first[pair]], own[self.second[pair]], self.term[pair]
            # Every sample ends with a token of its own, which no pair has.
            size, width = len(local) + 1, len(token) + 1
            find = _places(first * size + second, size)
            # A pair is in a sample once at most, unless both of its tokens come again.
            again = (times[first] > 1) & (times[second] > 1)
            pair_weight, pair_square = self.term_weight[term], self.term_square[term]
            step = max(1, min(len(mail.masks), _CELLS // width))
            kind = np.int32 if max(size * size, step * len(pair)) < 2**31 else np.int64
            tile, place = np.tile(np.append(token, len(local)).astype(kind), step), np.append(word, len(sizes))
            for s in range(0, len(mail.masks), step):
                held = mail.held[s : s + step, place]
                at = np.flatnonzero(held)
                kept = tile.take(at)
                code = kept[:-1] * kind(size)
                code += kept[1:]
                found = find(code)
                hit = np.flatnonzero(found >= 0)
                found, at = found.take(hit).astype(np.intp), at.take(hit)
                begin = np.searchsorted(at, np.arange(len(held) + 1) * width)
                hits = begin[1:] - begin[:-1]
                some = np.flatnonzero(hits)
                if not len(some):
                    continue
                total[s + some] += np.add.reduceat(pair_weight.take(found), begin[some])
                square[s + some] += np.add.reduceat(pair_square.take(found), begin[some])
                # n equal pairs count n x n times, of which n are added.
                more = np.flatnonzero(again.take(found))
                code = np.repeat(np.arange(len(held), dtype=kind) * kind(len(pair)), hits).take(more)
                code += found.take(more).astype(kind)
                code.sort()
                code = code[1:][code[1:] == code[:-1]]
                if len(code):
                    code, n = np.unique(code, return_counts=True)
                    row, column = np.divmod(code, kind(len(pair)))
                    square[s : s + len(held)] += np.bincount(row, n * (n + 1) * pair_square[column], len(held))
        margin = self.intercept + total / np.where(square > 0, np.sqrt(square), 1.0)
        return 1.0 / (1.0 + np.exp(-margin))

    def _singles(self, mail, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the single terms add to the samples' sums of weights and of squares.

        A term counts what its words' samples keep: ``amount`` times per ``source`` word, in the order of terms.
        """
        sizes = mail.token_counts
        which = self.single[flat]
        source = np.repeat(np.arange(len(sizes)), sizes)[which >= 0]
        code, amount = np.unique(which[which >= 0] * len(sizes) + source, return_counts=True)
        term, source = code // max(len(sizes), 1), code % max(len(sizes), 1)
        amount = amount * np.bincount(mail.order, minlength=len(sizes))[source]
        # Squares of terms of one word are sums over words, too.
        lone = (np.diff(term, prepend=-1) > 0) & (np.diff(term, append=len(self.term_square)) > 0)
        weight, squares = amount * self.term_weight[term], amount * amount * self.term_square[term] * lone
        sums = np.stack([np.bincount(source, v, len(sizes)) for v in (weight, squares)], 1)
        both = np.zeros((len(mail.masks), 2))
        step = max(1, _CELLS // max(len(sizes), 1))
        for s in range(0, len(both), step):
            both[s : s + step] = mail.masks[s : s + step].astype(float) @ sums
        term, source, amount = term[~lone], source[~lone], amount[~lone].astype(float)
        begin = np.flatnonzero(np.diff(term, prepend=-1))
        step = max(1, _CELLS // max(len(source), 1))
        for s in range(0, len(both) if len(term) else 0, step):
            counts = np.add.reduceat(mail.masks[s : s + step, source] * amount, begin, axis=1)
            both[s : s + step, 1] += (counts * counts) @ self.term_square[term[begin]]
        return both[:, 0], both[:, 1]


#: Tokens of samples that are worked on at once.
_CELLS = 250_000
#: Entries of a table of pairs of tokens (64 MB).
_TABLE = 16_000_000


def _places(codes: np.ndarray, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function from pairs of ``n`` tokens to their places in ``codes``, or -1: by a table, or by search if that were large."""
    if n * n <= _TABLE:
        table = np.full(n * n, -1, np.int16 if len(codes) < 2**15 else np.int32)
        table[codes] = np.arange(len(codes))
        return table.take
    order = np.argsort(codes)
    ordered = codes[order]

    def search(pairs: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(ordered, pairs), len(codes) - 1)
        return np.where(ordered[at] == pairs, order[at], -1)

    return search
