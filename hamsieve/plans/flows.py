"""Raw mails to a split corpus, a split corpus to fitted models, models to scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hamsieve.functions import fixed
from hamsieve.functions.text import clean, plain_text
from hamsieve.operators.corpus import exact_split, first_accepted, sample_n, union_corpora, with_label
from hamsieve.operators.features import TfidfModel, terms
from hamsieve.operators.gates import reject_reason, with_clean_mail
from hamsieve.operators.language import LanguageProfile
from hamsieve.operators.mime import corpus_mails, parse_mails, serve_mails
from hamsieve.operators.models import (
    LinearModel,
    LinearNeighbours,
    PerWorker,
    decide,
    fit_logistic,
    fit_naive_bayes,
)
from hamsieve.sources.artifacts import load_models, save_models, saved_profile
from hamsieve.sources.corpus import read_mail_files_for_scoring, read_split, write_splits
from hamsieve.sources.scratch import materialize


def with_full_text(df: DataFrame) -> DataFrame:
    return df.withColumn("full_text", plain_text(F.col("subject"), F.col("body")))


def judge_mails(mails: DataFrame) -> DataFrame:
    """Clean ``subject, body`` and add ``reason`` by the native gates; stored.

    Stored before anything filters on ``reason``: a filter is pushed below the projection it reads,
    and would carry a copy of the whole cleaning chain for each mention of a text. Afterwards
    ``reason`` is a pushed-down predicate. The joined text is cheap to rebuild and is not stored.
    """
    s, b, t = F.col("subject"), F.col("body"), F.col("full_text")
    reason = reject_reason(s, b, t)
    if "parse_error" in mails.columns:
        # An unreadable mail has empty texts; it is counted as what it is.
        reason = F.when(F.col("parse_error"), "parse_error").otherwise(reason)
    judged = with_clean_mail(mails).withColumn("reason", reason)
    return materialize(judged.drop("full_text", "parse_error"), "judged")


def judge_language(judged: DataFrame, profile: LanguageProfile) -> DataFrame:
    """Add ``detected``, and give mails that passed the other gates ``language`` as reason unless English.

    Inside the row: no text moves.
    """
    english = F.col("detected").eqNullSafe(F.lit("en"))
    reason = F.when((F.col("reason") == "accepted") & ~english, "language").otherwise(
        F.col("reason")
    )
    return profile.detect(with_full_text(judged)).drop("full_text").withColumn("reason", reason)


def accepted_english(judged: DataFrame, profile: LanguageProfile) -> DataFrame:
    """Accepted mails in English. Language, the costly gate, sees only what passed the others.

    Store the result before it is read twice.
    """
    return accepted(judge_language(accepted(judged), profile)).drop("detected", "reason")


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("reason") == "accepted")


def build_corpus(
    raw: DataFrame,
    id_col: str = "id",
    message: str = "message",
    profile: LanguageProfile | None = None,
) -> DataFrame:
    """Raw mails with ``id, label`` to cleaned, accepted and split ones: ``id, subject, body, label, split``."""
    judged = judge_mails(
        corpus_mails(parse_mails(raw, message)).withColumn("label", F.col("label").cast("int"))
    )
    kept = accepted(judged) if profile is None else materialize(accepted_english(judged, profile), "english")
    return exact_split(kept.select(id_col, "subject", "body", "label"), id_col)


def prepare_corpus(
    ham: DataFrame, spam: DataFrame, profile: LanguageProfile, path: str, size: int = fixed.SAMPLE_SIZE
) -> DataFrame:
    """Two mail corpora to one split table below ``path``: the first job of a training run.

    ``ham`` and ``spam``: ``id, message`` and perhaps ``latin1``, as the readers give them. At most
    ``size`` mails of each pass: of ham the first that pass all gates (no more is judged than it takes), of spam a
    sample of those that do.
    Ids must not clash.
    """

    def judged(mails: DataFrame, label: int) -> DataFrame:
        read = corpus_mails(parse_mails(mails))
        return with_label(accepted_english(judge_mails(read), profile).select("id", "subject", "body"), label)

    both = union_corpora(first_accepted(ham, size, lambda mails: judged(mails, 0)), sample_n(judged(spam, 1), size))
    write_splits(exact_split(materialize(both, "prepared")), path)
    return read_split(ham.sparkSession, path)


@dataclass(frozen=True)
class Baselines:
    """A fitted vectoriser and the models over it, with the cleaning profile they were fitted on."""

    tfidf: TfidfModel
    models: dict[str, LinearModel]
    profile: str = "corpus"

    def features(self, mails: DataFrame) -> DataFrame:
        """Add ``features`` to cleaned ``subject, body``."""
        text = plain_text(F.col("subject"), F.col("body"))
        return self.tfidf.transform(mails.withColumn("terms", terms(text))).drop("terms")

    def scorer(self, name: str = "naive_bayes") -> Callable[[DataFrame], DataFrame]:
        """A function that adds ``spam_prob`` to rows with ``text``, without further cleaning."""

        def run(df: DataFrame) -> DataFrame:
            vectors = self.tfidf.transform(df.withColumn("terms", terms(F.col("text"))))
            return self.models[name].score(vectors).drop("terms", "features")

        return run

    def neighbours(self, name: str = "naive_bayes") -> PerWorker:
        """A scorer for ``explain``: the vocabulary and weights are broadcast, and unpacked once per worker."""
        model = self.models[name]
        shared = SparkSession.active().sparkContext.broadcast((self.tfidf.vocabulary, self.tfidf.idf, model.weights, float(model.intercept)))
        return PerWorker(lambda: LinearNeighbours(*shared.value))

    def score(
        self,
        mails: DataFrame,
        name: str = "naive_bayes",
        threshold: float = fixed.THRESHOLD,
        profile: str | None = None,
    ) -> DataFrame:
        """Clean ``subject, body`` and add ``spam_prob, prediction, confidence``.

        The profile of the training text is the default: scoring text cleaned otherwise shifts
        every feature. ``serve`` stays selectable.
        """
        p = profile or self.profile
        cleaned = mails.withColumns(
            {"subject": clean(F.col("subject"), p), "body": clean(F.col("body"), p)}
        )
        scored = self.models[name].score(self.features(cleaned)).drop("features")
        return decide(scored, threshold)

    def score_raw(self, raw: DataFrame, message: str = "message", **options) -> DataFrame:
        """Parse raw mails as they are served, then ``score``."""
        return self.score(serve_mails(parse_mails(raw, message)), **options)

    def score_files(self, spark: SparkSession, path: str, **options) -> DataFrame:
        """Read the mail files below ``path`` and ``score_raw`` them; one row per file."""
        return self.score_raw(read_mail_files_for_scoring(spark, path), **options)

    def save(self, spark: SparkSession, path: str) -> None:
        save_models(spark, path, self.tfidf, self.models, self.profile)

    @classmethod
    def load(cls, spark: SparkSession, path: str, *names: str) -> "Baselines":
        return cls(*load_models(spark, path, *names), saved_profile(spark, path))


def vectors(train: DataFrame, **limits) -> tuple[TfidfModel, DataFrame]:
    """Fit TF-IDF on cleaned mails; return it with the training vectors.

    ``train`` should be a stored table: it is read for the count, the vocabulary and the vectors.
    Tokens are cut anew each time; stored, they would outweigh the text several times.
    """
    text = plain_text(F.col("subject"), F.col("body"))
    tokenized = train.withColumn("terms", terms(text)).drop("subject", "body")
    model = TfidfModel.fit(tokenized, **limits)
    return model, model.transform(tokenized).drop("terms")


def fit_baselines(train: DataFrame, which: tuple[str, ...] = ("naive_bayes",), **limits) -> Baselines:
    """Fit the named models (``naive_bayes``, ``logistic_regression``) on one set of features."""
    tfidf, data = vectors(train, **limits)
    models: dict[str, LinearModel] = {}
    for name in which:
        if name == "naive_bayes":
            models[name] = fit_naive_bayes(data, len(tfidf.vocabulary))
        elif name == "logistic_regression":
            models[name] = fit_logistic(data, len(tfidf.vocabulary))
        else:
            raise ValueError(f"unknown model {name!r}")
    return Baselines(tfidf, models)
