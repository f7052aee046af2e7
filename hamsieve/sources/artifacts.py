"""Saved models, run parameters, training history, the registry and the prediction history."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hamsieve.operators.features import TfidfModel
from hamsieve.operators.language import LanguageProfile
from hamsieve.operators.metrics import HISTORY_COLUMNS
from hamsieve.operators.models import LinearModel, NaiveBayes
from hamsieve.sources.log import append_entry, commit_batch, last_entry, read_committed, read_log


HISTORY_SCHEMA = ", ".join(f"{c} {'int' if c == 'epoch' else 'double'}" for c in HISTORY_COLUMNS)


def save_models(
    spark: SparkSession,
    path: str,
    tfidf: TfidfModel,
    models: Mapping[str, LinearModel],
    profile: str = "corpus",
) -> None:
    """The vectoriser and each model as tables of terms below ``path``; saved ones are replaced.

    Stored with them: the cleaning profile of the training text, and the priors and likelihoods of naive Bayes.
    """
    terms = tfidf.table(spark)
    terms.coalesce(1).write.mode("overwrite").parquet(f"{path}/vectorizer")
    about = [(profile, name) for name in models]
    spark.createDataFrame(about, "profile string, model string").coalesce(1).write.mode("overwrite").json(f"{path}/about")
    for name, model in models.items():
        # Null for the row of the intercept, where the priors stand.
        names = [None, *tfidf.vocabulary]
        weights = [model.intercept, *model.weights]
        theta = ([model.prior[c], *model.theta[c]] for c in (0, 1)) if isinstance(model, NaiveBayes) else ([None] * len(names),) * 2
        rows = list(zip(names, map(float, weights), *theta))
        table = spark.createDataFrame(rows, "term string, weight double, class_0 double, class_1 double")
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def saved_profile(spark: SparkSession, path: str) -> str:
    """The cleaning profile that the models below ``path`` were fitted on."""
    return spark.read.schema("profile string, model string").json(f"{path}/about").first()["profile"]


def load_models(
    spark: SparkSession, path: str, *names: str
) -> tuple[TfidfModel, dict[str, LinearModel]]:
    """Term ids are given anew on loading; weights follow their terms. The intercept has no term."""
    rows = spark.read.parquet(f"{path}/vectorizer").select("term", "idf").collect()
    tfidf = TfidfModel.of(spark, [(r["term"], r["idf"]) for r in rows])
    models = {}
    for name in names:
        saved = {r["term"]: r for r in spark.read.parquet(f"{path}/{name}").collect()}
        if saved[None]["class_0"] is None:
            models[name] = LinearModel(saved[None]["weight"], tuple(saved[t]["weight"] for t in tfidf.vocabulary))
        else:
            theta = [tuple(saved[t][c] for t in tfidf.vocabulary) for c in ("class_0", "class_1")]
            models[name] = NaiveBayes((saved[None]["class_0"], saved[None]["class_1"]), *theta)
    return tfidf, models


def save_language(spark: SparkSession, path: str, profile: LanguageProfile) -> None:
    profile.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/grams")
    spark.createDataFrame([(list(profile.langs),)], "langs array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/langs")


def load_language(spark: SparkSession, path: str) -> LanguageProfile:
    langs = spark.read.schema("langs array<string>").json(f"{path}/langs").first()["langs"]
    return LanguageProfile.of(tuple(langs), spark.read.parquet(f"{path}/grams"))


def save_ml(model: LogisticRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_ml(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(path)


def save_params(spark: SparkSession, path: str, run_id: str, params: Mapping[str, object]) -> None:
    """Append one JSON row of run parameters."""
    row = {"run_id": run_id, **params}
    spark.createDataFrame([row]).coalesce(1).write.mode("append").json(path)


def save_history(history: DataFrame, path: str) -> None:
    """Training history as CSV with a header, epochs in order. A run has few rows."""
    history.select(*HISTORY_COLUMNS).coalesce(1).sortWithinPartitions("epoch").write.mode(
        "overwrite"
    ).csv(path, header=True)


def append_predictions(scored: DataFrame, path: str, writer: str = "batch", batch: int | str | None = None) -> bool:
    """Append predictions to the history at ``path``, beside whatever streams and jobs append to it.

    A job that may run again names its ``batch``, and is counted once; without a name each call is one.
    """
    return commit_batch(scored, path, writer, uuid.uuid4().hex if batch is None else batch)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """All predictions of the history, each once."""
    return read_committed(spark, path)


_VERSION = "run_id string, f1 double"


def publish_model(spark: SparkSession, path: str, run_id: str, f1: float, seen: int | None = None) -> int:
    """Publish a run's model in the registry at ``path``; returns its version.

    Versions are numbered without a gap, and two runs never get the same: a run that finds its number taken
    takes the next. ``seen`` is the last version that the run knows of.
    """
    after = last_entry(spark, path) if seen is None else seen
    while not append_entry(spark, path, {"run_id": run_id, "f1": f1}, after):
        after += 1
    return after + 1


def model_versions(spark: SparkSession, path: str) -> DataFrame:
    """``version, run_id, f1`` of all published models."""
    return read_log(spark, path, _VERSION)


def registered_models(spark: SparkSession, path: str) -> DataFrame:
    """``run_id, alias, f1``: the newest version as ``latest``, and the first of those with the highest F1 above 0 as ``best``."""
    versions = model_versions(spark, path)
    model = F.struct("run_id", "f1")
    both = versions.agg(
        F.max_by(model, "version").alias("latest"),
        F.max_by(model, F.when(F.col("f1") > 0, F.struct("f1", -F.col("version")))).alias("best"),
    )
    each = F.inline(F.array(*(F.struct(F.lit(a).alias("alias"), F.col(a).alias("m")) for a in ("latest", "best"))))
    return both.select(each).where("m IS NOT NULL").select("m.run_id", "alias", "m.f1")


def resolve_model(registry: DataFrame, *by: str) -> DataFrame:
    """The model to use: the one called ``best``, else the newest ``latest``; one row per ``by``.

    An empty registry gives no row: use ``require_model`` where that is an error.
    """
    preference = F.struct((F.col("alias") == "best").alias("is_best"), F.col("run_id"))
    chosen = F.max_by(F.struct("run_id", "alias", "f1"), preference).alias("m")
    return (
        registry.where(F.col("alias").isin("best", "latest"))
        .groupBy(*by)
        .agg(chosen)
        .where(F.col("m").isNotNull())
        .select(*by, "m.run_id", "m.alias", "m.f1")
    )


def require_model(registry: DataFrame) -> tuple[str, str]:
    """Run and alias of the model to use; raises where there is none."""
    row = resolve_model(registry).first()
    if row is None:
        raise FileNotFoundError("no model is registered: train one first")
    return row["run_id"], row["alias"]
