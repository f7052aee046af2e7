import hashlib
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from hamsieve.operators import explain as X
from hamsieve.operators import features as V
from hamsieve.operators import metrics as M
from hamsieve.operators import models as L
from hamsieve.plans.flows import Baselines, fit_baselines
from hamsieve.sources import artifacts
from hamsieve.sources.artifacts import read_predictions
from hamsieve.sources.scratch import materialize, scratch_path
from hamsieve.streaming.scoring import mail_stream, score_stream

TEXTS = [
    (0, "meeting notes", "please read the meeting notes before friday", 0),
    (1, "lunch plans", "lunch on friday with the team please", 0),
    (2, "win money", "win free money now click to win money", 1),
    (3, "free prize", "free money prize click now", 1),
    (4, "project", "the project meeting moved to friday", 0),
    (5, "notes", "team notes for the project", 0),
]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(TEXTS, "id long, subject string, body string, label int").cache()


@pytest.fixture(scope="module")
def fitted(train):
    return fit_baselines(train, ("naive_bayes", "logistic_regression"))


def dense(fitted, df):
    rows = fitted.features(df).orderBy("id").collect()
    return np.array([r["features"].toArray() for r in rows]), np.array([r["label"] for r in rows])


def test_tokens(spark):
    df = spark.createDataFrame([("É-an ab a cd_e 1",), ("one",), ("",), (None,)], "x string")
    got = [r[0] for r in df.select(V.terms(F.col("x"))).collect()]
    assert got == [["an", "ab", "cd_e", "an ab", "ab cd_e"], ["one"], [], []]


def test_tfidf(fitted, train):
    x, _ = dense(fitted, train)
    assert np.allclose(np.linalg.norm(x, axis=1), 1)
    counts = {}
    for _, s, b, _ in TEXTS:
        words = [w for w in f"{s} {b}".split() if len(w) > 1]
        for t in set(words + [f"{a} {c}" for a, c in zip(words, words[1:])]):
            counts[t] = counts.get(t, 0) + 1
    want = {t: math.log(7 / (1 + n)) + 1 for t, n in counts.items() if n >= 2}
    assert dict(zip(fitted.tfidf.vocabulary, fitted.tfidf.idf)) == pytest.approx(want)


def test_vocabulary_cut_breaks_ties_by_term(train):
    df = train.withColumn("terms", V.terms(F.col("body")))
    kept = [r["term"] for r in V.fit_vocabulary(df, max_features=3).collect()]
    stats = {r["term"]: (-r["total"], r["term"]) for r in V.term_stats(df).where("df >= 2").collect()}
    assert kept == sorted(stats, key=stats.get)[:3]


def test_naive_bayes(fitted, train):
    x, y = dense(fitted, train)
    nb = fitted.models["naive_bayes"]
    for c in (0, 1):
        s = x[y == c].sum(0) + 1
        assert np.allclose(nb.theta[c], np.log(s / s.sum()))
        assert nb.prior[c] == pytest.approx(math.log((y == c).mean()))
    got = [r["spam_prob"] for r in nb.score(fitted.features(train)).orderBy("id").collect()]
    jll = np.stack([x @ np.array(nb.theta[c]) + nb.prior[c] for c in (0, 1)])
    assert np.allclose(got, 1 / (1 + np.exp(jll[0] - jll[1])))


def test_logistic_gradient_vanishes(fitted, train):
    x, y = dense(fitted, train)
    m = fitted.models["logistic_regression"]
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    residual = w * (1 / (1 + np.exp(-(x @ np.array(m.weights) + m.intercept))) - y)
    assert abs(residual.sum()) < 2e-4
    assert np.abs(x.T @ residual + np.array(m.weights)).max() < 2e-4


def test_one_class_is_refused_by_logistic(fitted, train):
    with pytest.raises(ValueError):
        L.fit_logistic(fitted.features(train.where("label = 0")), len(fitted.tfidf.vocabulary))


def test_score_unknown_words(fitted, spark):
    new = spark.createDataFrame([(9, "", "zzz qqq"), (10, None, None)], "id long, subject string, body string")
    nb = fitted.models["naive_bayes"]
    for r in fitted.score(new).collect():
        assert r["spam_prob"] == pytest.approx(1 / (1 + math.exp(-nb.intercept)))


def test_save_and_load(spark, fitted, train, tmp_path):
    path = str(tmp_path / "m")
    artifacts.save_models(spark, path, fitted.tfidf, fitted.models)
    tfidf, models = artifacts.load_models(spark, path, "naive_bayes", "logistic_regression")
    again = Baselines(tfidf, models)
    for name in models:
        a = [r["spam_prob"] for r in fitted.score(train, name).orderBy("id").collect()]
        b = [r["spam_prob"] for r in again.score(train, name).orderBy("id").collect()]
        assert a == pytest.approx(b)


def test_softmax_and_argmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([1000.0, 0.0],)], "z array<double>")
    got = df.select(L.softmax(F.col("z")).alias("p")).select("p", L.argmax(F.col("p")).alias("k")).collect()
    assert [r["k"] for r in got] == [1, 0]
    assert all(sum(r["p"]) == pytest.approx(1) for r in got)


def test_decide_includes_the_threshold(spark):
    df = spark.createDataFrame([(0.5,), (0.4999,)], "spam_prob double")
    got = [(r["prediction"], round(r["confidence"], 4)) for r in L.decide(df).collect()]
    assert got == [("spam", 0.5), ("ham", 0.5001)]


def test_dense_head(spark):
    rows = [([float(c == k) + 0.01 * i for k in range(3)], c) for i in range(10) for c in range(3)]
    df = spark.createDataFrame(rows, "embedding array<float>, label int")
    model = L.fit_dense_head(df)
    scored = L.dense_logits(df, model).withColumn("p", L.softmax(F.col("logits")))
    assert scored.where(L.argmax(F.col("p")) != F.col("label")).count() == 0


def test_encode(spark):
    df = spark.createDataFrame(
        [(1, "a b", "c " * 20), (2, "", "")], "id long, subject string, body string"
    )
    from hamsieve.functions.text import model_text

    toks = df.withColumn("t", V.model_tokens(model_text(F.col("subject"), F.col("body"))))
    vocab = V.fit_token_vocabulary(toks, "t", size=9)
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    # placeholders are tokens too; two places are left after the reserved ones
    assert ids["c"] == 7 and len(ids) == 9
    got = {r["id"]: r for r in V.encode(toks, vocab, "t", max_length=12).collect()}
    assert got[1]["input_ids"] == [2, 5, ids.get("a", 1), ids.get("b", 1), 6] + [7] * 6 + [3]
    assert got[1]["attention_mask"] == [1] * 12
    assert got[2]["input_ids"][0] == 2 and sum(got[2]["attention_mask"]) == 6
    assert all(len(r["input_ids"]) == len(r["attention_mask"]) == 12 for r in got.values())


# --- metrics -----------------------------------------------------------------------------------


def test_metrics_of_all_ham_predictions(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, pred int")
    assert tuple(M.binary_metrics(df).first()) == (0.5, 0.0, 0.0, 0.0)
    assert [tuple(r) for r in M.confusion(df).orderBy("label").collect()] == [(0, 1, 0), (1, 1, 0)]


SCORES = [(1, 0.9), (1, 0.8), (0, 0.8), (1, 0.4), (0, 0.3), (0, 0.3)]


def test_roc(spark):
    df = spark.createDataFrame(SCORES, "label int, spam_prob double")
    curve = [tuple(r) for r in M.roc_curve(df).orderBy("fpr", "tpr").collect()]
    assert curve[0] == (None, 0.0, 0.0) and curve[-1] == (0.3, 1.0, 1.0)
    area = sum((b[1] - a[1]) * (a[2] + b[2]) / 2 for a, b in zip(curve, curve[1:]))
    assert area == pytest.approx(7.5 / 9) == M.roc_auc(df).first()["auc"]


def test_ranges_of_scores_that_crowd_at_both_ends(spark):
    rows = [(k % 2, 1e-9 * k if k % 3 else 1 - 1e-9 * k) for k in range(4000)] + [(1, 0.5), (0, 0.5)]
    df = spark.createDataFrame(rows, "label int, spam_prob double")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in M._points(df, "label", "spam_prob").groupBy("range").count().collect()]
        auc = M.roc_auc(df).first()["auc"]
        curve = [tuple(r)[1:] for r in M.roc_curve(df).orderBy("fpr", "tpr").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / len(sizes)
    positive, negative = ([p for y, p in rows if y == c] for c in (1, 0))
    wins = sum((a > b) + (a == b) / 2 for a in positive for b in negative)
    assert auc == pytest.approx(wins / len(positive) / len(negative))
    assert sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:])) == pytest.approx(auc)


def test_history(spark):
    runs = {
        "a": [0.5, 0.7, 0.7, 0.6, 0.65, 0.9],
        "b": [0.0, 0.0, 0.0, 0.0],
        "c": [0.1, 0.2, 0.3],
    }
    rows = [(r, e + 1, f) for r, fs in runs.items() for e, f in enumerate(fs)]
    df = spark.createDataFrame(rows, "run_id string, epoch int, f1 double")
    stops = {r["run_id"]: (r["best_epoch"], r["stop_epoch"]) for r in M.early_stop(df).collect()}
    assert stops == {"a": (2, 5), "b": (0, 3), "c": (3, None)}
    ran = df.where("run_id <> 'a' OR epoch <= 5")
    assert {r["run_id"]: r["epoch"] for r in M.best_epoch(ran).collect()} == {"a": 2, "c": 3}


def test_batched_loss(spark):
    df = spark.createDataFrame([(0, 1, 0.5), (0, 1, 0.25), (1, 1, 1.0)], "b int, label int, spam_prob double")
    got = M.batched_log_loss(df, F.col("b")).first()["log_loss"]
    assert got == pytest.approx((math.log(2) + math.log(4)) / 4)


# --- explanation -------------------------------------------------------------------------------


def test_lime_agrees_with_the_linear_model(spark, fitted):
    df = spark.createDataFrame(
        [(1, "[SUBJECT] money [BODY] free money for the friday meeting notes"), (2, "  ")], "id long, text string"
    )
    found = X.lime_explain(df, fitted.neighbours(), num_samples=300)
    top = X.top_features(found)
    sign = {r["feature"]: r["direction"] for r in top.collect()}
    assert sign["money"] == sign["free"] == "spam"
    assert sign["meeting"] == sign["friday"] == "ham"
    assert "the" not in sign and "SUBJECT" not in sign
    status = {r["id"]: r["status"] for r in X.explain_status(df, top).collect()}
    assert status == {1: "ok", 2: "empty_text"}


def test_ridge_systems_agree():
    rng = np.random.default_rng(0)
    for n, p in ((30, 8), (8, 30)):
        x, y, w = rng.normal(size=(n, p)), rng.normal(size=n), rng.uniform(0.1, 1, n)
        got = X._ridge(x, y, w, 1.0)
        xc, yc = x - (w @ x) / w.sum(), y - (w @ y) / w.sum()
        assert np.allclose(xc.T @ (w * (yc - xc @ got)), got)


def test_ridge_over_many_words_needs_few_columns_at_once():
    rng = np.random.default_rng(1)
    x, y, w = rng.integers(0, 2, (40, 3000), dtype=np.uint8), rng.normal(size=40), rng.uniform(0.1, 1, 40)
    got = X._ridge(x, y, w, 0.5)
    xc, yc = x - (w @ x) / w.sum(), y - (w @ y) / w.sum()
    assert np.allclose(xc.T @ (w * (yc - xc @ got)), 0.5 * got)


ODD_TEXT = "Win!!! now, re-read [BODY] it: Free free FREE money, İstanbul\u0301 a1 b x_y ½ 漢字 win NOW"


def rows_of(df, **options):
    return [mail for _, mail in X._each_mail(iter(X.neighbourhoods(df, **options).toArrow().to_batches()))]


def test_neighbours_keep_what_stands_between_words(spark):
    df = spark.createDataFrame([(1, ODD_TEXT)], "id long, text string")
    (mail,) = rows_of(df, num_samples=200)
    texts = list(mail.texts())
    assert texts[0] == ODD_TEXT
    for mask, text in zip(mail.masks, texts, strict=True):
        want = ODD_TEXT
        for word, stays in zip(mail.words, mask):
            want = want if stays else re.sub(rf"(?<!\w){word}(?!\w)", "", want)
        assert text == want


def test_masks_are_the_same_in_tasks_and_in_columns(spark):
    df = spark.createDataFrame([(1, ODD_TEXT), (7, "one"), (8, " ".join(f"w{i}" for i in range(400)))], "id long, text string")
    want = {}
    for r in X.lime_masks(df, num_samples=150).collect():
        want.setdefault(r["id"], {})[r["sample"]] = r["mask"]
    weights = {(r["id"], r["sample"]): r["weight"] for r in X.lime_weights(X.lime_masks(df, num_samples=150)).collect()}
    for i, mail in zip((1, 7, 8), rows_of(df, num_samples=150), strict=True):
        assert [want[i][s] for s in range(150)] == mail.masks.tolist()
        assert mail.weights().tolist() == pytest.approx([weights[i, s] for s in range(150)])


def test_neighbours_score_as_their_texts_do(spark, fitted):
    texts = ["free money for the friday meeting notes, free money", "hello", ODD_TEXT, "notes friday meeting " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r["id"], r["sample"]): r["spam_prob"] for r in X.neighbour_scores(df, fitted.neighbours(), num_samples=60).collect()}
    rows = [(i, s, t) for i, mail in enumerate(rows_of(df, num_samples=60)) for s, t in enumerate(mail.texts())]
    scored = fitted.scorer("naive_bayes")(spark.createDataFrame(rows, "id long, sample int, text string"))
    want = {(r["id"], r["sample"]): r["spam_prob"] for r in scored.collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()} and len(set(want.values())) > 40


def test_samples_are_scored_in_parts(spark, fitted, monkeypatch):
    (mail,) = rows_of(spark.createDataFrame([(1, "free money for the friday meeting notes " * 9)], "id long, text string"), num_samples=50)
    scorer = fitted.neighbours().get()
    whole = scorer.score_neighbours(mail)
    monkeypatch.setattr(L, "_CELLS", 100)
    assert np.allclose(scorer.score_neighbours(mail), whole)


def test_scores_do_not_depend_on_how_pairs_are_found(spark, fitted, monkeypatch):
    text = "Free free money, FREE money for the friday meeting notes: win now notes friday meeting " * 5
    (mail,) = rows_of(spark.createDataFrame([(1, text)], "id long, text string"), num_samples=80)
    scorer = fitted.neighbours().get()
    by_table = scorer.score_neighbours(mail)
    monkeypatch.setattr(L, "_TABLE", 0)
    assert np.allclose(scorer.score_neighbours(mail), by_table) and len(set(by_table)) > 20


def test_mails_to_explain_are_dealt_evenly_to_tasks(spark):
    # One file of one row group is one task's work, however many cores there are.
    df = materialize(spark.range(1000).selectExpr("id", "concat('win ', id) AS text").coalesce(1), "t-one-file")
    assert df.rdd.getNumPartitions() == 1
    sizes = [len(p) for p in X.dealt(df, 100).rdd.glom().collect()]
    assert len(sizes) == 10 and max(sizes) <= 150 and sum(sizes) == 1000
    assert X.dealt(df.where("id < 0")).count() == 0


def test_places_of_words_are_looked_up_not_searched_for_in_columns(spark):
    df = spark.createDataFrame([(1, ODD_TEXT)], "id long, text string")
    assert "array_position" not in X.neighbourhoods(df)._jdf.queryExecution().executedPlan().toString()
    (mail,) = rows_of(df, num_samples=5)
    assert [mail.words[k] for k in mail.order] == [p for p in mail.pieces if p in mail.words] and len(mail.order) > 12


def test_words_and_samples_are_hashed_in_tasks_as_in_columns(spark):
    text = "one İstanbul\u0301 漢字 two " + "w" * 60 + " " + "é" * 30 + " " + " ".join(f"v{k}" for k in range(40))
    rows = [("7", text), (None, text), ("x" * 54, text), ("x" * 80, "one two"), ("é:", "b " + "a" * 48)]
    df = spark.createDataFrame(rows, "id string, text string")
    mails = X.neighbourhoods(df, num_samples=1200)
    # A thousand hashes per mail, worked out one by one in the columns, took longer than cutting the mail.
    assert "md5" not in mails._jdf.queryExecution().executedPlan().toString()
    i = F.col("id")
    draws = F.transform(F.sequence(F.lit(0), F.lit(1199)), lambda s: X.sample_draw(i, s, 42))
    want = mails.select(X.word_keys(F.col("vocab"), i, 42).alias("keys"), draws.alias("draws")).collect()
    (batch,) = mails.toArrow().combine_chunks().to_batches()
    got = X.keys_and_draws(batch["head"].to_pylist(), batch["vocab"], 1200)
    for r, (keys, first, factor) in zip(want, got, strict=True):
        assert keys.tolist() == r["keys"]
        assert first.tolist() == [d >> 28 for d in r["draws"]]
        assert factor.tolist() == [(d & (2**28 - 1)) * 2 + 1 for d in r["draws"]]


def test_words_of_one_number_are_removed_in_the_order_of_their_letters(spark):
    seen = {}
    for k in itertools.count():
        number = int(hashlib.md5(f"42:1:w{k}".encode()).hexdigest()[:8], 16) % 2**31
        if number in seen:
            break
        seen[number] = f"w{k}"
    text = f"w{k} and {seen[number]} of one number"
    df = spark.createDataFrame([(1, text)], "id long, text string")
    (mail,) = rows_of(df, num_samples=200)
    want = sorted(X.lime_masks(df, num_samples=200).collect(), key=lambda r: r["sample"])
    assert [r["mask"] for r in want] == mail.masks.tolist()
    assert mail.masks.sum(1).tolist() == (len(mail.words) - mail.removed).tolist()
    assert (mail.masks[:, 0] != mail.masks[:, 2]).any()


def test_what_samples_have_in_common_is_counted_exactly():
    rng = np.random.default_rng(2)
    x, y, w = rng.integers(0, 2, (60, 2500)).astype(bool), rng.normal(size=60), rng.uniform(3e-4, 1, 60)
    assert np.allclose(X._ridge(x, y, w, 0.01), X._ridge(x.astype(float), y, w, 0.01), rtol=0, atol=1e-12)
    xc, yc = x - (w @ x) / w.sum(), y - (w @ y) / w.sum()
    got = X._ridge(x, y, w, 0.01)
    assert np.allclose(xc.T @ (w * (yc - xc @ got)), 0.01 * got, atol=1e-12)


def test_tokens_of_words_are_those_of_each_word(spark):
    text = "ΟΔΟΣ a1 abİcd x ΣΑΣ_ B's ΑΣ win"
    df = spark.createDataFrame([(1, text)], "id long, text string")
    (mail,) = rows_of(df, num_samples=5)
    alone = spark.createDataFrame([(k, w) for k, w in enumerate(mail.words)], "k int, w string")
    assert mail.tokens == [r["t"] for r in alone.select("k", V.tokens(F.col("w")).alias("t")).orderBy("k").collect()]
    assert len(mail.words) == 9 and [] in mail.tokens and max(map(len, mail.tokens)) == 2


def test_masks_of_samples_with_an_order_of_their_own(spark):
    text = "w0 w1 w2 w3 w4 w5 w6 w7, w8 w9"
    df = spark.createDataFrame([(1, text), (2, "one"), (3, " ")], "id long, text string")
    rows = X.lime_masks(df, num_samples=300, own_order=True).collect()
    assert len(rows) == 600
    for r in rows:
        order = sorted(range(len(r["vocab"])), key=lambda k: hashlib.md5(f"42:{r['id']}:{r['sample']}:{r['vocab'][k]}".encode()).hexdigest())
        assert {k for k, stays in enumerate(r["mask"]) if not stays} == set(order[: r["removed"]])


def test_an_outside_model_explains_and_is_loaded_once_per_worker(spark, tmp_path):
    path = str(tmp_path / "loads")

    def load():
        with open(path, "a") as f:
            f.write("loaded\n")

        def share_of_money(texts):
            shares = [t.lower().count("money") / (1 + len(t.split())) for t in texts]
            return [(1 - s, s) for s in shares]

        return share_of_money

    df = spark.createDataFrame([(i, f"send money today mail{i} please") for i in range(64)], "id long, text string").repartition(16)
    factory = L.PerWorker(load)
    for _ in range(2):
        top = X.lime_explain(df, factory, num_samples=80).where("feature = 'money'").collect()
        assert len(top) == 64 and all(r["score"] > 0.05 and r["residual"] < 1e-6 for r in top)
    # 32 tasks on four cores.
    assert len(open(path).readlines()) <= 8


def test_sample_zero_is_the_whole_text(spark):
    df = spark.createDataFrame([(1, "a b c a")], "id long, text string")
    rows = X.lime_weights(X.lime_masks(df, num_samples=50)).collect()
    zero = [r for r in rows if r["sample"] == 0][0]
    assert (zero["kept"], zero["total"], zero["weight"]) == (3, 3, 1.0)
    assert all(0 <= r["kept"] < 3 for r in rows if r["sample"])


# --- scoring as it comes -----------------------------------------------------------------------


def test_stream_equals_batch(spark, fitted, train):
    inbox = scratch_path(spark, "t-inbox")
    mails = train.select("id", "subject", "body")
    mails.repartition(3).write.parquet(inbox)
    history, checkpoint = scratch_path(spark, "t-history"), scratch_path(spark, "t-checkpoint")
    for _ in range(2):  # a restart scores nothing twice
        stream = mail_stream(spark, inbox, mails.schema, max_files=1)
        score_stream(stream, fitted.score, history, checkpoint).awaitTermination()
    a = {r["id"]: r["prediction"] for r in read_predictions(spark, history).collect()}
    b = {r["id"]: r["prediction"] for r in fitted.score(mails).collect()}
    assert a == b and read_predictions(spark, history).count() == len(TEXTS)


def test_custom_scorer(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    got = L.score_with(df, lambda: lambda texts: [[1 - len(t), len(t)] for t in texts])
    assert {r["id"]: r["spam_prob"] for r in got.collect()} == {1: 1.0, 2: 0.0}


def test_empty_vector(spark):
    m = L.LinearModel(0.0, (1.0, 2.0))
    df = spark.createDataFrame([(Vectors.sparse(2, [], []),)], ["features"])
    assert m.score(df).first()["spam_prob"] == 0.5


def test_dense_head_is_at_its_optimum(spark, sf):
    """The softmax head's gradient, worked out from its weights over all rows, is zero."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("embedding", "label")
    model = L.fit_dense_head(rows, reg=0.05)
    data = rows.collect()
    x, y = np.array([r["embedding"] for r in data], float), np.array([r["label"] for r in data])
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    z = x @ w.T + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    rest = p - np.eye(len(b))[y]
    assert np.abs(rest.T @ x / len(x) + 0.05 * w).max() < 1e-4 and np.abs(rest.mean(0)).max() < 1e-4
    scored = L.dense_logits(rows, model).select("embedding", "logits", L.argmax(F.col("logits")).alias("top"), L.softmax(F.col("logits")).alias("p")).collect()
    found = {tuple(r["embedding"]): r for r in scored}
    for k in range(0, len(x), 50):
        r = found[tuple(data[k]["embedding"])]
        assert np.allclose(r["logits"], z[k]) and r["top"] == int(z[k].argmax()) and np.allclose(r["p"], p[k])


def test_logistic_weights_equal_newton_steps(spark, train, fitted):
    """Weights of the fit against plain Newton steps on the same vectors."""
    tfidf = fitted.tfidf
    rows = fitted.features(train).collect()
    x, y = np.array([r["features"].toArray() for r in rows]), np.array([r["label"] for r in rows], float)
    model = L.fit_logistic(fitted.features(train), len(tfidf.vocabulary))
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    full, penalty = np.hstack([x, np.ones((len(x), 1))]), np.append(np.ones(x.shape[1]), 0.0)
    w = np.zeros(full.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-full @ w))
        slope = full.T @ (weight * (p - y)) + penalty * w
        w -= np.linalg.solve(full.T @ (full * (weight * p * (1 - p))[:, None]) + np.diag(penalty), slope)
    assert np.allclose(model.weights, w[:-1], atol=2e-3) and model.intercept == pytest.approx(w[-1], abs=2e-3)
