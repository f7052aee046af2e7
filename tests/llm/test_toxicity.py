"""Subword-bag toxicity: the vectorised score against a plain one, held-out accuracy, odd inputs."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hamsieve.llm import toxicity
from hamsieve.llm.toxicity import SubwordModel, distinct_words, fit_subwords, grams, score_toxicity, train
from hamsieve.sources.tables import table


@pytest.fixture(scope="module")
def lines():
    """Clean lines, and ones with an insult; misspelt insults are held back."""
    r = random.Random(8)
    plain = "the of and river house green paper window garden morning letter number station people winter little".split()
    rude = ["moron", "pathetic", "worthless"]

    def line(word=None):
        words = [r.choice(plain) for _ in range(r.randint(15, 60))]
        if word:
            for _ in range(3):
                words[r.randrange(len(words))] = word
        return " ".join(words)

    texts = [line() for _ in range(120)] + [line(r.choice(rude)) for _ in range(60)]
    return texts, np.array([0] * 120 + [1] * 60, float)


@pytest.fixture(scope="module")
def model(lines):
    return train(*lines, rounds=4, passes=80)


def plain_score(model, text):
    words = list(dict.fromkeys(text.lower().split()))
    margin = float(model.bias[1] - model.bias[0])
    total = 0.0
    for word in words:
        buckets = [int(b) for found, _ in grams([word]) for b in found]
        total += sum(float(model.table[b]) for b in buckets) / max(len(buckets), 1)
    return 1 / (1 + math.exp(-(total / (len(words) + toxicity.DAMPING) + margin)))


def test_scores_equal_plain_ones(model, lines, monkeypatch):
    odd = ["", " \t\n", "x", "É é", "moron", "MORON moron", "😀 \ud800 x", "a" * 3000, "moron " * 400 + "river"]
    texts = lines[0][:20] + odd
    want = [plain_score(model, t) for t in texts]
    assert np.allclose(model.scores(texts), want)
    monkeypatch.setattr(toxicity, "PIECE", 30)
    assert np.allclose(model.scores(texts), want)


def test_grams_are_those_of_the_word_with_its_ends():
    words = ["ab", "river", "é"]
    found = [(int(w), n) for n, (bucket, word) in enumerate(grams(words), 3) for w in word]
    for k, word in enumerate(words):
        for n in range(3, 7):
            assert found.count((k, n)) == max(0, len(word) + 2 - n + 1)


def test_misspellings_that_were_never_seen_are_caught(model):
    score = dict(zip(("moronn", "patheticc", "worthles", "garden", "gardenn"), model.scores([f"the of green {w} {w}s" for w in ("moronn", "patheticc", "worthles", "garden", "gardenn")]), strict=True))
    assert min(score["moronn"], score["patheticc"], score["worthles"]) > 0.5 > max(score["garden"], score["gardenn"])
    a, b, c = model.vectors(["moron", "moronn", "garden"])
    assert a @ b > 0.5 * (a @ a) > abs(a @ c)


def test_embeddings_and_softmax_give_the_table(model):
    assert len(model.buckets) and model.embeddings.shape == (len(model.buckets), toxicity.DIMENSIONS)
    assert np.allclose(model.table[model.buckets], model.embeddings @ (model.weights[1] - model.weights[0]), atol=1e-4)
    assert np.count_nonzero(model.table) <= len(model.buckets)


def test_long_texts_are_cut_at_white_space(monkeypatch):
    r = random.Random(1)
    text = "".join(r.choice(["ab", "c", " ", "\n", "déf", "　"]) for _ in range(3000))
    whole = distinct_words(text)
    monkeypatch.setattr(toxicity, "PIECE", 17)
    assert distinct_words(text) == whole == list(dict.fromkeys(text.lower().split()))


@pytest.mark.parametrize("labels", [[], [1, 1], [0, 0, 0]])
def test_one_label_or_none_gives_the_bias(labels):
    model = train(["one two"] * len(labels), np.array(labels, float))
    a, b = model.scores(["", "one two"])
    assert a == b and (not labels or (a > 0.5) == (labels[0] == 1))


def test_held_out_documents(spark, make):
    """Half of the toxic labels of the small table stand on texts without a toxic word; see the ranks instead."""
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = fit_subwords(docs, labels.where(remainder != 0))
    rows = score_toxicity(docs, model).join(labels, "doc_id").where(remainder == 0).collect()
    right = np.array([r["predicted"] == r["toxic"] for r in rows])
    toxic = np.array([r["toxic"] == 1 for r in rows])
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert right.mean() > 0.96 and right[toxic].mean() > 0.85 and right[~toxic].mean() > 0.975


def test_odd_documents_and_labels(spark, make, corpus):
    docs = make([*corpus, (10, "another text of one id"), (None, "no id"), (None, None)])
    labels = spark.createDataFrame([(i, k % 3 == 0, "x") for k, (i, _) in enumerate(corpus)], "doc_id long, toxic boolean, text string")
    labels = labels.withColumn("toxic", F.col("toxic").cast("int"))
    more = spark.createDataFrame([(None, 1, "x"), (10, None, "x"), (11, 7, "x"), (987_654, 1, "x")], "doc_id long, toxic int, text string")
    model = fit_subwords(docs, labels.unionByName(more), sample=30)
    rows = score_toxicity(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert [c for c, _ in score_toxicity(docs, model).dtypes] == ["doc_id", "score", "predicted"]
    assert score_toxicity(make([]), model).count() == 0
    none = fit_subwords(make([]), labels)
    assert isinstance(none, SubwordModel) and not len(none.buckets)
