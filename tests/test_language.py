"""Language profile and the filter of single terms, against plain counts."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hamsieve.operators import features as V
from hamsieve.operators import language
from hamsieve.operators.language import fit_language
from hamsieve.sources import artifacts
from hamsieve.sources.scratch import scratch_path

TEXTS = [("en", "the cat and the dog"), ("en", "a thing of the then"), ("de", "der hund und die katze"), ("de", "über den äußeren 😀😀 dächern"), ("fr", "le chat et la souris"), ("fr", "ab"), (None, "nobody's")]


def plain(text, sample=1000):
    """Score of each language by dictionaries."""
    grams = lambda t: [t[i : i + 3] for i in range(len(t) - 2)]
    counts = {}
    for lang, t in TEXTS:
        if lang:
            counts.setdefault(lang, Counter()).update(grams(t))
    known = set().union(*counts.values())
    found = [g for g in grams(text[:sample]) if g in known]
    size = {k: sum(c.values()) + len(known) for k, c in counts.items()}
    return {k: round(sum(math.log(c[g] + 1) - math.log(size[k]) for g in found), 6) for k, c in counts.items()} if found else None


@pytest.fixture(scope="module")
def profile(spark):
    return fit_language(spark.createDataFrame(TEXTS, "lang string, full_text string").repartition(3))


def test_languages_and_confidence_equal_plain_counts(spark, profile):
    path = scratch_path(spark, "t-language")
    artifacts.save_language(spark, path, profile)
    loaded = artifacts.load_language(spark, path)
    assert loaded.langs == ("de", "en", "fr") and (loaded.codes == profile.codes).all() and np.allclose(loaded.log_probs, profile.log_probs)
    texts = ["the dog", "die katze und der hund", "le chat", "zz", "", None, "xyzxyz", "😀😀 d", "the " * 400 + "der hund " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for p in (profile, loaded):
        for r in df.select("id", p.judge(F.col("t")).alias("j")).collect():
            want = plain(texts[r["id"]] or "")
            if want is None:
                assert r["j"]["detected"] is None and r["j"]["confidence"] is None
            else:
                best = min(want, key=lambda k: (-want[k], k))
                assert r["j"]["detected"] == best
                assert r["j"]["confidence"] == pytest.approx(1 / sum(math.exp(s - want[best]) for s in want.values()))


def test_long_texts_are_counted_in_parts(spark, monkeypatch):
    r = random.Random(1)
    text = "".join(r.choice("abc é😀") for _ in range(500))
    for size in (3, 7, 100):
        monkeypatch.setattr(language, "_PIECE", size)
        parts = list(language._pieces([text, "ab", "xyz"]))
        got = Counter(p[i : i + 3] for part in parts for p in part for i in range(len(p) - 2))
        assert got == Counter(t[i : i + 3] for t in (text, "ab", "xyz") for i in range(len(t) - 2))


def test_no_language_or_too_many(spark, monkeypatch):
    none = spark.createDataFrame([(None, "some text"), ("en", "")], "lang string, full_text string")
    with pytest.raises(ValueError):
        fit_language(none)
    many = spark.createDataFrame([(f"l{i}", "some text") for i in range(6)], "lang string, full_text string")
    monkeypatch.setattr(language, "MAX_LANGUAGES", 5)
    with pytest.raises(ValueError):
        fit_language(many)
    monkeypatch.setattr(language, "MAX_LANGUAGES", 9)
    monkeypatch.setattr(language, "MAX_ENTRIES", 10)
    with pytest.raises(ValueError):
        fit_language(many)


@pytest.mark.parametrize(("fan", "bits"), [(64, 22), (2, 21), (2, 20)])
def test_terms_of_single_mails_are_found(spark, monkeypatch, fan, bits):
    monkeypatch.setattr(V, "_FAN", fan)
    r = random.Random(2)
    mails = [[f"t{min(int(r.paretovariate(0.4)), 3000)}" for _ in range(r.choice([0, 1, 40]))] for _ in range(200)] + [None]
    df = spark.createDataFrame(list(enumerate(mails)), "id long, terms array<string>").repartition(7)
    held = Counter(t for m in mails if m for t in set(m))
    shared = {t for t, n in held.items() if n > 1}
    kept = {row["id"]: row["terms"] for row in V.without_single(df, "terms", bits).collect()}
    singles = 0
    for i, m in enumerate(mails):
        assert [t for t in kept[i] or [] if t in shared] == [t for t in m or [] if t in shared]
        singles += sum(t not in shared for t in kept[i] or [])
    assert singles < 5 < sum(n == 1 for n in held.values())
    plainly = {tuple(row) for row in V.fit_vocabulary(df.where("terms IS NOT NULL"), filter_terms=10**9).collect()}
    assert {tuple(row) for row in V.fit_vocabulary(df.where("terms IS NOT NULL"), filter_terms=1).collect()} == plainly


def test_buckets_are_marked_in_tables_of_one_bit_each():
    r = np.random.default_rng(3)
    once, twice, seen = np.zeros(1 << 5, np.uint8), np.zeros(1 << 5, np.uint8), Counter()
    for size in (0, 1, 40, 60):
        at = r.integers(0, 1 << 8, size)
        V._mark(once, twice, at)
        seen.update(at.tolist())
        for table, least in ((once, 1), (twice, 2)):
            assert np.unpackbits(table).tolist() == [int(seen[k] >= least) for k in range(1 << 8)]
    # Both tables of a worker, whatever the number of terms.
    assert 2 * (1 << V._MOST_BITS) // 8 <= 64 << 20


def test_texts_of_a_batch_are_taken_out_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(language, "_ROWS", 4)
    taken = []

    class Column:
        def take(self, rows):
            taken.append(len(rows))
            return pa.array([f"text {k}" for k in rows.to_pylist()])

    texts = language._texts(Column(), pa.array(range(1, 11)))
    assert next(texts) == "text 1" and taken == [4]
    assert list(texts) == [f"text {k}" for k in range(2, 11)] and taken == [4, 4, 2]
