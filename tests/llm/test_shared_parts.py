"""What several operators share: exact sums at any size, hashes that collide, sums in rounds, rows without an id."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hamsieve.llm import blocks, jaccard, suffixes
from hamsieve.llm.blocks import answer_sums, ask, told
from hamsieve.llm.jaccard import first_of_groups, near_groups
from hamsieve.llm.suffixes import _marks


def test_sums_beyond_32_bits_are_exact(spark, make):
    """Three blocks each say two billion of one key."""
    table = spark.createDataFrame([(b,) for b in range(3)], "block int")
    known = np.array([5, 1 << 40, (1 << 63) + 9], np.uint64)

    def keys_of(part):
        return {1: (known, np.array([2_000_000_000, 1, 7])), 4: (known[:1], np.array([4_000_000_000]))}

    rows = answer_sums(ask(table, keys_of, 2)).toArrow()
    for b in range(3):
        got = told(rows.filter(pa.compute.equal(rows.column("block"), b)))
        assert got[1].tolist() == [6_000_000_000, 3, 21] and got[4].tolist() == [12_000_000_000]


def test_rows_of_one_id_lie_in_many_blocks(spark, make):
    docs = make([(None, f"text {i} " * 50) for i in range(200)])
    blocked, n = blocks.in_blocks(docs, "doc_id", "text", 4000)
    sizes = [r["count"] for r in blocked.groupBy("block").count().collect()]
    assert n > 5 and len(sizes) > n / 2 and max(sizes) < 100


def test_strings_of_one_hash_are_told_apart(monkeypatch):
    """With a hash of two values only, marks are those of plain comparison."""
    r = random.Random(1)
    length = 10
    texts = ["".join(r.choice("ab") for _ in range(r.randint(10, 14))) for _ in range(60)]
    ids = np.array([r.randint(0, 9) for _ in texts])
    counts = np.array([len(t) - length + 1 for t in texts])
    body = np.frombuffer("".join(texts).encode(), np.uint8)
    strings = [(i, t[k : k + length]) for i, t in zip(ids.tolist(), texts, strict=True) for k in range(len(t) - length + 1)]
    least = {}
    for i, s in strings:
        least[s] = min(i, least.get(s, i))
    want = [i > least[s] for i, s in strings]
    assert _marks(ids, counts, body, length).tolist() == want
    monkeypatch.setattr(suffixes, "_rolling", lambda data, n: (data[: len(data) - n + 1] & 1).astype(np.uint64))
    assert _marks(ids, counts, body, length).tolist() == want


@pytest.mark.parametrize("fan", [64, 2])
def test_sketches_of_many_tasks_are_summed_in_rounds(spark, make, corpus, monkeypatch, fan):
    monkeypatch.setattr(jaccard, "FAN", fan)
    docs = make(corpus).repartition(9).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(0).cast("long").alias("row"))
    _, sketch = jaccard._classes_and_sketch(docs, "doc_id", 3)
    want = Counter()
    for _, s in jaccard._sets(pa.array([t or "" for _, t in corpus]), 3):
        want.update((s & np.uint64(jaccard.SKETCH - 1)).tolist())
    assert {int(k): int(sketch[k]) for k in np.flatnonzero(sketch)} == want


def test_rows_without_an_id(spark, make):
    a, b = "one two three four five six seven", "other words that are no copy of it"
    docs = make([(None, a), (-1, a), (4, a + " "), (None, b), (None, b), (-1, "x y z"), (None, None)])
    got = Counter((r["doc_id"], r["component_id"]) for r in near_groups(docs).collect())
    assert got == Counter({(None, -1): 1, (-1, -1): 2, (4, -1): 1, (None, None): 3})
    kept = Counter((r["doc_id"], r["text"]) for r in first_of_groups(docs).collect())
    assert kept == Counter([(-1, a), (None, b), (-1, "x y z"), (None, None)])


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("rows", [[], "odd"])
def test_pipeline_on_nothing_and_on_rows_without_ids(spark, sf, make, corpus, rows):
    """Every stage runs on an empty table, and on rows whose columns are null, each for itself."""
    import corpus_pipeline

    if rows == "odd":
        prose = [(i, t) for i, t in corpus if t and len(t) < 2000]
        rows = prose + [(None, prose[0][1] + " and one more"), (None, None), (None, ""), (prose[1][0], prose[2][1] + " other end")]
    docs = make(rows).select(*COLUMNS).withColumns({c: F.when(F.col("doc_id").isNotNull(), F.col(c)) for c in ("lang", "source", "n_chars")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        n = out.count()
        assert (n == 0) == (not rows) or name in ("quality", "mixing"), name
        if name != "sharding":
            assert out.columns == COLUMNS
            kept = Counter((r["doc_id"], r["text"]) for r in out.collect())
            assert not kept - Counter((r["doc_id"], r["text"]) for r in docs.collect())
