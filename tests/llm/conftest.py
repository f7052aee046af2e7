import pytest
from pyspark.sql import types as T

WORDS = "the of and to in is it for on with as by at from that this be are was or an have not but they which one you were her all she there would their we him been has when who will more no if out so said what up its about".split()


@pytest.fixture(scope="session")
def make(spark, tmp_path_factory):
    """A ``documents`` table from (doc_id, text) pairs, with columns whose names clash with the operators' own."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("n_chars", T.LongType()),
            # Names that the operators use for columns of their own.
            *(T.StructField(n, T.StringType()) for n in ("n", "key", "id", "a", "b", "block", "hash", "tokens", "shard", "score", "component", "weight")),
        ]
    )

    def build(rows, lang="en", source="s"):
        full = [(i, t, lang, source if isinstance(source, str) else source(i), len(t) if t else 0, *["x"] * 12) for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(3)

    return build


@pytest.fixture(scope="session")
def corpus():
    """Prose with copies, near copies, shared passages, an empty, a blank, a null, a short and a long text."""
    import random

    r = random.Random(5)
    vocabulary = WORDS + [a + b + c for a in ("ka", "lo", "mi", "tu") for b in ("ren", "sol", "vid") for c in ("", "a", "er", "ing")]

    def prose(n):
        return " ".join(r.choice(vocabulary) for _ in range(n))

    base = [prose(r.randint(40, 160)) for _ in range(40)]
    passage = prose(30)
    texts = list(base)
    texts += [base[0]] * 6 + [base[1] + "\n", base[1].upper()]
    for k in range(12):
        w = base[2 + k % 4].split()
        w[r.randrange(len(w))] = "changed" + str(k)
        texts.append(" ".join(w))
    texts += [prose(20) + " " + passage + " " + prose(20) for _ in range(8)]
    texts += ["", " \t\n", None, "one", "One", "two words", prose(30_000), "é" * 60 + " ü", "é" * 60 + " ü!"]
    r.shuffle(texts)
    return list(enumerate(texts, 10))
