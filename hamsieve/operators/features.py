"""Word and bigram features, TF-IDF and token ids.

A mail is one row, so everything that concerns one mail (tokens, counts, norm, ids) is computed
inside the row. Only corpus-wide counts shuffle, after partial aggregation, keyed by term: a term
that is in every mail costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import (
    CountVectorizer,
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hamsieve.functions import fixed
from hamsieve.functions.let import let
from hamsieve.functions.rows import struct_rows, value_rows
from hamsieve.functions.text import WORD, WS
from hamsieve.sources.scratch import materialize


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more word characters, in order."""
    return F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"[{WORD}]{{2,}}"), F.lit(0)
    )


def bigrams(words: Column) -> Column:
    pairs = F.zip_with(
        words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat_ws(" ", a, b)
    )
    # The last word has no successor; ``slice`` also keeps short inputs empty.
    return F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))


def terms(text: Column) -> Column:
    """Unigrams, then bigrams."""
    return let(tokens(text), lambda w: F.concat(w, bigrams(w)))


def term_stats(df: DataFrame, term_col: str = "terms") -> DataFrame:
    """``term, df, total`` over an array column, in one shuffle.

    A mail's terms are sorted in the row; the first of each run of equal ones also counts the mail.
    """

    def marked(terms: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), terms)
        return F.zip_with(
            terms,
            F.slice(before, F.lit(1), F.size(terms)),
            lambda t, p: F.struct(t.alias("term"), (~t.eqNullSafe(p)).cast("int").alias("first")),
        )

    entries = let(F.array_sort(F.col(term_col)), marked)
    return (
        struct_rows(df, [], entries, "term")
        .groupBy("term")
        .agg(F.sum("first").alias("df"), F.count(F.lit(1)).alias("total"))
    )


#: Terms from which a first pass finds those that only one mail has; buckets per term of its table, and their number at most
#: (two bits each: 64 MB in a Python worker; with more terms than buckets, fewer single ones are found).
FILTER_TERMS = 20_000_000
_BUCKETS_PER_TERM = 4
_MOST_BITS = 28
#: Tables are merged so many at a time, in slices of so many buckets.
_FAN = 64
_SLICE_BITS = 20
#: Hashes that are looked at together, however many a batch has.
_HASHES = 1 << 20


def _mark(once: np.ndarray, twice: np.ndarray, at: np.ndarray) -> None:
    """Mark buckets in the two tables, a bit per bucket."""
    at, n = np.unique(at, return_counts=True)
    byte, bit = at >> 3, (0x80 >> (at & 7)).astype(np.uint8)
    again = bit & once[byte] | np.where(n > 1, bit, np.uint8(0))
    # Buckets are in order: those of one byte are neighbours.
    first = np.flatnonzero(np.diff(byte, prepend=-1))
    if len(first):
        twice[byte[first]] |= np.bitwise_or.reduceat(again, first)
        once[byte[first]] |= np.bitwise_or.reduceat(bit, first)


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    once = twice = None
    for a, b in zip(pdf["once"], pdf["twice"], strict=True):
        o, t = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        once, twice = (o, t) if once is None else (once | o, twice | t | (once & o))
    return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "part": pdf["part"].iloc[:1], "once": [once.tobytes()], "twice": [twice.tobytes()]})


def seen_twice(df: DataFrame, term_col: str, bits: int) -> np.ndarray:
    """A bit per bucket of terms: may a term in it be in two mails or more? (Never no, if one is.)

    Each task marks what it has seen once and twice; tables are merged a few at a time, in rounds, and
    slices of fixed size reach the driver.
    """
    schema = "slice int, part int, once binary, twice binary"
    mask = (1 << bits) - 1
    size = (1 << min(bits, _SLICE_BITS)) >> 3

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros((1 << bits) >> 3, np.uint8), np.zeros((1 << bits) >> 3, np.uint8)
        for batch in batches:
            hashes = batch.column(0).flatten().to_numpy()
            for at in range(0, len(hashes), _HASHES):
                _mark(once, twice, hashes[at : at + _HASHES] & mask)
        if once.any():
            part = TaskContext.get().partitionId()
            for k in range(len(once) // size):
                row = [[k], [part], [once[k * size : (k + 1) * size].tobytes()], [twice[k * size : (k + 1) * size].tobytes()]]
                types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], names=["slice", "part", "once", "twice"])

    hashes = F.transform(F.array_distinct(F.col(term_col)), lambda t: F.xxhash64(t)).alias("h")
    parts = materialize(df.where(F.col(term_col).isNotNull()).select(hashes).mapInArrow(scan, schema), "seen")
    left = (parts.agg(F.max("part").alias("n")).first()["n"] or 0) + 1
    while left > 1:
        parts = parts.withColumn("part", F.floor(F.col("part") / _FAN).cast("int")).groupBy("slice", "part").applyInPandas(_merge, schema)
        left = -(-left // _FAN)
    out = np.zeros((1 << bits) >> 3, np.uint8)
    for r in parts.select("slice", "twice").toLocalIterator():
        out[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["twice"], np.uint8)
    return out


def without_single(df: DataFrame, term_col: str, bits: int) -> DataFrame:
    """``df`` whose mails have lost (nearly) all terms that no other mail has; all others stay."""
    shared = df.sparkSession.sparkContext.broadcast(seen_twice(df, term_col, bits))
    mask = (1 << bits) - 1

    @F.arrow_udf("array<boolean>")
    def again(hashes: pa.Array) -> pa.Array:
        flat = hashes.flatten().to_numpy(zero_copy_only=False)
        known = np.empty(len(flat), bool)
        for k in range(0, len(flat), _HASHES):
            at = flat[k : k + _HASHES] & mask
            known[k : k + _HASHES] = (shared.value[at >> 3] >> (7 - (at & 7))) & 1
        bounds = np.concatenate([[0], np.cumsum(hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(known))

    kept = again(F.transform(term_col, lambda t: F.xxhash64(t)))
    pairs = F.filter(F.arrays_zip(F.col(term_col).alias("t"), kept.alias("k")), lambda x: x["k"])
    return df.withColumn(term_col, F.transform(pairs, lambda x: x["t"]))


def fit_vocabulary(
    df: DataFrame,
    term_col: str = "terms",
    max_features: int | None = fixed.MAX_FEATURES,
    min_df: int = fixed.MIN_DF,
    max_df: float = fixed.MAX_DF,
    filter_terms: int = FILTER_TERMS,
) -> DataFrame:
    """``term, df, total, idf``: terms by document frequency, then the most frequent; ties by term.

    ``df`` is read twice (once for its row count): pass a stored table. From ``filter_terms`` terms on it is read
    once more, to find the terms of a single mail (most bigrams are), which then are not shuffled; what
    the vocabulary is doesn't depend on it.
    """
    counted = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(term_col)), F.lit(0)).alias("terms")).first()
    n = F.lit(float(counted["n"]))
    if min_df >= 2 and counted["terms"] >= max(filter_terms, 1):
        df = without_single(df, term_col, min(_MOST_BITS, max(_SLICE_BITS, (_BUCKETS_PER_TERM * counted["terms"]).bit_length())))
    vocab = (
        term_stats(df, term_col)
        .where((F.col("df") >= min_df) & (F.col("df") <= n * F.lit(max_df)))
        .withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0)
    )
    return vocab if max_features is None else most_frequent(materialize(vocab, "terms"), max_features)


def most_frequent(counts: DataFrame, size: int) -> DataFrame:
    """The ``size`` rows of ``counts`` (``term``, ``total``) with the largest totals; ties by term.

    Rows are counted per total, which finds the total where the cut lies; terms above it stay, and
    only those that have just that total are ranked, in ranges of terms. Nothing but the cut and the counts of
    ranges reaches the driver. ``counts`` is read three times: pass a stored table.
    """
    levels = counts.groupBy("total").agg(F.count(F.lit(1)).alias("rows"))
    # One row per distinct total; running sums over them run in one task and see no terms.
    above = F.sum("rows").over(Window.orderBy(F.desc("total")).rowsBetween(Window.unboundedPreceding, -1))
    cut = (
        levels.withColumn("above", F.coalesce(above, F.lit(0)))
        .where((F.col("above") < size) & (F.col("above") + F.col("rows") >= size))
        .select("total", "above")
        .first()
    )
    if cut is None:
        return counts
    at_cut = numbered(counts.where(F.col("total") == cut["total"]), [F.asc("term")], "place")
    return counts.where(F.col("total") > cut["total"]).unionByName(
        at_cut.where(F.col("place") <= size - cut["above"]).select(*counts.columns)
    )


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the row's place, from 1, in a total ``order``: ranges are sorted each on its own.

    Rows are stored in ranges of the order, so that ranges stay as they are while they are counted.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    stored = materialize(ranged, "ranges")
    # One row per range.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    return (
        stored.join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_before") + F.row_number().over(inside))
        .drop("_range", "_before")
    )


def counter_of(spark: SparkSession, terms: list[str]) -> tuple[CountVectorizerModel, list[str]]:
    """A counting model over ``terms`` and their order in it.

    Fitting it on one row of all terms hands them over in one piece, where ``from_vocabulary`` sends
    them to the JVM one at a time.
    """
    one = spark.createDataFrame([(terms,)], "terms array<string>")
    counter = CountVectorizer(inputCol="terms", outputCol="_counts", vocabSize=len(terms), minDF=1.0).fit(one)
    single = one.select(F.explode("terms").alias("term")).withColumn("terms", F.array("term"))
    place = F.get(F.unwrap_udt("_counts")["indices"], F.lit(0))
    numbers = counter.transform(single).select("term", place.alias("i")).collect()
    return counter, [r["term"] for r in sorted(numbers, key=lambda r: r["i"])]


@dataclass(frozen=True)
class TfidfModel:
    """A fitted vocabulary (at most ``max_features`` terms) with its idf weights, by term id."""

    counter: CountVectorizerModel
    vocabulary: tuple[str, ...]
    idf: tuple[float, ...]

    @classmethod
    def fit(cls, df: DataFrame, term_col: str = "terms", **limits) -> "TfidfModel":
        rows = fit_vocabulary(df, term_col, **limits).select("term", "idf").collect()
        return cls.of(df.sparkSession, [(r["term"], r["idf"]) for r in rows])  # max_features rows

    @classmethod
    def of(cls, spark: SparkSession, weights: list[tuple[str, float]]) -> "TfidfModel":
        """From pairs of term and idf."""
        if not weights:
            raise ValueError("empty vocabulary: no term passed the frequency limits")
        idf = dict(weights)
        counter, ordered = counter_of(spark, list(idf))
        return cls(counter, tuple(ordered), tuple(idf[t] for t in ordered))

    def table(self, spark: SparkSession) -> DataFrame:
        """``term_id, term, idf``."""
        rows = [(i, t, w) for i, (t, w) in enumerate(zip(self.vocabulary, self.idf))]
        return spark.createDataFrame(rows, "term_id int, term string, idf double")

    def transform(self, df: DataFrame, term_col: str = "terms", out: str = "features") -> DataFrame:
        """Add a sparse vector of tf x idf with unit length. Narrow: no join, no shuffle.

        Unknown terms are ignored; a mail without known terms gets an empty vector.
        """
        counts = self.counter.copy().setInputCol(term_col).setOutputCol("_counts")
        weigh = ElementwiseProduct(
            scalingVec=Vectors.dense(self.idf), inputCol="_counts", outputCol="_weighted"
        )
        unit = Normalizer(p=2.0, inputCol="_weighted", outputCol=out)
        return unit.transform(weigh.transform(counts.transform(df))).drop("_counts", "_weighted")


def sparse_entries(vector: str = "features") -> Column:
    """Array of struct ``term_id, weight`` of a sparse vector column."""
    v = F.unwrap_udt(F.col(vector))
    return F.zip_with(
        v["indices"], v["values"], lambda i, w: F.struct(i.alias("term_id"), w.alias("weight"))
    )


def long_form(
    df: DataFrame, model: TfidfModel, id_col: str = "id", vector: str = "features"
) -> DataFrame:
    """``id, term, weight``: one row per non-zero entry."""
    entries = struct_rows(df, [id_col], sparse_entries(vector), "term_id")
    # max_features rows at most
    names = F.broadcast(model.table(df.sparkSession).select("term_id", "term"))
    return entries.join(names, "term_id").select(id_col, "term", "weight")


# --- token ids ---------------------------------------------------------------------------------

_SPECIAL = r"\[NO SUBJECT\]|\[NO BODY\]|\[SUBJECT\]|\[BODY\]"


def model_tokens(text: Column) -> Column:
    """Tokens of marked text: marks and placeholders stay whole; words and single symbols else."""
    return F.regexp_extract_all(
        text, F.lit(rf"{_SPECIAL}|[{WORD}]+|[^{WORD}{WS}]"), F.lit(0)
    )


def fit_token_vocabulary(df: DataFrame, token_col: str, size: int | None = None) -> DataFrame:
    """``token, token_id``: reserved tokens first, then by falling frequency; ties by token.

    Every token of ``df`` has an id unless ``size`` bounds the whole vocabulary; others read [UNK].
    """
    reserved = list(fixed.RESERVED_TOKENS)
    counts = (
        value_rows(df, [], F.col(token_col), "token")
        .where(~F.col("token").isin(reserved))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Stored: finding the ranges reads it once more.
    ranked = numbered(materialize(counts, "token-counts"), [F.desc("n"), F.asc("token")], "place")
    words = ranked.select("token", (F.col("place") + len(reserved) - 1).cast("int").alias("token_id"))
    if size is not None:
        words = words.where(F.col("token_id") < size)
    heads = df.sparkSession.createDataFrame(
        [(t, i) for i, t in enumerate(reserved)], "token string, token_id int"
    )
    return heads.unionByName(words)


#: Vocabularies up to this number of tokens travel with the tasks; larger ones are joined.
LOOKUP_TOKENS = 2_000_000


def encode(
    df: DataFrame,
    vocab: DataFrame,
    token_col: str,
    id_col: str = "id",
    max_length: int = fixed.MAX_LENGTH,
) -> DataFrame:
    """``id, input_ids, attention_mask``: start, token ids cut to fit, end, padding.

    The ids of a mail are looked up inside its row, in Arrow batches; no row moves. ``vocab`` should be
    a stored table: it is counted first, and a vocabulary beyond LOOKUP_TOKENS is joined instead.
    """
    reserved = {t: i for i, t in enumerate(fixed.RESERVED_TOKENS)}
    content = max_length - 2
    head = df.select(id_col, F.slice(token_col, 1, content).alias("_tokens"))
    if vocab.count() <= LOOKUP_TOKENS:
        ids = _looked_up(head, vocab, reserved["[UNK]"])
    else:
        ids = _joined(head, vocab, id_col, reserved["[UNK]"])
    used = F.concat(F.array(F.lit(reserved["[CLS]"])), F.col("_ids"), F.array(F.lit(reserved["[SEP]"])))
    pad = F.lit(max_length) - F.size("used")
    return (
        ids.select(id_col, used.alias("used"))
        .select(
            id_col,
            F.concat("used", F.array_repeat(F.lit(reserved["[PAD]"]), pad)).alias("input_ids"),
            F.concat(
                F.array_repeat(F.lit(1), F.size("used")), F.array_repeat(F.lit(0), pad)
            ).alias("attention_mask"),
        )
    )


def _looked_up(head: DataFrame, vocab: DataFrame, unknown: int) -> DataFrame:
    table = {r["token"]: r["token_id"] for r in vocab.select("token", "token_id").collect()}
    shared = head.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("array<int>")
    def look_up(rows: pd.Series) -> pd.Series:
        known = shared.value
        return rows.map(lambda words: [known.get(w, unknown) for w in words])

    return head.withColumn("_ids", look_up(F.coalesce("_tokens", F.array().cast("array<string>"))))


def _joined(head: DataFrame, vocab: DataFrame, id_col: str, unknown: int) -> DataFrame:
    """Only the tokens that fit are joined, so no group is longer than they are."""
    rows = head.select(id_col, F.posexplode_outer("_tokens"))
    known = rows.join(vocab, rows["col"] == vocab["token"], "left")
    token_id = F.when(F.col("col").isNotNull(), F.coalesce("token_id", F.lit(unknown)))
    placed = F.when(F.col("pos").isNotNull(), F.struct("pos", token_id.alias("t")))
    ids = known.groupBy(id_col).agg(F.sort_array(F.collect_list(placed)).alias("s"))
    return ids.select(id_col, F.transform("s", lambda x: x["t"]).alias("_ids"))


def remove_stop_words(
    df: DataFrame, word_col: str, stop_words: tuple[str, ...] = fixed.STOP_WORDS
) -> DataFrame:
    """Rows whose word, in lower case, is not a stop word."""
    return df.where(~F.lower(F.col(word_col)).isin(*stop_words))
