"""Language detection: naive Bayes over character trigrams, fitted on labelled text.

The fit counts every trigram of whole training texts, in each task before anything is shuffled. Detection looks
at the first 1000 characters of a text: one lookup of its trigrams in a table of grams by languages gives
the scores of all languages at once. Only those characters reach Python, and no row moves.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hamsieve.functions import fixed

#: More languages than this, and the column is not one of languages.
MAX_LANGUAGES = 200
#: Distinct trigrams that are collected and travel with the tasks, and entries of their table (a trigram in a
#: language); text of every script stays below.
MAX_GRAMS = 2_000_000
MAX_ENTRIES = 40_000_000
#: Characters whose trigrams are counted at once, or scores of trigrams that are looked up at once.
_PIECE = 1 << 20
#: Texts that are taken out of a batch at once.
_ROWS = 64
_BITS = 21

_CODES = "code long, lang string, n long"


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the bounds of the texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return points, np.concatenate([[0], np.cumsum(sizes)])


def _codes(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each trigram that lies in one text, and the text."""
    if len(points) < 3:
        return points[:0], points[:0]
    codes = points[:-2] << (2 * _BITS) | points[1:-1] << _BITS | points[2:]
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = text[:-2] == text[2:]
    return codes[whole], text[:-2][whole]


def _gram(code: int) -> str:
    mask = (1 << _BITS) - 1
    return chr(code >> (2 * _BITS)) + chr(code >> _BITS & mask) + chr(code & mask)


def _code(gram: str) -> int:
    a, b, c = map(ord, gram)
    return a << (2 * _BITS) | b << _BITS | c


@dataclass(frozen=True)
class LanguageProfile:
    """Log probability of each trigram (``codes``, sorted) in each language (columns, in the order of ``langs``)."""

    langs: tuple[str, ...]
    codes: np.ndarray
    log_probs: np.ndarray

    @cached_property
    def _shared(self):
        return SparkSession.active().sparkContext.broadcast((self.langs, self.codes, self.log_probs))

    def judge(self, text: Column) -> Column:
        """Struct of ``detected``, the most probable language, and ``confidence``, its probability among those known.

        Ties go to the smallest name; no known gram gives nulls. Trigrams that training has not seen say nothing.
        """
        shared = self._shared

        @F.arrow_udf("struct<detected: string, confidence: double>")
        def judged(heads: pa.Array) -> pa.Array:
            langs, codes, log_probs = shared.value
            rows = max(1, _PIECE // (fixed.LANG_SAMPLE_CHARS * len(langs)))
            scored = [_scores(heads.slice(at, rows).fill_null("").to_pylist(), codes, log_probs) for at in range(0, max(len(heads), 1), rows)]
            scores, known = (np.concatenate(part) for part in zip(*scored, strict=True))
            best = scores.argmax(1)
            odds = np.exp(scores - scores[np.arange(len(scores)), best][:, None]).sum(1)
            detected = pa.array(np.array(langs, object)[best], pa.string(), mask=~known)
            return pa.StructArray.from_arrays([detected, pa.array(1 / odds, mask=~known)], ["detected", "confidence"])

        return judged(F.substring(text, 1, fixed.LANG_SAMPLE_CHARS))

    def detect(self, df: DataFrame, text: str = "full_text", out: str = "detected") -> DataFrame:
        """Add the most probable language; see ``judge``. Narrow."""
        return df.withColumn(out, self.judge(F.col(text))["detected"])

    def table(self, spark: SparkSession) -> DataFrame:
        """``gram, log_probs`` (an entry per language), for saving."""
        rows = pa.table({"gram": [_gram(c) for c in self.codes.tolist()], "log_probs": list(self.log_probs)})
        return spark.createDataFrame(rows)

    @classmethod
    def of(cls, langs: tuple[str, ...], table: DataFrame) -> LanguageProfile:
        """From a saved table; its size is that of the profile that was saved."""
        rows = table.select("gram", "log_probs").toArrow()
        codes = np.array([_code(g) for g in rows.column("gram").to_pylist()], np.int64)
        order = np.argsort(codes)
        probs = np.array(rows.column("log_probs").combine_chunks().flatten()).reshape(len(codes), len(langs))
        return cls(tuple(langs), codes[order], probs[order])


def _scores(texts: list[str], codes: np.ndarray, log_probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score of every text in every language, rounded so that equal scores are ties in every engine; has it a known gram?"""
    out = np.zeros((len(texts), log_probs.shape[1]))
    known = np.zeros(len(texts), bool)
    for at in range(0, len(texts), 256):
        found, text = _codes(*_points(texts[at : at + 256]))
        place = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
        hit = codes[place] == found
        place, text = place[hit], text[hit]
        if len(text):
            first = np.flatnonzero(np.diff(text, prepend=-1))
            out[at + text[first]] = np.add.reduceat(log_probs[place], first)
            known[at + text[first]] = True
    return out.round(6), known


def gram_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """``code, lang, n``: how often each trigram stands in whole texts of each language; partial counts per batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).unique().to_pylist():
                rows = pa.compute.indices_nonzero(pa.compute.equal(batch.column(0), name))
                for part in _pieces(_texts(batch.column(1), rows)):
                    codes, n = np.unique(_codes(*_points(part))[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array([name] * len(codes), pa.string()), pa.array(n)], names=["code", "lang", "n"])

    partial = df.select(F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(count, _CODES)
    return partial.groupBy("code", "lang").agg(F.sum("n").alias("n"))


def _texts(column: pa.Array, rows: pa.Array) -> Iterator[str]:
    """The column's texts in these rows, a few at a time: a batch holds thousands."""
    for at in range(0, len(rows), _ROWS):
        yield from column.take(rows.slice(at, _ROWS)).to_pylist()


def _pieces(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in lists of bounded size; a long text in parts that overlap by two characters."""
    part, size = [], 0
    for text in texts:
        for at in range(0, max(len(text) - 2, 1), _PIECE):
            part.append(text[at : at + _PIECE + 2])
            size += len(part[-1])
            if size >= _PIECE:
                yield part
                part, size = [], 0
    if part:
        yield part


def fit_language(df: DataFrame, text: str = "full_text", lang: str = "lang") -> LanguageProfile:
    """Fit on rows whose language is known. Add-one smoothing over all trigrams of all languages.

    ``df`` is read once. Numbers of languages and of trigrams are checked before anything is collected.
    """
    counts = gram_counts(df.where(F.col(lang).isNotNull()), text, lang).checkpoint()
    sums = counts.groupBy("lang").agg(F.sum("n").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if not sums or len(sums) > MAX_LANGUAGES:
        raise ValueError(f"column {lang!r} has no text of at least three characters, or more than {MAX_LANGUAGES} languages")
    langs = tuple(sorted(r["lang"] for r in sums))
    n_grams = counts.select("code").distinct().count()
    if n_grams > MAX_GRAMS or n_grams * len(langs) > MAX_ENTRIES:
        raise ValueError(f"{n_grams} trigrams in {len(langs)} languages are too many: is column {text!r} text?")
    found = counts.toArrow()
    code, name, n = (np.asarray(found.column(c)) for c in ("code", "lang", "n"))
    codes, row = np.unique(code, return_inverse=True)
    table = np.zeros((n_grams, len(langs)))
    table[row, np.searchsorted(np.array(langs, object), name)] = n
    return LanguageProfile(langs, codes, np.log(table + 1) - np.array([math.log(r + n_grams) for r in table.sum(0)]))
