"""Which mails are kept: noise rules, length, language; and why the others are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hamsieve.functions import fixed
from hamsieve.functions.text import clean, is_blank, plain_text, trim_ws

_NOISE = "|".join(fixed.NOISE_PATTERNS)


def has_noise(c: Column) -> Column:
    return F.rlike(F.lower(c), F.lit(_NOISE))


def noise_rules(c: Column) -> Column:
    """The noise patterns that occur in ``c``, in rule order."""
    low = F.lower(c)
    hits = [F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in fixed.NOISE_PATTERNS]
    return F.array_compact(F.array(*hits))


def long_enough(c: Column) -> Column:
    return F.char_length(trim_ws(c)) >= fixed.MIN_CHARS


def is_valid(c: Column) -> Column:
    """Non-blank, free of noise, at least ten characters. Null counts as blank."""
    c = F.coalesce(c, F.lit(""))
    return ~is_blank(c) & long_enough(c) & ~has_noise(c)


def with_clean_mail(df: DataFrame, profile: str = "corpus") -> DataFrame:
    """Clean ``subject`` and ``body``; add ``full_text``, their concatenation."""
    return df.withColumns(
        {"subject": clean(F.col("subject"), profile), "body": clean(F.col("body"), profile)}
    ).withColumn("full_text", plain_text(F.col("subject"), F.col("body")))


def reject_reason(
    subject: Column, body: Column, full_text: Column, lang: Column | None = None
) -> Column:
    """First gate a cleaned mail fails, or ``accepted``. Cheap tests first, language last."""
    out = (
        F.when(is_blank(subject) & is_blank(body), "blank")
        .when(has_noise(full_text), "noise")
        .when(~long_enough(full_text), "short")
    )
    if lang is not None:
        out = out.when(~lang.eqNullSafe(F.lit("en")), "language")
    return out.otherwise("accepted")


def reject_report(df: DataFrame, by: str = "source", reason: str = "reason") -> DataFrame:
    """Mails per ``by`` and reason."""
    return df.groupBy(by, reason).agg(F.count(F.lit(1)).alias("mails"))
