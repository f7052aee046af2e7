"""Text cleaning as native column expressions.

Three profiles exist because the three users of text want different things:

* ``corpus``: what is stored for training; keeps ``. , ! ? -``.
* ``serve``:  what a mail handed in for scoring becomes; keeps letters, digits and ``_`` only.
* ``model``:  lower case and single spaces only.

``\\s`` and ``\\w`` of Java are ASCII, so the Unicode classes are spelled out.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from hamsieve.functions import fixed
from hamsieve.functions.html import decode_entities, visible_text
from hamsieve.functions.let import let

WS = r"\s\x0B\x1C-\x1F\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
# Every white-space character, for trimming by character set (linear, unlike a pattern at the end).
WS_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

URL_CORPUS = rf"https?://[^{WS}]+|www\.[^{WS}]+"
URL_SERVE = rf"(?:http|www)[^{WS}]+"
# Only tried at the start of a token: from there on it finds what a start anywhere would find, and
# a long token without "@" costs one pass instead of one per character.
ADDRESS = rf"(?<![^{WS}])[^{WS}]+@[^{WS}]+"
SYMBOLS_CORPUS = rf"[^{WORD}{WS}.,!?-]"
SYMBOLS_SERVE = rf"[^{WORD}{WS}]"

PROFILES = ("corpus", "serve", "model")


def _sub(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(replacement))


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def squeeze_ws(c: Column) -> Column:
    """Runs of white space become one space; the ends are trimmed."""
    return F.trim(_sub(c, rf"[{WS}]+", " "))


def is_blank(c: Column) -> Column:
    return F.coalesce(trim_ws(c) == "", F.lit(True))


def html_text(c: Column, gated: bool = True) -> Column:
    """Lower-cased text without mark-up. ``gated``: only where both ``<`` and ``>`` occur."""
    if gated:
        return let(
            F.lower(c),
            lambda low: F.when(
                F.contains(low, F.lit("<")) & F.contains(low, F.lit(">")), visible_text(low)
            ).otherwise(low),
        )
    return let(
        F.lower(c),
        lambda low: F.when(F.contains(low, F.lit("<")), visible_text(low)).otherwise(
            decode_entities(low)
        ),
    )


def clean(c: Column, profile: str = "corpus") -> Column:
    """Clean ``c`` with one of ``PROFILES``; null becomes an empty string."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; use one of {PROFILES}")
    c = F.coalesce(c, F.lit(""))
    if profile == "model":
        return squeeze_ws(F.lower(c))
    serve = profile == "serve"
    hosts = ("http", "www") if serve else ("http", "www.")
    c = html_text(c, gated=not serve)
    # Most texts hold neither a link nor an address: a substring test saves two pattern scans.
    c = let(c, lambda t: _sub_where(t, hosts, URL_SERVE if serve else URL_CORPUS))
    c = let(c, lambda t: _sub_where(t, ("@",), ADDRESS))
    c = _sub(c, SYMBOLS_SERVE if serve else SYMBOLS_CORPUS, " ")
    return squeeze_ws(c)


def _sub_where(t: Column, needles: tuple[str, ...], pattern: str) -> Column:
    """Delete ``pattern`` from the texts that hold any of ``needles``, which it needs to match."""
    found = reduce(or_, [F.contains(t, F.lit(n)) for n in needles])
    return F.when(found, _sub(t, pattern, "")).otherwise(t)


def marked_text(subject: Column, body: Column, placeholders: bool = False) -> Column:
    """``[SUBJECT] s [BODY] b``; with ``placeholders`` a blank side gets its stand-in."""
    subject, body = F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit(""))
    if placeholders:
        subject = F.when(is_blank(subject), fixed.NO_SUBJECT).otherwise(subject)
        body = F.when(is_blank(body), fixed.NO_BODY).otherwise(body)
    return F.concat(
        F.lit(fixed.SUBJECT_MARK + " "), subject, F.lit(" " + fixed.BODY_MARK + " "), body
    )


def model_text(subject: Column, body: Column) -> Column:
    """Text as the sequence encoder reads it: model profile, placeholders, marks."""
    return marked_text(clean(subject, "model"), clean(body, "model"), placeholders=True)


def plain_text(subject: Column, body: Column) -> Column:
    """``subject + ' ' + body``; a missing side counts as empty."""
    return F.concat(F.coalesce(subject, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))


def first_line(text: Column) -> Column:
    """The part before the first newline, or an empty string where there is none."""
    return F.when(F.instr(text, "\n") > 0, F.substring_index(text, "\n", 1)).otherwise("")


def after_first_line(text: Column) -> Column:
    at = F.instr(text, "\n")
    return F.when(at > 0, F.substr(text, at + F.lit(1))).otherwise(text)


def percent(c: Column) -> Column:
    """0.1234 -> '12.3%'."""
    return F.format_string("%.1f%%", c * 100)
