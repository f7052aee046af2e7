"""Raw mails to subjects, parts and bodies, as one narrow native projection per mail.

A mail is one row, so its parts stay together in an array column: no regrouping, no shuffle, no
Python. ``mail_parts`` explodes that array when a parts table is wanted.

Multipart mails are cut at every delimiter line of every boundary they declare. The pieces come in
the order in which a walk of the tree meets the parts, at any depth; containers are pieces with a
``multipart/`` type and drop out as non-text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hamsieve.functions.bytes import (
    base64_bytes,
    bytes_to_percent,
    decode_bytes,
    decode_percent,
    escape_percent,
    java_charsets,
    latin1_bytes,
    percent_utf8,
    quoted_printable_to_percent,
    uu_bytes,
)
from hamsieve.functions.let import let
from hamsieve.functions.rows import struct_rows
from hamsieve.functions.text import WS_CHARS
from hamsieve.operators.gates import is_valid

# Header lines and their continuations; the first line that is neither ends the block.
HEADER_BLOCK = (
    r"\A(?:From [^\n]*+\n)?+(?:(?:[!-9;-~]*+:|[ \t])[^\n]*+(?:\n|\z))*+"
)
# A part that is itself a mail: its own headers take the place of the part's.
NESTED_MAIL = (
    r"(?i)\A(?:(?:(?!content-type:)[^\n]++\n)*+"
    r"content-type:[ \t]*+message/rfc822[^\n]*+\n(?:[^\n]++\n)*+\n)++"
)
BOUNDARY = r"""(?i)boundary[ \t]*=[ \t]*"?([^"\n;]+)"""
# The same in the header block of a part: a delimiter line, header lines, and among them the content type.
PART_BOUNDARY = (
    r"(?im)^--[^\n]*+\n(?:(?!content-type:)[!-9;-~]++:[^\n]*+\n(?:[ \t][^\n]*+\n)*+)*+"
    r"""content-type:[ \t]*+multipart/(?:[^\n]|\n[ \t])*?boundary[ \t]*=[ \t]*"?([^"\n;]+)"""
)
ENCODED_WORD = r"=\?[^?\s]+\?[bBqQ]\?[^?]*\?="
_BETWEEN_WORDS = r"(=\?[^?\s]+\?[bBqQ]\?[^?]*\?=)\s+(?==\?[^?\s]+\?[bBqQ]\?[^?]*\?=)"
_WORD_OR_TEXT = rf"{ENCODED_WORD}|(?:(?!{ENCODED_WORD})(?s:.))++"


def _extract(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group)


def unix_newlines(raw: Column) -> Column:
    return F.replace(raw, F.lit("\r\n"), F.lit("\n"))


def split_mail(mail: Column) -> Column:
    """Struct ``header, body`` of a mail or part with unix newlines."""

    def cut(m: Column) -> Column:
        return let(
            _extract(m, HEADER_BLOCK, 0),
            lambda h: F.struct(
                F.regexp_replace(h, F.lit(r"\n[ \t]+"), F.lit(" ")).alias("header"),
                F.regexp_replace(
                    F.substr(m, F.char_length(h) + F.lit(1)), F.lit(r"\A\n"), F.lit("")
                ).alias("body"),
            ),
        )

    return let(mail, cut)


def header_value(header: Column, name: str) -> Column:
    """First value of a header in an unfolded block, whatever its case; empty when missing."""
    return _extract(header, rf"(?imd)^{name}:[ \t]*+([^\n]*+)", 1)


# --- header words ------------------------------------------------------------------------------


def _word(token: Column) -> Column:
    """Struct ``charset, percent, broken`` of one encoded word or of plain text."""
    is_word = F.rlike(token, F.lit(rf"\A{ENCODED_WORD}\z"))
    charset = F.lower(_extract(token, r"\A=\?([^?*\s]+)", 1))
    is_b64 = F.lower(_extract(token, r"\A=\?[^?\s]+\?([bBqQ])\?", 1)) == "b"
    data = _extract(token, r"\A=\?[^?\s]+\?[bBqQ]\?([^?]*)\?=\z", 1)
    q = quoted_printable_to_percent(F.replace(data, F.lit("_"), F.lit(" ")))
    n_data = F.char_length(F.regexp_replace(data, F.lit("[^A-Za-z0-9+/]"), F.lit("")))
    return F.struct(
        F.when(is_word, charset).otherwise("").alias("charset"),
        F.when(~is_word, escape_percent(token))
        .when(is_b64, bytes_to_percent(base64_bytes(data)))
        .otherwise(q)
        .alias("percent"),
        F.coalesce(is_word & is_b64 & (n_data % 4 == 1), F.lit(False)).alias("broken"),
    )


def _merge(words: Column) -> Column:
    """Join neighbours of one character set before decoding: a character may span two words."""

    def step(acc: Column, w: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = F.coalesce(last["charset"] == w["charset"], F.lit(False))
        joined = F.struct(
            w["charset"].alias("charset"),
            F.concat(last["percent"], w["percent"]).alias("percent"),
            (last["broken"] | w["broken"]).alias("broken"),
        )
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(same, F.concat(head, F.array(joined))).otherwise(
            F.concat(acc, F.array(w))
        )

    empty = F.array().cast("array<struct<charset:string,percent:string,broken:boolean>>")
    return F.aggregate(words, empty, step)


def decode_header(raw: Column) -> Column:
    """Struct ``text, broken``: encoded words decoded, pieces of different sets joined by a space."""

    def encoded(value: Column) -> Column:
        tight = F.regexp_replace(value, F.lit(_BETWEEN_WORDS), F.lit("$1"))
        words = F.transform(F.regexp_extract_all(tight, F.lit(_WORD_OR_TEXT), F.lit(0)), _word)
        return let(
            _merge(words),
            lambda ws: F.struct(
                F.array_join(
                    F.transform(ws, lambda w: decode_percent(w["percent"], w["charset"])), " "
                ).alias("text"),
                F.exists(ws, lambda w: w["broken"]).alias("broken"),
            ),
        )

    plain = F.struct(raw.alias("text"), F.lit(False).alias("broken"))
    return F.when(F.rlike(raw, F.lit(ENCODED_WORD)), encoded(raw)).otherwise(plain)


# --- parts -------------------------------------------------------------------------------------


def _content_type(value: Column) -> Column:
    kind = F.lower(F.btrim(F.substring_index(value, ";", 1), F.lit(WS_CHARS)))
    return F.when(F.rlike(kind, F.lit(r"\A[^/]+/[^/]+\z")), kind).otherwise("text/plain")


#: The names of that transfer encoding.
UUENCODED = ("x-uuencode", "uuencode", "uue", "x-uue")


def _typed(hb: Column, part_no: Column) -> Column:
    """Struct ``header, body`` to a struct with the header values that matter."""
    declared = header_value(hb["header"], "content-type")
    return F.struct(
        part_no.cast("int").alias("part_no"),
        let(declared, _content_type).alias("content_type"),
        F.lower(_extract(declared, r"""(?i)charset\s*=\s*"?([^";\s]+)""", 1)).alias("charset"),
        F.lower(
            F.btrim(header_value(hb["header"], "content-transfer-encoding"), F.lit(WS_CHARS))
        ).alias("encoding"),
        hb["body"].alias("body"),
    )


def _decoded(p: Column, latin1: Column) -> Column:
    """Add ``text`` (declared or guessed character set) and ``strict`` (UTF-8, null if it is not).

    ``latin1`` says that the mail was read byte by byte: an 8-bit part is then still to be decoded.
    """

    def out(text: Column, strict: Column) -> Column:
        return F.struct(
            p["part_no"].alias("part_no"),
            p["content_type"].alias("content_type"),
            p["charset"].alias("charset"),
            p["encoding"].alias("encoding"),
            text.alias("text"),
            strict.alias("strict"),
        )

    def from_bytes(b: Column) -> Column:
        as_text = b.cast("string")
        return out(decode_bytes(b, p["charset"]), F.when(F.is_valid_utf8(as_text), as_text))

    def as_read(text: Column) -> Column:
        return F.when(latin1, latin1_bytes(text)).otherwise(F.encode(text, "UTF-8"))

    def from_percent(q: Column) -> Column:
        utf8 = percent_utf8(q)
        return out(
            decode_percent(q, p["charset"]), F.when(~F.contains(utf8, F.lit("�")), utf8)
        )

    return (
        F.when(p["encoding"] == "base64", let(base64_bytes(p["body"]), from_bytes))
        .when(
            p["encoding"] == "quoted-printable",
            let(quoted_printable_to_percent(p["body"]), from_percent),
        )
        .when(p["encoding"].isin(*UUENCODED), let(F.coalesce(uu_bytes(p["body"]), as_read(p["body"])), from_bytes))
        .when(latin1, let(latin1_bytes(p["body"]), from_bytes))
        .otherwise(out(p["body"], p["body"]))
    )


def _delimiter(boundaries: Column) -> Column:
    quoted = F.transform(
        boundaries,
        # A boundary that holds the end of the quotation is quoted around it.
        lambda b: F.concat(F.lit(r"\Q"), F.replace(F.rtrim(b), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")),
    )
    return F.concat(
        F.lit(r"(?md)^--(?:"), F.array_join(quoted, "|"), F.lit(r")(?=(?:--)?[ \t]*$)")
    )


def _pieces(body: Column, boundaries: Column) -> Column:
    """Part texts of a multipart body. What follows a closing delimiter is not a part."""
    cut = F.split(body, _delimiter(boundaries))
    opened = F.filter(
        F.slice(cut, F.lit(2), F.size(cut)), lambda s: ~F.startswith(s, F.lit("--"))
    )
    return F.transform(
        opened,
        lambda s: F.regexp_replace(
            F.regexp_replace(s, F.lit(r"\A[ \t]*\n|\n\z"), F.lit("")), F.lit(NESTED_MAIL), F.lit("")
        ),
    )


def parse_mails(df: DataFrame, raw: str = "message") -> DataFrame:
    """Replace ``raw`` by ``subject_raw, is_multipart, parts, parse_error``.

    A column ``latin1`` tells mails that were read byte by byte (see ``sources.corpus.decode_mails``); without
    it no mail was. ``parts``: array of ``part_no, content_type, charset, encoding, text, strict`` in walk order; a
    mail without parts is its own only one. The text of non-text parts is not decoded.
    """
    latin1 = F.coalesce(F.col("latin1"), F.lit(False)) if "latin1" in df.columns else F.lit(False)
    mail = split_mail(unix_newlines(F.coalesce(F.col(raw), F.lit(""))))
    out = df.withColumn("_m", mail).withColumn(
        "_declared", header_value(F.col("_m.header"), "content-type")
    )
    # Only a mail that says it is multipart is searched for more boundaries.
    top = F.startswith(_content_type(F.col("_declared")), F.lit("multipart/")) & F.rlike(
        F.col("_declared"), F.lit(BOUNDARY)
    )
    out = out.withColumn("is_multipart", top).withColumn(
        "_boundaries",
        F.when(
            F.col("is_multipart"),
            F.array_distinct(
                F.concat(
                    F.regexp_extract_all(F.col("_declared"), F.lit(BOUNDARY), F.lit(1)),
                    F.regexp_extract_all(F.col("_m.body"), F.lit(PART_BOUNDARY), F.lit(1)),
                )
            ),
        ),
    )
    split_pieces = F.transform(_pieces(F.col("_m.body"), F.col("_boundaries")), split_mail)
    typed = F.when(
        F.col("is_multipart"), F.transform(split_pieces, lambda hb, i: _typed(hb, i + 1))
    ).otherwise(F.array(_typed(F.col("_m"), F.lit(0))))
    subject = F.rtrim(header_value(F.col("_m.header"), "subject"))
    with java_charsets(df.sparkSession):
        out = out.withColumn("parts", F.transform(typed, lambda p: _decoded(p, latin1)))
    return (
        out.withColumn("subject_raw", subject)
        .withColumn("parse_error", F.col(raw).isNull())
        .drop("_m", "_declared", "_boundaries", "latin1", raw)
    )


def mail_parts(parsed: DataFrame, id_col: str = "mail_id") -> DataFrame:
    """One row per leaf part; containers are left out."""
    return struct_rows(parsed, [id_col], F.col("parts"), "part_no").where(
        ~F.startswith("content_type", F.lit("multipart/"))
    )


def _is_text(p: Column) -> Column:
    return F.startswith(p["content_type"], F.lit("text/"))


def corpus_mails(parsed: DataFrame) -> DataFrame:
    """Subject and body for the corpus: decoded subject; every valid text part, joined by spaces."""
    with java_charsets(parsed.sparkSession):
        parsed = parsed.withColumn("_s", decode_header(F.col("subject_raw")))
    kept = F.filter(F.col("parts"), lambda p: _is_text(p) & is_valid(p["text"]))
    body = F.array_join(F.transform(kept, lambda p: p["text"]), " ")
    return _finish(
        parsed.withColumn("parse_error", F.col("parse_error") | F.col("_s.broken")),
        F.col("_s.text"),
        body,
    )


def serve_mails(parsed: DataFrame) -> DataFrame:
    """Subject and body for scoring: raw subject; the first plain part, or the whole of a mail
    without parts whatever its type. Text that is not UTF-8 is a parse error."""
    first_plain = F.get(
        F.filter(F.col("parts"), lambda p: p["content_type"] == "text/plain"), F.lit(0)
    )
    chosen = F.when(F.col("is_multipart"), first_plain).otherwise(F.get("parts", F.lit(0)))
    return _finish(
        parsed.withColumn("_p", chosen).withColumn(
            "parse_error",
            F.col("parse_error") | (F.col("_p").isNotNull() & F.col("_p.strict").isNull()),
        ),
        F.col("subject_raw"),
        F.coalesce(F.col("_p.strict"), F.lit("")),
    )


def _finish(df: DataFrame, subject: Column, body: Column) -> DataFrame:
    """A mail that fails to parse keeps its row, with both texts empty."""
    return (
        df.withColumn("subject", F.when(F.col("parse_error"), "").otherwise(subject))
        .withColumn("body", F.when(F.col("parse_error"), "").otherwise(body))
        .drop("parts", "subject_raw", "is_multipart", "_s", "_p")
    )
