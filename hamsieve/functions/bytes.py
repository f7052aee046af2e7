"""Bytes to text, natively, for the character sets mail is written in."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from encodings.aliases import aliases
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from hamsieve.functions.let import let

_HIGH = "".join(chr(i) for i in range(0x80, 0x100))
_UTF8_NAMES = ("utf-8", "utf8", "us-ascii", "ascii")
# Declared name -> codec that says what bytes 0x80..0xFF mean, for the commonest; all others are the platform's.
_SINGLE_BYTE = {
    "iso-8859-1": "latin-1",
    "latin1": "latin-1",
    "iso-8859-2": "iso8859-2",
    "iso-8859-5": "iso8859-5",
    "iso-8859-7": "iso8859-7",
    "iso-8859-9": "iso8859-9",
    "iso-8859-15": "iso8859-15",
    "windows-1250": "cp1250",
    "windows-1251": "cp1251",
    "windows-1252": "cp1252",
    "windows-1253": "cp1253",
    "windows-1254": "cp1254",
    "koi8-r": "koi8-r",
}
_JAVA_SETS = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")


@contextmanager
def java_charsets(spark: SparkSession) -> Iterator[None]:
    """Within, expressions may name any character set of the Java platform, and replace what does not fit.

    Spark notes both settings in each expression when it is resolved, so that plans built within keep them
    and the session goes on with its own.
    """
    before = {k: spark.conf.get(k) for k in _JAVA_SETS}
    try:
        for k in _JAVA_SETS:
            spark.conf.set(k, "true")
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@lru_cache(maxsize=1)
def platform_charsets() -> dict[str, str]:
    """Lower-cased name -> name of the set in the Java platform, for all names that the platform or Python has for its sets."""
    available = SparkSession.active()._jvm.java.nio.charset.Charset.availableCharsets()
    names = {}
    for canonical in available.keySet():
        for name in (canonical, *available.get(canonical).aliases()):
            names.setdefault(name.lower(), canonical)
    squeezed = {re.sub("[^a-z0-9]", "", n): c for n, c in sorted(names.items(), reverse=True)}
    for alias, codec in aliases.items():
        found = squeezed.get(re.sub("[^a-z0-9]", "", codec))
        for name in (alias, alias.replace("_", "-"), codec, codec.replace("_", "-")) if found else ():
            names.setdefault(name, found)
    return names


def _java_name(charset: Column) -> Column:
    """The platform's name of a declared set; null where it has none. A folded constant, not a branch per name."""
    table = "\n".join(f"{name}\t{java}" for name, java in platform_charsets().items())
    return F.str_to_map(F.lit(table), F.lit("\n"), F.lit("\t"))[charset]


def _upper_half(codec: str) -> str:
    return "".join(bytes([i]).decode(codec, "replace") for i in range(0x80, 0x100))


def _by_charset(
    charset: Column, utf8: Column, latin1: Column, undeclared: Column, content: Column
) -> Column:
    """Pick by declared character set. ``latin1`` is the text with byte n as character n."""
    out = F.when(charset.isin(*_UTF8_NAMES), utf8)
    by_codec: dict[str, list[str]] = {}
    for name, codec in _SINGLE_BYTE.items():
        by_codec.setdefault(codec, []).append(name)
    for codec, names in by_codec.items():
        text = latin1 if codec == "latin-1" else F.translate(latin1, _HIGH, _upper_half(codec))
        out = out.when(charset.isin(*names), text)
    # An empty name is no key, and needs no lookup.
    named = F.when(charset != "", _java_name(charset))
    return out.otherwise(let(named, lambda java: F.when(java.isNull(), undeclared).otherwise(F.call_function("decode", content, java))))


def latin1_text(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def latin1_bytes(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def decode_bytes(content: Column, charset: Column | None = None) -> Column:
    """Binary to string: the declared character set, else UTF-8 when valid, else Latin-1.

    Bytes that the declared set cannot read become U+FFFD; nothing raises. Build it within ``java_charsets``.
    """
    charset = F.lit("") if charset is None else F.lower(F.coalesce(charset, F.lit("")))
    valid = F.is_valid_utf8(content.cast("string"))
    utf8 = F.make_valid_utf8(content.cast("string"))
    latin1 = latin1_text(content)
    return _by_charset(charset, utf8, latin1, F.when(valid, utf8).otherwise(latin1), content)


def decode_ignoring(content: Column) -> Column:
    """Binary to string as UTF-8; bytes that do not fit are dropped."""
    text = F.make_valid_utf8(content.cast("string"))
    valid = F.is_valid_utf8(content.cast("string"))
    return F.when(valid, text).otherwise(F.replace(text, F.lit("�"), F.lit("")))


def base64_bytes(text: Column) -> Column:
    """Lenient base64: foreign characters are ignored, missing padding is supplied."""

    def padded(data: Column) -> Column:
        over = F.length(data) % 4
        # A single left-over character carries no whole byte.
        return (
            F.when(over == 0, data)
            .when(over == 1, F.substring(data, F.lit(1), F.length(data) - 1))
            .otherwise(F.concat(data, F.repeat(F.lit("="), F.lit(4) - over)))
        )

    data = F.regexp_replace(text, F.lit("[^A-Za-z0-9+/]+"), F.lit(""))
    return F.unbase64(let(data, padded))


#: Six bits as uuencode writes them, and as base64 does.
_UU = " " + "".join(map(chr, range(33, 96))) + "`"
_SIX = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/A"


def uu_bytes(text: Column) -> Column:
    """Bytes of uuencoded text; null where it has no first line, or a line that isn't uuencode.

    After a line ``begin mode name`` each line tells its number of bytes by its first character and has
    four characters for three bytes; blanks that were lost at its end are supplied, what stands behind is
    left out. A line ``end`` ends it, or the text.
    """
    lines = F.regexp_extract(text, r"(?s)(?:\A|\n)begin [0-7]+(?: [^\n]*)?\n(.*)", 1)
    body = F.split(F.regexp_replace(lines, r"(?s)(?:\A|\n)[ \t\r\f]*end[ \t\r\f]*(?:\n.*)?\z", ""), "\n")
    body = F.transform(body, lambda line: F.rtrim(line, F.lit("\r")))
    # The last line end leaves an empty line that is none.
    body = F.when(F.element_at(body, -1) == "", F.slice(body, F.lit(1), F.size(body) - 1)).otherwise(body)
    size = lambda line: (F.ascii(line) - 32).bitwiseAND(F.lit(63))
    wanted = lambda line: F.ceil(size(line) / 3).cast("int") * 4
    broken = F.exists(body, lambda line: ~F.rlike(F.substring(line, F.lit(1), wanted(line) + 1), F.lit(r"\A[ -`]+\z")))

    def unpacked(line: Column) -> Column:
        chars = F.translate(F.rpad(F.substring(line, F.lit(2), wanted(line)), wanted(line), F.lit(" ")), _UU, _SIX)
        return F.substring(F.hex(F.unbase64(chars)), F.lit(1), size(line) * 2)

    found = F.rlike(text, F.lit(r"(?:\A|\n)begin [0-7]+(?: [^\n]*)?\n"))
    return F.when(found & ~broken, F.unhex(F.array_join(F.transform(body, unpacked), "")))


# --- percent form: text in which byte XX is written %XX and a literal % is %25 ------------------


def escape_percent(text: Column) -> Column:
    text = F.replace(text, F.lit("%"), F.lit("%25"))
    return F.replace(text, F.lit("+"), F.lit("%2B"))


def quoted_printable_to_percent(text: Column) -> Column:
    """Drop soft line breaks and trailing blanks, turn ``=XX`` into ``%XX``."""
    text = F.regexp_replace(escape_percent(text), F.lit(r"[ \t]++(?=\n|\z)"), F.lit(""))
    text = F.regexp_replace(text, F.lit(r"=(?:\n|\z)"), F.lit(""))
    return F.regexp_replace(text, F.lit("=([0-9A-Fa-f]{2})"), F.lit("%$1"))


def bytes_to_percent(content: Column) -> Column:
    return F.regexp_replace(F.hex(content), F.lit("(..)"), F.lit("%$1"))


def percent_utf8(p: Column) -> Column:
    return F.try_url_decode(p)


def percent_latin1(p: Column) -> Column:
    """Read each %XX as the character XX: rewrite the upper half to its two UTF-8 bytes."""
    p = F.regexp_replace(p, F.lit("%([89ABab][0-9A-Fa-f])"), F.lit("%!2%$1"))
    for digit, low in zip("CDEF", "89AB"):
        p = F.regexp_replace(
            p, F.lit(f"%[{digit}{digit.lower()}]([0-9A-Fa-f])"), F.lit(f"%!3%{low}$1")
        )
    return F.try_url_decode(F.replace(p, F.lit("%!"), F.lit("%C")))


def decode_percent(p: Column, charset: Column) -> Column:
    """Percent form to string, by the same rules as ``decode_bytes``."""
    charset = F.lower(F.coalesce(charset, F.lit("")))
    utf8, latin1 = percent_utf8(p), percent_latin1(p)
    undeclared = F.when(F.contains(utf8, F.lit("�")), latin1).otherwise(utf8)
    return _by_charset(charset, utf8, latin1, undeclared, latin1_bytes(latin1))
