"""Mark-up removal without a parser: ordered native replacements, then character references.

Limits against a real HTML parser: broken mark-up may leave other residue, and a ``>`` inside an
attribute is understood only when the attribute is quoted.
"""

from __future__ import annotations

from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from hamsieve.functions.let import let

COMMENT = r"(?s)<!--.*?(?:-->|\z)"
# The text of these elements is code or is not shown.
HIDDEN = r"(?is)<({})\b[^>]*+>.*?(?:</\1[^>]*+>|\z)".format("script|style|template")
DECLARATION = r"<[!?][^>]*+>"
# Possessive loops: no backtracking and no recursion, however long the tag.
TAG_QUOTED = r"""(?i)</?[a-z][^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>"""
TAG_PLAIN = r"(?i)</?[a-z][^>]*+>"

_PAIR, _ENTRY = "\x02", "\x01"


def _names(source) -> dict[str, str]:
    return {k.rstrip(";"): v for k, v in source if k.rstrip(";").islower()}


# Text is lower-cased before this step, so lower-case names are all that can occur. The older,
# shorter set is asked first because map look-up is a scan.
_COMMON = _names((k, chr(v)) for k, v in name2codepoint.items())
_RARE = {k: v for k, v in _names(html5.items()).items() if k not in _COMMON}
# Numbers 128..159 mean the Windows-1252 characters at those places.
_C1 = "".join(chr(i) for i in range(0x80, 0xA0))
_C1_TEXT = "".join(
    bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(0x80, 0xA0)
)


def _lookup(names: dict[str, str], key: Column) -> Column:
    text = _ENTRY.join(k + _PAIR + v for k, v in names.items())
    # One literal that the optimizer folds to a map once per query.
    table = F.str_to_map(F.lit(text), F.lit(_ENTRY), F.lit(_PAIR))
    return F.try_element_at(table, key)


def strip_tags(c: Column) -> Column:
    """Remove tags, comments, declarations and hidden elements; nothing is put in their place."""
    out = c
    for pattern in (COMMENT, HIDDEN, DECLARATION, TAG_QUOTED, TAG_PLAIN):
        out = F.regexp_replace(out, F.lit(pattern), F.lit(""))
    return out


def _numeric(ref: Column) -> Column:
    is_hex = F.substring(ref, 2, 1).isin("x", "X")
    code = F.when(
        is_hex, F.conv(F.substr(ref, F.lit(3)), 16, 10).cast("long")
    ).otherwise(F.substr(ref, F.lit(2)).cast("long"))
    usable = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    char = F.when(code.between(0x80, 0x9F), F.translate(char, _C1, _C1_TEXT)).otherwise(char)
    return F.when(usable, char).otherwise("�")


def _decode_piece(p: Column) -> Column:
    """``p`` is the text after an ampersand, up to the next one."""
    ref = F.regexp_extract(p, r"^(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*)", 0)
    rest = F.regexp_replace(F.substr(p, F.length(ref) + F.lit(1)), F.lit("^;"), F.lit(""))
    char = F.when(F.startswith(ref, F.lit("#")), _numeric(ref)).otherwise(
        F.coalesce(_lookup(_COMMON, ref), _lookup(_RARE, ref), F.concat(F.lit("&"), ref))
    )
    return F.when(ref == "", F.concat(F.lit("&"), p)).otherwise(F.concat(char, rest))


def _decode(pieces: Column) -> Column:
    tail = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: let(p, _decode_piece))
    return F.concat(F.get(pieces, F.lit(0)), F.array_join(tail, ""))


def decode_entities(c: Column) -> Column:
    """Named and numeric character references become characters; unknown names lose their ``;``.

    ``c`` is read several times: pass a plain column or a bound value (see ``let``).
    """
    return F.when(F.contains(c, F.lit("&")), let(F.split(c, "&"), _decode)).otherwise(c)


def visible_text(c: Column) -> Column:
    return let(strip_tags(c), decode_entities)
