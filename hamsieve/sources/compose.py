"""Compose raw mails from tables of texts, so that the decoders have real input at any scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hamsieve.functions.bytes import java_charsets

FORMATS = ("plain", "base64", "quoted", "alternative", "nested")


def _b64(c: Column) -> Column:
    return F.base64(F.encode(c, "UTF-8"))


def _quoted(c: Column) -> Column:
    """Quoted-printable in lines of at most 60 units."""
    q = F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit(" ")), F.lit("%"), F.lit("="))
    return F.regexp_replace(q, F.lit("((?:=[0-9A-F]{2}|[^=]){60})"), F.lit("$1=\n"))


def _b64_word(c: Column) -> Column:
    return F.concat(
        F.lit("=?utf-8?B?"), F.regexp_replace(_b64(c), F.lit(r"\s"), F.lit("")), F.lit("?=")
    )


def _q_word(c: Column) -> Column:
    q = F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("_")), F.lit("%"), F.lit("="))
    return F.concat(F.lit("=?UTF-8?Q?"), q, F.lit("?="))


def html_body(body: Column) -> Column:
    return F.concat(F.lit("<html><body><p>"), body, F.lit("</p></body></html>"))


def compose_mails(df: DataFrame, id_col: str, subject: str, body: str) -> DataFrame:
    """``mail_id, format, message``: each row becomes one raw mail, in a format chosen by its id."""
    i, s, b = F.col(id_col), F.col(subject), F.col(body)
    fmt = F.element_at(
        F.array(*[F.lit(f) for f in FORMATS]), (F.pmod(i, F.lit(len(FORMATS))) + 1).cast("int")
    )
    head = F.concat(
        F.lit("From: a@example.org\nTo: b@example.org\nMIME-Version: 1.0\n"),
    )
    plain_head = "Content-Type: text/plain; charset=utf-8\n"
    alt = F.concat(
        F.lit("--alt\nContent-Type: text/plain; charset=utf-8\n\n"),
        b,
        F.lit("\n--alt\nContent-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"),
        _b64(html_body(b)),
        F.lit("\n--alt--\n"),
    )
    message = (
        F.when(fmt == "plain", F.concat(F.lit("Subject: "), s, F.lit("\n"), head, F.lit("\n"), b))
        .when(
            fmt == "base64",
            F.concat(
                head, F.lit("SUBJECT: "), _q_word(s), F.lit("\n" + plain_head),
                F.lit("Content-Transfer-Encoding: base64\n\n"), _b64(b), F.lit("\n"),
            ),
        )
        .when(
            fmt == "quoted",
            F.concat(
                head, F.lit("Subject:\n "), s, F.lit("\n" + plain_head),
                F.lit("Content-Transfer-Encoding: quoted-printable\n\n"), _quoted(b),
            ),
        )
        .when(
            fmt == "alternative",
            F.concat(
                F.lit("subject: "), s, F.lit("\n"), head,
                F.lit('Content-Type: multipart/alternative; boundary="alt"\n\npreamble\n'), alt,
            ),
        )
        .otherwise(
            F.concat(
                head, F.lit("Subject: "), _b64_word(s),
                F.lit("\nContent-Type: multipart/mixed;\n boundary=outer\n\n"),
                F.lit("--outer\nContent-Type: multipart/alternative; boundary=alt\n\n"), alt,
                F.lit("epilogue\n--outer\nContent-Type: image/png; name=\"x.png\"\n"),
                F.lit("Content-Transfer-Encoding: base64\n\niVBORw0KGgo=\n--outer--\nbye\n"),
            )
        )
    )
    return df.select(i.alias("mail_id"), fmt.alias("format"), message.alias("message"))


#: Character sets and the letters that stand for a to z in mails written in them.
ALPHABETS = (
    ("koi8-r", "абцдефгхийклмнопярстувшыжз"),
    ("windows-1251", "абцдефгхийклмнопярстувшыжз"),
    ("iso-8859-2", "aącćdeęfghijklłmnńoóprsśtu"),
    ("gb2312", "天地人你我他上下大小中国学生老师工作时间地方朋友水火"),
    ("shift_jis", "アイウエオカキクケコサシスセソタチツテトナニヌネノハ"),
    ("big5", "天地人你我他上下大小中國學生老師工作時間地方朋友水火"),
    ("windows-1255", "אבגדהוזחטיךכלםמןנסעףפץצקרש"),
    ("windows-1256", "ابتثجحخدذرزسشصضطظعغفقكلمنه"),
    ("windows-874", "กขคฆงจฉชซญฎฏฐฑฒณดตถทธนบปผฝ"),
    ("windows-1257", "aābcčdeēgģiīkķlļnņsšuūzžąė"),
    ("iso-8859-3", "abcĉdefgĝhĥijĵklmnopsŝuŭġż"),
    ("koi8-u", "абвгґдеєжзиіїйклмнопрстуфх"),
)
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
TRANSFERS = ("8bit", "quoted-printable", "base64")


def foreign_text(text: Column, which: Column) -> Column:
    """``text`` in lower case with the letters of one of ``ALPHABETS``; what is not ASCII becomes a question mark."""
    plain = F.lower(F.regexp_replace(text, F.lit(r"[^\x00-\x7F]"), F.lit("?")))
    out = plain
    for k, (_, letters) in enumerate(ALPHABETS):
        out = F.when(which == k, F.translate(plain, _LETTERS, letters)).otherwise(out)
    return out


def compose_foreign_mails(df: DataFrame, id_col: str, subject: str, body: str) -> DataFrame:
    """``mail_id, content``: each row becomes the bytes of a mail in a character set and transfer encoding chosen by its id.

    Every fiftieth cannot be read: one has no content, the next a broken word as its subject.
    """
    i = F.col(id_col)
    which = F.pmod(i, F.lit(len(ALPHABETS)))
    transfer = F.pmod(F.floor(i / len(ALPHABETS)), F.lit(len(TRANSFERS)))
    s, b = foreign_text(F.col(subject), which), foreign_text(F.col(body), which)

    def encoded(text: Column) -> Column:
        out = F.encode(text, "UTF-8")
        for k, (name, _) in enumerate(ALPHABETS):
            out = F.when(which == k, F.encode(text, name)).otherwise(out)
        return out

    name = F.element_at(F.array(*[F.lit(n) for n, _ in ALPHABETS]), (which + 1).cast("int"))
    with java_charsets(df.sparkSession):
        # Resolved column by column, while the sets are known.
        bytes_ = df.select(i.alias("mail_id"), name.alias("_set"), transfer.alias("_transfer"), encoded(s).alias("_s"), encoded(b).alias("_b"))
    word = F.concat(F.lit("=?"), "_set", F.lit("?B?"), F.regexp_replace(F.base64("_s"), F.lit(r"\s"), F.lit("")), F.lit("?="))
    broken = F.lit("=?utf-8?B?abcde?=")
    head = F.concat(
        F.lit("Subject: "), F.when(F.pmod("mail_id", F.lit(50)) == 8, broken).otherwise(word),
        F.lit("\nContent-Type: text/plain; charset="), F.col("_set"), F.lit("\nContent-Transfer-Encoding: "),
        F.element_at(F.array(*[F.lit(t) for t in TRANSFERS]), (F.col("_transfer") + 1).cast("int")), F.lit("\n\n"),
    )
    quoted = F.regexp_replace(F.regexp_replace(F.hex("_b"), F.lit("(..)"), F.lit("=$1")), F.lit("((?:=..){20})"), F.lit("$1=\n"))
    whole = (
        F.when(F.col("_transfer") == 0, F.concat(F.encode(head, "UTF-8"), "_b"))
        .when(F.col("_transfer") == 1, F.encode(F.concat(head, quoted), "UTF-8"))
        .otherwise(F.encode(F.concat(head, F.base64("_b")), "UTF-8"))
    )
    content = F.when(F.pmod("mail_id", F.lit(50)) != 7, whole)
    return bytes_.select("mail_id", content.alias("content"))


def uu_lines(content: Column) -> Column:
    """Bytes as uuencoded lines of 45 bytes, without the first and last line."""
    chunks = F.regexp_extract_all(F.hex(content), F.lit("(?:..){1,45}"), F.lit(0))

    def line(chunk: Column) -> Column:
        six = F.translate(F.regexp_replace(F.base64(F.unhex(chunk)), r"\s", ""), _SIX, _UU)
        return F.concat(F.char((F.length(chunk) / 2).cast("int") + 32), six)

    return F.array_join(F.transform(chunks, line), "\n")


_SIX = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/="
_UU = "`" + "".join(map(chr, range(33, 96))) + "`"


def compose_uu_mails(df: DataFrame, id_col: str, subject: str, body: str) -> DataFrame:
    """``mail_id, message``: each row becomes a mail with a uuencoded body; by its id blanks at line ends are lost, or the last line."""
    i = F.col(id_col)
    name = F.element_at(F.array(*map(F.lit, ("x-uuencode", "uuencode", "X-UUE", "uue"))), (F.pmod(i, F.lit(4)) + 1).cast("int"))
    lines = uu_lines(F.encode(F.col(body), "UTF-8"))
    lost = F.regexp_replace(F.replace(lines, F.lit("`"), F.lit(" ")), r"(?m) +$", "")
    message = F.concat(
        F.lit("Subject: "), F.col(subject), F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: "), name,
        F.lit("\n\nbegin 644 a text.txt"), F.when(F.col(body) != "", F.concat(F.lit("\n"), F.when(F.pmod(i, F.lit(3)) == 1, lost).otherwise(lines))).otherwise(""),
        F.when(F.pmod(i, F.lit(5)) == 2, F.lit("\n")).otherwise(F.lit("\n`\nend\n")),
    )
    return df.select(i.alias("mail_id"), message.alias("message"))
