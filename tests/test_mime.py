"""Mail decoding against the standard library's parser and against composed mails."""

import base64
import binascii
import email
from email.header import decode_header
from email.parser import Parser

from pyspark.sql import functions as F

from hamsieve.operators import mime

B = "Hello there, this is a body long enough.\nSecond line é."
MAILS = {
    "plain": f"Subject: Hi\nX: y\n\n{B}",
    "crlf": "Subject: Hi\r\nX: y\r\n\r\nLine one is here.\r\nLine two.",
    "no_subject": f"From: a@b\n\n{B}",
    "no_header": "just some text that is not a header\nand more",
    "unix_from": f"From me Mon Jan 1\nsUbJeCt: case\n\n{B}",
    "folded": f"Subject: one\n two\n\tthree\n\n{B}",
    "two_subjects": f"Subject: first\nSubject: second\n\n{B}",
    "html_only": "Subject: h\nContent-Type: TEXT/HTML; charset=utf-8\n\n<p>Some html text</p>",
    "image_only": "Subject: i\nContent-Type: image/png\nContent-Transfer-Encoding: base64\n\naGVsbG8gd29ybGQgaGVsbG8=",
    "bad_type": f"Subject: t\nContent-Type: nonsense\n\n{B}",
    "b64": "Subject: b\nContent-Transfer-Encoding: BASE64\n\n" + base64.encodebytes(B.encode()).decode(),
    "b64_nopad": "Subject: b\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode(b"hello wide world").decode().rstrip("="),
    "qp": "Subject: q\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\ncaf=C3=A9 50% + more=20\nsoft =\nbreak a=3Db",
    "short_parts": "Subject: s\nContent-Type: multipart/mixed; boundary=b\n\n--b\n\nshort\n--b\n\nthis one is long enough\n--b--\n",
    "alternative": "Subject: a\nContent-Type: multipart/alternative; boundary=\"b 1\"\n\npre\n--b 1\nContent-Type: text/plain\n\nplain text part here\n--b 1\nContent-Type: text/html\n\n<p>html text part</p>\n--b 1--\nepilogue words here",
    "nested": "Subject: n\nContent-Type: multipart/mixed;\n boundary=out\n\n--out\nContent-Type: multipart/alternative; boundary=in\n\n--in\n\nfirst inner part\n--in\nContent-Type: text/html\n\nsecond inner part\n--in--\ninner epilogue text\n--out\nContent-Type: text/x-log\n\nlog attachment text\n--out\nContent-Type: application/pdf\n\npdf bytes are not text\n--out--\n",
    "unclosed": "Subject: u\nContent-Type: multipart/mixed; boundary=b\n\n--b\n\nnever closed part text",
    "rfc822": "Subject: r\nContent-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: message/rfc822\n\nSubject: inner\n\nforwarded mail body text\n--b--\n",
    "noise_part": "Subject: x\nContent-Type: multipart/mixed; boundary=b\n\n--b\n\ntext with charset=utf-8 inside it\n--b\n\nclean text without noise\n--b--\n",
    "no_boundary": f"Subject: x\nContent-Type: multipart/mixed\n\n{B}",
    "q_word": f"Subject: Re: =?utf-8?Q?caf=C3=A9_au?= lait\n\n{B}",
    "b_words": f"Subject: =?utf-8?B?4oKs?= =?utf-8?B?NTA=?=\n\n{B}",
    "split_char": f"Subject: =?utf-8?B?4oI=?= =?utf-8?B?rA==?=\n\n{B}",
    "latin_word": f"Subject: =?iso-8859-1?Q?f=FCr?= =?utf-8?Q?=C3=BC?=\n\n{B}",
    "unknown_word": f"Subject: =?x-unknown?Q?f=FCr?=\n\n{B}",
    "bad_word": f"Subject: =?utf-8?B?abcde?=\n\n{B}",
    "empty": "",
}
NOISE = ("charset=",)


def header_text(value):
    out = []
    for part, charset in decode_header(value or ""):
        if isinstance(part, bytes):
            try:
                out.append(part.decode(charset or "utf-8", errors="replace"))
            except LookupError:
                out.append(part.decode("latin1"))
        else:
            out.append(part)
    return " ".join(" ".join(out).split())


def part_text(part):
    if not part.get_content_type().startswith("text/"):
        return ""
    if part.get("content-transfer-encoding", "").lower() in ("base64", "quoted-printable"):
        return part.get_payload(decode=True).decode("utf-8", "replace")
    return part.get_payload()


def expected(raw):
    msg = Parser().parsestr(raw.replace("\r\n", "\n"))
    try:
        subject = header_text(msg.get("subject", ""))
    except email.errors.HeaderParseError:
        return "", ""
    parts = list(msg.walk()) if msg.is_multipart() else [msg]
    texts = [part_text(p) for p in parts if not p.is_multipart()]
    kept = [t for t in texts if len(t.strip()) >= 10 and not any(n in t.lower() for n in NOISE)]
    return subject, " ".join(kept)


def expected_serve(raw):
    msg = Parser().parsestr(raw.replace("\r\n", "\n"))
    if msg.is_multipart():
        for p in msg.walk():
            if p.get_content_type() == "text/plain" and not p.is_multipart():
                return p.get_payload(decode=True).decode("utf-8", "replace") if p.get(
                    "content-transfer-encoding"
                ) else p.get_payload()
        return ""
    if msg.get("content-transfer-encoding"):
        return msg.get_payload(decode=True).decode()
    return msg.get_payload()


def tidy(text):
    return "\n".join(line.rstrip() for line in text.split("\n")).strip()


def test_against_standard_library(spark):
    parsed = mime.parse_mails(spark.createDataFrame(list(MAILS.items()), "mail_id string, message string"))
    got = {r["mail_id"]: r for r in mime.corpus_mails(parsed).collect()}
    served = {r["mail_id"]: r for r in mime.serve_mails(parsed).collect()}
    for name, raw in MAILS.items():
        subject, body = expected(raw)
        if name == "no_boundary":
            assert got[name]["body"] == ""
            continue
        assert " ".join(got[name]["subject"].split()) == subject, name
        assert tidy(got[name]["body"]) == tidy(body), name
        assert tidy(served[name]["body"]) == tidy(expected_serve(raw)), name
    assert got["bad_word"]["parse_error"]


def test_latin1_bodies(spark):
    qp = "Content-Transfer-Encoding: quoted-printable\n{}\n\nf=FCr Gr=F6=DFe – = ok=2C é"
    rows = [("undeclared", qp.format("X: y")), ("declared", qp.format("Content-Type: text/plain; charset=ISO-8859-1"))]
    parsed = mime.parse_mails(spark.createDataFrame(rows, "mail_id string, message string"))
    for r in mime.corpus_mails(parsed).collect():
        assert r["body"].startswith("für Größe"), r
    # strict UTF-8 on the serving path: the whole mail is an error
    for r in mime.serve_mails(parsed).collect():
        assert (r["subject"], r["body"], r["parse_error"]) == ("", "", True)


def test_null_mail(spark):
    parsed = mime.parse_mails(spark.createDataFrame([("a", None)], "mail_id string, message string"))
    r = mime.corpus_mails(parsed).first()
    assert (r["subject"], r["body"], r["parse_error"]) == ("", "", True)


def test_parts_are_leaves_in_order(spark):
    parsed = mime.parse_mails(spark.createDataFrame([("n", MAILS["nested"])], "mail_id string, message string"))
    types = [r["content_type"] for r in mime.mail_parts(parsed).orderBy("part_no").collect()]
    assert types == ["text/plain", "text/html", "text/x-log", "application/pdf"]


def test_many_quoted_attributes_do_not_overflow(spark):
    from hamsieve.functions.text import html_text

    long_tag = "<a " + "x='1' " * 50_000 + ">hi</a>"
    df = spark.createDataFrame([(long_tag,)], "x string")
    assert df.select(html_text(F.col("x"))).first()[0] == "hi"


def uu(data, end="`\nend\n", strip=False):
    lines = [binascii.b2a_uu(data[i : i + 45]).decode().rstrip("\n") for i in range(0, len(data), 45)]
    if strip:
        lines = [line.replace("`", " ").rstrip(" ") for line in lines]
    return "begin 644 file name\n" + "\n".join(lines) + "\n" + end


UU = bytes(range(256)) * 2 + b"tail"
UU_BODIES = {
    "whole": uu(UU),
    "short": uu(b"ab"),
    "stripped": uu(bytes(200) + b"x" + bytes(7), strip=True),
    "no_end": uu(UU, ""),
    "text_before": "hello\n\n" + uu(UU) + "and after\n",
    "end_with_blanks": uu(UU, " end \t\nmore"),
    "trailing_sign": "begin 644 x\n" + binascii.b2a_uu(b"check me").decode().rstrip("\n") + "A\nend\n",
    "no_begin": binascii.b2a_uu(b"abc").decode() + "end\n",
    "bad_mode": "begin 9x4 x\n" + binascii.b2a_uu(b"abc").decode() + "end\n",
    "bad_sign": "begin 644 x\n#86)~\nend\n",
    "gap": "begin 644 x\n#86)C\n\n#86)C\nend\n",
}


def test_uuencoded_bodies_equal_the_standard_library(spark):
    head = "Subject: s\nContent-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: {}\n\n"
    mails = {f"{k}/{e}": head.format(e) + b for k, b in UU_BODIES.items() for e in ("x-uuencode", "UUE")}
    df = spark.createDataFrame(list(mails.items()), "mail_id string, message string")
    got = {r["mail_id"]: r["text"] for r in mime.mail_parts(mime.parse_mails(df)).collect()}
    want = {k: email.message_from_string(m).get_payload(decode=True).decode("latin1") for k, m in mails.items()}
    assert got == want


def test_every_declared_set_of_the_platform_is_read(spark):
    """One text per set, in letters that it has, 8-bit and base64, under each of several names."""
    texts = {
        "windows-1255": "שלום", "windows-1256": "سلام", "windows-1257": "ąčęė", "windows-1258": "Việt".replace("ệ", "ê"), "windows-874": "สวัสดี",
        "iso-8859-3": "ĉĝĥĵŝŭ", "iso-8859-4": "ąķĸŗ", "iso-8859-6": "سلام", "iso-8859-8": "שלום", "iso-8859-13": "ąčęė", "iso-8859-16": "ăâîșț",
        "koi8-u": "їєґі", "macintosh": "café", "mac-roman": "café", "mac_cyrillic": "Привет", "cp437": "café", "IBM850": "café", "cp866": "Привет", "tis-620": "สวัสดี",
        "ks_c_5601-1987": "한국어", "iso-2022-kr": "한국어", "utf-32": "é漢😀", "latin2": "łóź", "iso_8859-5": "Привет",
    }
    rows = []
    for name, text in texts.items():
        codec = {"ks_c_5601-1987": "euc-kr", "IBM850": "cp850", "mac_cyrillic": "mac_cyrillic", "iso-2022-kr": "iso2022_kr", "windows-874": "cp874"}.get(name, name)
        data = text.encode(codec)
        rows.append((name, f"Subject: s\nContent-Type: text/plain; charset=\"{name}\"\nContent-Transfer-Encoding: base64\n\n{base64.b64encode(data).decode()}"))
    df = spark.createDataFrame(rows, "mail_id string, message string")
    got = {r["mail_id"]: r["text"] for r in mime.mail_parts(mime.parse_mails(df)).collect()}
    assert got == texts


def test_names_of_no_set_count_as_undeclared(spark):
    body = base64.b64encode("für".encode("latin1")).decode()
    rows = [(n, f"Subject: s\nContent-Type: text/plain; charset={n}\nContent-Transfer-Encoding: base64\n\n{body}") for n in ("x-none", "unknown-8bit")]
    df = spark.createDataFrame(rows, "mail_id string, message string")
    assert {r["text"] for r in mime.mail_parts(mime.parse_mails(df)).collect()} == {"für"}
