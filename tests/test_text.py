import re

import pytest
from pyspark.sql import functions as F

from hamsieve.functions import text as T
from hamsieve.functions.bytes import decode_bytes, decode_ignoring
from hamsieve.operators import gates as G
from hamsieve.functions import fixed

GOLDEN = [
    ("Visit HTTPS://x.co/a?b=1 NOW!!! or www.foo.com, mail Bob@x.org.", "visit now!!! or mail", "visit now or mail"),
    ("wwwhatever xhttpy http end", "wwwhatever xhttpy http end", "x http end"),
    ("a_b-c; d: e/f (g) É½ café", "a_b-c d e f g é½ café", "a_b c d e f g é½ café"),
    ("Price: $5,000.00?  50% @ noon", "price 5,000.00? 50 noon", "price 5 000 00 50 noon"),
    ("see httpd docs, name=joe", "see httpd docs, name joe", "see docs name joe"),
    ("x@y", "", ""),
    (" \t   ", "", ""),
    ("<p>a</p><p>b</p>", "ab", "ab"),
    ("<script>x</script>hi", "hi", "hi"),
    ("a &amp; b <b>c</b>", "a b c", "a b c"),
    ("1 < 2", "1 2", "1 2"),
    ("<a title='x>y' b=\"c\">q</a> &#233;&#xE9; &Eacute;", "q éé é", "q éé é"),
    ("<!-- a > b --><style>p{}</style>z", "z", "z"),
    ("@foo a@ @a@b c", "foo a c", "foo a c"),
    (None, "", ""),
]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


def test_cleaners(spark):
    rows = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "i int, x string")
    got = {
        r["i"]: (r["c"], r["s"])
        for r in rows.select(
            "i", T.clean(F.col("x"), "corpus").alias("c"), T.clean(F.col("x"), "serve").alias("s")
        ).collect()
    }
    assert got == {i: (g[1], g[2]) for i, g in enumerate(GOLDEN)}


def test_unknown_profile():
    with pytest.raises(ValueError):
        T.clean(F.lit("x"), "other")


def test_cleaning_is_idempotent_and_equals_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    once = docs.select("text", T.clean(F.col("text")).alias("once"))
    rows = once.select("text", "once", T.clean(F.col("once")).alias("twice")).collect()
    assert rows
    for r in rows:
        assert r["once"] == r["twice"]
        t = re.sub(r"https?://\S+|www\.\S+", "", r["text"].lower())
        t = re.sub(r"[^\w\s.,!?-]", " ", re.sub(r"\S+@\S+", "", t))
        assert r["once"] == re.sub(r"\s+", " ", t).strip()


def test_long_token_is_linear(spark):
    blob = "a" * 300_000
    assert one(spark, blob + " x@y", T.clean(F.col("x"))) == blob


def test_entities(spark):
    text = "<i>&lt;&amp;lt; &middot;&copy; &#150; &#x1F600; &nope; &nsupseteq; & &#0;</i>"
    assert one(spark, text, T.html_text(F.col("x"))) == "<&lt; ·© – 😀 &nope ⊉ & �"


def test_model_text(spark):
    df = spark.createDataFrame([("  ", None), ("Hi  X", "B\nC")], "s string, b string")
    got = [r[0] for r in df.select(T.model_text(F.col("s"), F.col("b"))).collect()]
    assert got == ["[SUBJECT] [NO SUBJECT] [BODY] [NO BODY]", "[SUBJECT] hi x [BODY] b c"]


def test_noise_and_length(spark):
    rows = [(p, f"some words {p.upper()} more words") for p in fixed.NOISE_PATTERNS]
    got = spark.createDataFrame(rows, "p string, x string").select(
        "p", G.is_valid(F.col("x")).alias("ok"), G.noise_rules(F.col("x")).alias("rules")
    ).collect()
    for r in got:
        assert not r["ok"] and r["p"] in r["rules"]
    for text, ok in (("123456789", False), ("1234567890", True), ("  123456789 ", False), (None, False)):
        assert one(spark, text, G.is_valid(F.col("x"))) is ok


def test_reject_reasons(spark):
    df = spark.createDataFrame(
        [("", ""), ("", "see base64 text here"), ("ab", "cd"), ("fine words", "here now")], "subject string, body string"
    )
    got = G.with_clean_mail(df).select(
        G.reject_reason(F.col("subject"), F.col("body"), F.col("full_text"), F.lit("en"))
    )
    assert [r[0] for r in got.collect()] == ["blank", "noise", "short", "accepted"]


def test_bytes(spark):
    rows = [
        ("é€".encode(), "utf-8", "é€", "é€"),
        ("é".encode("latin1"), "", "é", ""),
        ("“x”".encode("cp1252"), "Windows-1252", "“x”", "x"),
        (b"\xffabc", "utf-8", "�abc", "abc"),
        ("привет".encode("koi8-r"), "koi8-r", "привет", ""),
        (b"plain", None, "plain", "plain"),
    ]
    df = spark.createDataFrame([(bytearray(b), c, i) for i, (b, c, *_) in enumerate(rows)], "b binary, c string, i int")
    got = df.orderBy("i").select(decode_bytes(F.col("b"), F.col("c")), decode_ignoring(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(d, g) for _, _, d, g in rows]
