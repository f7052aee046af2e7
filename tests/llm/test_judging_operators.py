"""Pages, URLs, quality, leaks, mixing and the pipeline."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from hamsieve.llm import decontam
from hamsieve.llm.decontam import WindowTable, _Codes, contaminated, find_leaks, leaks_of, without_leaks
from hamsieve.llm.html import extract_pages, main_text
from hamsieve.llm.mixing import BUDGET, calibrate, draw, margins, mix, rake, token_count
from hamsieve.llm.quality import NeighbourModel, fit_neighbours, keep_good, score_quality, term_rows
from hamsieve.llm.urls import DigestArray, digest_file, judge_urls

ARTICLE = "<h1>A &amp; B</h1><p>First, with <b>bold</b>\n and  <a href='#'>links</a>.</p><p>Second&nbsp;one.<br>Same block. <p>Be."
WANT = "A & B\n\nFirst, with bold and links.\n\nSecond one. Same block.\n\nBe."
AROUND = (
    "<html><head><title>T</title><style>p{{}}</style></head><body><header>Site name</header><nav><ul><li><a>Menu</a></ul></nav>"
    "<div class='cookie-notice'>We use cookies, do you agree? Yes, of course.</div>{}<aside>Side, bar, with signs.</aside>"
    "<form><p>Sign up, please.</p></form><section id='comments'><p>I do not agree, at all.</p></section>"
    "<script>var a = '<p>no</p>';</script><footer>&copy; me, 2020</footer></body></html>"
)


def test_main_text_of_an_article():
    assert main_text(AROUND.format(f"<article>{ARTICLE}<div class='ad'>Buy, now!</div></article>")) == WANT


def test_main_text_without_an_article():
    assert main_text(AROUND.format(f"<div id='main'>{ARTICLE}</div>")) == WANT


def test_odd_pages():
    assert main_text("") == "" and main_text("<nav>only</nav>") == "" and main_text("<script>x") == ""
    assert main_text("plain, text < 5 &lt; 6") == "plain, text < 5 < 6"
    assert main_text("<article><p>a" + " b" * 100_000) == "a" + " b" * 100_000
    assert main_text("</p></div><article><p>one</b></i></article>") == "one"


def test_pages(spark):
    rows = [(1, "u", AROUND.format(f"<article>{ARTICLE}</article>"), "x"), (2, None, None, "x"), (None, "v", "", "x"), (1, "u", "<p>x.</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"] or 0), r["url"] or "", r["text"], r["n_chars"]) for r in extract_pages(df).collect())
    assert got == [(0, "v", "", 0), (1, "u", WANT, len(WANT)), (1, "u", "x.", 2), (2, "", "", 0)]
    assert extract_pages(df.limit(0)).collect() == []


RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"))
URLS = {
    "http://Example.COM/en/1": "example.com/en/", "http://a.example.com/en/": "example.com/en/", "http://www.example.com/en/x?q": "www.example.com/en/",
    "http://example.com/en": "com/", "http://example.com": None, "http://badexample.com/en/": "com/", "x://net/es/#f": "net/es/",
    "http://b.net/es": None, "http://b.net/ES/": None, "no scheme": None, "http://net.org/es/": None, "": None, None: None, "a://b://c.net/es/": None,
}


def test_urls(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)]
    got = {r["page_id"]: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), RULES).collect()}
    verdicts = dict(RULES)
    for i, (url, rule) in enumerate(URLS.items()):
        assert (got[i]["rule"], got[i]["verdict"]) == (rule, verdicts.get(rule, "allow")), url
    assert (got[0]["host"], got[0]["path"]) == ("example.com", "/en/1")
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).collect() == []


def test_many_digests_and_a_collision(tmp_path, monkeypatch):
    import xxhash

    def write_digests(rules, folder):
        path = tmp_path / f"{len(rules)}.bin"
        path.write_bytes(digest_file(rules))
        return str(path)

    rules = [(f"h{i}.org/p{i}", "block") for i in range(2000)]
    array = DigestArray(write_digests(rules, str(tmp_path)))
    assert (np.diff(array.digests.astype(object)) >= 0).all()
    assert [array.text(k) for k in array.find([r for r, _ in rules])] == [r for r, _ in rules]
    assert (array.find(["h1.org/p2", "x"]) == -1).all()
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda s: 7)
    array = DigestArray(write_digests([("a/x", "block"), ("b/x", "allow")], str(tmp_path)))
    assert [array.text(k) if k >= 0 else None for k in array.find(["b/x", "a/x", "c/x"])] == ["b/x", "a/x", None]
    assert (DigestArray(write_digests([], str(tmp_path))).find(["a/"]) == -1).all()


def prose(r, n=60):
    words = "the of and river stone light morning walked under quiet bridge towards village market".split()
    return " ".join(r.choice(words) for _ in range(n)).capitalize() + "."


def junk(r, kind):
    w = prose(r).split()
    return (" | ".join(w), " ".join(x + "###" for x in w), " ".join(x.upper() + "!!" for x in w), " ".join(x for x in w[:6] for _ in range(10)))[kind]


def test_quality_on_held_out_texts(make, spark):
    r = random.Random(1)
    texts = [prose(r) if i % 5 else junk(r, (i // 5) % 4) for i in range(400)]
    docs = make(list(enumerate(texts)) + [(900, ""), (901, None), (902, prose(r, 50_000))])
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(200)] + [(3, None), (None, 1), (5000, 0)], "doc_id long, quality int")
    model = fit_neighbours(docs, labels)
    got = {x["doc_id"]: x for x in score_quality(docs, model).collect()}
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in got.values())
    wrong = [i for i in range(200, 400) if got[i]["predicted"] != int(i % 5 > 0)]
    assert len(wrong) <= 2
    assert got[900]["score"] == got[901]["score"] == pytest.approx(0.8) and got[902]["predicted"] == 1
    kept = keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {x["doc_id"] for x in kept.select("doc_id").collect()} == {i for i, x in got.items() if x["predicted"]}
    assert score_quality(make([]), model).collect() == []


def test_cosines_equal_brute_force():
    r = random.Random(2)
    terms = term_rows(pa.array([prose(r) if i % 3 else junk(r, i % 4) for i in range(60)]))
    labels = np.array([i % 3 > 0 for i in range(60)], float)
    model = NeighbourModel(terms[:40], labels[:40])
    for t, got in zip(terms[40:], model.scores(terms[40:], 5), strict=True):
        v = (t * model.weights) @ model.basis
        cosine = model.vectors @ (v / np.linalg.norm(v))
        near = np.argsort(cosine)[-5:]
        weight = np.maximum(cosine[near], 0) ** 8
        assert got == pytest.approx((weight * labels[:40][near]).sum() / weight.sum(), abs=1e-4)
    assert (NeighbourModel(terms[:0], labels[:0]).scores(terms[:3]) == 0.5).all()


QUESTION = "A train leaves Paris at 300 km per hour with 12 people for Lyon. How many minutes does it take if Lyon is 450 km away from Paris?"
CHANGED = "A train leaves Berlin at 250 miles per hour with 17 people for Munich. How many minutes does it take if Munich is 600 miles away from Berlin?"
MIXED = "A train leaves Berlin at 250 km per hour with 17 people for Munich. How many minutes does it take if Hamburg is 250 km away from Rome?"


def test_templates_and_slots():
    table = WindowTable([(1, QUESTION)])
    codes = _Codes(table.vocabulary)

    def match(text):
        found = find_leaks(text, table, codes)
        return found[0][2] if found else None

    whole = table.totals[0]
    assert match("Before it. " + QUESTION + " After it.").windows == whole
    assert match(QUESTION).changed == 0 and match(CHANGED).windows == whole and match(CHANGED).changed == 9
    # The second name no longer stands for what it stood for: its windows do not count.
    assert match(MIXED) is None or match(MIXED).windows < whole
    assert match("A train leaves at noon. Nobody knows how many minutes it takes.") is None
    assert match(QUESTION.replace("300 km", "300km")).windows >= whole - 5


def test_copies_in_other_case_or_with_other_spaces():
    table = WindowTable([(1, QUESTION)])
    codes = _Codes(table.vocabulary)
    copies = [QUESTION.lower(), QUESTION.upper(), QUESTION.title()]
    copies += [t.replace(" ", space) for t in (QUESTION, copies[0]) for space in ("\u00a0", "\u3000", "\u2009", "\x85", "\x1f")]
    seen = dict(table.stretches(pa.array(["before it " + t + " after it" for t in copies])))
    for k, t in enumerate(copies):
        found = find_leaks("before it " + t + " after it", table, codes)
        assert leaks_of(seen[k], table, codes) == found and [(item, m.changed) for item, _, m in found] == [(0, 0)], t
    # Other words between the names are no copy in any case.
    assert not find_leaks("a boat sails from paris to lyon with 12 people. how far is paris?", table, codes)


def test_the_glance_misses_nothing():
    r = random.Random(3)
    items = [(i, prose(r, r.randint(2, 40)).replace("river", r.choice(["Paris", "7 km", "river", "É tang", "$5"]))) for i in range(40)]
    table = WindowTable(items)
    codes = _Codes(table.vocabulary)
    texts = [prose(r, 30) for _ in range(60)] + [prose(r, 10) + " " + t.replace("Paris", "New York").replace("7 km", "9km") + " " + prose(r, 10) for _, t in items]
    seen = dict(table.stretches(pa.array(texts)))
    for k, t in enumerate(texts):
        assert leaks_of(seen.get(k, []), table, codes) == find_leaks(t, table, codes)


@pytest.mark.parametrize("glance_bytes", [4 << 20, 3000])
def test_stretches_of_long_texts_hold_what_the_texts_hold(monkeypatch, glance_bytes):
    """Copies far apart, at both ends, behind names and glued figures, and windows without a copy around them."""
    monkeypatch.setattr(decontam, "GLANCE_BYTES", glance_bytes)
    monkeypatch.setattr(decontam, "CHUNK", 2000)
    r = random.Random(9)
    items = [(i, prose(r, r.choice([3, 5, 6, 12, 30]))) for i in range(25)] + [(30, QUESTION), (31, "Anna Lee has 5 km to go."), (32, "go")]
    table = WindowTable(items)
    codes = _Codes(table.vocabulary)
    texts = []
    for k in range(60):
        parts = [prose(r, r.choice([0, 1, 300])) + r.choice(["", " Then Bob", " 7km", " Anna Lee", "　x"])]
        for _ in range(r.choice([1, 1, 2, 4])):
            copy = r.choice(items)[1]
            words = copy.split()
            parts += [r.choice([copy, CHANGED, copy.lower(), " ".join(words[: len(words) // 2])]), prose(r, r.choice([0, 2, 90, 400]))]
        texts.append(" ".join(parts[:: 1 if k % 2 else -1]))
    seen = dict(table.stretches(pa.array(texts)))
    held = [find_leaks(t, table, codes) for t in texts]
    assert sum(map(bool, held)) > 30
    for k, want in enumerate(held):
        assert leaks_of(seen.get(k, []), table, codes) == want


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_contaminated(make, spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block_bytes)
    r = random.Random(4)
    items = [(i, prose(r, 25)) for i in range(6)] + [(20, QUESTION), (21, ""), (22, None)]
    clean = [(i, prose(r, 80)) for i in range(20)] + [(50, ""), (51, None)]
    dirty = [(100 + i, "unrelated opening words " + t + " unrelated closing words") for i, t in items[:6]] + [(120, "See: " + CHANGED)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make(clean + dirty)
    got = {(x["doc_id"], x["item_id"]) for x in contaminated(docs, bench).collect()}
    assert got == {(100 + i, i) for i in range(6)} | {(120, 20)}
    assert {x["doc_id"] for x in without_leaks(docs, bench).collect()} == {i for i, _ in clean}
    assert contaminated(docs, bench.limit(0)).collect() == [] and contaminated(make([]), bench).collect() == []


def test_raking_meets_all_margins(spark):
    r = random.Random(6)
    cells = [(s, g, t, r.randint(1, 1000)) for s in "abc" for g in "xy" for t in "pq" if (s, g) != ("a", "y")]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.2, "b": 0.5, "c": 0.3}, "lang": 0.5, "topic": 0.0}
    got = {(x["margin"], x["value"]): x["share"] for x in margins(rake(df, targets), ["source", "lang", "topic"], F.col("weight")).collect()}
    had = Counter()
    for _, g, _, n in cells:
        had[g] += n
    root = {g: n**0.5 for g, n in had.items()}
    want = {("source", "a"): 0.2, ("source", "b"): 0.5, ("source", "c"): 0.3, ("topic", "p"): 0.5, ("topic", "q"): 0.5}
    want |= {("lang", g): v / sum(root.values()) for g, v in root.items()}
    assert got == {k: pytest.approx(v, abs=1e-4) for k, v in want.items()}


def test_mix_draws_to_the_targets(make):
    r = random.Random(7)
    docs = make([(i, prose(r, 20 + i % 30)) for i in range(3000)] + [(-1, ""), (-2, None)], source=lambda i: "big" if i % 4 else "small")
    got = mix(docs, {"source": {"big": 0.5, "small": 0.5}}).collect()
    assert len(got) == 3002 and {x["probability"] for x in got if x["source"] == "small" and x["tokens"]} == {1.0}
    taken = Counter()
    for x in got:
        taken[x["source"]] += x["tokens"] * x["selected"]
    assert taken["big"] / sum(taken.values()) == pytest.approx(0.5, abs=0.03)
    assert sum(x["weight"] for x in got) == pytest.approx(1)
    kept = draw(docs, {"source": {"big": 0.5, "small": 0.5}})
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == {x["doc_id"] for x in got if x["selected"]}
    assert mix(make([])).collect() == [] and mix(make([(1, None)])).collect()[0]["selected"] in (True, False)


def test_a_scarce_cell_scales_nothing_down(spark):
    cells = [(f"s{k}", g, 1000 * (k + 1) * n, 10 * (k + 1)) for k in range(5) for g, n in (("x", 3), ("y", 1))]
    schema = "source string, lang string, tokens long, docs long"
    targets = {"source": 0.7, "lang": 0.8}
    total = sum(c[2] for c in cells) + 5
    found = calibrate(spark.createDataFrame([*cells, ("stray", "x", 5, 1)], schema), targets)
    rates = {(x["source"], x["lang"]): x["_rate"] for x in found.rates.collect()}
    assert rates["stray", "x"] == 1.0 and max(rates.values()) == 1.0
    # The stray document is short by itself; the budget is drawn all the same, and the margins of the others hold.
    got = {(x["margin"], x["value"]): x for x in found.reached.collect()}
    assert sum(x["given"] for (m, _), x in got.items() if m == "source") == pytest.approx(BUDGET * total, rel=1e-4)
    assert got["source", "stray"]["given"] == 5 < got["source", "stray"]["asked"]
    one, other = got["source", "s1"], got["source", "s3"]
    assert one["given"] / other["given"] == pytest.approx((one["had"] / other["had"]) ** 0.7, rel=1e-4)
    assert got["lang", "x"]["given"] == pytest.approx(got["lang", "x"]["asked"], rel=1e-4)
    whole = calibrate(spark.createDataFrame(cells, schema), targets, budget=1.0)
    assert {x["_rate"] for x in whole.rates.collect()} == {1.0}


def test_token_count(make):
    texts = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, " a  b\tc\n")]
    got = make(texts).select("doc_id", token_count(F.col("text")).alias("k")).collect()
    assert {x["doc_id"]: x["k"] for x in got} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 3}


def test_pipeline_stages(spark, sf, make):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.limit(5)).unionByName(docs.limit(5).withColumn("doc_id", F.col("doc_id") + 100_000))
    before = {x["doc_id"]: x["text"] for x in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        rows = out.collect()
        assert rows and all(before[x["doc_id"]] == x["text"] for x in rows)
        if name == "near_duplicates":
            assert len({x["doc_id"] for x in rows}) == len(rows) and not [x for x in rows if x["doc_id"] >= 100_000]
        docs = spark.createDataFrame(rows, out.schema)
    assert corpus_pipeline.STAGES[4][1](spark, docs, sf).count() == docs.count()


def test_registered():
    names = set(queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert {"op5_url_filters", "op9_exact_dedup"} <= set(oracle_sql())
