"""Operators on whole texts against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hamsieve.llm import blocks, lm, suffixes
from hamsieve.llm.components import connected_components
from hamsieve.llm.exact import directory, exact_groups
from hamsieve.llm.jaccard import first_of_groups, near_groups
from hamsieve.llm.kernels import shingle_hashes, words
from hamsieve.llm.lm import score_texts
from hamsieve.llm.sharding import shard_rows

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))


def shingles(text, k):
    w = tokens(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_kernel_counts_words_and_shingles(corpus):
    texts = [t or "" for _, t in corpus]
    got = {}
    for first, h, bounds in words(pa.array(texts)):
        s, ends = shingle_hashes(h, bounds, 3)
        for d in range(len(ends) - 1):
            got[first + d] = (bounds[d + 1] - bounds[d], len(np.unique(s[ends[d] : ends[d + 1]])))
    assert got == {i: (len(tokens(t)), len(shingles(t, 3))) for i, t in enumerate(texts)}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard(make, corpus, k, percent):
    rows = corpus + [corpus[0]]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_groups(make(rows), k, percent).collect()}
    sets = {i: shingles(t, k) for i, t in corpus}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert got == {i: (len(sets[i]), find(i)) for i in sets}
    assert len({find(i) for i in sets}) < len(sets) - 10


def test_jaccard_of_different_texts_under_one_id(make):
    def text(name, changed=""):
        return " ".join(f"{name}{i}" for i in range(60)) + changed

    # No id and an id that repeats, each with several texts; copies of all but the first text of each.
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (7, text("d")), (7, text("e")), (7, text("e")), (None, ""), (8, "")]
    rows += [(20, text("b", " more")), (21, text("c", " more")), (5, text("e", " more")), (22, text("f"))]
    got = Counter((r["doc_id"], r["component_id"]) for r in near_groups(make(rows), 3, 90).collect())
    want = [(None, None), (None, 20), (None, 21), (None, None), (5, 5), (7, 5), (7, 5), (7, 7), (8, 8), (20, 20), (21, 21), (22, 22)]
    assert got == Counter(want)
    kept = first_of_groups(make(rows), 3, 90)
    assert kept.columns == make(rows).columns
    found = sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect())
    copies = [(20, text("b", " more")), (21, text("c", " more")), (5, text("e", " more"))]
    assert found == sorted([*copies, (0, text("a")), (0, ""), (8, ""), (7, text("d")), (22, text("f"))])


def test_jaccard_of_nothing(make):
    assert near_groups(make([])).collect() == []


def test_jaccard_of_a_large_group_with_frequent_tokens(make):
    body = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(body)
        w[(i * 7) % 120] = f"own{i}"
        if i % 3 == 0:
            w[(i * 11 + 5) % 120] = f"other{i}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in near_groups(make(rows), 3, 90).collect()}
    sets = {i: shingles(t, 3) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both) and label[i] > label[j]:
                    label[i] = label[j]
                    changed = True
    assert got == label


@pytest.mark.parametrize("keys", [[5], [0, 1], [1, 2**63, 2**64 - 1], list(range(0, 2**40, 2**33 + 7))])
def test_packed_keys(keys):
    keys = np.array(keys, np.uint64)
    assert (blocks.unpack(blocks.pack(keys)) == keys).all()


def test_components_of_a_long_path(spark, make):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def plain_scores(seqs, learn, order):
    """Per text: its tokens, known ones, base score and score, by dictionaries and the definition of the probabilities."""
    grams = [Counter() for _ in range(order + 1)]
    for i in learn:
        padded = ["<s>", *seqs[i]]
        for k in range(1, order + 1):
            for end in range(1, len(padded)):
                if end - k + 1 >= (0 if k > 1 else 1):
                    grams[k][tuple(padded[end - k + 1 : end + 1])] += 1
    one = grams[1]
    n, v = sum(one.values()), len(one)
    n1, n2 = (sum(c == k for c in one.values()) for k in (1, 2))
    d = min(max(n1 / (n1 + 2 * n2), 0.1), 0.9) if n1 + n2 else 0.5

    def probability(context, w):
        if not context:
            return (one[w,] - d) / n if one[w,] else d * v / n
        shorter = probability(context[1:], w)
        c = len(learn) if context == ("<s>",) else grams[len(context)][context]
        if not c:
            return shorter
        share = 0.3 + 0.7 * 4 / (4 + c)
        return (1 - share) * grams[len(context) + 1][*context, w] / c + share * shorter

    out = {}
    for i, s in seqs.items():
        padded = ["<s>", *s]
        base = sum(math.log10((one[w,] + 0.1) / (n + 0.1 * (v + 1))) for w in s)
        score = sum(math.log10(probability(tuple(padded[max(0, at - order + 1) : at]), padded[at])) for at in range(1, len(padded)))
        out[i] = (len(s), sum(one[w,] > 0 for w in s), n, base, score)
    return out


@pytest.mark.parametrize(("order", "lane"), [(1, 512), (2, 512), (2, 7), (3, 512), (3, 5), (4, 512)])
def test_scores(make, corpus, monkeypatch, order, lane):
    monkeypatch.setattr(lm, "LANE", lane)
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    rows = [(i, t) for i, t in corpus if t is None or len(t) < 20_000] if order > 2 else corpus
    got = {r["doc_id"]: tuple(r)[1:] for r in score_texts(make(rows), train, order=order).collect()}
    learn = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 10}
    want = plain_scores({i: [*tokens(t), None] for i, t in rows}, learn, order)
    assert {i: r[:3] for i, r in got.items()} == {i: r[:3] for i, r in want.items()}
    assert {i: r[3:] for i, r in got.items()} == {i: pytest.approx(r[3:]) for i, r in want.items()}


def test_states_and_arcs(make):
    """Two texts, a bigram model: what the automaton is made of, and the way of a word it has not seen."""
    seq, bounds = lm._sequence(pa.array(["a b a", "a c"]))
    counts = {k: np.unique(g, return_counts=True)[1] for k, g in enumerate(lm._grams(seq, bounds, 2), 1)}
    model = lm.BackoffAutomaton(seq, bounds, 2, counts, lm.Totals(7, 4, 2, 1, 2))
    # The empty context, the begin, and one state per word; an arc for every word, and for each pair that was seen.
    assert len(model.failure) == 2 + 4 and (model.failure == 0).all() and model.paid[0] == 0 and (model.paid[1:] < 0).all()
    assert len(model.arc) == 4 + 6 and (np.diff(model.arc) > 0).all()
    assert (model.target[model.arc // model.words == 0] > 0).all()
    a, b = model.word[0], model.word[1]
    state = {w: int(model.entered[list(model.word).index(w)]) for w in (a, b)}
    assert state[b] * model.words + b not in model.arc and state[a] * model.words + b in model.arc


def test_no_training(make, corpus):
    few = corpus[:20]
    assert {r["score"] for r in score_texts(make(few), F.lit(False)).collect()} == {0.0}
    assert {r["score"] for r in score_texts(make(few), F.lit(False), order=3).collect()} == {0.0}
    assert score_texts(make([]), F.lit(True)).collect() == []


@pytest.mark.parametrize(("block_bytes", "hot"), [(1 << 20, suffixes.HOT), (20_000, suffixes.HOT), (20_000, 3), (1 << 20, 1)])
def test_repeats(make, corpus, block_bytes, hot):
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.remove_repeats(make(corpus), block_bytes=block_bytes, hot=hot).collect()}
    data = {i: (t or "").encode() for i, t in corpus}
    first = {}
    for i in sorted(data):
        for p in range(len(data[i]) - 49):
            first.setdefault(data[i][p : p + 50], i)
    want = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        want[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    assert got == want
    assert sum(w[1] for w in want.values()) > 3000


def test_repeats_within_one_text_stay(make):
    text = "abcdefghij klmnopqrst uvwxyz " * 20
    got = suffixes.remove_repeats(make([(1, text), (1, text), (2, "short"), (None, text)])).collect()
    by = sorted((r["doc_id"] is None, r["n_removed"]) for r in got)
    assert by == [(False, 0), (False, 0), (False, 0), (True, len(text))]
    assert suffixes.remove_repeats(make([])).collect() == []


def test_exact(make, corpus):
    rows = corpus + [corpus[3], (None, "of its own"), (7, "o ne"), (8, "o  n e")]
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -9), *tuple(r)[1:]) for r in exact_groups(make(rows)).collect())
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    want = []
    for norm, members in groups.items():
        keep = max(members, key=lambda m: (len(m[1]), -(m[0] if m[0] is not None else 1 << 62)))[0]
        for i, _ in members:
            want.append((i if i is not None else -9, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    assert got == sorted(want)
    assert exact_groups(make([])).collect() == []


def test_the_directory_splits_only_overfull_buckets(spark):
    # Half of the hashes share their six leading bits, so only that region goes deep.
    values = [(k * 0x9E3779B97F4A7C15) % 2**64 for k in range(1, 401)]
    values += [(0b101010 << 58) | (v >> 6) for v in values]
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    rows = directory(spark.createDataFrame(signed, "hash long"), capacity=40, max_depth=8).collect()
    found = {r["slot"]: (r["bucket"], r["depth"]) for r in rows}
    held = Counter(found[v >> 56] for v in values)
    for (bucket, depth), n in held.items():
        assert n <= 40 or depth == 8
        # A shorter address would have been overfull.
        assert depth == 1 or sum(v >> (64 - depth + 1) == bucket >> (8 - depth + 1) for v in values) > 40
    assert sum(held.values()) == len(values) and {d for _, d in held} >= {4, 8}


def test_sharding(make, corpus):
    rows = corpus + [corpus[0], (-5, "below zero"), (1 << 62, "large"), (None, None)]
    got = shard_rows(make(rows), 24).collect()
    assert len(got) == len(rows)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    for r in got:
        key = r["doc_id"] or 0
        assert (r["shard"], r["grown_shard"], r["law"]) == (jump(key, 24), jump(key, 25), "key")
        assert (r["size"], r["text_crc32"]) in {(len(t.encode()) + 8, zlib.crc32(t.encode())) for t in texts[r["doc_id"]]}
        assert r["grown_shard"] in (r["shard"], 24)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_rows(make([]), 24).collect() == []


def test_native_operators_run_no_python(make, corpus):
    for df in (shard_rows(make(corpus), 24), exact_groups(make(corpus))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
