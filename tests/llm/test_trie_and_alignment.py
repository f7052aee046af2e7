"""The conversation trie and the alignment of tokenizers against plain versions."""

import hashlib
import itertools
import os
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hamsieve.llm import align as alignment
from hamsieve.llm.align import align, gallop, token_groups
from hamsieve.llm.trie import conversation_trie, graft, measured, number_turns, prefix_trie

TOKENIZERS = os.environ.get("HAMSIEVE_TOKENIZERS", "/opt/tokenizers")
CONVERSATIONS = "conv_id long, turn long, role string, text string, depth long, a string, n_convs string, block string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "x", "x") for r in rows], CONVERSATIONS).repartition(3)


def paths_of(rows):
    """Turns of each conversation in order; equal numbers by digest."""
    out = {}
    for conv, turn, role, text in rows:
        if conv is None:
            continue
        role, text = role or "", text or ""
        key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
        out.setdefault(conv, []).append(((turn is not None, turn or 0, key), (role, text)))
    return {c: [t for _, t in sorted(turns)] for c, turns in out.items()}


def grafted(paths):
    out = {}
    for c, own in paths.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = paths.get(base, [])[:h] + own[h:]
    return out


def trie_of(paths):
    """Every node by plain dictionaries."""
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    children = Counter(p[:-1] for p in members if p)
    out = set()
    for p, convs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = sorted(c for c in convs if len(paths[c]) == len(p))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(members[p[:-1]]) if p else None
        out.add((min(convs), len(p), parent, len(convs), children[p], sum(not children[q] for q in below), saved, digest, len(ends)))
    return out


def nodes(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def dialogues():
    """Shared openings, whole copies, long conversations, ties, nulls, empty and very long texts, negative ids."""
    r = random.Random(3)
    rows = []
    for c in [*range(-7, 40), 10_000_000_019]:
        for t in range(r.choice([1, 2, 3, 5, 9, 14, 40])):
            rows.append((c, t * 2, r.choice(["user", "bot"]) if t > 2 else "user", r.choice(["", "a", "b", "é"]) if t else "hello"))
    rows += [(100 + k, t, "user", "same" + str(t)) for k in range(30) for t in range(6)]
    rows += [(7, None, None, None), (7, None, None, "x"), (8, 0, "user", "hello"), (8, 0, "user", "hello"), (9, 2, "bot", "tie"), (9, 2, "user", "tie")]
    rows += [(None, 0, "user", "nobody's"), (200, 0, "", "z" * 300_000), (201, 0, "z", "z" * 299_999)]
    return rows


@pytest.mark.parametrize(("width", "blocks", "id_bits"), [(8, 1024, 12), (3, 2, 1), (1, 4, 0)])
def test_trie_equals_dictionaries(spark, make, dialogues, width, blocks, id_bits):
    found = prefix_trie(*measured(number_turns(conversations(spark, dialogues))), width=width, blocks=blocks, id_bits=id_bits)
    assert nodes(found) == trie_of(paths_of(dialogues))


def test_grafted_trie_equals_dictionaries(spark, make, dialogues):
    conv = F.col("conv_id")
    head = F.crc32(conv.cast("string").cast("binary")) % 9
    turns, members = graft(number_turns(conversations(spark, dialogues)), conv - conv % 5, head, 8)
    assert nodes(prefix_trie(turns, members, width=4, blocks=2)) == trie_of(grafted(paths_of(dialogues)))


def test_turnless_conversations_are_members_of_the_root(spark, make):
    rows = [(c, t, "user", f"{c}") for c in (1, 2, 3, 4) for t in range(2)]
    turns, members = graft(number_turns(conversations(spark, rows)), F.lit(77), F.lit(8), 8)
    (root,) = prefix_trie(turns, members).collect()
    assert (root["conv_id"], root["depth"], root["n_convs"], root["n_leaves"], root["n_ends"]) == (1, 0, 4, 1, 4)
    assert root["ends_sha256"] == hashlib.sha256(b"1,2,3,4").hexdigest()


def test_no_conversations_give_no_nodes(spark, make):
    assert conversation_trie(conversations(spark, [])).count() == 0
    assert conversation_trie(conversations(spark, [(None, 1, "user", "x")])).count() == 0


def test_gallop_finds_what_binary_search_finds():
    import numpy as np

    r = np.random.default_rng(1)
    values = np.unique(r.integers(0, 5000, 900))
    low = r.integers(0, len(values), 400)
    high = np.minimum(low + r.integers(0, 500, 400), len(values))
    wanted = r.integers(-5, 5100, 400)
    want = [lo + int(np.searchsorted(values[lo:hi], w)) for lo, hi, w in zip(low, high, wanted, strict=True)]
    assert gallop(values, low, high, wanted).tolist() == want


@pytest.fixture(scope="module")
def texts(corpus):
    r = random.Random(2)
    letters = [*"ab '-.\n0", "é", "漢", "😀", "ß", " "]
    odd = ["".join(r.choice(letters) for _ in range(r.randrange(1, 120))) for _ in range(40)]
    more = ["a" * 4000, " " * 700, "^" * 900, "▁x", "<0x0A>", "<|endoftext|> so </s> <unk>", "\x00a\x00", "ﬁ ½ Ⅷ", "x", " x", "漢字" * 30]
    short = [(i, t) for i, t in corpus if t is None or len(t) < 5000]
    return short + list(enumerate(odd + more, 1000)) + [(1000, odd[0]), (None, "no id"), (None, "no id")]


def aligned_plainly(texts):
    a, b = alignment.vocabularies(*(open(f"{TOKENIZERS}/{n}", "rb").read() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")))
    spell = [lambda i, t=t: bytes(t.bytes[t.starts[i] : t.starts[i] + t.sizes[i]]) for t in (a, b)]
    told, held = [], Counter()
    for i, text in texts:
        ids = [a.slow.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text)] if text else [[], []]
        ends = [list(itertools.accumulate(len(f(x)) for x in own)) for f, own in zip(spell, ids, strict=True)]
        if not text or any(b"".join(map(f, own)) != (" " + text).encode() for f, own in zip(spell, ids, strict=True)):
            told.append((i, [], [], []))
            continue
        groups, at = [], (0, 0)
        for end in sorted(set(ends[0]) & set(ends[1])):
            to = (ends[0].index(end) + 1, ends[1].index(end) + 1)
            groups.append((at[0], to[0], at[1], to[1]))
            at = to
        links = Counter()
        for p, q, x, y in groups:
            for k, n in Counter(ids[0][p:q]).items():
                for m, o in Counter(ids[1][x:y]).items():
                    links[k, m] += n * o
        held.update(links.keys())
        told.append((i, ids, groups, links))
    most = {}
    for (k, _), n in held.items():
        most[k] = max(most.get(k, 0), n)
    rows = []
    for i, ids, groups, links in told:
        if not groups:
            rows.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        spelt = ";".join(",".join(map(str, ids[0][p:q])) + "|" + ",".join(map(str, ids[1][x:y])) for p, q, x, y in groups)
        best = sum(n for p, n in links.items() if held[p] == most[p[0]])
        total = sum(n * held[p] for p, n in links.items())
        rows.append((i, *map(len, ids), len(groups), sum(links.values()), best, total, hashlib.sha256(spelt.encode()).hexdigest()))
    return Counter(rows), told


@pytest.mark.parametrize(("block_bytes", "links"), [(alignment.BLOCK_BYTES, alignment.LINKS), (4000, 6)])
def test_alignment_equals_a_plain_one(spark, make, texts, monkeypatch, block_bytes, links):
    # Workers read these at import; the small case also runs in this process.
    monkeypatch.setattr(alignment, "LINKS", links)
    want, _ = aligned_plainly(texts)
    found = align(make(texts), TOKENIZERS, block_bytes=block_bytes)
    assert Counter(tuple(r) for r in found.collect()) == want


def test_pairs_of_large_groups_are_counted_by_distinct_ids(monkeypatch):
    both = alignment.vocabularies(*(open(f"{TOKENIZERS}/{n}", "rb").read() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")))
    texts = ["a" * 900, "words and 12345 more", "^" * 300, "", "漢字かな" * 9]
    found = alignment.Alignment(texts, *both)
    whole = [c.tolist() for c in found.pairs()]
    monkeypatch.setattr(alignment, "LINKS", 2)
    assert [c.tolist() for c in found.pairs()] == whole


def test_quick_and_plain_encoders_agree_on_settled_characters():
    a, _ = alignment.vocabularies(*(open(f"{TOKENIZERS}/{n}", "rb").read() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")))
    for c in [*range(0x370), *range(0x2000, 0x2070)]:
        for text in (f"x{chr(c)}y", f" {chr(c)} {chr(c)}{chr(c)} z1{chr(c)}2", f"{chr(c)}'s !{chr(c)}?"):
            assert a.fast.encode_ordinary(text) == a.slow.encode(text, add_special_tokens=False).ids


def test_token_groups_give_the_ranges(spark, make, texts):
    _, told = aligned_plainly(texts)
    want = {i: [tuple(g) for g in groups] for i, _, groups, _ in told if i is not None and i != 1000}
    rows = token_groups(make(texts), TOKENIZERS).collect()
    found = {r["doc_id"]: [(g["a_from"], g["a_to"], g["b_from"], g["b_to"]) for g in r["groups"]] for r in rows if r["doc_id"] not in (None, 1000)}
    assert found == want


def test_no_documents_give_no_rows(spark, make):
    assert align(make([]), TOKENIZERS).count() == 0
