"""Bounded raking against plain loops over dictionaries."""

import random
from collections import defaultdict

import pytest

from hamsieve.llm import mixing
from hamsieve.llm.mixing import BUDGET, draw, mix, rake_within

SCHEMA = "source string, lang string, topic string, tokens long, docs long"
MARGINS = ("source", "lang", "topic")


def plainly(cells, targets, budget, sweeps):
    """Tokens drawn of each cell: goals per value, values that have too little give all, cells are held at what they have."""
    cells = {c[:3]: c[3] for c in cells if c[3] > 0}
    total = sum(cells.values())
    had = [defaultdict(int) for _ in MARGINS]
    for cell, n in cells.items():
        for k, value in enumerate(cell):
            had[k][value] += n
    goals = []
    for k, margin in enumerate(MARGINS):
        target = targets[margin]
        raw = {v: float(target.get(v, 0)) if isinstance(target, dict) else n**target for v, n in had[k].items()}
        goals.append({v: x / sum(raw.values()) for v, x in raw.items()})
    size = min([budget * total, *(sum(n for v, n in had[k].items() if goals[k][v] > 0) for k in range(3))])
    want = []
    for k in range(3):
        full = set()
        while True:
            held = sum(had[k][v] for v in full)
            free = sum(g for v, g in goals[k].items() if v not in full)
            level = (size - held) / free if free > 1e-15 else 0
            more = {v for v, g in goals[k].items() if v not in full and had[k][v] <= g * level * (1 + 1e-9)}
            if not more:
                break
            full |= more
        want.append({v: float(had[k][v]) if v in full else g * level for v, g in goals[k].items()})
    weight = {c: n * size / total for c, n in cells.items()}
    for _ in range(sweeps):
        for k in range(3):
            for value in had[k]:
                own = [c for c in cells if c[k] == value]
                has = sum(min(weight[c], cells[c]) for c in own)
                free = sum(weight[c] for c in own if weight[c] < cells[c])
                if has <= 0:
                    factor = 0.0
                elif want[k][value] > has:
                    factor = (want[k][value] - (has - free)) / free if free else 1.0
                else:
                    factor = want[k][value] / has
                for c in own:
                    weight[c] *= factor
    return {c: min(weight[c], cells[c]) for c in cells}


def random_cells(seed, scarce):
    r = random.Random(seed)
    return [(s, g, t, r.choice([0, r.randint(1, 30) if scarce else r.randint(400, 900), r.randint(500, 5000)]), r.randint(1, 9)) for s in "abcd" for g in "xyz" for t in "pq"]


@pytest.mark.parametrize(
    ("seed", "scarce", "targets", "budget"),
    [
        (1, False, {"source": 0.7, "lang": 0.8, "topic": 0.8}, 0.5),
        (2, True, {"source": 0.7, "lang": 0.8, "topic": 0.8}, 0.5),
        (3, True, {"source": 0.3, "lang": {"x": 0.5, "y": 0.3, "z": 0.2}, "topic": 0.5}, 0.4),
    ],
)
@pytest.mark.parametrize("task_cells", [mixing.TASK_CELLS, 0])
def test_bounded_raking_equals_plain_loops(spark, monkeypatch, task_cells, seed, scarce, targets, budget):
    monkeypatch.setattr(mixing, "TASK_CELLS", task_cells)
    cells = random_cells(seed, scarce)
    raked, _ = rake_within(spark.createDataFrame(cells, SCHEMA), targets, budget, sweeps=8, tolerance=0)
    got = {(x["source"], x["lang"], x["topic"]): min(x["weight"], float(x["tokens"])) for x in raked.collect()}
    want = plainly(cells, targets, budget, sweeps=8)
    assert got.keys() == want.keys()
    # Whether a cell at its bound is free hangs on the last digit, so the sums of a sweep may differ by more than that.
    assert got == {c: pytest.approx(w, rel=2e-4) for c, w in want.items()}


def test_many_values_are_joined_not_broadcast(spark, monkeypatch):
    cells = spark.createDataFrame(random_cells(4, True), SCHEMA)
    targets = {"source": 0.7, "lang": 0.8, "topic": 0.8}
    monkeypatch.setattr(mixing, "TASK_CELLS", 0)
    few = {(*x[:3], x["weight"]) for x in rake_within(cells, targets, sweeps=2)[0].collect()}
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    many = {(*x[:3], x["weight"]) for x in rake_within(cells, targets, sweeps=2)[0].collect()}
    assert {c[:3]: pytest.approx(c[3], rel=1e-9) for c in few} == {c[:3]: c[3] for c in many}


def test_raking_that_cannot_end_says_so(spark, caplog):
    cells = spark.createDataFrame([("a", "x", "p", 10, 1), ("b", "y", "p", 10, 1)], SCHEMA)
    with caplog.at_level("WARNING"):
        rake_within(cells, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}, "topic": 1.0}, 0.5, sweeps=3)
    assert "still off" in caplog.text


def test_clashing_names_and_no_tokens(spark, make):
    docs = make([(1, "a b c"), (2, "d e"), (None, None), (None, ""), (2, "d e")] + [(10 + i, "w " * (i + 1)) for i in range(30)])
    found = {(x["doc_id"], x["tokens"]) for x in mix(docs).collect()}
    assert (1, 3) in found and (None, 0) in found and len(mix(docs).collect()) == docs.count()
    kept = draw(docs, budget=1.0)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert draw(make([])).count() == 0 and BUDGET == 0.5
