"""Triangles are counted among colours, without a row for a wedge."""

import random
from itertools import combinations

import pytest

from quillgraph.operators import graph as G


@pytest.mark.parametrize("bound", [1_000, 30])
def test_no_wedge_is_shuffled(spark, monkeypatch, bound):
    rng = random.Random(bound)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(400)} | {(0, i) for i in range(1, 60)} | {(100, 101), (101, 102), (100, 102), (10**12, 10**12 + 1)}
    want = dict.fromkeys([*range(60), 100, 101, 102], 0)
    near = {v: {x for p in pairs if v in p for x in p} - {v} for v in want}
    for v in want:
        want[v] = sum((min(x, y), max(x, y)) in pairs for x, y in combinations(near[v], 2))
    monkeypatch.setattr(G, "WEDGES", 100, raising=False)
    monkeypatch.setattr(G, "TRIANGLE_EDGES", 200, raising=False)
    monkeypatch.setattr(G, "ONE_COLOUR", bound, raising=False)
    monkeypatch.setattr(G, "degrees", lambda *a: pytest.fail("edges were joined for wedges"))
    e = spark.createDataFrame(sorted(pairs), "src long, dst long").repartition(3)
    assert {r[0]: r[1] for r in G.closed_wedges(e, None).collect()} == {v: n for v, n in want.items() if n}
