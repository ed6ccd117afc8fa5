"""Distances by searches that run together, and components by forests, against plain searches."""

import random
from collections import Counter

import pytest

from quillgraph.operators import graph as G


@pytest.fixture(scope="module")
def web(spark):
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(90), 2))) for _ in range(100)} | {(200 + i, 201 + i) for i in range(140)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    nodes = [*range(100), *range(200, 341)]
    dist = {}
    for s in nodes:
        front, d, seen = {s}, 0, {s: 0}
        while front:
            d += 1
            front = {x for v in front for x in near.get(v, ())} - seen.keys()
            seen |= dict.fromkeys(front, d)
        dist[s] = seen
    return spark.createDataFrame(sorted(pairs), "src long, dst long").repartition(3), spark.createDataFrame([(v,) for v in nodes], "v long"), dist


def test_distances_are_counted_without_listing_pairs(spark, web, monkeypatch):
    e, n, dist = web
    monkeypatch.setattr(G, "TOGETHER", 64)
    monkeypatch.setattr(G, "distances", lambda *a: pytest.fail("pairs were listed"))
    want = Counter(d for seen in dist.values() for d in seen.values() if d)
    assert {r[0]: r[1] for r in G.distance_counts(e, n).collect()} == want


def test_drawn_pairs_share_searches(spark, web):
    e, n, dist = web
    rng = random.Random(6)
    pairs = [tuple(rng.choices(list(dist), k=2)) for _ in range(900)]
    targets = spark.createDataFrame(pairs, "s long, v long")
    got = Counter(map(tuple, G.distances(e, n, None, targets).collect()))
    assert got == Counter((s, v, dist[s][v]) for s, v in pairs if v in dist[s])


def test_components_take_no_rounds(spark, web, monkeypatch):
    e, n, dist = web
    monkeypatch.setattr(G, "both_ways", lambda *a: pytest.fail("edges were shuffled"))
    assert {r[0]: r[1] for r in G.components(e, n).collect()} == {v: min(seen) for v, seen in dist.items()}
