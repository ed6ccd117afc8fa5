"""Registered path comparisons count all pairs, as their SQL does, whatever the number of nodes; nothing is drawn."""

from collections import Counter

import pytest

from quillgraph.operators import graph as G
from quillgraph.operators import metrics as M
from quillgraph.plans import queries as Q
from test_paths import web  # noqa: F401


def test_queries_count_all_pairs(spark, web, monkeypatch):  # noqa: F811
    e, n, dist = web
    monkeypatch.setattr(M.avg_path_length, "__defaults__", (10, 5, 0, True))  # beyond 5 nodes ten pairs would be drawn
    monkeypatch.setattr(M.shortest_path, "__defaults__", (10, 5, 0))
    star = spark.createDataFrame([(0, i) for i in range(1, 90)], "src long, dst long")
    monkeypatch.setattr(Q, "_pair", lambda s, d: ((e, n), (star, n)))
    monkeypatch.setattr(G, "path_lengths", lambda *a: pytest.fail("pairs were drawn or listed"))
    big = max(dist.values(), key=len).keys()
    counts = Counter(d for s in big for d in dist[s].values() if d)
    mean = sum(d * c for d, c in counts.items()) / sum(counts.values())
    other = {1: 2 * 89, 2: 89 * 88}
    assert Q.avg_path_length_diff(spark, "").first()[0] == pytest.approx(abs(mean - sum(d * c for d, c in other.items()) / sum(other.values())), abs=1e-7)
    f, emd = 0.0, 0.0
    for d in range(1, max(counts) + 1):
        f += counts.get(d, 0) / sum(counts.values()) - other.get(d, 0) / sum(other.values())
        emd += abs(f)
    assert Q.path_emd(spark, "").first()[0] == pytest.approx(emd, abs=1e-7)
