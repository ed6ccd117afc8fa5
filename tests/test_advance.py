"""A step of searches that run together looks only at what it needs, and graphs too large for walks are still counted in place."""

from collections import Counter

import numpy as np
import pytest

from quillgraph.operators import graph as G
from test_paths import web  # noqa: F401


def _graph(n, m, seed):
    rng = np.random.default_rng(seed)
    pairs = rng.integers(0, n, (m, 2))
    pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
    ring = np.stack([np.arange(n), (np.arange(n) + 1) % n], axis=1)
    u = np.concatenate([pairs, ring])
    u = np.unique(np.concatenate([u, u[:, ::-1]]), axis=0)
    return np.searchsorted(u[:, 0], np.arange(n + 1)), u[:, 1].astype(np.intp)


@pytest.mark.parametrize("m", [0, 300, 20_000])
def test_advance_is_a_step_of_every_search(m, monkeypatch):
    monkeypatch.setattr(G, "GATHERED", 3_000)
    n = 300
    starts, near = _graph(n, m, m)
    sources = np.arange(7, 150)
    gathered = []

    class Front(np.ndarray):
        def take(self, at, axis=None):
            gathered.append(len(at))
            return np.asarray(self).take(at, axis=axis)

    i = np.arange(len(sources))
    front = np.zeros((n, 3), np.uint64)
    np.bitwise_or.at(front, (sources, i // 64), np.uint64(1) << (i % 64).astype(np.uint64))
    seen, all_ = front.copy(), np.bitwise_or.reduce(front, axis=0)
    for level in range(400):
        want = np.bitwise_or.reduceat(front.take(near, axis=0), starts[:-1], axis=0) & ~seen
        del gathered[:]
        got = G._advance(front.view(Front), seen, all_, starts, near)
        assert np.array_equal(np.asarray(got), want)
        full = bool((seen == all_).all())
        assert sum(gathered) <= len(near) and (not full or sum(gathered) == 0)
        front = np.asarray(got)
        seen |= front
        if not front.any():
            break
    assert (seen == all_).all()


def test_graphs_too_large_for_walks_are_counted(spark, web, monkeypatch):  # noqa: F811
    e, n, dist = web
    monkeypatch.setattr(G, "BROADCAST_EDGES", 2)
    monkeypatch.setattr(G, "distances", lambda *a: pytest.fail("pairs were listed"))
    want = Counter(d for seen in dist.values() for d in seen.values() if d)
    assert {r[0]: r[1] for r in G.distance_counts(e, n).collect()} == want
