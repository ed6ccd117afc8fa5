"""Swaps scored in packed blocks against the joins, over many slices and with more blocks than the tables take."""

import random

import pytest

from quillgraph.operators import blocks as B
from quillgraph.operators import packed as P
from quillgraph.operators import swaps as W


@pytest.mark.parametrize("dense", [256, 2])
def test_cross_swaps_equal_the_joined_ones(spark, monkeypatch, dense):
    rng = random.Random(8)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(260)})
    e = spark.createDataFrame(pairs, "src long, dst long")
    b = spark.createDataFrame([(v, rng.randrange(4) if v else 4) for v in range(60)], "v long, blk long")  # block 4 has one node
    monkeypatch.setattr(W, "DENSE_BLOCKS", dense)
    monkeypatch.setattr(P, "bounds", lambda nodes, width: __import__("numpy").array([15, 31, 40]))
    if dense > 4:
        monkeypatch.setattr(W, "swap_delta", lambda *a: pytest.fail("cells of moves were joined"))
    moves = W._plain(e, b)
    delta = B.swap_delta(moves, e, b)
    assert sorted(map(tuple, W.cross_deltas(e, b).collect())) == sorted(map(tuple, delta.collect()))
    want = {r[0]: r[1] for r in B.swap_delta_nll(delta, B.connectivity(e, b), B.sizes(b)).collect()}
    got = {r[0]: r[1] for r in W.cross_scores(e, b).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
