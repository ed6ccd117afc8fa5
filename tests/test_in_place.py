"""Samples are drawn where their stretches are: the same edges as by joins, no place is shuffled."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.scalars import u01, u01_range
from quillgraph.operators import noise as N


def test_uniforms_of_a_range_are_those_of_its_keys(spark):
    want = [r[0] for r in spark.range(1, 12_001).select(u01(42, F.lit(3), F.lit(17), F.lit(0), "id")).collect()]
    assert u01_range("42:3:17:0:", 12_000).tolist() == want


@pytest.mark.parametrize("directed", [False, True])
def test_edges_are_those_of_the_joins(spark, monkeypatch, directed):
    blocks = spark.createDataFrame([(7 * i % 400 + 5, i % 3) for i in range(400)], "v long, blk long")
    conn = spark.createDataFrame([(0, 0, 900), (0, 1, 700), (1, 1, 133 * 66), (1, 2, 3), (2, 2, 1500)], "r long, s long, m long")
    monkeypatch.setattr(N, "STRETCH", 100)
    members = N.MEMBERS
    monkeypatch.setattr(N, "MEMBERS", 0)
    want = sorted(map(tuple, N.sample_graph(blocks, conn, 9, directed).collect()))
    monkeypatch.setattr(N, "MEMBERS", members)
    monkeypatch.setattr(N, "positions", lambda *a: pytest.fail("places were shuffled"))
    got = N.sample_graph(blocks, conn, 9, directed)
    assert len(want) > 5_000 and sorted(map(tuple, got.collect())) == want
