"""Components found on the driver and by rounds of joins are the same, and small ones take no rounds."""

import random

import numpy as np
import pytest

from quillgraph.llm import ngram_join, spark_util


def test_driver_and_rounds_agree(spark, monkeypatch):
    rng = random.Random(71)
    path = [(i, i + 1) for i in range(-40, 40)]
    links = [*path, *((rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)), (7, 7), (None, 3), (2**62, -(2**62))]
    rng.shuffle(links)
    edges = spark.createDataFrame(links, "a long, b long")
    one = {tuple(r) for r in spark_util.connected_components(edges).collect()}
    monkeypatch.setattr(spark_util, "DRIVER_LINKS", 0)
    two = {tuple(r) for r in spark_util.connected_components(edges).collect()}
    assert one == two and (40, -40) in one


def test_small_components_take_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(spark_util, "join_hot", lambda *a, **b: pytest.fail("a round of joins"))
    got = spark_util.connected_components(spark.createDataFrame([(3, 2), (2, 1), (9, 8)], "a long, b long")).collect()
    assert {tuple(r) for r in got} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}


def test_sketch_counts_travel_small_and_whole():
    x = np.zeros(1 << 16, np.uint32)
    x[::5], x[7], x[9] = 1, 300, 2**31
    packed = ngram_join._squeezed(x)
    assert np.array_equal(ngram_join._whole_counts(packed, np.uint32, len(x)), x)
    assert len(packed) < len(x) // 8
