"""Partitioners, spectra, chains and fit files against NumPy, brute force and invariants."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import blocks as B
from quillgraph.operators import chain as C
from quillgraph.operators import noise as N
from quillgraph.operators import partition as P
from quillgraph.operators import spectral as E
from quillgraph.operators.ordering import ranked
from quillgraph.sources import fits


@pytest.fixture(scope="module")
def er(spark):
    rng = random.Random(3)
    pairs = [(a, b) for a in range(23) for b in range(a + 1, 23) if rng.random() < 0.3]
    return spark.createDataFrame(pairs, "src long, dst long").cache(), spark.range(23).withColumnRenamed("id", "v").cache(), pairs


def sizes_of(blocks):
    rows = blocks.collect()
    assert sorted(r["v"] for r in rows) == list(range(23))
    return sorted(r["k"] for r in B.sizes(blocks).collect())


def test_ranks(spark):
    df = spark.createDataFrame([(i * 7 % 50, i % 3) for i in range(50)], "v long, x int")
    got = {r["v"]: r["rank"] for r in ranked(df, "x", "v").collect()}
    want = sorted((i % 3, i * 7 % 50) for i in range(50))
    assert got == {v: n for n, (_, v) in enumerate(want)}


def test_partitions(spark, er):
    e, n, _ = er
    for made in (P.balanced(e, n, 4, rounds=4), P.from_coordinates(n.select("v", F.sin("v").alias("x0")), 4)):
        assert sizes_of(made) == [4, 4, 5, 5, 5]
    lopsided = n.select("v", F.when(F.col("v") < 15, 0).otherwise(F.col("v")).cast("long").alias("blk"))
    assert sizes_of(P.rebalance(lopsided, e, 5)) == [5, 6, 6, 6]
    assert sizes_of(P.rebalance(n.select("v", F.lit(9).cast("long").alias("blk")), e, 4)) == [4, 4, 5, 5, 5]
    start = B.uniform_blocks(n, 4)
    refined = P.refine(e, start, 3)
    assert sizes_of(refined) == sizes_of(start) and P.cut_size(e, refined) < P.cut_size(e, start)
    with pytest.raises(ValueError):
        P.assign(e, n, 4, "none")
    with pytest.raises(ValueError):
        P.rebalance(start, e, 24)


def test_spectrum(er):
    e, n, pairs = er
    a = np.zeros((23, 23))
    for x, y in pairs:
        a[x, y] = a[y, x] = 1
    w, u = np.linalg.eigh(a)
    assert np.allclose(E.eigenvalues(e, n, 2, 25), w[::-1][:2], atol=1e-3)
    x = {r["v"]: r["x"] for r in E.centrality(e, n, 25).collect()}
    assert np.allclose([x[v] for v in range(23)], np.abs(u[:, -1]), atol=1e-3)


def test_fit(spark, er, tmp_path):
    e, n, _ = er
    start = B.uniform_blocks(n, 4)
    fit = C.fit(e, start, 2, sign=1.0)
    assert sizes_of(fit.blocks) == sizes_of(start)
    assert fit.nll < fit.trace[0][1]
    assert fit.nll == pytest.approx(B.nll(B.connectivity(e, fit.blocks), fit.sizes, 1.0).first()[0])
    swaps = C.uniform_swaps(start, 20, 1).collect()
    at = {r["v"]: r["blk"] for r in start.collect()}
    assert len(swaps) == 20 and all(r["a"] != r["b"] and at[r["i"]] == r["a"] and at[r["j"]] == r["b"] for r in swaps)
    fits.save_fit(str(tmp_path / "fit"), fit.sizes, fit.conn, fit.nll, metadata={"k": 4})
    size, conn, scalars = fits.load_fit(spark, str(tmp_path / "fit"))
    assert sorted(size.collect()) == sorted(fit.sizes.select("blk", "k").collect()) and sorted(conn.collect()) == sorted(fit.conn.collect())
    assert scalars == {"directed": False, "neg_loglike": fit.nll, "metadata": {"k": "4"}}


def test_logs(spark, tmp_path):
    trace = spark.range(10).select(F.col("id").alias("iteration"), (F.col("id") / 3).alias("nll"))
    fits.write_log(trace, str(tmp_path / "run_a"), 5)
    fits.write_log(trace, str(tmp_path / "run_b"), 2)
    got = fits.scan_logs(spark, str(tmp_path / "run_*")).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in got} == {"run_a": 2, "run_b": 5}
    fits.write_metrics(trace, str(tmp_path / "m"))
    fits.write_metrics(trace.limit(1), str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 10


def test_homogeneous(spark):
    size, conn = spark.createDataFrame([(0, 5), (1, 6), (2, 1)], "blk long, k long"), spark.createDataFrame([(0, 0, 10), (0, 1, 30)], "r long, s long, m long")
    k, m = N.homogeneous_draw(conn, size, 0.0, 1)
    assert {r["blk"]: r["k"] for r in k.collect()} == {0: 5.0, 1: 6.0, 2: 1.0}
    assert {(r["r"], r["s"]): r["m"] for r in m.collect()} == {(0, 0): 10, (0, 1): 30}
    k, m = N.homogeneous_draw(conn, size, 20.0, 2)
    at = {r["blk"]: r["k"] for r in k.collect()}
    assert min(at.values()) >= 1 and all(r["m"] <= (at[0] * (at[0] - 1) / 2 if r["s"] == 0 else at[0] * at[1]) for r in m.collect())
