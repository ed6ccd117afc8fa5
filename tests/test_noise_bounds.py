"""Zero pairs that no draw can lift are not listed, and quantiles take large blocks."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.scalars import normal
from quillgraph.operators import noise as N


def _stats(spark):
    size = spark.createDataFrame([(i, 4) for i in range(40)], "blk long, k long")
    return spark.createDataFrame([(0, 0, 1), (0, 1, 5), (2, 3, 1)], "r long, s long, m long"), size


def test_pairs_without_a_chance_are_not_listed(spark, monkeypatch):
    conn, size = _stats(spark)
    total = N.normaliser(conn, size, 3).first()[0]
    monkeypatch.setattr(N, "zero_pairs", lambda *a: pytest.fail("all pairs were listed"))
    low = 0.5 / N.LARGEST_DRAW  # the sigma from which a pair can be lifted
    factor = F.lit((low * 0.999) ** 2 * total / (3 / 6**0.5)) / F.col("total")
    assert N.noisy_zero_pairs(conn, size, factor, 3, 4, 9).count() == 0


def test_pairs_with_a_chance_are_all_there(spark):
    conn, size = _stats(spark)
    total = N.normaliser(conn, size, 3).first()[0]
    for scale in (0.3, 0.12):  # both kinds of cells; then the larger sigma of the diagonal only, nearly
        factor = F.lit(scale**2 * total) / F.col("total")
        got = {tuple(r) for r in N.noisy_zero_pairs(conn, size, factor, 3, 4, 9).collect()}
        z = N.zero_pairs(conn, size).select("r", "s", F.when(F.col("r") == F.col("s"), 6).otherwise(16).alias("n"))
        z = z.withColumn("z", F.sqrt(F.sqrt(F.lit(9.0) / F.col("n")) * F.lit(scale**2 * total) / F.lit(total)) * normal(29, "r", "s")).where("z >= 0.5")
        assert got == {tuple(r) for r in z.select("r", "s", F.least("n", F.bround("z").cast("long")).alias("m")).where("m > 0").collect()}
        assert got or scale < 0.3


def test_draws_stay_under_the_largest(spark):
    low = spark.range(1).select((F.sqrt(-2.0 * F.log((F.lit(0) + F.lit(0.5)) / F.lit(4294967296.0)))).alias("x")).first()[0]
    assert low <= N.LARGEST_DRAW < low * 1.001


def test_quantiles_of_large_blocks(spark):
    size = spark.createDataFrame([(0, 20_000), (1, 20_000), (2, 5)], "blk long, k long")
    conn = spark.createDataFrame([(0, 0, 2_000_000), (0, 1, 4_000_000), (1, 1, 199_990_000)], "r long, s long, m long")
    got = {r["blk"]: r["c"] for r in N.binomial_quantiles(conn, size, 0.999).collect()}
    assert 243 <= got[0] <= 250  # Bin(20000, 0.01): mean 200, deviation 14
    assert got[1] == 20_000 and got[2] == 0
