"""Community search and streams."""

from pyspark.sql import functions as F

from quillgraph.operators import blocks as B
from quillgraph.operators import community as Q
from quillgraph.streaming import events as S


def test_local_moving(spark):
    cliques = [(8 * c + a, 8 * c + b) for c in range(3) for a in range(8) for b in range(a + 1, 8)] + [(0, 8), (8, 16)]
    e, n = spark.createDataFrame(cliques, "src long, dst long"), spark.range(25).withColumnRenamed("id", "v")
    blocks, q = Q.local_moving(e, n)
    at = {r["v"]: r["blk"] for r in blocks.collect()}
    assert len(at) == 25 and at[24] == 24
    assert all(len({at[8 * c + i] for i in range(8)}) == 1 for c in range(3)) and len({at[0], at[8], at[16]}) == 3
    assert q > 0.6 and abs(q - B.modularity(B.connectivity(e, blocks)).first()[0]) < 1e-12
    assert Q.local_moving(e.limit(0), n)[1] == 0.0
    assert Q.modularity_difference(e, e, n, 2) == 0.0


def test_streams(spark, tmp_path):
    rows = [(i, i % 3, (i * 7) % 5, i % 5) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, kind int, src long, dst long").select(
        (F.timestamp_seconds(F.col("i") * 600)).alias("ts"), F.col("kind").cast("string").alias("event_type"), F.col("i").cast("double").alias("value"), "src", "dst"
    )
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    blocks = spark.createDataFrame([(v, v % 2) for v in range(5)], "v long, blk long")

    def final(made, name):
        q = made.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return sorted(spark.table(name).collect())

    assert final(S.windowed_counts(stream), "counts") == sorted(S.windowed_counts(df).collect())
    assert final(S.block_counts(stream.where("src < dst"), blocks), "cells") == sorted(S.block_counts(df.where("src < dst"), blocks).collect())
    q = S.first_edges(stream, "100 hours").writeStream.format("memory").queryName("edges").option("checkpointLocation", str(tmp_path / "e")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    seen = [(r["src"], r["dst"]) for r in spark.table("edges").collect()]
    assert len(seen) == len(set(seen)) and set(seen) == {(r["src"], r["dst"]) for r in S.first_edges(df).collect()}
