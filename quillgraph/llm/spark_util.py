"""Session helpers shared by the operators: reading, cutting lineage, checked broadcasts, components."""

from __future__ import annotations

import ctypes
import gc
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import drop, stored
from ..plans.session import cut, shared_folder

__all__ = ["connected_components", "cut", "drop", "fold", "give_back", "giving_back", "join_hot", "release", "shared_folder", "shuffle_partitions", "small_or_shuffled", "stored", "table", "tree_sum", "trim_workers"]

#: A side is broadcast only when a measurement shows at most this many rows and bytes; beyond either the join shuffles.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 48_000_000
#: Links whose components are found on the driver (16 bytes each); beyond it rounds of joins.
DRIVER_LINKS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Collect garbage on both sides of the driver: Spark's cleaner deletes the shuffle files and checkpoints of finished rounds
    only once nothing refers to them any more, and a driver with memory to spare may not get there for many rounds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return memory that this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # only glibc has it
        pass


def giving_back(run):
    """run(batches) that leaves no freed memory in its worker. Spark deals tasks over all idle workers of an executor in turn, so each of them
    would keep what the largest task took."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def trim_workers(spark: SparkSession) -> None:
    """Executors and idle Python workers give the memory that finished work left behind back to the system: as many tasks as there are cores,
    twice, each with a full collection, after which a JVM gives up heap, and with two workers, as stages have that chain two functions."""

    def run(batches):
        for batch in batches:
            give_back()
            time.sleep(0.1)
            yield batch

    n = 2 * spark.sparkContext.defaultParallelism
    kinds = "id long, collected string"
    freed = spark.range(0, n, 1, n).withColumn("collected", F.expr("java_method('java.lang.System', 'gc')"))
    freed.mapInArrow(run, kinds).mapInArrow(run, kinds).write.format("noop").mode("overwrite").save()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_or_shuffled(df: DataFrame, width: Column | None = None, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it has at most `rows` rows and BROADCAST_BYTES bytes (`width` a row; without it, rows
    of a few numbers), else with a hint for a shuffled join. The count stops at the bound."""
    size = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(width if width is not None else F.lit(0)).alias("b")).first()
    if size["n"] <= rows and (size["b"] or 0) <= BROADCAST_BYTES:
        return F.broadcast(df)
    return df.hint("merge")


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], how: str = "inner", total: int | None = None) -> DataFrame:
    """`rows` joined to `keyed`, which has one row a key. Keys with more than a small share of `rows` (a quarter of a partition, 1,000
    at least; so there are at most four a partition, which bounds the broadcast) are dealt over several tasks by a hash
    of the other columns, and their row of `keyed` is copied to each."""
    spark = rows.sparkSession
    limit = max(1000, (rows.count() if total is None else total) // (4 * shuffle_partitions(spark)))
    hot = cut(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*on, F.ceil(F.col("_n") / limit).cast("int").alias("_copies")))
    if hot.isEmpty():
        return rows.join(keyed, on, how)
    copies = F.coalesce("_copies", F.lit(1))
    left = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.pmod(F.xxhash64(*(c for c in rows.columns if c not in on)), copies).cast("int")).drop("_copies")
    right = keyed.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def fold(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(mod)).cast("int")


def tree_sum(parts: DataFrame, column: str, width: int = 16) -> Column | None:
    """Sum equally long float64 vectors, one binary row a partition, in two levels: at most `width` rows
    of fixed length reach the driver, however many partitions there were. None without rows."""
    def add(batches):
        total = None
        for batch in batches:
            for v in batch.column(0):
                x = np.frombuffer(v.as_py(), dtype=np.float64)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_pydict({column: pa.array([total.tobytes()], pa.binary())})

    rows = parts.select(column).repartition(width).mapInArrow(add, f"{column} binary").collect()
    total = None
    for r in rows:
        x = np.frombuffer(bytes(r[0]), dtype=np.float64)
        total = x.copy() if total is None else total + x
    return total


def _smallest_reachable(t: pa.Table) -> pa.Table:
    """(node, component) of links (u, v): minimum labels with pointer jumping, as arrays."""
    u, v = (t.column(c).to_numpy() for c in ("u", "v"))
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = place[: len(u)], place[len(u) :]
    root = np.arange(len(ids))
    while True:
        a, b = root[u], root[v]
        apart = np.flatnonzero(a != b)
        if not len(apart):
            return pa.table({"node": ids, "component": ids[root]})
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up := root[root], root):
            root = up


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over `edges` (a, b), for every node in an edge.

    Up to DRIVER_LINKS different links, counted first, are settled on the driver. Beyond, alternates large-star and small-star steps. Each groups by a node with a minimum that combines on the map
    side and joins it back, so no neighbour list is ever gathered, and nodes with very many edges are dealt over several tasks.
    Lineage is cut each round. Nulls are not nodes; loops and repeated edges are harmless.
    """
    e = edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u is not null and v is not null and u <> v").distinct()

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return (r[0], r[1])

    e = cut(e)
    seen = state(e)
    if seen[0] == 0:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    if seen[0] <= DRIVER_LINKS:
        return e.sparkSession.createDataFrame(_smallest_reachable(e.select(F.col("u").cast("long"), F.col("v").cast("long")).toArrow()))
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join_hot(both, low, ["u"], total=2 * seen[0]).where("v > u and v <> m").select(F.col("m").alias("u"), "v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = join_hot(large, down, ["v"], total=2 * seen[0]).select(F.col("m").alias("x"), F.explode(F.array("u", "v")).alias("y"))
        e = cut(small.where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
        del both, low, large, down, small
        release(e.sparkSession)
        now = state(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    low = e.groupBy("v").agg(F.min("u").alias("m"))
    return low.select(F.col("v").alias("node"), F.col("m").alias("component")).union(e.select("u", F.col("u")).distinct())

