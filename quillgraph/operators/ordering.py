"""Global ranks without a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """df with `rank` (0 up) in a total order of columns. Rows are dealt by range; each range counts itself, and only the ranges'
    offsets, one row a partition, are broadcast."""
    from ..plans.session import cut

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    offsets = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_o", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_o")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return dealt.join(F.broadcast(offsets), "_p").withColumn("rank", (F.col("_o") + inside - 1).cast("long")).drop("_p", "_o")


def even_chunks(df: DataFrame, n: int, k: int, *order: str) -> DataFrame:
    """(v, blk): n ordered nodes cut into max(1, n // k) blocks, the remainder spread one node a block over the first ones."""
    count = max(1, n // k)
    small, extra = divmod(n, count)
    r = F.col("rank")
    split = extra * (small + 1)
    blk = F.when(r < split, F.floor(r / (small + 1))).otherwise(extra + F.floor((r - split) / max(1, small)))
    return ranked(df, *order).select("v", blk.cast("long").alias("blk"))
