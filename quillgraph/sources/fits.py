"""Sinks and sources of fits, metric tables and chain logs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_fit(path: str, size: DataFrame, conn: DataFrame, nll: float, directed: bool = False, metadata: dict[str, str] | None = None) -> None:
    """Five parts, a folder each: block_sizes, block_connectivity, directed_graph, neg_loglike and metadata. The assignment of nodes is
    never written."""
    spark = size.sparkSession
    size.write.mode("overwrite").json(f"{path}/block_sizes")
    conn.write.mode("overwrite").parquet(f"{path}/block_connectivity")
    spark.createDataFrame([(bool(directed),)], "directed boolean").write.mode("overwrite").json(f"{path}/directed_graph")
    spark.createDataFrame([(None if nll is None else float(nll),)], "neg_loglike double").write.mode("overwrite").parquet(f"{path}/neg_loglike")
    spark.createDataFrame([({str(k): str(v) for k, v in (metadata or {}).items()},)], "metadata map<string,string>").write.mode("overwrite").json(f"{path}/metadata")


def load_fit(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(sizes, counts, {directed, neg_loglike, metadata})."""
    size = spark.read.schema("blk long, k long").json(f"{path}/block_sizes")
    scalars = {
        "directed": spark.read.schema("directed boolean").json(f"{path}/directed_graph").first()[0],
        "neg_loglike": spark.read.parquet(f"{path}/neg_loglike").first()[0],
        "metadata": spark.read.schema("metadata map<string,string>").json(f"{path}/metadata").first()[0] or {},
    }
    return size, spark.read.parquet(f"{path}/block_connectivity"), scalars


def write_metrics(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """A CSV folder with header; one that exists is left alone unless `overwrite`."""
    rows.write.mode("overwrite" if overwrite else "ignore").option("header", True).csv(path)


def write_log(trace: DataFrame, path: str, every: int = 1000) -> None:
    """Rows of every `every`-th iteration as CSV, numbers in fixed format."""
    kept = trace.where(F.col("iteration") % every == 0)
    text = [F.format_string("%.6f", F.col(c).cast("double")).alias(c) if t in ("double", "float") else F.col(c) for c, t in kept.dtypes]
    kept.select(*text).write.mode("overwrite").option("header", True).csv(path)


class ChainLog:
    """Appends rows of a running fit to a CSV folder: every `every`-th iteration, with the seconds since it began, `flush` rows a write."""

    def __init__(self, spark: SparkSession, path: str, every: int = 1000, flush: int = 10):
        self.spark, self.path, self.every, self.flush = spark, path, every, flush
        self.rows: list[tuple] = []
        self.names: list[str] = []
        self.began = time.monotonic()

    def log(self, iteration: int, **values: float) -> None:
        if iteration % self.every:
            return
        self.names = ["iteration", "elapsed", *values]
        self.rows.append((str(iteration), f"{time.monotonic() - self.began:.3f}", *(f"{v:.6f}" if isinstance(v, float) else str(v) for v in values.values())))
        if len(self.rows) >= self.flush:
            self.close()

    def close(self) -> None:
        """Write what is held; more rows may follow."""
        if self.rows:
            schema = ", ".join(f"`{c}` string" for c in self.names)
            self.spark.createDataFrame(self.rows, schema).coalesce(1).write.mode("append").option("header", True).csv(self.path)
            self.rows = []


def scan_logs(spark: SparkSession, pattern: str, name: str = r"([^/]+)/[^/]*$") -> DataFrame:
    """All CSV files of a glob in one frame, with `source` taken from each file's path."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(pattern)
    return df.withColumn("source", F.regexp_extract(F.col("_metadata.file_path"), name, 1))
