"""Raw network files made into edge lists (src, dst): one function a format, and all of them in one run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components, largest_component, within
from .graphs import keep_first, raw_lines

PREPS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def prep(name: str):
    def add(f):
        PREPS[name] = f
        return f

    return add


def _named(lines: DataFrame) -> DataFrame:
    return lines.orderBy("line").select(F.col("u").alias("src"), F.col("v").alias("dst"))


@prep("matrix_market")
def matrix_market_lines(spark: SparkSession, path: str) -> DataFrame:
    """The first two lines (header and sizes) go; columns one and two are kept as they are, from 1 up, repeats and loops too."""
    return _named(raw_lines(spark, path, 2))


@prep("weighted_edges")
def weighted_edges(spark: SparkSession, path: str) -> DataFrame:
    """Columns one and two; attributes after them go, repeats stay."""
    return _named(raw_lines(spark, path))


@prep("temporal_edges")
def temporal_edges(spark: SparkSession, path: str) -> DataFrame:
    """Of each unordered pair the first line in its own direction; loops and times go."""
    return _named(keep_first(raw_lines(spark, path)))


@prep("snap_edges")
def snap_edges(spark: SparkSession, path: str) -> DataFrame:
    """As temporal_edges, after four header lines."""
    return _named(keep_first(raw_lines(spark, path, 4)))


@prep("csv_edges")
def csv_edges(spark: SparkSession, path: str) -> DataFrame:
    """As temporal_edges, comma-separated, after one header line."""
    return _named(keep_first(raw_lines(spark, path, 1, ",")))


def prepare_all(spark: SparkSession, jobs: list[tuple[str, str, str]], folder: str) -> list[str]:
    """Run (dataset, prep, path) jobs; each writes its edges as Parquet under the folder. Returns the folders written."""
    unknown = {kind for _, kind, _ in jobs} - set(PREPS)
    if unknown:
        raise ValueError(f"unknown preparations {sorted(unknown)}")
    out = []
    for name, kind, path in jobs:
        target = f"{folder.rstrip('/')}/{name}"
        PREPS[kind](spark, path).write.mode("overwrite").parquet(target)
        out.append(target)
    return out


def largest_as_networkx(edges: DataFrame, nodes: DataFrame, directed: bool = False):
    """The largest (weakly connected) component as a NetworkX graph, where that library is installed; nodes and edges are collected."""
    try:
        import networkx
    except ImportError as e:
        raise RuntimeError("NetworkX is not installed") from e
    kept = largest_component(components(edges, nodes))
    graph = networkx.DiGraph() if directed else networkx.Graph()
    graph.add_nodes_from(r["v"] for r in kept.orderBy("v").collect())
    graph.add_edges_from((r["src"], r["dst"]) for r in within(edges, kept).select("src", "dst").collect())
    return graph
