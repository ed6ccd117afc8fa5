"""Graph sources: text formats read into edges (src, dst), dataset cleaning, and graphs derived from tables.

Canonical edges have src < dst, one row an edge. Node tables keep isolated nodes.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import canonical

LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(*extensions: str):
    """Register a reader of directed edges (src, dst, w) for file extensions."""

    def add(f):
        for e in extensions:
            LOADERS[e.lower()] = f
        return f

    return add


@register(".edges", ".edgelist", ".txt", ".gz")
def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Two leading columns, white space between; blank and # lines skipped; repeated lines add up."""
    return _pairs(spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')"), r"\s+").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


@register(".mtx")
def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """Coordinate format; 1-based entries become 0-based; symmetric matrices get both directions (skew-symmetric ones with the sign turned).
    Values are kept (1 in pattern files) and repeated entries add up. The size line is the first that is no comment."""
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = spark.read.text(path).select("value", place.alias("line"))
    head = lines.orderBy("line").limit(1).first()
    kind = head["value"].lower() if head is not None else ""
    rows = lines.where("not startswith(value, '%') and trim(value) <> ''")
    size = rows.agg(F.min("line")).first()[0]
    parts = F.split(F.trim("value"), r"\s+")
    value = F.lit(1.0) if "pattern" in kind else F.coalesce(F.try_element_at(parts, F.lit(3)).cast("double"), F.lit(1.0))
    e = rows.where(F.col("line") != F.lit(size if size is not None else -1)).select((parts[0].cast("long") - 1).alias("src"), (parts[1].cast("long") - 1).alias("dst"), value.alias("w"))
    if "symmetric" in kind:
        turned = -F.col("w") if "skew" in kind else F.col("w")
        e = e.union(e.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), turned.alias("w")))
    return e.groupBy("src", "dst").agg(F.sum("w").alias("w"))


@register(".npz")
def sparse_archive(spark: SparkSession, path: str) -> DataFrame:
    """A compressed sparse row matrix in a NumPy archive, read through Spark's binary source; weights are doubles."""

    def rows(batches):
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    part = {n.removesuffix(".npy"): np.load(io.BytesIO(z.read(n)), allow_pickle=False) for n in z.namelist() if n.removesuffix(".npy") in ("data", "indices", "indptr")}
                src = np.repeat(np.arange(len(part["indptr"]) - 1), np.diff(part["indptr"]))
                yield pd.DataFrame({"src": src.astype("int64"), "dst": part["indices"].astype("int64"), "w": part["data"].astype("float64")})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "src long, dst long, w double")


def _graphml(text: str) -> tuple[list[str], list[tuple[str, str, float]], bool]:
    """Node names in order, edges by name, and whether edges are directed by default."""
    root = ElementTree.fromstring(text)
    own = lambda tag: [x for x in root.iter() if x.tag.rsplit("}", 1)[-1] == tag]
    directed = any(g.get("edgedefault") == "directed" for g in own("graph"))
    weights = {k.get("id") for k in own("key") if k.get("attr.name") == "weight"}
    found = []
    for e in own("edge"):
        if e.get("source") is None or e.get("target") is None:
            raise ValueError("an edge without source or target")
        w = [float(x.text) for x in e if x.tag.rsplit("}", 1)[-1] == "data" and x.get("key") in weights and x.text]
        found.append((e.get("source"), e.get("target"), w[0] if w else 1.0))
    return [n.get("id") for n in own("node")], found, directed


def _gml(text: str) -> tuple[list[str], list[tuple[str, str, float]], bool]:
    words = re.findall(r'"[^"]*"|\[|\]|[^\s\[\]]+', re.sub(r"(?m)^\s*#.*$", "", text))
    names, found, directed, stack = [], [], False, []
    at = 0
    while at < len(words):
        word = words[at]
        if word == "]":
            kind, values = stack.pop()
            if kind == "node":
                names.append(values["id"])
            elif kind == "edge":
                if "source" not in values or "target" not in values:
                    raise ValueError("an edge without source or target")
                found.append((values["source"], values["target"], float(values.get("weight", values.get("value", 1)))))
            at += 1
        elif at + 1 < len(words) and words[at + 1] == "[":
            stack.append((word, {}))
            at += 2
        else:
            if at + 1 >= len(words):
                raise ValueError("a key without a value")
            if stack:
                stack[-1][1].setdefault(word, words[at + 1].strip('"'))
                directed |= word == "directed" and words[at + 1] == "1" and stack[-1][0] == "graph"
            at += 2
    return names, found, directed


@register(".gml", ".graphml")
def markup_graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges of GML or GraphML; without `directed` both directions are given. Names that are whole numbers (GraphML also n0, n1 ..) are the
    ids; otherwise nodes are numbered in file order, those that only edges name after the others. An edge without an end is an error."""

    def rows(batches):
        for batch in batches:
            for text in batch["value"]:
                names, found, directed = _graphml(text) if "<graphml" in text else _gml(text)
                names = list(dict.fromkeys([*names, *(x for a, b, _ in found for x in (a, b))]))
                plain = [re.fullmatch(r"n?(-?\d+)", x) for x in names]
                ids = {x: int(m[1]) for x, m in zip(names, plain)} if all(plain) else {}
                if len(set(ids.values())) < len(names):
                    ids = {x: i for i, x in enumerate(names)}
                e = [(ids[a], ids[b], w) for a, b, w in found]
                e += [] if directed else [(b, a, w) for a, b, w in e if a != b]
                yield pd.DataFrame(e, columns=["src", "dst", "w"]).astype({"src": "int64", "dst": "int64", "w": "float64"})

    return spark.read.text(path, wholetext=True).mapInPandas(rows, "src long, dst long, w double")


def load(spark: SparkSession, path: str, directed: bool | None = None, force_undirected: bool = False, weights: bool = False) -> tuple[DataFrame, bool]:
    """(edges, directed) by extension. Undirected graphs come back canonical and simple; with `weights` they keep their loops and the larger
    weight w of both directions, src <= dst. Directed ones have weights always."""
    ext = "." + path.rsplit(".", 1)[-1].lower()
    if ext not in LOADERS:
        raise ValueError(f"no loader for {ext}")
    e = LOADERS[ext](spark, path)
    found = is_directed(e) if directed is None else directed
    if not force_undirected and found:
        return e, True
    if not weights:
        return canonical(e), False
    return e.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("w").alias("w")), False


def from_networkx(spark: SparkSession, graph) -> tuple[DataFrame, DataFrame, bool]:
    """(edges (src, dst, w), nodes (v), directed) of a graph object with nodes, edges(data=True) and is_directed(), such as NetworkX's. Nodes
    are numbered in their order there; an undirected graph is canonical but for its loops."""
    number = {x: i for i, x in enumerate(graph.nodes)}
    directed = bool(graph.is_directed())
    rows = [(number[a], number[b], float(x.get("weight", 1.0))) for a, b, x in graph.edges(data=True)]
    if not directed:
        rows = [(min(a, b), max(a, b), w) for a, b, w in rows]
    return spark.createDataFrame(rows, "src long, dst long, w double"), spark.createDataFrame([(i,) for i in number.values()], "v long"), directed


def is_directed(edges: DataFrame) -> bool:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return not edges.join(back, ["src", "dst", "w"], "left_anti").isEmpty()


def _pairs(lines: DataFrame, pattern: str) -> DataFrame:
    parts = F.split(F.trim("value"), pattern)
    return lines.select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"))


def keep_first(raw: DataFrame, line: str = "line") -> DataFrame:
    """Of each unordered pair (u, v) the first line, in its own direction; loops go."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.least("u", "v"), F.greatest("u", "v")).orderBy(line)
    return raw.where("u <> v").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def raw_lines(spark: SparkSession, path: str, skip: int = 0, separator: str = r"\s+") -> DataFrame:
    """(line, u, v) of a delimited file; `line` grows in file order, and the first `skip` lines are dropped. It is the first byte of the
    line's split plus its place there, which a split's length bounds."""
    numbered = spark.read.text(path).select("value", (F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("line"))
    parts = F.split(F.trim("value"), separator)
    return numbered.where(F.col("line") >= skip).where("trim(value) <> '' and not startswith(value, '#')").select("line", parts[0].cast("long").alias("u"), parts[1].cast("long").alias("v")).where("u is not null and v is not null")


def co_purchase(spark: SparkSession, sf_dir: str, flag: str | None = None, min_quantity: float | None = None) -> DataFrame:
    """Canonical edges between parts that share an order; with `flag` or `min_quantity`, in order lines with that returned flag or at least so many."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if flag:
        li = li.where(F.col("l_returnflag") == flag)
    if min_quantity is not None:
        li = li.where(F.col("l_quantity") >= min_quantity)
    a = li.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("src"))
    b = li.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("dst"))
    return a.join(b, "o").where("src < dst").select(F.col("src").cast("long"), F.col("dst").cast("long")).distinct()


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("v"))


def part_blocks(spark: SparkSession, sf_dir: str, column: str = "p_brand") -> DataFrame:
    from ..operators.blocks import reindex

    return reindex(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("v"), F.col(column).alias("blk")))
