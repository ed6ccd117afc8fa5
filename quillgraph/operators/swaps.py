"""Swaps over all cross-block edges, scored where the edge's packed block lies: no move's cells are shuffled.

Each slice of nodes has a dense table of neighbours by block; a block of edges meets the tables of its two slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed as P
from .blocks import LIMIT, connectivity, cross_edges, sizes, swap_delta, swap_delta_nll

#: Blocks up to which tables are dense; counts (a byte or two each, packed) that are broadcast; moves looked at together.
DENSE_BLOCKS, BROADCAST_COUNTS, TOGETHER = 256, 40_000_000, 1 << 14


def _score(e: np.ndarray, n: np.ndarray, sign: float) -> np.ndarray:
    """nll_cell() on arrays."""
    p = np.clip(e / np.maximum(n, 1), LIMIT, 1 - LIMIT)
    return np.where(n > 0, e * np.log(p) + sign * (n - e) * np.log(1 - p), 0.0)


def _tables(b: P.Blocks, blocks: DataFrame, count: int) -> tuple[DataFrame, np.ndarray]:
    """(p, ids, lab, table) with the packed labels and neighbour counts of each slice, and the whole matrix of ends by blocks."""
    label = P.stored(P.slices(blocks.select("v", F.col("blk").cast("double").alias("blk")), b.cuts, ["blk"], "lab"))

    def neighbours(batches):
        for row in P._rows(batches):
            lab = np.frombuffer(row["lab"]).astype(np.int64)
            each = np.repeat(np.arange(row["rows"]), P.unpack(row["count"], row["rows"]))
            key = each * count + lab[P.unpack(row["col"], row["n"])]
            yield pa.RecordBatch.from_pydict({"p": pa.array([row["p"]], pa.int32()), "x": pa.array([np.bincount(key, minlength=row["rows"] * count).astype(float).tobytes()], pa.binary())})

    found = P.total(b.blocks.join(F.broadcast(label.select(F.col("p").alias("q"), "lab")), "q").mapInArrow(neighbours, "p int, x binary"))

    def shrink(batches):
        for row in P._rows(batches):
            lab, x = np.frombuffer(row["lab"]).astype(np.int64), np.frombuffer(row["x"]).astype(np.int64).reshape(-1, count)
            ends = np.zeros((count, count))
            for k in range(count):
                ends[k] = x[lab == k].sum(axis=0)
            yield pa.RecordBatch.from_pydict({"p": pa.array([row["p"]], pa.int32()), "ids": [row["ids"]], "lab": [P.pack(lab.astype(np.uint32))], "table": [P.pack(x.astype(np.uint32).reshape(-1))], "m": [ends.tobytes()]})

    out = P.stored(label.join(found, "p").mapInArrow(shrink, "p int, ids binary, lab binary, table binary, m binary"))
    total = np.zeros((count, count))
    for row in out.select("m").toLocalIterator():
        total += np.frombuffer(bytes(row[0])).reshape(count, count)
    return out.drop("m"), total


def _moves(edges: DataFrame, blocks: DataFrame, work, schema: str) -> DataFrame | None:
    """What `work` makes of every cross-block edge, or None with too many blocks: it gets ids i and j, blocks a and b, the changes of the
    cells of a and of b, and the matrices of counts and pairs."""
    k = {r[0]: r[1] for r in sizes(blocks).limit(DENSE_BLOCKS + 1).collect()}
    count = max(k, default=-1) + 1
    if not k or count > DENSE_BLOCKS:
        return None
    b = P.blocks_of(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), blocks.select("v"))
    tables, ends = _tables(b, blocks, count)
    size = np.array([k.get(i, 0) for i in range(count)], float)
    m, n = ends - np.diag(np.diag(ends)) / 2, np.outer(size, size) - np.diag(size * (size + 1) / 2)

    def run(batches):
        for row in P._rows(batches):
            ids = [np.frombuffer(row[f"ids{s}"], np.int64) for s in "pq"]
            lab = [P.unpack(row[f"lab{s}"], len(x)).astype(np.int64) for s, x in zip("pq", ids)]
            near = [P.unpack(row[f"table{s}"], len(x) * count).reshape(-1, count) for s, x in zip("pq", ids)]
            each = np.repeat(np.arange(row["rows"]), P.unpack(row["count"], row["rows"]))
            col = P.unpack(row["col"], row["n"]).astype(np.int64)
            ok = lab[0][each] != lab[1][col]
            if row["p"] == row["q"]:
                ok &= each < col
            each, col = each[ok], col[ok]
            for first in range(0, len(each), TOGETHER):
                i, j = each[first : first + TOGETHER], col[first : first + TOGETHER]
                x = near[1][j].astype(np.int64) - near[0][i]
                a, c, r = lab[0][i], lab[1][j], np.arange(len(i))
                one, two = x.copy(), -x
                one[r, a] -= 1  # the swapped pair's own edge stays between the blocks
                one[r, c] = x[r, c] - x[r, a] + 2
                two[r, c] = -x[r, c] - 1
                two[r, a] = 0  # the cell of both is counted once
                yield work(ids[0][i], ids[1][j], a, c, one, two, m, n)

    both = b.blocks.where("p <= q")
    for s in "pq":
        side = tables.select(F.col("p").alias(s), *(F.col(x).alias(x + s) for x in ("ids", "lab", "table")))
        both = both.join(F.broadcast(side) if b.nodes * count <= BROADCAST_COUNTS else side, s)
    return both.mapInArrow(run, schema)


def _plain(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    return cross_edges(edges, blocks).select((F.col("i") * 4294967296 + F.col("j")).alias("move_id"), "i", "a", "j", "b")


def cross_deltas(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(move_id, r, s, de) of swap_delta() for every cross-block edge; the move's id is made of the pair."""

    def work(i, j, a, b, one, two, m, n):
        (r1, t1), (r2, t2) = np.nonzero(one), np.nonzero(two)
        r, x, y = np.concatenate([r1, r2]), np.concatenate([a[r1], b[r2]]), np.concatenate([t1, t2])
        de = np.concatenate([one[r1, t1], two[r2, t2]])
        return pa.RecordBatch.from_pydict({"move_id": pa.array((i * 4294967296 + j)[r]), "r": pa.array(np.minimum(x, y)), "s": pa.array(np.maximum(x, y)), "de": pa.array(de)})

    found = _moves(edges, blocks, work, "move_id long, r long, s long, de long")
    if found is None:
        edges = P.stored(edges)
        return swap_delta(_plain(edges, blocks), edges, blocks)
    return found


def cross_scores(edges: DataFrame, blocks: DataFrame, sign: float = -1.0) -> DataFrame:
    """(move_id, delta_nll) of swap_delta_nll() for every cross-block edge that changes a cell."""

    def work(i, j, a, b, one, two, m, n):
        now = _score(m, n, sign)
        change = np.zeros(len(i))
        for of, de in ((a, one), (b, two)):
            change += np.where(de != 0, _score(m[of] + de, n[of], sign) - now[of], 0.0).sum(axis=1)
        some = np.any(one != 0, axis=1) | np.any(two != 0, axis=1)
        return pa.RecordBatch.from_pydict({"move_id": pa.array((i * 4294967296 + j)[some]), "delta_nll": pa.array(-change[some])})

    found = _moves(edges, blocks, work, "move_id long, delta_nll double")
    if found is None:
        edges = P.stored(edges)
        return swap_delta_nll(swap_delta(_plain(edges, blocks), edges, blocks), P.stored(connectivity(edges, blocks)), sizes(blocks), sign)
    return found
