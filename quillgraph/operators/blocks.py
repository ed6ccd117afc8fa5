"""Block statistics: sizes, connectivity, probabilities, likelihoods, moves.

blocks (v, blk) with blk 0 .. B - 1; sizes (blk, k); conn (r, s, m) with r <= s, absent pairs meaning 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import both_ways

LIMIT = 1e-6
#: Cells of the matrix on which blocks are matched.
MATCHING_CELLS = 4_000_000


def reindex(blocks: DataFrame) -> DataFrame:
    """Block ids become 0 .. B - 1 in order. Ranks are taken over the distinct ids, not over all nodes."""
    ids = blocks.select("blk").distinct().withColumn("_i", F.dense_rank().over(Window.orderBy("blk")).cast("long") - 1)
    return blocks.join(ids, "blk").select("v", F.col("_i").alias("blk"))


def sizes(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("blk").agg(F.count(F.lit(1)).alias("k"))


def members(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("blk").agg(F.sort_array(F.collect_set("v")).alias("members"))


def labelled(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(src, dst, bs, bd)."""
    return edges.join(blocks.select(F.col("v").alias("src"), F.col("blk").alias("bs")), "src").join(blocks.select(F.col("v").alias("dst"), F.col("blk").alias("bd")), "dst")


def connectivity(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    return labelled(edges, blocks).groupBy(F.least("bs", "bd").alias("r"), F.greatest("bs", "bd").alias("s")).agg(F.count(F.lit(1)).alias("m"))


def possible(kr: str, ks: str) -> Column:
    return F.when(F.col("r") == F.col("s"), (F.col(kr) * (F.col(kr) - 1) / 2).cast("long")).otherwise(F.col(kr) * F.col(ks))


def with_pairs(conn: DataFrame, size: DataFrame) -> DataFrame:
    """conn with the block sizes and possible pairs n."""
    out = conn.join(size.select(F.col("blk").alias("r"), F.col("k").alias("kr")), "r").join(size.select(F.col("blk").alias("s"), F.col("k").alias("ks")), "s")
    return out.withColumn("n", possible("kr", "ks"))


def possible_pairs(size: DataFrame) -> DataFrame:
    """(r, s, n) of all pairs of blocks; B squared rows by definition."""
    a, b = size.select(F.col("blk").alias("r"), F.col("k").alias("kr")), size.select(F.col("blk").alias("s"), F.col("k").alias("ks"))
    return a.join(b, F.col("r") <= F.col("s")).select("r", "s", possible("kr", "ks").alias("n"))


def zero_pairs(conn: DataFrame, size: DataFrame) -> DataFrame:
    return possible_pairs(size).join(conn, ["r", "s"], "left_anti")


def nll_cell(e: Column, n: Column, sign: float = -1.0) -> Column:
    """Score of a cell with the parity sign (-1): e ln p - (n - e) ln(1 - p); +1 is the Bernoulli log-likelihood."""
    p = F.greatest(F.lit(LIMIT), F.least(F.lit(1 - LIMIT), e / n))
    return F.when(n > 0, e * F.log(p) + sign * (n - e) * F.log(1 - p)).otherwise(0.0)


def nll(conn: DataFrame, size: DataFrame, sign: float = -1.0) -> DataFrame:
    """One row `nll`."""
    return with_pairs(conn, size).agg((-F.sum(nll_cell(F.col("m"), F.col("n"), sign))).alias("nll"))


def nll_slow(conn: DataFrame, size: DataFrame, eps: float = 1e-6) -> DataFrame:
    """The cell-by-cell form: probabilities bounded below only; counts are validated; rows of singletons are left out."""
    c = with_pairs(conn, size).where("kr > 1 and n > 0")
    c = c.withColumn("m", F.when((F.col("m") < 0) | (F.col("m") > F.col("n")), F.raise_error(F.lit("edge count outside 0..n"))).otherwise(F.col("m")))
    p = F.col("m") / F.col("n")
    cell = F.when(F.col("m") == 0, 0.0).otherwise(F.col("m") * F.log(F.greatest(p, F.lit(eps))) - (F.col("n") - F.col("m")) * F.log(F.greatest(1 - p, F.lit(eps))))
    return c.agg((-F.sum(cell)).alias("nll"))


def neighbour_blocks(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(v, blk, n): neighbours of v in each block."""
    return both_ways(edges).join(blocks.select(F.col("v"), "blk"), "v").groupBy(F.col("u").alias("v"), "blk").agg(F.count(F.lit(1)).alias("n"))


def boundary(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    return labelled(edges, blocks).where("bs <> bd").select(F.explode(F.array("src", "dst")).alias("v")).distinct()


def categories(size: DataFrame, k: int) -> DataFrame:
    return size.select("blk", "k", F.when(F.col("k") > k + 1, "over").when(F.col("k") == k + 1, "one_over").when(F.col("k") == k, "exact").otherwise("under").alias("category"))


def uniform_blocks(nodes: DataFrame, k: int) -> DataFrame:
    """Chunks of k consecutive ids; a last chunk that is too small joins the one before."""
    n = nodes.count()
    return nodes.select("v", F.least(F.floor(F.col("v") / k), F.lit(max(1, n // k) - 1)).cast("long").alias("blk"))


def swap_delta(moves: DataFrame, edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(move_id, r, s, de): changed cells when i (block a) and j (block b) of each move trade places."""
    kn = neighbour_blocks(edges, blocks)
    i, j = (kn.select(F.col("v").alias(x), F.col("blk").alias("t"), F.col("n").alias("n")) for x in ("i", "j"))
    base = moves.join(edges.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.lit(1).alias("adj")), (F.least("i", "j") == F.col("x")) & (F.greatest("i", "j") == F.col("y")), "left").select("move_id", "i", "a", "j", "b", F.coalesce("adj", F.lit(0)).alias("adj"))
    ki = base.join(i, "i").select("move_id", "a", "b", "adj", "t", (-F.col("n")).alias("x"))
    kj = base.join(j, "j").select("move_id", "a", "b", "adj", "t", F.col("n").alias("x"))
    # x sums to k_j[t] - k_i[t]: what row a gains in column t and row b loses
    gain = ki.union(kj).groupBy("move_id", "a", "b", "t").agg(F.sum("x").alias("x"))
    row_a = gain.select("move_id", F.col("a").alias("p"), F.col("t").alias("q"), "x", "a", "b")
    row_b = gain.select("move_id", F.col("b").alias("p"), F.col("t").alias("q"), (-F.col("x")).alias("x"), "a", "b")
    cells = row_a.union(row_b).select("move_id", F.least("p", "q").alias("r"), F.greatest("p", "q").alias("s"), F.col("x").alias("de"))
    # the swapped pair's own edge stays between the blocks
    own = base.where("adj = 1").select("move_id", F.explode(F.array(
        F.struct(F.least("a", "b").alias("r"), F.greatest("a", "b").alias("s"), F.lit(2).cast("long").alias("de")),
        F.struct(F.col("a").alias("r"), F.col("a").alias("s"), F.lit(-1).cast("long").alias("de")),
        F.struct(F.col("b").alias("r"), F.col("b").alias("s"), F.lit(-1).cast("long").alias("de")),
    )).alias("c")).select("move_id", "c.r", "c.s", "c.de")
    return cells.union(own).groupBy("move_id", "r", "s").agg(F.sum("de").alias("de")).where("de <> 0")


def swap_delta_nll(delta: DataFrame, conn: DataFrame, size: DataFrame, sign: float = -1.0) -> DataFrame:
    """(move_id, delta_nll)."""
    d = with_pairs(delta, size).join(conn, ["r", "s"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    change = nll_cell(F.col("m") + F.col("de"), F.col("n"), sign) - nll_cell(F.col("m"), F.col("n"), sign)
    return d.groupBy("move_id").agg((-F.sum(change)).alias("delta_nll"))


def apply_delta(conn: DataFrame, delta: DataFrame) -> DataFrame:
    return conn.select("r", "s", "m").union(delta.select("r", "s", F.col("de").alias("m"))).groupBy("r", "s").agg(F.sum("m").alias("m")).where("m <> 0")


def overwritten(increments: DataFrame) -> DataFrame:
    """(move_id, r, s, de): of the increments (move_id, seq, r, s, de) of a cell the last one, r <= s; of two with one seq the larger."""
    x = increments.select("move_id", F.least("r", "s").alias("r"), F.greatest("r", "s").alias("s"), "seq", "de")
    return x.groupBy("move_id", "r", "s").agg(F.max_by("de", F.struct("seq", "de")).alias("de"))


def diagonal_counts(conn: DataFrame, size: DataFrame) -> DataFrame:
    """(blk, m) of all blocks, 0 without inner edges."""
    return size.select("blk").join(conn.where("r = s").select(F.col("r").alias("blk"), "m"), "blk", "left").select("blk", F.coalesce("m", F.lit(0)).cast("long").alias("m"))


def counts_for_pairs(conn: DataFrame, pairs: DataFrame) -> DataFrame:
    """(r, s, m) for each of the pairs, 0 where there is no count."""
    return pairs.select("r", "s").join(conn, ["r", "s"], "left").select("r", "s", F.coalesce("m", F.lit(0)).cast("long").alias("m"))


def add_block(size: DataFrame, blocks: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sizes, blocks) with a new last block that holds `nodes` (v), or none; nodes leave their old blocks. Counts do not change
    where the block is empty; else connectivity() gives the new ones."""
    spark = size.sparkSession
    new = int(size.agg(F.coalesce(F.max("blk") + 1, F.lit(0))).first()[0])
    if nodes is None:
        return size.select("blk", "k").union(spark.createDataFrame([(new, 0)], "blk long, k long")), blocks
    moved = blocks.join(nodes.select("v", F.lit(True).alias("_m")), "v", "full").select("v", F.when(F.col("_m"), F.lit(new)).otherwise(F.col("blk")).cast("long").alias("blk"))
    all_ = size.select("blk").union(spark.createDataFrame([(new,)], "blk long"))
    return all_.join(sizes(moved), "blk", "left").select("blk", F.coalesce("k", F.lit(0)).cast("long").alias("k")), moved


def remove_block(size: DataFrame, conn: DataFrame, blk: int) -> tuple[DataFrame, DataFrame]:
    """(sizes, conn) without a block; the ids above it move down by one."""
    down = lambda c: (F.col(c) - (F.col(c) > blk).cast("long")).alias(c)
    return size.where(F.col("blk") != blk).select(down("blk"), "k"), conn.where((F.col("r") != blk) & (F.col("s") != blk)).select(down("r"), down("s"), "m")


def apply_moves(blocks: DataFrame, moves: DataFrame) -> DataFrame:
    to = moves.select(F.explode(F.array(F.struct(F.col("i").alias("v"), F.col("b").alias("to")), F.struct(F.col("j").alias("v"), F.col("a").alias("to")))).alias("x")).select("x.v", "x.to")
    return blocks.join(to, "v", "left").select("v", F.coalesce("to", "blk").alias("blk"))


def cross_edges(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Edge-based swap candidates."""
    return labelled(edges, blocks).where("bs <> bd").select(F.col("src").alias("i"), F.col("bs").alias("a"), F.col("dst").alias("j"), F.col("bd").alias("b"))


def wedge_counts(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Open-wedge swap candidates i - j - k with i and k in one block and j in another, counted for (j, block): n members give n (n - 1) / 2
    wedges, which are never listed."""
    nb = neighbour_blocks(edges, blocks).join(blocks.select("v", F.col("blk").alias("own")), "v").where("blk <> own and n > 1")
    return nb.select(F.col("v").alias("j"), F.col("own").alias("a"), F.col("blk").alias("b"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("wedges"))


def triad_candidates(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(blk, touches, n): members of blk with a neighbour in block `touches`, counted."""
    nb = neighbour_blocks(edges, blocks).join(blocks.select("v", F.col("blk").alias("own")), "v").where("blk <> own")
    return nb.groupBy(F.col("own").alias("a"), F.col("blk").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def twin_leaves(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(i, a, j, b): leaves i in a and j in b whose only neighbours lie in b and a."""
    nb = neighbour_blocks(edges, blocks)
    leaf = nb.groupBy("v").agg(F.sum("n").alias("d"), F.max("blk").alias("nb")).where("d = 1").join(blocks, "v").where("blk <> nb")
    x, y = leaf.select(F.col("v").alias("i"), F.col("blk").alias("a"), F.col("nb").alias("b")), leaf.select(F.col("v").alias("j"), F.col("blk").alias("b"), F.col("nb").alias("a"))
    return x.join(y, ["a", "b"]).where("i < j").select("i", "a", "j", "b")


def modularity(conn: DataFrame) -> DataFrame:
    """One row `modularity` of a partition, from its connectivity."""
    total = conn.agg(F.sum("m").alias("e"))
    ends = conn.select(F.explode(F.array(F.struct(F.col("r").alias("c"), F.col("m").alias("d")), F.struct(F.col("s").alias("c"), F.col("m").alias("d")))).alias("x"), F.when(F.col("r") == F.col("s"), F.col("m")).otherwise(0).alias("w"))
    per = ends.groupBy(F.col("x.c").alias("c")).agg(F.sum("x.d").alias("d"), (F.sum("w") / 2).alias("inside"))
    return per.crossJoin(F.broadcast(total)).agg(F.sum(F.col("inside") / F.col("e") - F.pow(F.col("d") / (2 * F.col("e")), 2)).alias("modularity"))


def map_equation(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row `codelength`: the two-level map equation of a partition of an undirected graph, in bits."""
    e = labelled(edges, blocks)
    m2 = F.lit(2.0)
    total = edges.agg(F.count(F.lit(1)).alias("e"))
    plogp = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)
    deg = both_ways(edges).groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    nodes = deg.crossJoin(F.broadcast(total)).agg(F.sum(plogp(F.col("d") / (m2 * F.col("e")))).alias("hn"))
    ends = e.select(F.explode(F.array(F.struct(F.col("bs").alias("c"), (F.col("bs") != F.col("bd")).cast("int").alias("x")), F.struct(F.col("bd").alias("c"), (F.col("bs") != F.col("bd")).cast("int").alias("x")))).alias("y")).groupBy("y.c").agg(F.sum("y.x").alias("cut"), F.count(F.lit(1)).alias("vol"))
    q, p = F.col("cut") / (m2 * F.col("e")), F.col("vol") / (m2 * F.col("e"))
    mods = ends.crossJoin(F.broadcast(total)).agg(F.sum(q).alias("q"), F.sum(plogp(q)).alias("hq"), F.sum(plogp(q + p)).alias("hp"))
    return mods.crossJoin(nodes).select((plogp(F.col("q")) - 2 * F.col("hq") - F.col("hn") + F.col("hp")).alias("codelength"))


def contingency(estimated: DataFrame, truth: DataFrame) -> DataFrame:
    """(estimated, truth, n) of two assignments (v, blk)."""
    return estimated.select("v", F.col("blk").alias("estimated")).join(truth.select("v", F.col("blk").alias("truth")), "v").groupBy("estimated", "truth").agg(F.count(F.lit(1)).alias("n"))


def misclassification(estimated: DataFrame, truth: DataFrame) -> float:
    """1 - (nodes on the best one-to-one matching of blocks) / nodes. The counts are made in Spark; the matching is solved on the driver, on
    a matrix of blocks by blocks of at most MATCHING_CELLS cells."""
    cells = contingency(estimated, truth).limit(MATCHING_CELLS + 1).collect()
    rows, cols = sorted({r["estimated"] for r in cells}), sorted({r["truth"] for r in cells})
    if len(rows) * len(cols) > MATCHING_CELLS:
        raise ValueError("too many blocks to match")
    if not cells:
        return 0.0
    at, to = {x: i for i, x in enumerate(rows)}, {x: i for i, x in enumerate(cols)}
    m = np.zeros((len(rows), len(cols)))
    for r in cells:
        m[at[r["estimated"]], to[r["truth"]]] = r["n"]
    return float(1 - best_matching(m) / m.sum())


def best_matching(gain: np.ndarray) -> float:
    """The largest sum of cells, at most one a row and one a column, by shortest augmenting paths with potentials."""
    cost = -np.asarray(gain if gain.shape[0] <= gain.shape[1] else gain.T, float)
    n, m = cost.shape
    row_of = np.full(m, -1)
    u, v = np.zeros(n), np.zeros(m)
    for start in range(n):
        least, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col = start, -1
        while True:
            slack = cost[row] - u[row] - v
            better = ~done & (slack < least)
            least[better], back[better] = slack[better], col
            open_ = np.where(done, np.inf, least)
            nxt = int(np.argmin(open_))
            step = open_[nxt]
            u[start] += step
            u[row_of[done]] += step
            v[done] -= step
            least[~done] -= step
            done[nxt], col = True, nxt
            if row_of[nxt] < 0:
                break
            row = row_of[nxt]
        while col >= 0:
            row_of[col] = start if back[col] < 0 else row_of[back[col]]
            col = back[col]
    held = row_of >= 0
    return float(-cost[row_of[held], np.flatnonzero(held)].sum())
