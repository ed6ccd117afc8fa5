"""Calibrated noise on block statistics, post-processing, and surrogate graphs. Randomness is a hash of seed and key."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import activation_threshold, gaussian_constant, normal, u01, u01_range
from .blocks import possible, possible_pairs, with_pairs, zero_pairs

#: Expected draws of one stretch of a cell when a graph is sampled.
STRETCH = 10_000
#: Nodes that are broadcast to the stretches of a sample (16 bytes each at most); beyond it drawn places are joined to them.
MEMBERS = 5_000_000

CLIP, WEIGHT_CLIP = 1e-12, 1e12
#: No normal() of hash uniforms is larger: the smallest uniform is 2**-33.
LARGEST_DRAW = math.sqrt(66 * math.log(2)) * (1 + 1e-9)


def probabilities(conn: DataFrame, size: DataFrame, clip: float = CLIP) -> DataFrame:
    """conn with n and p = m / n; exact 0 and 1 are moved inside by `clip`."""
    p = F.col("m") / F.col("n")
    return with_pairs(conn, size).withColumn("p", F.when(p == 0, F.lit(clip)).when(p == 1, F.lit(1 - clip)).otherwise(p))


def binomial_quantiles(conn: DataFrame, size: DataFrame, alpha: float) -> DataFrame:
    """(blk, c): the smallest c with prod_s P(Bin(k, p_s) <= c) >= alpha over a row's pairs. Pairs of a block with the same p count as one
    with their number. Pmf by running sums of logarithms; one block's k + 1 values are held at a time."""
    c = with_pairs(conn, size).withColumn("p", F.col("m") / F.col("n")).where("p is not null")
    rows = c.select(F.col("r").alias("blk"), F.col("kr").alias("k"), "p").union(c.where("r <> s").select("s", "ks", "p"))
    rows = rows.groupBy("blk", "k", "p").agg(F.count(F.lit(1)).alias("times"))

    def logs(k: int, p: float, binom: np.ndarray) -> np.ndarray:
        j = np.arange(k + 1.0)
        if p <= 0 or p >= 1:
            pmf = (j == (0 if p <= 0 else k)).astype(float)
        else:
            pmf = np.exp(binom + j * math.log(p) + (k - j) * math.log(1 - p))
        return np.log(np.maximum(np.cumsum(pmf), 1e-300))

    def run(batches):
        blk, total, held, binom = None, None, -1, None

        def found():
            ok = np.flatnonzero(np.exp(total) >= alpha)
            return pa.RecordBatch.from_pydict({"blk": pa.array([blk], pa.int64()), "c": pa.array(ok[:1], pa.int64())}) if len(ok) else None

        for batch in batches:
            for b, k, p, times in zip(*(batch.column(x).to_pylist() for x in ("blk", "k", "p", "times"))):
                if b != blk:
                    if total is not None and (out := found()) is not None:
                        yield out
                    blk, total = b, np.zeros(k + 1)
                if k != held:
                    i = np.arange(1.0, k + 1)
                    held, binom = k, np.concatenate([[0.0], np.cumsum(np.log((k - i + 1) / i))])
                total += times * logs(k, p, binom)
        if total is not None and (out := found()) is not None:
            yield out

    parts = int(size.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(F.col("blk").cast("long").alias("blk"), F.col("k").cast("long").alias("k"), "p", "times")
    quantiles = rows.repartition(parts, "blk").sortWithinPartitions("blk", "p").mapInArrow(run, "blk long, c long")
    return size.join(quantiles, "blk", "left").select("blk", F.coalesce("c", F.lit(0)).cast("long").alias("c"))


def pair_weight(p: Column, n: Column) -> Column:
    return F.least(n / (2.0 * p * (1.0 - p)), F.lit(WEIGHT_CLIP))


def edge_weights(conn: DataFrame, size: DataFrame) -> DataFrame:
    """(r, s, n, w) of stored pairs and of all diagonal cells; a diagonal without edges gets the clip."""
    w = probabilities(conn, size).select("r", "s", "n", pair_weight(F.col("p"), F.col("n")).alias("w"))
    d = size.select(F.col("blk").alias("r"), F.col("blk").alias("s"), F.col("k").alias("kr"), F.col("k").alias("ks"))
    return w.union(d.join(conn, ["r", "s"], "left_anti").select("r", "s", possible("kr", "ks").alias("n"), F.lit(WEIGHT_CLIP).alias("w")))


def block_weights(conn: DataFrame, size: DataFrame) -> DataFrame:
    """(blk, w): weights of block sizes; blocks of one node have no inner term."""
    c = probabilities(conn, size)
    off = c.where(f"r <> s and p > {CLIP} and p < {1 - CLIP}")
    both = off.select(F.col("r").alias("blk"), "kr", "n", "p").union(off.select("s", "ks", "n", "p"))
    outer = both.groupBy("blk").agg(F.sum(2.0 * F.col("n") / (2.0 * F.col("p") * (1 - F.col("p"))) * F.col("p") * F.col("p") / (F.col("kr") * F.col("kr"))).alias("x"))
    inner = c.where("r = s and kr > 1").select(F.col("r").alias("blk"), (pair_weight(F.col("p"), F.col("n")) * F.pow((2 * F.col("kr") - 4) / (F.col("kr") * (F.col("kr") - 1)), 2) * F.col("p") * F.col("p")).alias("y"))
    return size.join(outer, "blk", "left").join(inner, "blk", "left").select("blk", F.least(F.coalesce("x", F.lit(0.0)) + F.coalesce("y", F.lit(0.0)), F.lit(WEIGHT_CLIP)).alias("w"))


def normaliser(conn: DataFrame, size: DataFrame, sensitivity: int) -> DataFrame:
    """One row `total`: sum of sqrt(c w) over block sizes, stored cells and zero pairs (weight 1 / n; pairs without room count nothing).
    Zero pairs are not listed: over all pairs of blocks 1 / sqrt(k_r k_s) sums to half of (sum k^-1/2)^2 - sum 1 / k, and the
    stored ones are taken off."""
    c = float(sensitivity**2)
    stored = with_pairs(conn.where("r <> s"), size)
    every = size.agg(((F.pow(F.sum(1 / F.sqrt("k")), 2) - F.sum(1 / F.col("k"))) / 2).alias("x"))
    held = stored.agg(F.coalesce(F.sum(1 / F.sqrt("n")), F.lit(0.0)).alias("y"))
    parts = [
        block_weights(conn, size).agg(F.sum(F.sqrt("w")).alias("x")),
        edge_weights(conn, size).agg(F.sum(F.sqrt(c * F.col("w"))).alias("x")),
        every.crossJoin(held).select((math.sqrt(c) * F.greatest(F.col("x") - F.col("y"), F.lit(0.0))).alias("x")),
    ]
    total = parts[0].union(parts[1]).union(parts[2]).agg(F.sum("x").alias("total"))
    return total.select(F.when(F.col("total") > 0, F.col("total")).otherwise(1e-12).alias("total"))


def sigmas(conn: DataFrame, size: DataFrame, eps: float, delta: float, sensitivity: int) -> tuple[DataFrame, DataFrame]:
    """(blk, sigma) and (r, s, n, sigma)."""
    k = gaussian_constant(eps, delta)
    factor = (2 * k) ** 2 / F.col("total")
    total = F.broadcast(normaliser(conn, size, sensitivity))
    n = block_weights(conn, size).crossJoin(total).select("blk", F.sqrt(F.sqrt("w") * factor).alias("sigma"))
    e = edge_weights(conn, size).crossJoin(total).select("r", "s", "n", F.sqrt(F.sqrt(float(sensitivity**2) * F.col("w")) * factor).alias("sigma"))
    return n, e


def noisy_counts(conn: DataFrame, sigma: DataFrame, seed: int) -> DataFrame:
    """(r, s, x): stored counts plus noise."""
    return conn.join(sigma.select("r", "s", "sigma"), ["r", "s"], "left").select("r", "s", (F.col("m") + F.coalesce("sigma", F.lit(0.0)) * normal(seed, "r", "s")).alias("x"))


def noisy_sizes(size: DataFrame, sigma: DataFrame, seed: int) -> DataFrame:
    """(blk, x): sizes plus noise of sigma (blk, sigma)."""
    return size.join(sigma.select("blk", "sigma"), "blk", "left").select("blk", (F.col("k") + F.coalesce("sigma", F.lit(0.0)) * normal(seed + 30, "blk")).alias("x"))


def private_acceptance(delta: Column, eps: float, sensitivity: float) -> Column:
    """min(1, exp(-eps delta / (2 sensitivity))): the chance of a swap that changes the score by delta under an exponential mechanism."""
    return F.least(F.lit(1.0), F.exp(-eps * delta / (2.0 * sensitivity)))


def naive_clamp(noisy: DataFrame, sigma: DataFrame, size: DataFrame, k: int, seed: int) -> DataFrame:
    """(r, s, m): a second draw is added, then counts are cut to integers in 0 .. N for blocks of k nodes."""
    full = F.when(F.col("r") == F.col("s"), F.lit(k * (k - 1) // 2)).otherwise(F.lit(k * k))
    x = noisy.join(sigma.select("r", "s", "sigma"), ["r", "s"], "left")
    return x.select("r", "s", F.least(full, F.greatest(F.lit(0.0), F.col("x") + F.coalesce("sigma", F.lit(0.0)) * normal(seed + 10, "r", "s")).cast("long")).cast("long").alias("m"))


def lasso(noisy: DataFrame, sigma: DataFrame, k: int, lam: float | None = None) -> DataFrame:
    """(r, s, m): soft threshold at lam sigma, half-even rounding, 0 .. N."""
    lam = activation_threshold() if lam is None else lam
    full = F.when(F.col("r") == F.col("s"), F.lit(k * (k - 1) // 2)).otherwise(F.lit(k * k))
    x = noisy.join(sigma.select("r", "s", "sigma"), ["r", "s"], "left")
    soft = F.signum("x") * F.greatest(F.abs("x") - lam * F.coalesce("sigma", F.lit(0.0)), F.lit(0.0))
    return x.select("r", "s", F.least(full, F.greatest(F.lit(0), F.bround(soft))).cast("long").alias("m"))


def noisy_zero_pairs(conn: DataFrame, size: DataFrame, factor: Column, sensitivity: int, k: int, seed: int, lam: float = 0.0) -> DataFrame:
    """(r, s, m): zero pairs that noise lifts to a count; lam 0 is the naive form. `factor` is a column of one row with the
    normaliser's `total`."""
    total = float(normaliser(conn, size, sensitivity).first()[0])  # once; every use below is a number
    # a draw is at most LARGEST_DRAW deviations, so cells whose sigma cannot reach a half hold no count and are not listed
    sigma = lambda n: F.sqrt(F.sqrt(F.lit(float(sensitivity**2)) / n) * factor)
    rooms = {"r = s": k * (k - 1) // 2, "r < s": k * k}
    row = size.sparkSession.range(1).select(F.lit(total).alias("total")).select(*(sigma(F.lit(n)).alias(str(i)) if n > 0 else F.lit(0.0).alias(str(i)) for i, n in enumerate(rooms.values()))).first()
    one, all_ = (x * LARGEST_DRAW >= 0.5 for x in row)
    full = F.when(F.col("r") == F.col("s"), F.lit(rooms["r = s"])).otherwise(F.lit(rooms["r < s"]))
    if all_:
        z = zero_pairs(conn, size)
    else:
        cells = size.where(F.lit(one)).select(F.col("blk").alias("r"), F.col("blk").alias("s"))
        z = cells.join(conn.where("r = s"), ["r", "s"], "left_anti")
    z = z.withColumn("total", F.lit(total)).select("r", "s", full.alias("n"), sigma(full).alias("sig"))
    z = z.where("n > 0").withColumn("z", F.col("sig") * normal(seed + 20, "r", "s")).where("z >= 0.5")
    return z.select("r", "s", F.least("n", F.bround(F.greatest(F.col("z") - lam * F.col("sig"), F.lit(0.0))).cast("long")).alias("m")).where("m > 0")


def _stretches(cells: DataFrame) -> DataFrame:
    """Stretches _i of _n places (the others _l) of cells (r, s, n, p ..), with their number of draws _k."""
    c = cells.where("n > 0 and p > 0").withColumn("_c", F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("p") / STRETCH)).cast("long"))
    c = c.withColumn("_l", F.ceil(F.col("n") / F.col("_c")).cast("long")).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1)))
    c = c.withColumn("_n", F.least(F.col("_l"), F.col("n") - F.col("_i") * F.col("_l"))).where("_n > 0")
    mean = F.col("_n") * F.col("p")
    return c.withColumn("_k", F.least(F.col("_n"), F.ceil(mean + 10 * F.sqrt(mean) + 40).cast("long")))


def positions(cells: DataFrame, seed: int) -> DataFrame:
    """(.., at): places 0 .. n - 1 of each cell (r, s, n, p ..), each there with chance p, independently. Gaps between places are
    geometric and drawn by hash, so the work grows with the places drawn, not with n. A cell is cut into stretches of about STRETCH
    expected draws, each summed by itself; a stretch gets ten deviations more draws than it is expected to need, and too few are an error."""
    c = _stretches(cells).withColumn("_d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k"))))
    gap = F.when(F.col("p") >= 1, F.lit(0.0)).otherwise(F.floor(F.log(u01(seed, "r", "s", "_i", "_d")) / F.log(1 - F.col("p"))))
    run = Window.partitionBy("r", "s", "_i").orderBy("_d")
    c = c.withColumn("_at", F.sum(F.least(gap.cast("double"), F.col("_n").cast("double")) + 1).over(run.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    short = (F.col("_d") == F.col("_k")) & (F.col("_at") < F.col("_n") - 1) & (F.col("_k") < F.col("_n"))
    c = c.withColumn("_at", F.when(short, F.raise_error(F.lit("too few draws for a stretch"))).otherwise(F.col("_at")))
    return c.where("_at < _n").withColumn("at", (F.col("_i") * F.col("_l") + F.col("_at")).cast("long")).drop("_c", "_l", "_i", "_n", "_k", "_d", "_at")


def _drawn(blocks: DataFrame, cells: DataFrame, seed: int, directed: bool = False) -> DataFrame:
    """(src, dst): places of cells (r, s, n, p, kr, ks) as pairs of members, numbered by id inside their blocks. Up to MEMBERS nodes are broadcast, and
    a stretch becomes edges where it is drawn; beyond, places are joined to members."""
    whole = {dict(blocks.dtypes)[c] for c in ("v", "blk")} <= {"tinyint", "smallint", "int", "bigint"}
    if whole and blocks.limit(MEMBERS + 1).count() <= MEMBERS:
        return _drawn_in_place(blocks, cells, seed, directed)
    x = positions(cells, seed)
    at = F.col("at")
    if directed:  # a diagonal cell leaves out loops
        wide = F.when(F.col("r") == F.col("s"), F.col("ks") - 1).otherwise(F.col("ks"))
        i = F.floor(at / wide).cast("long")
        j = F.pmod(at, wide)
        j = F.when((F.col("r") == F.col("s")) & (j >= i), j + 1).otherwise(j)
    else:  # a diagonal cell is the triangle j < i
        row = F.floor((1 + F.sqrt(1 + 8.0 * at)) / 2).cast("long")
        row = F.when(row * (row - 1) / 2 > at, row - 1).when(row * (row + 1) / 2 <= at, row + 1).otherwise(row)
        i = F.when(F.col("r") == F.col("s"), row).otherwise(F.floor(at / F.col("ks")).cast("long"))
        j = F.when(F.col("r") == F.col("s"), at - (row * (row - 1) / 2).cast("long")).otherwise(F.pmod(at, F.col("ks")))
    numbered = blocks.withColumn("_n", F.row_number().over(Window.partitionBy("blk").orderBy("v")).cast("long") - 1)
    x = x.select("r", "s", i.alias("i"), j.alias("j"))
    x = x.join(numbered.select(F.col("blk").alias("r"), F.col("_n").alias("i"), F.col("v").alias("u")), ["r", "i"])
    x = x.join(numbered.select(F.col("blk").alias("s"), F.col("_n").alias("j"), F.col("v").alias("w")), ["s", "j"])
    return x.select(F.col("u").alias("src"), F.col("w").alias("dst")) if directed else x.select(F.least("u", "w").alias("src"), F.greatest("u", "w").alias("dst"))


def _drawn_in_place(blocks: DataFrame, cells: DataFrame, seed: int, directed: bool) -> DataFrame:
    """_drawn() without a shuffle of places: stretches are dealt over tasks, and each draws, sums and names its edges by itself."""
    from .packed import _parts

    spark = blocks.sparkSession
    held = blocks.select(F.col("blk").cast("long").alias("blk"), F.col("v").cast("long").alias("v")).where("blk is not null").toArrow()
    b, v = (held.column(c).to_numpy() for c in ("blk", "v"))
    by = np.lexsort((v, b))
    names, first = np.unique(b[by], return_index=True)
    shared = spark.sparkContext.broadcast((dict(zip(names.tolist(), first.tolist())), v[by]))

    def edges(r, s, p, ks, i, length, n, k):
        begin, ids = shared.value
        gap = np.zeros(k) if p >= 1 else np.floor(np.log(u01_range(f"{seed}:{r}:{s}:{i}:", k)) / np.log(1 - p))
        at = np.cumsum(np.minimum(gap, n) + 1) - 1
        if at[-1] < n - 1 and k < n:
            raise ValueError("too few draws for a stretch")
        at = at[: np.searchsorted(at, n)].astype(np.int64) + i * length
        if directed:  # a diagonal cell leaves out loops
            x, y = np.divmod(at, ks - 1 if r == s else ks)
            y += (y >= x) & (r == s)
        elif r == s:  # the triangle y < x
            x = ((1 + np.sqrt(1 + 8.0 * at)) / 2).astype(np.int64)
            x += (x * (x + 1) // 2 <= at).astype(np.int64) - (x * (x - 1) // 2 > at)
            y = at - x * (x - 1) // 2
        else:
            x, y = np.divmod(at, ks)
        x, y = ids[begin[r] + x], ids[begin[s] + y]
        return (x, y) if directed else (np.minimum(x, y), np.maximum(x, y))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(e) for e in edges(*(row[c] for c in columns))], ["src", "dst"])

    columns = ["r", "s", "p", "ks", "_i", "_l", "_n", "_k"]
    kinds = {"p": "double"}
    dealt = _stretches(cells).select(*(F.col(c).cast(kinds.get(c, "long")).alias(c) for c in columns)).repartition(4 * _parts(blocks))
    kind = dict(blocks.dtypes)["v"]
    return dealt.mapInArrow(run, "src long, dst long").select(F.col("src").cast(kind), F.col("dst").cast(kind))


def sample_graph(blocks: DataFrame, conn: DataFrame, seed: int, directed: bool = False) -> DataFrame:
    """Edges of a surrogate: each pair of nodes in a pair of blocks with m > 0 edges is drawn with chance m / n, so the work grows with
    the edges. Undirected edges are canonical; with `directed`, conn holds ordered pairs of blocks and edges are ordered. The
    draw is a hash, so a lost task repeats it exactly."""
    size = blocks.groupBy("blk").agg(F.count(F.lit(1)).alias("k"))
    p = with_pairs(conn.where("m > 0"), size)
    if directed:
        p = p.withColumn("n", F.when(F.col("r") == F.col("s"), F.col("kr") * (F.col("kr") - 1)).otherwise(F.col("kr") * F.col("ks")))
    return _drawn(blocks, p.where("n > 0").select("r", "s", "n", F.least(F.col("m") / F.col("n"), F.lit(1.0)).alias("p"), "kr", "ks"), seed, directed)


def checked_sample(size: DataFrame, conn: DataFrame, seed: int, directed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(blocks, edges) of a released fit: sizes (blk, k) and counts (r, s, m). Nodes are numbered block by block. Sizes below 1, blocks
    without a size, negative counts and counts above the pairs there are raise ValueError."""
    rows = size.where("k is null or k < 1 or k <> floor(k)").limit(1).count()
    if rows or size.count() != size.select("blk").distinct().count():
        raise ValueError("block sizes must be whole numbers of at least 1, one a block")
    ends = conn.select(F.explode(F.array("r", "s")).alias("blk")).join(size, "blk", "left_anti")
    if not ends.isEmpty():
        raise ValueError("a count names a block without a size")
    room = F.when(F.col("r") == F.col("s"), F.col("kr") * (F.col("kr") - 1) / (1 if directed else 2)).otherwise(F.col("kr") * F.col("ks"))
    if not with_pairs(conn, size).where((F.col("m") < 0) | (F.col("m") > room)).isEmpty():
        raise ValueError("a count is negative or above the pairs of its blocks")
    if not directed and not conn.where("r > s").isEmpty():
        raise ValueError("undirected counts hold each pair of blocks once, r <= s")
    offsets = size.select("blk", "k", (F.sum("k").over(Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("k")).alias("o"))
    blocks = offsets.select("blk", F.explode(F.expr("sequence(cast(o as bigint), cast(o + k - 1 as bigint))")).alias("v")).select("v", "blk")
    return blocks, sample_graph(blocks, conn, seed, directed)


def planted_partition(blocks: DataFrame, p_in: float, p_out: float, seed: int) -> DataFrame:
    """Canonical edges of a planted partition."""
    return sample_matrix(blocks, None, seed, (p_in, p_out))


def sample_matrix(blocks: DataFrame, chances: DataFrame | None, seed: int, planted: tuple[float, float] | None = None) -> DataFrame:
    """Canonical edges from chances (r, s, p) of all pairs of blocks, or from a pair of them for inside and between blocks. A chance outside
    0 .. 1, a pair given twice with different chances, or a pair without one raises ValueError."""
    size = blocks.groupBy("blk").agg(F.count(F.lit(1)).alias("k"))
    every = with_pairs(possible_pairs(size).select("r", "s"), size)
    if planted is not None:
        if not all(0 <= p <= 1 for p in planted):
            raise ValueError("chances lie in 0 .. 1")
        cells = every.withColumn("p", F.when(F.col("r") == F.col("s"), float(planted[0])).otherwise(float(planted[1])))
    else:
        if not chances.where("p is null or p < 0 or p > 1").isEmpty():
            raise ValueError("chances lie in 0 .. 1")
        given = chances.groupBy(F.least("r", "s").alias("r"), F.greatest("r", "s").alias("s")).agg(F.min("p").alias("p"), F.max("p").alias("q"))
        if not given.where("p <> q").isEmpty() or not every.join(given, ["r", "s"], "left_anti").isEmpty():
            raise ValueError("chances must be a symmetric matrix over all blocks")
        cells = every.join(given.drop("q"), ["r", "s"])
    return _drawn(blocks, cells.select("r", "s", "n", "p", "kr", "ks"), seed)


def expected_counts(chances: DataFrame, size: DataFrame) -> DataFrame:
    """(r, s, m) with r <= s: round(p n), half to even, cells of 0 left out."""
    return with_pairs(chances.where("r <= s"), size).select("r", "s", F.bround(F.col("p") * F.col("n")).cast("long").alias("m")).where("m > 0")


def homogeneous_sigma(blocks: int, eps: float, delta: float, tail: float, sensitivity: float) -> float:
    """One sigma for all sizes and counts."""
    total = blocks + blocks * (blocks + 1) / 2 * sensitivity**2
    return math.sqrt(total / (eps**2 / (2 * math.log(1.25 / (delta + tail)))))


def homogeneous_draw(conn: DataFrame, size: DataFrame, sigma: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(blk, k) of at least 1 and (r, s, m) with the same noise on every size and stored count. Counts are cut to integers, then
    held to the pairs that the rounded noisy sizes leave; sizes of blocks without any count stay unrounded, as doubles."""
    k = F.greatest(F.lit(1.0), F.col("k") + sigma * normal(seed, "blk"))
    touched = conn.where("m <> 0").select(F.explode(F.array("r", "s")).alias("blk")).distinct().withColumn("t", F.lit(True))
    drawn = size.select("blk", k.alias("k")).join(touched, "blk", "left").select("blk", F.when(F.col("t"), F.bround("k")).otherwise(F.col("k")).alias("k"))
    x = conn.where("m <> 0").select("r", "s", (F.col("m") + sigma * normal(seed + 10, "r", "s")).cast("long").alias("m"))
    c = x.where("m <> 0").join(drawn.select(F.col("blk").alias("r"), F.col("k").alias("kr")), "r").join(drawn.select(F.col("blk").alias("s"), F.col("k").alias("ks")), "s")
    full = F.when(F.col("r") == F.col("s"), F.col("kr") * (F.col("kr") - 1) / 2).otherwise(F.col("kr") * F.col("ks")).cast("long")
    return drawn, c.select("r", "s", F.least("m", full).alias("m"))
