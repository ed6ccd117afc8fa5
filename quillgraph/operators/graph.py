"""Edges, degrees and one-dimensional distances."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import packed

#: Directed edges of a graph that is broadcast for searches (16 bytes each, with the offsets); beyond it frontiers are joined.
BROADCAST_EDGES = 5_000_000
#: The same for distances that are only counted (4 bytes each in a task), and words of searches that a step gathers at once.
COUNTED_EDGES, GATHERED = 20_000_000, 4_000_000
#: Nodes of a graph whose components one last task settles from forests (16 bytes each); beyond it rounds of joins.
FOREST_NODES = 20_000_000
#: Searches that run together, one bit each; a multiple of 64.
TOGETHER = 256
#: Edges among three colours of nodes that one task counts triangles of (about 40 bytes each), and wedges it looks at together.
TRIANGLE_EDGES, WEDGES = 6_000_000, 2_000_000
#: Edges below which one colour, so one task, is enough.
ONE_COLOUR = 100_000


def canonical(edges: DataFrame) -> DataFrame:
    """Simple undirected edges: src < dst, once each, no loops."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(u, v) in both directions."""
    return edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))


def asymmetric_edges(directed: DataFrame) -> DataFrame:
    back = directed.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return directed.join(back, ["u", "v"], "left_anti")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(v, degree) of all nodes. Counted before the join, so only one row a node is shuffled there."""
    d = edges.select(F.explode(F.array("src", "dst")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(d, "v", "left").select("v", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_histogram(deg: DataFrame) -> DataFrame:
    """(degree, frequency) from 0 to the largest degree, gaps included."""
    counts = deg.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.max("degree").alias("top"), F.sum("n").alias("total"))
    grid = ends.select(F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("degree"), "total")
    return grid.join(counts, "degree", "left").select("degree", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("frequency"))


def wasserstein(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row `emd`: the first Wasserstein distance between samples (x), or values with their counts (x, n). Samples are counted by value first. Distinct values are dealt by
    range; each range sums inside, and only the ranges' totals and first values, one row a partition, are put in order on one task."""
    from ..plans.session import cut

    number = [F.sum("n") if "n" in s.columns else F.count(F.lit(1)) for s in (a, b)]
    one = a.groupBy("x").agg(number[0].alias("p")).select("x", "p", F.lit(0).cast("long").alias("q"))
    two = b.groupBy("x").agg(number[1].alias("q")).select("x", F.lit(0).cast("long").alias("p"), "q")
    both = one.union(two).where("x is not null").groupBy("x").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(both.repartitionByRange(parts, "x").withColumn("_p", F.spark_partition_id()))
    ranges = dealt.groupBy("_p").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"), F.min("x").alias("low"))
    before, whole = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = F.lit(0)
    ranges = ranges.select("_p", F.coalesce(F.sum("sp").over(before), zero).alias("op"), F.coalesce(F.sum("sq").over(before), zero).alias("oq"), F.sum("sp").over(whole).alias("tp"), F.sum("sq").over(whole).alias("tq"), F.lead("low").over(Window.orderBy("_p")).alias("next"))
    run = Window.partitionBy("_p").orderBy("x")
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    step = dealt.join(F.broadcast(ranges), "_p").select(
        ((F.col("op") + F.sum("p").over(upto)) / F.col("tp")).alias("f"),
        ((F.col("oq") + F.sum("q").over(upto)) / F.col("tq")).alias("g"),
        (F.coalesce(F.lead("x").over(run), "next") - F.col("x")).alias("dx"),
    )
    return step.agg(F.coalesce(F.sum(F.abs(F.col("f") - F.col("g")) * F.col("dx")), F.lit(0.0)).alias("emd"))


def _corners(u: np.ndarray, v: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
    """(node, triangles) of distinct edges (u, v), counting those whose corners keep() lets pass. Edges lead from lower to higher degree, and the
    third side is looked up in a table of bits before the sorted edges."""
    ids, x = np.unique(np.concatenate([u, v]), return_inverse=True)
    n, m = len(ids), len(u)
    place = np.empty(n, np.int64)
    place[np.argsort(np.bincount(x, minlength=n), kind="stable")] = np.arange(n)
    ids, x = ids[np.argsort(place)], place[x]
    key = np.sort(np.minimum(x[:m], x[m:]) * n + np.maximum(x[:m], x[m:]))
    a, b = key // n, key % n
    begin = np.searchsorted(a, np.arange(n + 1))
    shift = np.uint64(64 - min(26, max(10, m.bit_length() + 3)))
    slot = lambda k: (k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> shift).view(np.int64)
    there = np.zeros(1 << (64 - int(shift)), bool)
    there[slot(key)] = True
    count, found = begin[b + 1] - begin[b], np.zeros(n, np.int64)
    upto = np.cumsum(count)
    at = 0
    while at < m:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + WEDGES, side="right")))
        k = count[at:end]
        row = np.repeat(np.arange(at, end), k)
        c = b[np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k) + begin[b[row]]]
        side = a[row] * n + c
        hit = np.flatnonzero(there[slot(side)])
        hit = hit[key[np.minimum(np.searchsorted(key, side[hit]), m - 1)] == side[hit]]
        three = np.stack([a[row[hit]], b[row[hit]], c[hit]])
        three = three[:, keep(*ids[three])]
        found += np.bincount(three.ravel(), minlength=n)
        at = end
    some = np.flatnonzero(found)
    return ids[some], found[some]


def closed_wedges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(v, triangles): nodes are dealt over colours by hash, so many that the edges among three colours are about TRIANGLE_EDGES; a task
    counts the triangles whose corners have its colours. Edges travel in packed blocks, a lowest colour at a time; no wedge is shuffled."""
    edges = edges if hasattr(edges, "_stored") else packed.stored(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")))
    total = edges.count()
    colours = 1 if total < ONE_COLOUR else max(3, int(np.ceil(np.sqrt(6 * total / TRIANGLE_EDGES))))

    def colour(v: np.ndarray) -> np.ndarray:
        z = v.astype(np.int64).view(np.uint64) * np.uint64(0xD1342543DE82EF95)
        return ((z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % colours

    out = None
    for i in range(colours):

        def deal(batches, i=i):
            held, size = [], 0
            for batch in itertools.chain(batches, [None]):
                if batch is not None:
                    held.append([batch.column(c).to_numpy() for c in ("src", "dst")])
                    size += batch.num_rows
                if size and (batch is None or size >= packed.CHUNK):
                    u, v = (np.concatenate([h[k] for h in held]) for k in (0, 1))
                    by = np.argsort(u)
                    u, v = u[by], v[by]
                    x, y = colour(u), colour(v)
                    kind = np.minimum(x, y) * colours + np.maximum(x, y)
                    for j in range(i, colours):
                        for k in range(j, colours):
                            own = np.flatnonzero(np.logical_or.reduce([kind == t for t in {i * colours + j, i * colours + k, j * colours + k}]))
                            if len(own):
                                yield pa.RecordBatch.from_pydict({"p": pa.array([j], pa.int32()), "q": pa.array([k], pa.int32()), "n": [len(own)], "u": [packed.pack(np.diff(u[own], prepend=0))], "v": [packed.pack(v[own])]})
                    held, size = [], 0

        def count(batches, i=i):
            for (j, k), parts in packed._groups(batches, ("n", "u", "v")):
                u = np.concatenate([np.cumsum(packed.unpack(x[1], x[0], np.int64)) for x in parts])
                v = np.concatenate([packed.unpack(x[2], x[0], np.int64) for x in parts])
                node, found = _corners(u, v, lambda a, b, c: np.ones(len(a), bool) if i == j == k else (colour(a) != colour(b)) | (colour(b) != colour(c)))
                yield pa.RecordBatch.from_pydict({"v": pa.array(node), "triangles": pa.array(found)})

        dealt = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).mapInArrow(deal, "p int, q int, n long, u binary, v binary")
        dealt = dealt.repartition((colours - i) * (colours - i + 1) // 2, "p", "q").sortWithinPartitions("p", "q")
        part = packed.stored(dealt.mapInArrow(count, "v long, triangles long").groupBy("v").agg(F.sum("triangles").alias("triangles")))
        out = part if out is None else out.union(part)
    return out.groupBy("v").agg(F.sum("triangles").alias("triangles"))


def local_clustering(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(v, clustering) of all nodes, 0 below degree 2."""
    d = degrees(edges, nodes)
    return d.join(closed_wedges(edges, nodes), "v", "left").select("v", F.when(F.col("degree") < 2, 0.0).otherwise(2.0 * F.coalesce("triangles", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).alias("clustering"))


def assortativity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row `assortativity`: Pearson correlation of degrees over both directions of all edges."""
    d = degrees(edges, nodes)
    s = both_ways(edges).join(d.select(F.col("v").alias("u"), F.col("degree").cast("double").alias("x")), "u").join(d.select("v", F.col("degree").cast("double").alias("y")), "v")
    return s.agg(F.corr("x", "y").alias("assortativity"))


def _smallest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node reachable from each of n nodes over edges (u, v): minimum labels with pointer jumping."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = np.flatnonzero(a != b)
        if not len(apart):
            return root
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up := root[root], root):
            root = up


def _forest(batches, most: int = 2_000_000):
    """Edges (u, v) as the edges (smallest node reachable, v) of their components, at most one a node."""

    def settled(held):
        u, v = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = _smallest(at[: len(u)], at[len(u) :], len(ids))
        some = np.flatnonzero(root != np.arange(len(ids)))
        return [(ids[root[some]], ids[some])], len(some)

    held, count, kept = [], 0, 0
    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")))
        count += batch.num_rows
        if count >= most + 2 * kept:
            held, kept = settled(held)
            count = kept
    if held:
        (u, v), *_ = settled(held)[0]
        yield pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v)})


def components(edges: DataFrame, nodes: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, component): the smallest node reachable. Each task leaves a forest of its edges, and one task joins the forests; a graph of more than
    FOREST_NODES goes by minimum labels with pointer jumping, a reliable checkpoint each round."""
    from ..plans.session import cut

    if nodes.count() <= FOREST_NODES:
        spark = nodes.sparkSession
        pairs = edges.select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v"))
        trees = pairs.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(_forest, "u long, v long").repartition(1).mapInArrow(_forest, "u long, v long")
        return nodes.select("v").join(trees, "v", "left").select("v", F.coalesce("u", "v").alias("component"))
    sym = cut(both_ways(edges))
    label = cut(nodes.select("v", F.col("v").alias("c")))
    for _ in range(max_rounds):
        low = sym.join(label.select(F.col("v").alias("u"), F.col("c").alias("cu")), "u").groupBy("v").agg(F.min("cu").alias("m"))
        hooked = label.join(low, "v", "left").select("v", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("c"))
        jump = hooked.select(F.col("v").alias("r"), F.col("c").alias("rc"))
        nxt = cut(hooked.join(jump, F.col("c") == F.col("r")).select("v", "old", F.least("c", "rc").alias("c")))
        same = nxt.where("old <> c").isEmpty()
        label = nxt.select("v", "c")
        if same:
            return label.withColumnRenamed("c", "component")
    raise RuntimeError("components did not settle")


def largest_component(comp: DataFrame) -> DataFrame:
    """Nodes (v) of the largest component; ties go to the smallest label."""
    top = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return comp.join(F.broadcast(top.select("component")), "component", "left_semi").select("v")


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.withColumnRenamed("v", "src"), "src", "left_semi").join(nodes.withColumnRenamed("v", "dst"), "dst", "left_semi")


def bfs(edges: DataFrame, sources: DataFrame, cutoff: int | None = None) -> DataFrame:
    """(s, v, d): shortest distances from each source (v) to every node it reaches. The frontier advances by a join and
    keeps what an anti join has not seen."""
    from ..plans.session import cut

    sym = cut(both_ways(edges))
    seen = cut(sources.select(F.col("v").alias("s"), "v", F.lit(0).cast("long").alias("d")))
    front, d = seen, 0
    while (cutoff is None or d < cutoff) and not front.isEmpty():
        d += 1
        nxt = front.select("s", F.col("v").alias("u")).join(sym, "u").select("s", "v").distinct()
        front = cut(nxt.join(seen.select("s", "v"), ["s", "v"], "left_anti").select("s", "v", F.lit(d).cast("long").alias("d")))
        seen = cut(seen.union(front))
    return seen


def _packed(edges: DataFrame, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(ids, offsets, neighbours) of the graph both ways, if it has at most `most` directed edges (BROADCAST_EDGES without it)."""
    most = (BROADCAST_EDGES if most is None else most) // 2
    if edges.limit(most + 1).count() > most:
        return None
    t = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).toArrow()
    a, b = t.column("src").to_numpy(), t.column("dst").to_numpy()
    del t
    ids = np.union1d(np.unique(a), np.unique(b))
    a, b = (np.searchsorted(ids, x).astype(np.int32) for x in (a, b))
    u, w = np.concatenate([a, b]), np.concatenate([b, a])
    del a, b
    by = np.argsort(u, kind="stable")
    return ids, np.concatenate([[0], np.cumsum(np.bincount(u, minlength=len(ids)))]), w[by]


def _by_component(packed: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, place of each sorted id, offsets, neighbours, where components begin): a packed graph whose components stand one after the other."""
    ids, offsets, to = packed
    u = np.repeat(np.arange(len(ids)), np.diff(offsets))
    root = _smallest(u, to.astype(np.int64), len(ids))
    by = np.argsort(root, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[by] = np.arange(len(ids))
    row = np.argsort(place[u], kind="stable")
    begin = np.flatnonzero(np.diff(root[by], prepend=-1))
    return ids, place, np.concatenate([[0], np.cumsum(np.diff(offsets)[by])]), place[to[row]].astype(np.int32), np.append(begin, len(ids))


def _advance(front: np.ndarray, seen: np.ndarray, all_: np.ndarray, starts: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The searches (bits of `all_`) that first come to each node from a neighbour in `front`. In a large graph a small front is sent to its neighbours;
    else nodes gather from theirs, GATHERED words at a time. Where the front is dense only nodes that a search has not seen do, and
    they look at no more neighbours once none is missing."""
    n, width = front.shape
    out = np.zeros_like(front)
    if not (seen != all_).any():
        return out
    some = GATHERED // width
    if len(near) > some:
        on = np.flatnonzero(front.any(axis=1))
        sizes = starts[on + 1] - starts[on]
        if 8 * sizes.sum() < len(near):
            first = np.cumsum(sizes) - sizes
            to = near[np.arange(sizes.sum()) + np.repeat(starts[on] - first, sizes)]
            by = np.argsort(to, kind="stable")
            to = to[by]
            head = np.flatnonzero(np.diff(to, prepend=-1))
            out[to[head]] = np.bitwise_or.reduceat(front.take(np.repeat(on, sizes)[by], axis=0), head, axis=0)
            return out & ~seen
    dense = len(near) > 32 * n and 16 * int(np.bitwise_count(front).sum()) > n * int(np.bitwise_count(all_).sum())
    if not dense:
        at = 0
        while at < n:
            end = n if len(near) <= some else max(at + 1, int(np.searchsorted(starts, starts[at] + some, side="right")) - 1)
            out[at:end] = np.bitwise_or.reduceat(front.take(near[starts[at] : starts[end]], axis=0), starts[at:end] - starts[at], axis=0)
            at = end
        return out & ~seen
    rows = np.flatnonzero((seen != all_).any(axis=1))
    upto, at = np.cumsum(np.minimum(starts[rows + 1] - starts[rows], 16)), 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + some, side="right")))
        todo, skip, step = rows[at:end], 0, 16
        while len(todo):
            k = np.minimum(starts[todo + 1] - starts[todo] - skip, step)
            first = np.cumsum(k) - k
            out[todo] |= np.bitwise_or.reduceat(front.take(near[np.arange(k.sum()) + np.repeat(starts[todo] + skip - first, k)], axis=0), first, axis=0)
            skip += step
            todo = todo[starts[todo + 1] - starts[todo] > skip]
            todo = todo[((seen[todo] | out[todo]) != all_).any(axis=1)]
        at = end
    return out & ~seen


def _together(offsets: np.ndarray, to: np.ndarray, begin: np.ndarray, sources: np.ndarray):
    """Searches from sorted places `sources`, TOGETHER at a time inside one component: yields (first, count, lowest place, level, reached), where
    reached[node - lowest, i // 64] has the bit i % 64 set if source first + i gets to the node at that level first."""
    comp = np.searchsorted(begin, sources, side="right") - 1
    ends = np.append(np.flatnonzero(np.diff(comp)) + 1, len(sources))
    first = 0
    for end in ends:
        low, high = begin[comp[first]], begin[comp[first] + 1]
        starts = offsets[low : high + 1] - offsets[low]
        near = to[offsets[low] : offsets[high]].astype(np.intp) - low
        for at in range(first, end, TOGETHER):
            own = sources[at : min(at + TOGETHER, end)] - low
            i = np.arange(len(own))
            front = np.zeros((high - low, -(-len(own) // 64)), np.uint64)
            np.bitwise_or.at(front, (own, i // 64), np.uint64(1) << (i % 64).astype(np.uint64))
            seen, level = front.copy(), 0
            all_ = np.bitwise_or.reduce(front, axis=0)
            while True:
                level += 1
                front = _advance(front, seen, all_, starts, near)
                if not front.any():
                    break
                seen |= front
                if (yield at, len(own), low, level, front):
                    break
        first = end


def distance_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(d, n): how many ordered pairs of different nodes have the distance d. Where the graph is small enough to broadcast, many searches run
    together, one bit each, and only their counts leave a task; else the rows of distances() are counted."""
    packed = _packed(edges, COUNTED_EDGES)
    if packed is None:
        return distances(edges, nodes).where("s <> v").groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    spark = edges.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = len(packed[0])
    shared = spark.sparkContext.broadcast(_by_component(packed))
    known = nodes.select(F.col("v").cast("long").alias("v")).distinct()

    def run(batches):
        ids, place, offsets, to, begin = shared.value
        v = np.concatenate([np.zeros(0, np.int64), *(batch.column("v").to_numpy(zero_copy_only=False) for batch in batches)])
        at = np.searchsorted(ids, v)
        v, at = v[at < len(ids)], at[at < len(ids)]
        counts = {}
        for _, _, _, level, front in _together(offsets, to, begin, np.sort(place[at[ids[at] == v]])):
            counts[level] = counts.get(level, 0) + int(np.bitwise_count(front).sum())
        yield pa.RecordBatch.from_pydict({"d": pa.array(list(counts), pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})

    # tasks get neighbouring ids, so that searches of one component meet
    dealt = known.repartitionByRange(max(1, min(parts, n // TOGETHER)), "v")
    return dealt.mapInArrow(run, "d long, n long").groupBy("d").agg(F.sum("n").alias("n"))


def distances(edges: DataFrame, sources: DataFrame, cutoff: int | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(s, v, d) as bfs(). Where the graph is small enough to broadcast (its size is measured), sources are dealt over tasks and each
    searches by itself, one level of the whole frontier at a time; else the frontiers of all sources are joined. With `targets` (s, v)
    only those rows are given, each as often as it stands there."""
    packed = _packed(edges)
    if packed is None:
        found = bfs(edges, sources, cutoff)
        return found if targets is None else targets.select("s", "v").join(found, ["s", "v"])
    spark = edges.sparkSession
    if targets is not None and cutoff is None:
        return _drawn_distances(spark, packed, targets)
    shared = spark.sparkContext.broadcast(packed)

    def run(batches):
        ids, offsets, to = shared.value
        for batch in batches:
            wanted = batch.column("to") if "to" in batch.schema.names else None
            for i, s in enumerate(batch.column("v").to_pylist()):
                at = int(np.searchsorted(ids, s))
                if at < len(ids) and ids[at] == s:
                    dist = np.full(len(ids), -1, np.int64)
                    dist[at], front, d = 0, np.array([at]), 0
                    while len(front) and (cutoff is None or d < cutoff):
                        d += 1
                        count = offsets[front + 1] - offsets[front]
                        first = np.cumsum(count) - count
                        near = to[np.arange(count.sum()) + np.repeat(offsets[front] - first, count)]
                        near = near[dist[near] < 0]
                        dist[near] = d
                        front = np.unique(near)
                    seen = np.flatnonzero(dist >= 0)
                    v, d = ids[seen], dist[seen]
                else:
                    v, d = np.array([s]), np.array([0])
                if wanted is not None:
                    t = np.array(wanted[i].as_py(), np.int64)
                    place = np.minimum(np.searchsorted(v, t), len(v) - 1)
                    t, place = t[v[place] == t], place[v[place] == t]
                    v, d = t, d[place]
                yield pa.RecordBatch.from_pydict({"s": pa.array(np.full(len(v), s, np.int64)), "v": pa.array(v.astype(np.int64)), "d": pa.array(d.astype(np.int64))})

    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    if targets is None:
        rows = sources.select(F.col("v").cast("long").alias("v"))
    else:
        rows = targets.groupBy(F.col("s").cast("long").alias("v")).agg(F.collect_list(F.col("v").cast("long")).alias("to"))
    return rows.repartition(parts).mapInArrow(run, "s long, v long, d long")


def _drawn_distances(spark, packed: tuple, targets: DataFrame) -> DataFrame:
    """(s, v, d) of the targets (s, v) that are reached, by searches that run together."""
    shared = spark.sparkContext.broadcast(_by_component(packed))

    def run(batches):
        ids, place, offsets, to, begin = shared.value
        held = [[batch.column(c).to_numpy(zero_copy_only=False) for c in ("s", "v")] for batch in batches]
        if not held:
            return
        s, v = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        d = np.where(s == v, 0, -1)
        at = np.stack([np.minimum(np.searchsorted(ids, x), max(len(ids) - 1, 0)) for x in (s, v)])
        ok = np.flatnonzero((ids[at[0]] == s) & (ids[at[1]] == v) & (d < 0)) if len(ids) else np.zeros(0, np.int64)
        a, b = place[at[:, ok]] if len(ids) else at[:, ok]
        same = np.searchsorted(begin, a, side="right") == np.searchsorted(begin, b, side="right")
        ok, a, b = ok[same], a[same], b[same]
        by = np.argsort(a, kind="stable")
        ok, a, b = ok[by], a[by], b[by]
        sources, i = np.unique(a, return_inverse=True)
        search = _together(offsets, to, begin, sources)
        step = next(search, None)
        while step is not None:
            first, count, low, level, front = step
            own = slice(*np.searchsorted(i, [first, first + count]))
            bit, node = i[own] - first, b[own] - low
            hit = front[node, bit // 64] >> (bit % 64).astype(np.uint64) & np.uint64(1)
            d[ok[own][hit > 0]] = level
            try:
                step = search.send(bool((d[ok[own]] >= 0).all()))
            except StopIteration:
                step = None
        yield pa.RecordBatch.from_pydict({"s": pa.array(s[d >= 0]), "v": pa.array(v[d >= 0]), "d": pa.array(d[d >= 0].astype(np.int64))})

    pairs = targets.select(F.col("s").cast("long").alias("s"), F.col("v").cast("long").alias("v"))
    return pairs.repartition(2 * spark.sparkContext.defaultParallelism, "s").mapInArrow(run, "s long, v long, d long")


def weighted_distances(edges: DataFrame, sources: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(s, v, d): least sums of nonnegative weights w over undirected edges (src, dst, w), by rounds of relaxation."""
    from ..plans.session import cut

    if not edges.where("w < 0").isEmpty():
        raise ValueError("weights must not be negative")
    one = edges.select(F.col("src").alias("u"), F.col("dst").alias("x"), F.col("w").cast("double").alias("w"))
    sym = cut(one.union(one.select(F.col("x").alias("u"), F.col("u").alias("x"), "w")).groupBy("u", "x").agg(F.min("w").alias("w")))
    best = cut(sources.select(F.col("v").alias("s"), "v", F.lit(0.0).alias("d")))
    front = best
    for _ in range(max_rounds):
        step = front.join(sym, front["v"] == sym["u"]).groupBy("s", "x").agg(F.min(F.col("d") + F.col("w")).alias("n")).withColumnRenamed("x", "v")
        front = cut(step.join(best, ["s", "v"], "left").where("d is null or n < d").select("s", "v", F.col("n").alias("d")))
        if front.isEmpty():
            return best
        best = cut(best.join(front.withColumnRenamed("d", "n"), ["s", "v"], "full").select("s", "v", F.coalesce("n", "d").alias("d")))
    raise RuntimeError("distances did not settle")


def largest(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of the largest component."""
    from ..plans.session import cut

    edges = packed.stored(edges)
    kept = cut(largest_component(cut(components(edges, nodes))))
    return within(edges, kept), kept


def path_lengths(edges: DataFrame, nodes: DataFrame, samples: int | None = 10_000, exact: int = 2_000, seed: int = 0, lcc: bool = True) -> DataFrame:
    """(x): shortest distances between different nodes of the largest component. Up to `exact` nodes, or without `samples`, those of all
    ordered pairs; else of min(samples, n (n - 1) / 2) ordered pairs drawn by hash, with repeats. Distances are never cut."""
    from ..functions.scalars import u01
    from ..plans.session import cut
    from .ordering import ranked

    if lcc:
        edges, nodes = largest(edges, nodes)
    edges, nodes = packed.stored(edges), cut(nodes)
    n = nodes.count()
    if samples is None or n <= exact:
        return distances(edges, nodes).where("s <> v").select(F.col("d").alias("x"))
    draws = nodes.sparkSession.range(min(samples, n * (n - 1) // 2))
    i, j = F.floor(u01(seed, "id") * n).cast("long"), F.floor(u01(seed + 1, "id") * (n - 1)).cast("long")
    draws = draws.select("id", i.alias("i"), F.when(j >= i, j + 1).otherwise(j).alias("j"))
    numbered = cut(ranked(nodes, "v").select("rank", "v"))
    pairs = draws.join(numbered.select(F.col("rank").alias("i"), F.col("v").alias("s")), "i").join(numbered.select(F.col("rank").alias("j"), "v"), "j").select("s", "v")
    pairs = cut(pairs)
    return distances(edges, pairs.select(F.col("s").alias("v")).distinct(), None, pairs).select(F.col("d").alias("x"))


def path_counts(edges: DataFrame, nodes: DataFrame, samples: int | None = 10_000, exact: int = 2_000, seed: int = 0, lcc: bool = True) -> DataFrame:
    """(x, n): how often path_lengths() has each distance. Where all pairs count, they are counted by distance_counts()."""
    from ..plans.session import cut

    if lcc:
        edges, nodes = largest(edges, nodes)
    edges, nodes = packed.stored(edges), cut(nodes)
    if samples is None or nodes.count() <= exact:
        return distance_counts(edges, nodes).select(F.col("d").alias("x"), "n")
    return path_lengths(edges, nodes, samples, exact, seed, False).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
