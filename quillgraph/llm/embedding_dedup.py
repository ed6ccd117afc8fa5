"""Near-duplicate vectors by an inverted multi-index.

Vectors are cut in halves; each half has a codebook of its own, learnt by k-means on a bounded sample (`sample_rows`).
A vector lies in the cell of its two nearest codewords, one of books x books cells. (about
16 vectors a cell unless `books` is given). A query visits cells in order of the sum of
its distances to their codewords (multi-sequence traversal). How many cells it visits follows from the data: sampled queries are compared with all
vectors, and the number is chosen so that their links are found with at least `recall`, from either end by itself. Where these queries have fewer than
LEAST_LINKS links, pairs made at the threshold, the hardest there are, decide as well; where the cells looked at do not reach the recall, more are, up
to all of them. In a visited cell the cosine is computed in double precision from the whole vectors; pairs below the threshold
are never linked. Equal vectors are indexed once, with their count.

Every vector is indexed and queried. Links are counted where they are found, and only a spanning forest of each visited cell leaves it, never
its pairs. Crowded cells are split into blocks of bounded size. Defined cases: vectors that are null, empty, zero or
hold null or non-finite components link with nothing and are their own component; vectors of another length than most lie in one (split) cell
per length and link only among themselves; a null vec_id keeps its row, unlinked, with a null component; rows that repeat a
vec_id count as separate vectors where they differ and all count as copies where they are equal.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_util import connected_components, cut, join_hot, shuffle_partitions, tree_sum

BLOCK = 4096
QUERY_SAMPLE = 400
LEAST_LINKS = 100


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        near = nearest(x, centre)
        for j in range(len(centre)):
            own = x[near == j]
            centre[j] = own.mean(0) if len(own) else x[rng.integers(len(x))]
    return centre


def _distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centre.T + (centre * centre).sum(1)[None], 0)


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argmin(_distances(x, centre), axis=1)


def multi_sequence(d1: np.ndarray, d2: np.ndarray, cells: int) -> list[tuple[int, int]]:
    """The first `cells` pairs (i, j) in order of d1[i] + d2[j], by a heap over the sorted sequences."""
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    a, b = d1[o1].tolist(), d2[o2].tolist()
    heap, seen, out = [(a[0] + b[0], 0, 0)], {(0, 0)}, []
    while heap and len(out) < cells:
        _, i, j = heapq.heappop(heap)
        out.append((o1[i], o2[j]))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (a[x] + b[y], x, y))
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class MultiIndex:
    def __init__(self, sample: np.ndarray, books: int):
        self.dim, self.half = sample.shape[1], sample.shape[1] // 2
        x = _unit(sample)
        self.first, self.second = kmeans(x[:, : self.half], books), kmeans(x[:, self.half :], books, seed=4)
        self.width = len(self.second)
        self.visits = 1

    def cells(self, v: np.ndarray) -> np.ndarray:
        x = _unit(v)
        return nearest(x[:, : self.half], self.first) * self.width + nearest(x[:, self.half :], self.second)

    def probes(self, v: np.ndarray, visits: int) -> list[list[int]]:
        x = _unit(v)
        d1, d2 = _distances(x[:, : self.half], self.first), _distances(x[:, self.half :], self.second)
        return [[i * self.width + j for i, j in multi_sequence(p, q, visits)] for p, q in zip(d1, d2)]


def _matrix(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.float64) for x in b.column("v").to_pylist()]


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the components as packed doubles; only rows that can link."""

    def run(batches):
        for b in batches:
            ids, out = [], []
            for i, x in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist()):
                if i is not None and x and None not in x:
                    v = np.array(x, np.float64)
                    with np.errstate(over="ignore"):
                        if np.isfinite(v).all() and v.any():
                            top = np.abs(v).max()
                            v = v if 1e-100 < top < 1e100 else v / top
                            ids.append(i)
                            out.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "v"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, v binary")


def _choose_visits(reps: DataFrame, index: MultiIndex, queries: np.ndarray, ids: np.ndarray, threshold: float, recall: float) -> int:
    """Cells to visit so that each end of a sampled query's links finds the other in `recall` of them."""
    cells = len(index.first) * index.width
    most = min(cells, 256)
    while True:
        t = _link_ranks(reps, index, queries, ids, threshold, most)
        ranks = [t] if t is not None and t.sum() else []
        if not ranks or ranks[0].sum() < 2 * LEAST_LINKS:
            ranks.append(_made_ranks(index, queries, threshold, most))
        visits = [int(np.searchsorted(np.cumsum(r), recall * r.sum())) + 1 for r in ranks]
        if max(visits) <= most:
            return max(4, *visits)
        if most == cells:  # every cell is visited: nothing is missed
            return cells
        most = min(cells, 4 * most)


def _made_ranks(index: MultiIndex, queries: np.ndarray, threshold: float, most: int) -> np.ndarray:
    """How many made pairs at exactly the threshold have the partner's cell at each place of the traversal; the last counts those beyond."""
    rng = np.random.default_rng(11)
    q = _unit(queries)
    away = rng.normal(size=q.shape)
    away -= (away * q).sum(1)[:, None] * q
    other = threshold * q + np.sqrt(1 - threshold**2) * away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    total = np.zeros(most + 1)
    for near, cell in ((index.probes(q, most), index.cells(other)), (index.probes(other, most), index.cells(q))):
        for p, c in zip(near, cell.tolist()):
            total[p.index(c) if c in p else most] += 1
    return total


def _link_ranks(reps: DataFrame, index: MultiIndex, queries: np.ndarray, ids: np.ndarray, threshold: float, most: int) -> np.ndarray | None:
    """The same for the links of sampled queries with all vectors, from both ends."""
    shared = reps.sparkSession.sparkContext.broadcast((index, _unit(queries), ids, index.probes(queries, most), index.cells(queries)))

    def run(batches):
        idx, q, qid, seen, own = shared.value
        place = [{c: r for r, c in enumerate(p)} for p in seen]
        total = np.zeros(most + 1, np.int64)
        for b in batches:
            rows = [(i, v) for i, v in zip(b.column("rep").to_pylist(), _matrix(b)) if len(v) == idx.dim]
            if rows:
                x = np.stack([v for _, v in rows])
                close = np.argwhere(_unit(x) @ q.T >= threshold)
                close = [(r, k) for r, k in close.tolist() if rows[r][0] != qid[k]]
                if close:
                    cells = idx.cells(x)
                    back = {r: {c: n for n, c in enumerate(idx.probes(x[r : r + 1], most)[0])} for r in {r for r, _ in close}}
                    for r, k in close:
                        total[place[k].get(int(cells[r]), most)] += 1
                        total[back[r].get(int(own[k]), most)] += 1
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.astype(np.float64).tobytes()], pa.binary())})

    return tree_sum(reps.mapInArrow(run, "part binary"), "part")


def find_links(vectors: DataFrame, threshold: float = 0.95, books: int | None = None, sample_rows: int = 20_000, recall: float = 0.99) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, counts, links): members (vec_id, rep, key, copies) of classes of equal vectors, the vectors of other classes that each class is linked
    to (key, others), and links (a, b) between classes with cosine >= threshold that join all that are linked."""
    spark = vectors.sparkSession
    usable = _usable(vectors)
    classes = cut(usable.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("key", F.concat_ws(":", F.col("rep"), F.sha1("v"))))
    members = join_hot(usable, classes.select("v", "rep", "key", "copies"), ["v"]).select("vec_id", "rep", "key", "copies")
    reps = classes.select("key", "rep", "v", "copies")
    total = classes.count()
    if not total:
        return members, classes.select("key", F.lit(0).cast("long").alias("others")).where("false"), classes.select(F.col("key").alias("a"), F.col("key").alias("b")).where("false")
    dims = classes.groupBy(F.length("v").alias("bytes")).count().orderBy(F.desc("count"), "bytes").first()
    share = max(1, -(-total // sample_rows))
    of_dim = reps.where(F.length("v") == dims["bytes"])
    picked = of_dim.where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).orderBy(F.xxhash64("key"), "key").limit(sample_rows).select("rep", "v").collect()
    if not picked:
        picked = of_dim.orderBy("key").limit(1).select("rep", "v").collect()
    sample = np.stack([np.frombuffer(bytes(r["v"]), np.float64) for r in picked])
    index = MultiIndex(sample, books or int(np.clip(np.sqrt(total / 16), 8, 1024)))
    index.visits = _choose_visits(reps.select("rep", "v"), index, sample[:QUERY_SAMPLE], np.array([r["rep"] for r in picked[:QUERY_SAMPLE]]), threshold, recall)
    shared = spark.sparkContext.broadcast(index)

    def place(batches):
        idx = shared.value
        for b in batches:
            vs = _matrix(b)
            cell = np.array([-len(v) for v in vs], np.int64)
            fit = [i for i, v in enumerate(vs) if len(v) == idx.dim]
            if fit:
                cell[fit] = idx.cells(np.stack([vs[i] for i in fit]))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("v"), b.column("copies"), pa.array(cell)], ["key", "v", "copies", "cell"])

    placed = reps.select("key", "v", "copies").mapInArrow(place, "key string, v binary, copies long, cell long")
    blocks = {r["cell"]: -(-r["count"] // BLOCK) for r in placed.groupBy("cell").count().where(F.col("count") > BLOCK).collect()}
    split = spark.sparkContext.broadcast(blocks)

    def spread(batches):
        idx = shared.value
        for b in batches:
            out: list[tuple] = []
            vs, keys = _matrix(b), b.column("key").to_pylist()
            fit = [i for i, v in enumerate(vs) if len(v) == idx.dim]
            probes: dict[int, list[int]] = dict(zip(fit, idx.probes(np.stack([vs[i] for i in fit]), idx.visits))) if fit else {}
            for i, (key, v, copies, cell) in enumerate(zip(keys, b.column("v").to_pylist(), b.column("copies").to_pylist(), b.column("cell").to_pylist())):
                n = split.value.get(cell, 1)
                out.append((cell, hash_block(key, n), 0, key, copies, v))
                for c in probes.get(i, [cell]):
                    out.extend((c, k, 1, key, copies, v) for k in range(split.value.get(c, 1)))
                if len(out) > 20_000:
                    yield _spread_batch(out)
                    out = []
            yield _spread_batch(out)

    def compare(batches):
        where, keys, held, unit, copies, root = None, [], [], None, [], []

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for b in batches:
            left, right, count = [], [], []
            rows = list(zip(*(b.column(c).to_pylist() for c in ("cell", "block", "probe", "key", "copies", "v"))))
            i = 0
            while i < len(rows):
                at = rows[i][:2]
                if at != where:
                    where, keys, held, unit, copies, root = at, [], [], None, [], []
                j = i
                while j < len(rows) and rows[j][:3] == rows[i][:3]:
                    j += 1
                if rows[i][2] == 0:
                    keys += [r[3] for r in rows[i:j]]
                    copies += [r[4] for r in rows[i:j]]
                    held += [np.frombuffer(r[5], np.float64) for r in rows[i:j]]
                elif keys:
                    if unit is None:
                        unit, copies, root = _unit(np.stack(held)), np.array(copies), list(range(len(keys)))
                        number = {k: n for n, k in enumerate(keys)}
                    for s in range(i, j, 1024):
                        part = rows[s : min(s + 1024, j)]
                        close = _unit(np.stack([np.frombuffer(r[5], np.float64) for r in part])) @ unit.T >= threshold
                        own = [number.get(r[3], -1) for r in part]
                        inside = [x for x, n in enumerate(own) if n >= 0]
                        close[inside, [own[x] for x in inside]] = False
                        for x in np.flatnonzero(close.any(axis=1)).tolist():
                            hits = np.flatnonzero(close[x])
                            left.append(part[x][3])
                            right.append(None)
                            count.append(int(copies[hits].sum()))
                            first = int(hits[0])
                            if own[x] < 0 or find(own[x]) != find(first):
                                left.append(part[x][3])
                                right.append(keys[first])
                                count.append(None)
                                if own[x] >= 0:
                                    root[find(own[x])] = find(first)
                            for y in hits[1:].tolist():
                                if find(y) != find(first):
                                    root[find(y)] = find(first)
                                    left.append(keys[first])
                                    right.append(keys[y])
                                    count.append(None)
                i = j
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(count, pa.int64())], ["a", "b", "n"])

    rows = placed.mapInArrow(spread, "cell long, block int, probe int, key string, copies long, v binary")
    found = cut(rows.repartition(shuffle_partitions(spark), "cell", "block").sortWithinPartitions("cell", "block", "probe").mapInArrow(compare, "a string, b string, n long"))
    counts = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("others"))
    return members, counts, found.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def hash_block(key: str, n: int) -> int:
    """A block below n, spread by the key's bytes."""
    return int.from_bytes(key.rpartition(":")[2][:8].encode(), "little") % 1_000_003 % n


def _spread_batch(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary()))], ["cell", "block", "probe", "key", "copies", "v"])


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, books: int | None = None, sample_rows: int = 20_000, recall: float = 0.99) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of `vectors`."""
    members, counts, links = find_links(vectors, threshold, books, sample_rows, recall)
    members = cut(members)
    classes = members.groupBy("key").agg(F.min("rep").alias("rep"))
    edges = links.join(classes.select(F.col("key").alias("a"), F.col("rep").alias("x")), "a").join(classes.select(F.col("key").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # rows of one vec_id that differ are one node
    part = connected_components(edges.union(members.select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))))
    own = join_hot(members.select("vec_id", "key", "copies"), counts, ["key"], "left").select("vec_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"))
    own = own.join(part.withColumnRenamed("node", "vec_id"), "vec_id", "left").select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = ids.where("vec_id is null or embedding is null or size(embedding) = 0 or exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) or forall(embedding, x -> x = 0)")
    alone = bad.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
