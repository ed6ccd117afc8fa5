"""Exact n-gram Jaccard join and the components of its links: a size-aware heavy-light join.

A text's set holds its distinct k-word shingles (64-bit hashes). Small sets enumerate the subsets that are left
when up to d = n - ceil(t n) members are taken away; two linked sets, both small, share one. Large sets use
inverted lists: under one global order, linked sets share one of their first d + 1 members. The boundary
between small and large is the size at which the estimated cost of both sides is least; sets just below the
boundary appear on both sides, so that no pair across it is lost.

The global order puts members with few occurrences first. It comes from a counting sketch over every
shingle of the corpus, one byte a cell (a logarithm) and between 2**20 and 2**24 cells, one for some forty shingles, so what is broadcast is
bounded by 16 MB. Any order gives the same links; this one keeps the lists short.

What is joined are classes of rows with the same set. Lists longer than LIST_ROWS are cut into blocks by hash, and each pair of blocks
becomes a list of its own, so no task holds more than about two blocks. Inside a list, candidates must be close in size, have enough members left after their place in the list's order, and be close in a parity bitmap (each
differing bit proves a differing member), compared in NumPy without emitting rows. Of the survivors only a spanning forest leaves the task,
so a list of m near copies gives at most m - 1 rows. Forest edges are then verified on the whole sets. If
one fails, rows that are still in a surviving pair across components get bitmaps eight times as fine for another forest;
the few pairs that survive these and still lie across components are all emitted and verified, which makes the components exact.

Defined cases: null texts and texts without words have an empty set and link with nothing; with fewer than k
words, the whole sequence is the one shingle; identical sets link (even when their texts differ); a null doc_id
keeps its row, links with nothing and has a null component; rows that repeat a doc_id count as one document
when linking, whatever links one of their texts has, and each keeps its row with the set size of its own text.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .spark_util import connected_components, cut, drop, join_hot, release, shuffle_partitions, small_or_shuffled, stored, trim_workers

#: Fewest and most cells of the sketch, as powers of two.
SKETCH_BITS = (20, 24)
#: Rows of one list that a task compares at once; longer lists are cut into blocks.
LIST_ROWS = 20_000
#: Subsets one small set may enumerate at most, which bounds the rows of a text.
MAX_SUBSETS = 500


def _removable(n: int, percent: int) -> int:
    """How many members of a set of n may be missing from a linked set."""
    return n - -(-n * percent // 100)


def _sets(batch: pa.RecordBatch, k: int):
    data, at = T.text_buffer(batch.column("text"))
    data = T.LOWER[data]
    starts, ends, words = T.word_spans(data, at, T.NONSPACE)
    return T.shingle_hashes(T.span_hashes(data, starts, ends), words, k, short=True)


def _distinct(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes, sorted and without repeats."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    return h, np.searchsorted(o, np.arange(len(at)))


def _sums(h: np.ndarray, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Two 64-bit hashes of each set."""
    m = T.mix(h)
    with np.errstate(over="ignore"):
        runs = (np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (m, T.mix(m)))
        s1, s2 = (r[at[1:]] - r[at[:-1]] for r in runs)
    return pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64))


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, s1, s2, items): the sorted set of each text and its hashes."""

    def run(batches):
        for batch in batches:
            for b in T.slices(batch, "text"):
                h, at = _distinct(*_sets(b, k))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *_sums(h, at), T.list_column(h.view(np.int64), at, pa.int64())], ["doc_id", "s1", "s2", "items"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, s1 long, s2 long, items array<long>")


def _squeezed(x: np.ndarray) -> bytes:
    """Counts by planes of their bytes, of which most are zero, compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def _whole_counts(packed: bytes, kind: type, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed, n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def count_sketch(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Eight times the binary logarithm of the occurrences of all shingles by hash cell (0 for none), and how many texts have each set
    size up to 63 (then in 63)."""
    low, high = SKETCH_BITS
    bits = min(high, max(low, int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0).bit_length() - 8))
    pieces = 16

    def run(batches):
        total, sizes = np.zeros(1 << bits, np.uint32), np.zeros(64, np.int64)
        for batch in batches:
            for b in T.slices(batch, "text"):
                h, at = _sets(b, k)
                np.add.at(total, (h >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
                sizes += np.bincount(np.minimum(np.diff(at), 63), minlength=64)
        for i, x in enumerate([*np.split(total, pieces), sizes]):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([_squeezed(x)], pa.binary())], ["piece", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = _whole_counts(c.as_py(), np.uint32, (1 << bits) // pieces) if p < pieces else _whole_counts(c.as_py(), np.int64, 64)
                sums[p] = sums[p] + x if p in sums else x.astype(np.int64)
        for p, x in sums.items():
            out = np.where(x > 0, np.minimum(1 + np.round(8 * np.log2(np.maximum(x, 1))), 255), 0).astype(np.uint8) if p < pieces else x
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["piece", "counts"])

    rows = docs.select("text").mapInArrow(run, "piece int, counts binary").repartition(pieces, "piece").mapInArrow(add, "piece int, counts binary").collect()
    total, sizes = np.zeros((pieces, (1 << bits) // pieces), np.uint8), np.zeros(64, np.int64)
    for r in rows:
        if r["piece"] < pieces:
            total[r["piece"]] = np.frombuffer(bytes(r["counts"]), np.uint8)
        else:
            sizes += np.frombuffer(bytes(r["counts"]), np.int64)
    return total.ravel(), sizes


def size_boundary(sizes: np.ndarray, list_length: float, percent: int) -> int:
    """The largest set size that enumerates subsets, by least total cost: a subset row costs 1, a row of an
    inverted list 1 and its expected candidates."""
    costs = []
    for x in range(len(sizes) - 1):
        total = 0.0
        for n in range(1, len(sizes)):
            d = _removable(n, percent)
            subsets = sum(math.comb(n, j) for j in range(d + 1))
            if n <= x:
                total += sizes[n] * subsets if subsets <= MAX_SUBSETS else math.inf
            if n >= x * percent // 100:
                total += sizes[n] * (d + 1) * (1 + list_length)
        costs.append(total)
    return int(np.argmin(costs))


def signatures(docs: DataFrame, k: int, percent: int, sketch: np.ndarray, boundary: int) -> DataFrame:
    """For each text: set size n, two set hashes, its first members in the global order, its subset keys and its parity bitmap."""
    cells = docs.sparkSession.sparkContext.broadcast(sketch)
    bits = len(sketch).bit_length() - 1

    def subsets_of(h: np.ndarray) -> np.ndarray:
        n = len(h)
        if n > boundary:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            m = T.mix(h)
            total = m.sum(dtype=np.uint64)
            subs = [total - sum((m[i] for i in c), np.uint64(0)) + np.uint64(n - j) for j in range(_removable(n, percent) + 1) for c in combinations(range(n), j)]
        return np.unique(T.mix(np.array(subs, np.uint64) ^ np.uint64(0x5B5B)))

    def firsts_of(h: np.ndarray, load: np.ndarray) -> np.ndarray:
        n = len(h)
        if n < (boundary + 1) * percent // 100:
            return np.zeros(0, np.uint64)
        return h[np.lexsort((h, load))[: _removable(n, percent) + 1]]

    def run(batches):
        for batch in batches:
            for b in T.slices(batch, "text"):
                h, at = _distinct(*_sets(b, k))
                load = cells.value[(h >> np.uint64(64 - bits)).astype(np.int64)]
                sizes = np.diff(at)
                firsts, subs, maps = [], [], []
                for i in range(len(sizes)):
                    own = h[at[i] : at[i + 1]]
                    firsts.append(firsts_of(own, load[at[i] : at[i + 1]]) if len(own) else own)
                    subs.append(subsets_of(own) if len(own) else own)
                    maps.append(bitmap(own) if len(own) else b"")
                lists = [T.list_column(np.concatenate(x).view(np.int64), np.concatenate([[0], np.cumsum([len(y) for y in x])]), pa.int64()) for x in (firsts, subs)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), *_sums(h, at), *lists, pa.array(maps, pa.binary())],
                    ["doc_id", "n", "s1", "s2", "firsts", "subsets", "bits"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, firsts array<long>, subsets array<long>, bits binary")


def bitmap(h: np.ndarray, per_member: int = 1) -> bytes:
    """Parities of hash bits: a power of two of bits, at least 128 and per_member times the members."""
    size = max(128, 1 << (per_member * len(h) - 1).bit_length())
    p = np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1
    return np.packbits(p, bitorder="little").tobytes()


def _close(rows_n: np.ndarray, maps: dict[int, np.ndarray], row_at: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether bitmaps let pairs (i, j) be linked: sets of a and b members differ in at most
    (100 - t)(a + b) / (100 + t) members."""
    out = np.zeros(len(i), bool)
    room = (100 - percent) * (rows_n[i] + rows_n[j]) // (100 + percent)
    for s in np.unique(np.minimum(size[i], size[j])):
        pick = np.flatnonzero(np.minimum(size[i], size[j]) == s)
        for part in np.array_split(pick, max(1, len(pick) * int(s) // 32_000_000 + 1)):
            x = _folded(maps, row_at, size, i[part], int(s)) ^ _folded(maps, row_at, size, j[part], int(s))
            out[part] = np.bitwise_count(x).sum(axis=1) <= room[part]
    return out


def _folded(maps: dict[int, np.ndarray], row_at: np.ndarray, size: np.ndarray, rows: np.ndarray, s: int) -> np.ndarray:
    out = np.zeros((len(rows), s // 64), np.uint64)
    for own in np.unique(size[rows]):
        pick = size[rows] == own
        m = maps[int(own)][row_at[rows[pick]]]
        while m.shape[1] * 64 > s:
            half = m.shape[1] // 2
            m = m[:, :half] ^ m[:, half:]
        out[pick] = m
    return out


def near(n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets i and j (n[i] <= n[j]) of a list can be linked and have no common member before this one: at most
    n - pos members of each are left, and the overlap must reach t (a + b) / (100 + t)."""
    need = -(-percent * (n[i] + n[j]) // (100 + percent))
    return (n[i] - pos[i] >= need) & (n[j] - pos[j] >= need) & (100 * n[i] >= percent * n[j])


def list_pairs(key: np.ndarray, n: np.ndarray, pos: np.ndarray, bits: list[bytes], label: np.ndarray, percent: int, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (row numbers) of whole lists, sorted by key and n: those with different labels that size, place in the list and
    bitmap allow; all of them, or a spanning forest over the labels of each list."""
    size = np.array([len(b) * 8 for b in bits], np.int64)
    row_at, maps = np.zeros(len(bits), np.int64), {}
    for s in np.unique(size):
        pick = np.flatnonzero(size == s)
        row_at[pick] = np.arange(len(pick))
        maps[int(s)] = np.frombuffer(b"".join(bits[i] for i in pick), np.uint64).reshape(len(pick), int(s) // 64)
    _, first, same = np.unique(np.stack([key, label]), axis=1, return_index=True, return_inverse=True)
    root = first[same.ravel()]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    left, right = [], []
    live, step = np.arange(len(key)), 1
    while len(live):
        live = live[live + step < len(key)]
        other = live + step
        same = (key[live] == key[other]) & (100 * n[live] >= percent * n[other])
        live, other = live[same], other[same]
        if forest and step & (step - 1) == 0 and len(live):  # lists that are one tree already are done
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            whole = np.minimum.reduceat(root, heads) == np.maximum.reduceat(root, heads)
            pick = ~whole[np.searchsorted(heads, live, side="right") - 1]
            live, other = live[pick], other[pick]
        fit = near(n, pos, live, other, percent)
        i, j = live[fit], other[fit]
        if forest and len(i):
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
        elif len(i):
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
        if len(i):
            ok = _close(n, maps, row_at, size, i, j, percent)
            i, j = i[ok], j[ok]
        if forest and len(i):
            for a, b in zip(i.tolist(), j.tolist()):
                ra, rb = find(a), find(b)
                if ra != rb:
                    root[max(ra, rb)] = min(ra, rb)
                    left.append(a)
                    right.append(b)
            while not np.array_equal(up := root[root], root):
                root[:] = up
        elif len(i):
            left.extend(i.tolist())
            right.extend(j.tolist())
        step += 1
    return np.array(left, np.int64), np.array(right, np.int64)


def _by_list(work):
    """Feed whole lists to `work`; rows come sorted by key."""

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            stop = int(np.searchsorted(key, key[-1]))
            if stop or held and held[-1].column("key")[-1].as_py() != key[0]:
                yield from work(pa.Table.from_batches([*held, batch.slice(0, stop)]).combine_chunks())
                held = [batch.slice(stop)]
            else:
                held.append(batch)
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    return run


def _sorted_by_key(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    return df.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", "n", "doc")


def in_blocks(rows: DataFrame) -> DataFrame:
    """`rows` with each list of more than LIST_ROWS rows as lists of the pairs of its blocks; two rows of a list still meet."""
    long = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LIST_ROWS).select("key", F.ceil(F.col("_n") / LIST_ROWS).cast("int").alias("_blocks"))
    long = cut(long)
    if long.isEmpty():
        return rows
    dealt = rows.join(small_or_shuffled(long), "key", "left").withColumn("_b", F.pmod(F.xxhash64("doc"), F.coalesce("_blocks", F.lit(1))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1))
    name = F.when(F.col("_blocks").isNotNull(), F.xxhash64("key", F.least("_b", "_o"), F.greatest("_b", "_o"))).otherwise(F.col("key"))
    return dealt.withColumn("_o", other).withColumn("key", name).select(*rows.columns)


def partnered(rows: DataFrame, percent: int) -> DataFrame:
    """The (key, doc, n, pos) rows that have another row of their key with which near() holds. Only (n, pos) decides, so the distinct ones of
    a list are compared, not its rows. A list of more than LIST_ROWS rows passes as it is: this only spares work later."""

    def work(t):
        key, n, pos = (t.column(c).to_numpy() for c in ("key", "n", "pos"))
        at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (n[1:] != n[:-1]) | (pos[1:] != pos[:-1])]))
        count = np.diff(np.concatenate([at, [len(key)]]))
        key, n, pos, own = key[at], n[at], pos[at], np.arange(len(at))
        keep, live, step = (count > 1) & near(n, pos, own, own, percent), own, 1
        while len(live):
            live = live[live + step < len(key)]
            live = live[(key[live] == key[live + step]) & (100 * n[live] >= percent * n[live + step])]
            i, j = live, live + step
            fit = near(n, pos, i, j, percent)
            keep[i[fit]] = keep[j[fit]] = True
            step += 1
        if keep.any():
            yield from t.filter(pa.array(np.repeat(keep, count))).combine_chunks().to_batches()

    def run(batches):
        held, passing = [], None  # the rows of the last list, or the list that passes
        for batch in batches:
            if batch.num_rows and passing is not None:
                same = int(np.searchsorted(batch.column("key").to_numpy(), passing, side="right"))
                if same:
                    yield batch.slice(0, same)
                    batch = batch.slice(same)
                passing = passing if not batch.num_rows else None
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            stop = int(np.searchsorted(key, key[-1]))
            if stop or held and held[-1].column("key")[-1].as_py() != key[0]:
                yield from work(pa.Table.from_batches([*held, batch.slice(0, stop)]).combine_chunks())
                held = []
            held.append(batch.slice(stop))
            if sum(b.num_rows for b in held) > LIST_ROWS:
                yield from held
                held, passing = [], key[-1]
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "key").sortWithinPartitions("key", "n", "pos")
    return dealt.mapInArrow(run, "key long, doc long, n long, pos int")


def _pairs_of(t, percent: int, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    key, n, pos, label = (t.column(c).to_numpy() for c in ("key", "n", "pos", "label"))
    return list_pairs(key, n, pos, t.column("bits").to_pylist(), label, percent, forest)


def candidate_pairs(rows: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Distinct pairs (a, b), a < b, of documents from lists of (key, doc, n, pos, bits, label)."""

    def work(t):
        i, j = _pairs_of(t, percent, forest)
        doc = t.column("doc").to_numpy()
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(doc[i], doc[j])), pa.array(np.maximum(doc[i], doc[j]))], ["a", "b"])

    return _sorted_by_key(rows.select("key", "doc", "n", "pos", "bits", "label")).mapInArrow(_by_list(work), "a long, b long").where("a <> b").distinct()


def near_misses(rows: DataFrame, percent: int) -> DataFrame:
    """The (key, doc, n, pos) rows that are still in a candidate pair across labels."""

    def work(t):
        i, j = _pairs_of(t, percent, False)
        if len(i):
            yield from t.select(["key", "doc", "n", "pos"]).take(pa.array(np.unique(np.concatenate([i, j])))).combine_chunks().to_batches()

    return _sorted_by_key(rows.select("key", "doc", "n", "pos", "bits", "label")).mapInArrow(_by_list(work), "key long, doc long, n long, pos int")


def class_sets(docs: DataFrame, ids: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(doc, items) of the classes in ids (doc), from a row of `docs` that is in each."""
    wanted = classes.join(small_or_shuffled(ids), "doc", "left_semi").select("doc", F.col("rep").alias("doc_id"), "s1", "s2")
    sets = shingle_sets(docs.join(small_or_shuffled(wanted.select("doc_id").distinct()), "doc_id", "left_semi"), k)
    return sets.join(small_or_shuffled(wanted), ["doc_id", "s1", "s2"]).select("doc", "items").dropDuplicates(["doc"])


def fine_bitmaps(docs: DataFrame, ids: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(doc, bits) with eight bits a member, for the classes in ids (doc)."""

    def run(batches):
        for b in batches:
            maps = [bitmap(np.array(x.as_py(), np.int64).view(np.uint64), 8) for x in b.column("items")]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(maps, pa.binary())], ["doc", "bits"])

    return class_sets(docs, ids, classes, k).mapInArrow(run, "doc long, bits binary")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes with `linked`: whether 100 x intersection >= percent x union, on the whole sets."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    sets = class_sets(docs, ids, classes, k)
    one = pairs.hint("merge").join(sets.select(F.col("doc").alias("a"), F.col("items").alias("x")), "a")
    both = one.join(sets.select(F.col("doc").alias("b"), F.col("items").alias("y")).hint("merge"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (100 * common >= percent * (F.size("x") + F.size("y") - common)).alias("linked"))


def _labelled(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows with the component of their document as label."""
    return rows.join(parts.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("label", F.coalesce("component", "doc")).drop("component")


def _stars(parts: DataFrame) -> DataFrame:
    """Links (a, b) of each document to its component's smallest: the same components as the links they came from, nearly settled."""
    return parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (smallest linked doc_id, itself included)."""
    docs = docs.select("doc_id", "text")
    trim_workers(docs.sparkSession)
    sketch, sizes = count_sketch(docs, k)
    used = sketch[sketch > 0]
    boundary = size_boundary(sizes, float(2 ** ((np.quantile(used, 0.1) - 1) / 8)) if len(used) else 0.0, percent)
    same = ["s1", "s2", "n"]
    # rows keep their sizes and hashes; members, subsets and bitmaps are kept once a class
    sig = stored(shingle_sets(docs, k).select("doc_id", "s1", "s2", F.size("items").cast("long").alias("n")))
    full = sig.where("n > 0 and doc_id is not null")
    one = signatures(docs, k, percent, sketch, boundary).where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("firsts", "subsets", "bits")))
    made = stored(one.withColumn("doc", F.monotonically_increasing_id()))
    classes = stored(made.select("doc", "rep", *same))
    # classes that hold texts of one doc_id
    several = full.groupBy("doc_id").agg(F.min(F.struct(*same)).alias("x"), F.max(F.struct(*same)).alias("y")).where("x <> y").select("doc_id")
    texts = full.join(small_or_shuffled(several), "doc_id", "left_semi").select("doc_id", *same).distinct().join(classes.drop("rep"), same)
    shared = cut(texts.join(texts.groupBy("doc_id").agg(F.min("doc").alias("a")), "doc_id").select("a", F.col("doc").alias("b")))
    keys = made.select("doc", "n", F.size("firsts").alias("placed"), F.posexplode(F.concat("firsts", "subsets")).alias("at", "key"))
    listed = stored(partnered(keys.select("key", "doc", "n", F.when(F.col("at") < F.col("placed"), F.col("at")).otherwise(0).alias("pos")), percent))
    del keys
    maps = stored(made.select("doc", "bits"))
    drop(made)
    rows = in_blocks(listed)
    trim_workers(docs.sparkSession)
    # kept before it is verified, which reads it several times
    pairs = stored(candidate_pairs(rows.join(maps, "doc").withColumn("label", F.col("doc")), percent, True))
    tried = cut(verified(pairs, docs, classes, k, percent))
    drop(pairs)
    parts = cut(connected_components(tried.where("linked").select("a", "b")))
    links = _stars(parts)
    release(docs.sparkSession)
    if not tried.where("not linked").isEmpty():
        missed = stored(near_misses(_labelled(rows, parts).join(maps, "doc"), percent))
        fine = stored(fine_bitmaps(docs, missed.select("doc").distinct(), classes, k))
        again = _labelled(missed, parts).join(fine, "doc")
        more = cut(verified(cut(candidate_pairs(again, percent, True).join(tried.select("a", "b"), ["a", "b"], "left_anti")), docs, classes, k, percent))
        release(docs.sparkSession)
        parts = cut(connected_components(links.union(more.where("linked").select("a", "b"))))
        seen = tried.select("a", "b").union(more.select("a", "b"))
        rest = cut(candidate_pairs(_labelled(missed, parts).join(fine, "doc"), percent, False).join(seen, ["a", "b"], "left_anti"))
        links = _stars(parts).union(cut(verified(rest, docs, classes, k, percent)).where("linked").select("a", "b"))
        release(docs.sparkSession)
    parts = cut(connected_components(links.union(shared)))
    drop(listed)
    named = cut(classes.join(parts.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("component", "doc")))
    lowest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_class = join_hot(named.select("label", *same), lowest, ["label"]).select(*same, "component_id")
    out = join_hot(sig.select("doc_id", *same), of_class, same, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without near duplicates: of each component the document with the smallest id stays. Of rows that repeat its doc_id and its
    text one stays; other texts of that doc_id stay."""
    groups = ngram_components(docs, k, percent)
    gone = cut(groups.where("doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(small_or_shuffled(gone), "doc_id", "left_anti").select(*docs.columns)
    again = cut(kept.where("doc_id is not null").groupBy("doc_id", F.xxhash64("text")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id").distinct())
    if again.isEmpty():
        return kept
    again = small_or_shuffled(again)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).union(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns))
