"""Samplers, distances, metrics, proposals, diagnostics, releases and sources against brute force on small graphs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions.scalars import gaussian_constant
from quillgraph.operators import blocks as B
from quillgraph.operators import chain as C
from quillgraph.operators import graph as G
from quillgraph.operators import metrics as M
from quillgraph.operators import model as D
from quillgraph.operators import noise as N
from quillgraph.operators import spectral as E
from quillgraph.sources import config, fits, graphs, preps


def edges(spark, pairs):
    return spark.createDataFrame([(min(p), max(p)) for p in pairs], "src long, dst long")


def nodes(spark, n):
    return spark.range(n).withColumnRenamed("id", "v")


def random_pairs(rng, n, p):
    return [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < p]


def search(n, pairs):
    near = {v: set() for v in range(n)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for s in range(n):
        dist, front = {s: 0}, [s]
        while front:
            nxt = []
            for v in front:
                for w in near[v]:
                    if w not in dist:
                        dist[w] = dist[v] + 1
                        nxt.append(w)
            front = nxt
        out |= {(s, v): d for v, d in dist.items()}
    return out


def emd(a, b):
    x = sorted(set(a) | set(b))
    f = lambda s, t: sum(v <= t for v in s) / len(s)
    return sum(abs(f(a, u) - f(b, u)) * (w - u) for u, w in zip(x, x[1:]))


def test_sampled_graph_has_the_expected_counts(spark):
    blocks = spark.range(90).selectExpr("id as v", "id % 3 as blk")
    conn = spark.createDataFrame([(0, 0, 100), (0, 1, 450), (1, 1, 435), (1, 2, 9)], "r long, s long, m long")
    totals = {}
    for seed in range(6):
        rows = N.sample_graph(blocks, conn, seed).collect()
        assert len({(r["src"], r["dst"]) for r in rows}) == len(rows) and all(r["src"] < r["dst"] for r in rows)
        for r in rows:
            k = tuple(sorted((r["src"] % 3, r["dst"] % 3)))
            totals[k] = totals.get(k, 0) + 1 / 6
        assert sum((r["src"] % 3, r["dst"] % 3) == (1, 1) for r in rows) == 435  # every pair of the block
    assert set(totals) <= {(0, 0), (0, 1), (1, 1), (1, 2)}
    assert abs(totals[0, 0] - 100) < 20 and abs(totals[0, 1] - 450) < 40 and abs(totals[1, 2] - 9) < 8
    assert N.sample_graph(blocks, conn, 3).orderBy("src", "dst").collect() == N.sample_graph(blocks, conn, 3).orderBy("src", "dst").collect()


def test_places_are_independent_of_the_stretches(spark, monkeypatch):
    cells = spark.createDataFrame([(0, 0, 1000, 0.3), (0, 1, 7, 1.0), (1, 1, 40, 0.0)], "r long, s long, n long, p double")
    for stretch in (10_000, 25):
        monkeypatch.setattr(N, "STRETCH", stretch)
        at = N.positions(cells, 5)
        one = [r["at"] for r in at.where("s = 0").collect()]
        assert len(set(one)) == len(one) and 240 < len(one) < 360 and 0 <= min(one) and max(one) < 1000 and max(one) > 900
        assert sorted(r["at"] for r in at.where("r = 0 and s = 1").collect()) == list(range(7)) and at.where("r = 1").count() == 0


def test_directed_sample_and_validation(spark):
    size = spark.createDataFrame([(0, 4), (1, 3)], "blk long, k long")
    conn = spark.createDataFrame([(0, 0, 12), (1, 0, 12)], "r long, s long, m long")
    blocks, e = N.checked_sample(size, conn, 1, directed=True)
    at = {r["v"]: r["blk"] for r in blocks.collect()}
    assert at == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1}
    rows = {(r["src"], r["dst"]) for r in e.collect()}
    assert rows == {(a, b) for a in range(4) for b in range(4) if a != b} | {(a, b) for a in (4, 5, 6) for b in range(4)}
    bad = [
        (size, spark.createDataFrame([(0, 0, 7)], "r long, s long, m long")),
        (size, spark.createDataFrame([(0, 0, -1)], "r long, s long, m long")),
        (size, spark.createDataFrame([(0, 5, 1)], "r long, s long, m long")),
        (size, spark.createDataFrame([(1, 0, 1)], "r long, s long, m long")),
        (spark.createDataFrame([(0, 0)], "blk long, k long"), conn.where("false")),
    ]
    for k, m in bad:
        with pytest.raises(ValueError):
            N.checked_sample(k, m, 1)


def test_sample_from_a_matrix(spark):
    blocks = spark.range(8).selectExpr("id as v", "id div 4 as blk")
    p = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0), (1, 1, 1.0)], "r long, s long, p double")
    got = {(r["src"], r["dst"]) for r in N.sample_matrix(blocks, p, 1).collect()}
    assert got == {(a, b) for a in range(8) for b in range(a + 1, 8) if a // 4 == b // 4}
    for rows in ([(0, 0, 1.5), (0, 1, 0.0), (1, 1, 1.0)], [(0, 0, 1.0)], [(0, 0, 1.0), (0, 1, 0.2), (1, 0, 0.3), (1, 1, 1.0)]):
        with pytest.raises(ValueError):
            N.sample_matrix(blocks, spark.createDataFrame(rows, "r long, s long, p double"), 1)
    m = N.expected_counts(spark.createDataFrame([(0, 0, 0.25), (0, 1, 0.01), (1, 1, 0.75)], "r long, s long, p double"), B.sizes(blocks))
    assert {(r["r"], r["s"]): r["m"] for r in m.collect()} == {(0, 0): 2, (1, 1): 4}  # 1.5 and 4.5 to even, 0.16 goes


def test_distances_match_search(spark, monkeypatch):
    rng = random.Random(41)
    pairs = random_pairs(rng, 40, 0.05)
    e, n = edges(spark, pairs), nodes(spark, 40)
    want = search(40, pairs)
    got = lambda: {(r["s"], r["v"]): r["d"] for r in G.distances(e, n).collect()}
    assert got() == want
    monkeypatch.setattr(G, "BROADCAST_EDGES", 2)
    assert got() == want
    w = e.withColumn("w", F.lit(2.5))
    some = nodes(spark, 3)
    assert {(r["s"], r["v"]): r["d"] for r in G.weighted_distances(w, some).collect()} == {k: 2.5 * d for k, d in want.items() if k[0] < 3}


def test_path_lengths(spark):
    rng = random.Random(42)
    pairs = random_pairs(rng, 30, 0.08) + [(50, 51)]
    n = spark.createDataFrame([(v,) for v in [*range(30), 50, 51, 60]], "v long")
    want = search(61, pairs)
    parts = {}
    for s in range(30):
        parts.setdefault(min(v for v in range(61) if (s, v) in want), []).append(s)
    lcc = set(max(parts.values(), key=len))
    exact = sorted(d for (s, v), d in want.items() if s in lcc and s != v)
    assert sorted(r["x"] for r in G.path_lengths(edges(spark, pairs), n).collect()) == exact
    drawn = [r["x"] for r in G.path_lengths(edges(spark, pairs), n, 200, exact=5).collect()]
    assert len(drawn) == min(200, len(lcc) * (len(lcc) - 1) // 2) and set(drawn) <= set(exact)
    assert abs(np.mean(drawn) - np.mean(exact)) < 0.5


def test_wasserstein_over_ranges(spark):
    rng = random.Random(43)
    a, b = [rng.randrange(60) / 4 for _ in range(150)], [rng.randrange(20, 90) / 4 for _ in range(70)]
    frame = lambda x: spark.createDataFrame([(v,) for v in x], "x double")
    assert G.wasserstein(frame(a), frame(b)).first()[0] == pytest.approx(emd(a, b))
    assert G.wasserstein(frame([1.0]), frame([4.0])).first()[0] == 3.0 and G.wasserstein(frame([2.0]), frame([2.0])).first()[0] == 0.0


def test_normaliser_counts_zero_pairs(spark):
    size = spark.createDataFrame([(i, k) for i, k in enumerate((3, 5, 2, 4, 6))], "blk long, k long")
    conn = spark.createDataFrame([(0, 0, 1), (0, 1, 4), (2, 4, 3), (1, 1, 2), (2, 2, 1), (3, 3, 1), (4, 4, 5)], "r long, s long, m long")
    listed = B.zero_pairs(conn, size).where("r <> s and n > 0").agg(F.sum(6 / F.sqrt("n"))).first()[0]
    other = N.block_weights(conn, size).agg(F.sum(F.sqrt("w"))).first()[0] + N.edge_weights(conn, size).agg(F.sum(6 * F.sqrt("w"))).first()[0]
    assert N.normaliser(conn, size, 6).first()[0] == pytest.approx(listed + other)


def test_metrics(spark):
    rng = random.Random(44)
    g = [(random_pairs(rng, 25, 0.2), 25), (random_pairs(rng, 25, 0.3), 25)]
    a, b = ((edges(spark, p), nodes(spark, n)) for p, n in g)
    assert len(M.REGISTRY) == 12
    got = {r["metric"]: r["value"] for r in M.compare_all(["shortest_path", "avg_path_length", "degree", "clustering", "avg_clustering", "assortativity", "eigen_val"], a, b).collect()}
    mats, paths, freq = [], [], []
    for pairs, n in g:
        m = np.zeros((n, n))
        for x, y in pairs:
            m[x, y] = m[y, x] = 1
        mats.append(m)
        d = search(n, pairs)
        paths.append([v for (s, t), v in d.items() if s != t])
        deg = m.sum(0).astype(int)
        freq.append([(deg == k).mean() for k in range(deg.max() + 1)])
    assert got["shortest_path"] == pytest.approx(emd(*paths)) and got["avg_path_length"] == pytest.approx(abs(np.mean(paths[0]) - np.mean(paths[1])))
    assert got["degree"] == pytest.approx(emd(*freq)) and got["clustering"] == got["avg_clustering"]
    local = [np.mean([((m @ m) * m)[v].sum() / max(1, m[v].sum() * (m[v].sum() - 1)) for v in range(25)]) for m in mats]
    assert got["clustering"] == pytest.approx(abs(local[0] - local[1]))
    vals = [np.linalg.eigvalsh(m)[::-1][:10] for m in mats]
    assert got["eigen_val"] == pytest.approx(np.linalg.norm(vals[0] - vals[1]), abs=2e-2)
    assert M.eigen_vec(a, a, 2).first()[0] == pytest.approx(0, abs=1e-6)
    with pytest.raises(ValueError):
        M.eigen_vec(a, (a[0], nodes(spark, 26)))
    with pytest.raises(ValueError):
        M.compare("no such", a, b)


def test_walks_and_embeddings(spark, monkeypatch):
    rng = random.Random(45)
    pairs = random_pairs(rng, 20, 0.2)
    e, n = edges(spark, pairs), nodes(spark, 21)  # node 20 stands alone
    near = {(a, b) for p in pairs for a, b in (p, p[::-1])}
    for small in (True, False):
        if not small:
            monkeypatch.setattr(G, "BROADCAST_EDGES", 2)
        rows = M.walks(e, n, 6, 3, 1).collect()
        assert len(rows) == 63 and all((a, b) in near for r in rows for a, b in zip(r["path"], r["path"][1:]))
        assert all(len(r["path"]) == (1 if r["path"][0] == 20 else 6) for r in rows if r["path"][0] == 20 or any(r["path"][0] in p for p in pairs))
    x = {r["v"]: r["x"] for r in M.factorised_embedding(e, n, 4, 9).collect()}
    assert len(x) == 21 and all(len(v) == 4 and np.isfinite(v).all() for v in x.values())
    y = {r["v"]: r["x"] for r in M.walk_embedding(e, n, 4, 10, 5).collect()}
    assert len(y) == 21 and all(len(v) == 4 for v in y.values())
    points = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "v long, x array<double>")
    assert [r["x"] for r in M.inner_products(points, 50).collect()] == [11.0]


@pytest.fixture
def blocked(spark):
    rng = random.Random(46)
    pairs = random_pairs(rng, 30, 0.15)
    of = [v // 5 for v in range(30)]
    return pairs, of, edges(spark, pairs), spark.createDataFrame(list(enumerate(of)), "v long, blk long")


def test_proposals_obey_their_rules(spark, blocked):
    pairs, of, e, b = blocked
    near = {v: {x for p in pairs if v in p for x in p if x != v} for v in range(30)}
    rows = C.triadic_swaps(e, b, 60, 3, fill=False).collect()
    assert len(rows) > 40 and len({r["move_id"] for r in rows}) == len(rows)
    for r in rows:
        assert of[r["i"]] == r["a"] != r["b"] == of[r["j"]] and any(of[x] == r["b"] and x != r["j"] for x in near[r["i"]]) and any(of[x] == r["a"] for x in near[r["j"]])
    rows = C.cross_triangle_swaps(e, b, 60, 3, fill=False).collect()
    assert len(rows) > 40
    for r in rows:
        assert r["j"] in near[r["i"]] and of[r["i"]] == r["a"] != r["b"] == of[r["j"]] and any(of[k] == r["a"] and k != r["i"] for k in near[r["j"]])
    lone = spark.createDataFrame([(0, 29)], "src long, dst long")  # no wedge at all: uniform swaps instead
    rows = C.cross_triangle_swaps(lone, b, 10, 3, trials=4).collect()
    assert len(rows) == 10 and all(of[r["i"]] == r["a"] != r["b"] == of[r["j"]] for r in rows)
    mixed = C.proposals(e, b, 40, 5, {"triadic_swap": 0.5, "cross_triangle": 0.25, "edge_based_swap": 0.25}).collect()
    assert 10 <= len(mixed) <= 40
    with pytest.raises(ValueError):
        C.proposals(e, b, 4, 5, {"sideways": 1.0})


def test_fit_by_kinds_of_moves(spark, blocked):
    _, _, e, b = blocked
    fit = C.fit(e, b, 2, sign=1.0, moves={"triadic_swap": 0.5, "uniform_swap": 0.5}, stopping=D.AtMost(1))
    assert len(fit.trace) == 2 and fit.nll <= fit.trace[0][1]
    p = D.Patience(2)
    assert [p.should_stop(i, s) for i, s in enumerate((5.0, 4.0, 4.0, 4.5))] == [False, False, False, True]


def test_matching_is_best():
    rng = np.random.default_rng(47)
    for n, m in ((1, 1), (3, 3), (2, 5), (5, 2), (6, 6)):
        for _ in range(20):
            x = rng.integers(0, 9, (n, m)).astype(float)
            y = x if n <= m else x.T
            want = max(sum(y[i, p[i]] for i in range(len(y))) for p in itertools.permutations(range(y.shape[1]), len(y)))
            assert B.best_matching(x) == want


def test_misclassification(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(12)], "v long, blk long")
    b = spark.createDataFrame([(i, (i + 1) % 3 if i != 4 else 0) for i in range(12)], "v long, blk long")
    assert B.misclassification(a, b) == pytest.approx(1 / 12)


def test_diagnostics(spark):
    rng = np.random.default_rng(48)
    x = rng.normal(size=(3, 40))
    rows = [(c, i, "s", float(x[c, i])) for c in range(3) for i in range(40)]
    t = spark.createDataFrame(rows, "chain long, iteration long, stat string, val double")
    r = C.diagnostics(t, 30).first()
    y = x[:, 10:]
    within, between = y.var(axis=1, ddof=1).mean(), y.mean(axis=1).var(ddof=1)
    assert r["rhat"] == pytest.approx(math.sqrt((29 / 30 * within + between) / within))
    sizes = []
    for c in y:
        z = c - c.mean()
        auto = [(z[: 30 - k] * z[k:]).sum() / (30 - k) for k in range(30)]
        auto = [v / auto[0] for v in auto]
        total = -1.0
        for k in range(0, 30, 2):
            if auto[k] + auto[k + 1] <= 0:
                break
            total += 2 * sum((30 - j) / 30 * auto[j] for j in (k, k + 1))
        sizes.append(30 / total)
    assert r["ess"] == pytest.approx(min(sizes))
    assert C.diagnostics(t, 41).first()["rhat"] is None
    assert C.last_draws(t, 7).count() == 21


def test_blocks_come_and_go(spark):
    b = spark.createDataFrame([(v, v // 2) for v in range(6)], "v long, blk long")
    conn = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 2, 3), (2, 2, 4)], "r long, s long, m long")
    size, moved = B.add_block(B.sizes(b), b, spark.createDataFrame([(1,), (2,)], "v long"))
    assert {r["blk"]: r["k"] for r in size.collect()} == {0: 1, 1: 1, 2: 2, 3: 2} and {r["v"]: r["blk"] for r in moved.collect()} == {0: 0, 1: 3, 2: 3, 3: 1, 4: 2, 5: 2}
    size, left = B.remove_block(B.sizes(b), conn, 1)
    assert sorted(map(tuple, left.collect())) == [(0, 0, 1), (1, 1, 4)] and {r["blk"] for r in size.collect()} == {0, 1}
    assert {r["blk"]: r["m"] for r in B.diagonal_counts(conn, B.sizes(b)).collect()} == {0: 1, 1: 0, 2: 4}
    inc = spark.createDataFrame([(1, 1, 0, 1, 5), (1, 2, 1, 0, 7), (1, 3, 0, 0, 1)], "move_id long, seq long, r long, s long, de long")
    assert {(r["r"], r["s"]): r["de"] for r in B.overwritten(inc).collect()} == {(0, 1): 7, (0, 0): 1}


def test_releases(spark, blocked):
    _, of, e, b = blocked
    model = D.BlockModel(e, b.select("v"), 5, "uniform")
    model.fit(1, stopping=D.AtMost(1))
    out = model.release({"k": 5})
    assert out.nll == pytest.approx(B.nll(B.connectivity(e, model.assignments()), out.sizes).first()[0])
    for kind, post in (("heterogeneous_gaussian", "naive"), ("heterogeneous_gaussian", "lasso"), ("naive_edge_count_gaussian", None), ("naive_degree_gaussian", None)):
        noise = D.create_noise(out, 1.0, 1e-4, 0.999, kind)
        drawn = noise.draw(3, post)
        rows = drawn.conn.collect()
        assert len({(r["r"], r["s"]) for r in rows}) == len(rows) and drawn.metadata["noise"] == kind and drawn.metadata["k"] == 5
        if kind == "heterogeneous_gaussian":
            assert all(r["m"] <= (10 if r["r"] == r["s"] else 25) and r["m"] >= 0 for r in rows)
            blocks, sampled = drawn.sample(1)
            assert sampled.count() > 0 and blocks.count() == 30
    with pytest.raises(ValueError):
        D.create_noise(out, 1.0, 1e-4, 0.999, "loud")
    with pytest.raises(NotImplementedError):
        D.create_noise(D.Release(out.sizes, out.conn, directed=True), 1.0, 1e-4, 0.999)
    with pytest.raises(ValueError):
        D.BlockModel(e, b.select("v"), 5, "uniform", {"sideways": 1.0})


def test_zero_pairs_are_lifted(spark):
    size = spark.createDataFrame([(i, 4) for i in range(12)], "blk long, k long")
    conn = spark.createDataFrame([(i, i, 3) for i in range(12)], "r long, s long, m long")
    factor = (2 * gaussian_constant(0.5, 1e-6)) ** 2 / F.col("total")
    rows = N.noisy_zero_pairs(conn, size, factor * 1e6, 3, 4, 9).collect()
    assert rows and all(r["r"] < r["s"] and 0 < r["m"] <= 16 for r in rows)
    shrunk = N.noisy_zero_pairs(conn, size, factor * 1e6, 3, 4, 9, 1.645).collect()
    assert len(shrunk) <= len(rows)


def write(path, text):
    path.write_text(text)
    return str(path)


def test_graph_files_keep_names_weights_and_loops(spark, tmp_path):
    got = lambda name, text: (lambda e, d: (sorted(map(tuple, e.select("src", "dst", "w").collect())), d))(*graphs.load(spark, write(tmp_path / name, text), weights=True))
    xml = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="edge" attr.name="weight"/><graph edgedefault="{}"><node id="a"/><node id="b"/><node id="c"/><edge target="b" source="a"><data key="d0">2.5</data></edge><edge source="c" target="c"/></graph></graphml>'
    assert got("a.graphml", xml.format("undirected")) == ([(0, 1, 2.5), (2, 2, 1.0)], False)
    assert got("b.graphml", xml.format("directed")) == ([(0, 1, 2.5), (2, 2, 1.0)], True)
    gml = 'graph [\n directed 0\n node [ id 7 label "x y" ]\n node [ id 9 ]\n edge [ target 7 source 9 weight 0.5 ]\n]'
    assert got("c.gml", gml) == ([(7, 9, 0.5)], False)
    mtx = "%%MatrixMarket matrix coordinate real general\n% note\n3 3 3\n1 2 0.5\n2 1 0.25\n3 3 3\n"
    assert got("d.mtx", mtx) == ([(0, 1, 0.5), (1, 0, 0.25), (2, 2, 3.0)], True)
    np.savez(tmp_path / "e.npz", data=np.array([0.5, 0.5]), indices=np.array([1, 0]), indptr=np.array([0, 1, 2]), shape=np.array([2, 2]))
    e, directed = graphs.load(spark, str(tmp_path / "e.npz"), weights=True)
    assert not directed and [tuple(r) for r in e.collect()] == [(0, 1, 0.5)]
    for name, text in (("f.graphml", xml.format("directed").replace(' source="a"', "")), ("g.gml", "graph [ node [ id 1 ] edge [ source 1 ] ]")):
        with pytest.raises(Exception):
            got(name, text)


def test_graph_objects(spark):
    class Net:
        nodes = ["x", "y", "z"]

        def is_directed(self):
            return False

        def edges(self, data):
            return [("y", "x", {"weight": 2}), ("z", "z", {})]

    e, n, directed = graphs.from_networkx(spark, Net())
    assert sorted(map(tuple, e.collect())) == [(0, 1, 2.0), (2, 2, 1.0)] and n.count() == 3 and not directed


def test_preparations(spark, tmp_path):
    files = {
        "matrix_market": ("%%MatrixMarket matrix coordinate pattern symmetric\n5 5 3\n2 1\n2 1\n3 3\n", [(2, 1), (2, 1), (3, 3)]),
        "weighted_edges": ("1 2 {'w': 3}\n2 1 {}\n", [(1, 2), (2, 1)]),
        "temporal_edges": ("4 3 100\n3 4 101\n5 5 1\n3 6 7\n", [(4, 3), (3, 6)]),
        "snap_edges": ("# a\n# b\n# c\n# d\n9 8\n8 9\n", [(9, 8)]),
        "csv_edges": ("from,to\n2,1\n1,2\n7,7\n", [(2, 1)]),
    }
    jobs = [(f"set {k}", k, write(tmp_path / f"{k}.txt", text)) for k, (text, _) in files.items()]
    for (_, kind, _), out in zip(jobs, preps.prepare_all(spark, jobs, str(tmp_path / "out"))):
        assert [(r["src"], r["dst"]) for r in spark.read.parquet(out).collect()] == files[kind][1], kind
    with pytest.raises(ValueError):
        preps.prepare_all(spark, [("a", "none", "b")], str(tmp_path))


def test_configuration(spark, tmp_path):
    c = {"seed": 42, "datasets": [{"name": "a.b", "path": "p"}, {"name": "c", "path": "q"}], "sbm": [{"min_block_size": 3}, {"min_block_size": 6, "seed": 1}]}
    rows = config.fit_rows(c)
    assert len(rows) == 4 and rows[0] == {"name": "a.b", "path": "p", "min_block_size": 3, "seed": 42} and rows[1]["seed"] == 1
    import json

    assert config.read_config(write(tmp_path / "c.json", json.dumps(c))) == c
    assert config.eval_row({"n_surrogates": 20, "metrics": ["degree", "leiden"]}) == {"n_surrogates": "20", "metrics": "degree_leiden"}
    g = config.grid(spark, c["datasets"], c["sbm"]).collect()
    assert len(g) == 4 and len({r["seed"] for r in g}) == 4
    assert config.statistics_name("a.b", 20) == "a_b_surrogates_20_.csv" and config.statistics_name("a", 2, {"k": 3}) != config.statistics_name("a", 2, {"k": 4})
    assert config.dataset_path("data/", "a.b") == "data/a_b.npz" and config.fit_path("f", "a.b", {"k": 3}) == "f/sbm_fit_a_b_k_3"
    f = spark.createDataFrame([("x/sbm_fit_wiki_vote_cooling_rate_0_9_min_block_size_12_patience_5.csv",), ("y/other.csv",)], "file string")
    r = f.select(config.dataset_in(F.col("file")).alias("d"), config.block_size_in(F.col("file")).alias("k")).collect()
    assert [tuple(x) for x in r] == [("wiki_vote", 12), ("other", None)] and config.named_with(f, "patience").count() == 1
    assert spark.range(1).select(config.elapsed(F.lit(1.23456))).first()[0] == "1.235"


def test_chain_log(spark, tmp_path):
    log = fits.ChainLog(spark, str(tmp_path / "log"), every=5, flush=2)
    for i in range(21):
        log.log(i, nll=float(i), accepted=i % 2)
    log.close()
    rows = spark.read.option("header", True).csv(str(tmp_path / "log")).collect()
    assert sorted(int(r["iteration"]) for r in rows) == [0, 5, 10, 15, 20] and all(float(r["nll"]) == int(r["iteration"]) and float(r["elapsed"]) >= 0 for r in rows)


def test_moments_in_numpy(spark):
    rng = np.random.default_rng(49)
    x, y = rng.normal(size=(30, 3)), rng.normal(size=(30, 3))
    df = spark.createDataFrame([tuple(map(float, (*a, *b))) for a, b in zip(x, y)], [*(f"x{i}" for i in range(3)), *(f"y{i}" for i in range(3))])
    xx, xy = E._moment(df, 3, [("x", "x"), ("x", "y")])
    assert np.allclose(xx, x.T @ x) and np.allclose(xy, (x.T @ y + y.T @ x) / 2)
