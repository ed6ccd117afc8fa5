"""Registered queries of the graph operators over the driver's tables, and the same in SQL.

Graphs: `e`, parts that share an order; `er`, the second graph of comparisons, parts that share an order by returned lines ("R"); `e2`, a sparse
graph, returned lines of 30 pieces and more. Blocks: part brands; `fine` blocks of FINE parts each, of which many pairs have no edge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import activation_threshold, gaussian_constant, u01
from ..operators import blocks as B
from ..operators import chain as C
from ..operators import community as Q
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import model as D
from ..operators import noise as N
from ..operators import packed
from ..operators import partition as P
from ..operators import spectral as E
from ..operators import swaps as W
from ..sources import config as S
from ..sources.graphs import co_purchase, keep_first, part_blocks, part_nodes
from ..streaming.events import windowed_counts
from .session import cut

EPS, DELTA, ALPHA, SENSITIVITY, SEED, K, FINE = 1.0, 1e-6, 0.999, 6, 42, 75, 7

#: Block sizes that are broadcast to the counts (16 bytes each); more are joined.
BROADCAST_BLOCKS = 1_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Views every oracle query may use.
_GRAPHS = """with recursive li as (select l_orderkey as o, l_partkey as p, l_quantity as q, l_returnflag = 'R' as ret from lineitem),
e as (select distinct a.p as src, b.p as dst from li a join li b on a.o = b.o and a.p < b.p),
er as (select distinct a.p as src, b.p as dst from li a join li b on a.o = b.o and a.p < b.p where a.ret and b.ret),
e2 as (select distinct a.p as src, b.p as dst from li a join li b on a.o = b.o and a.p < b.p where a.ret and b.ret and a.q >= 30 and b.q >= 30),
symr as (select src as u, dst as v from er union all select dst, src from er),
degr as (select n.v, count(s.u) as degree from (select p_partkey as v from part) n left join symr s on s.v = n.v group by 1),
"""

_BRANDS = "blk as (select p_partkey as v, dense_rank() over (order by p_brand) - 1 as blk from part),"
_CHUNKS = f"blk as (select p_partkey as v, least(p_partkey // {FINE}, (select count(*) from part) // {FINE} - 1) as blk from part),"

_REST = f"""
nodes as (select p_partkey as v from part),
sizes as (select blk, count(*) as k from blk group by 1),
lab as (select src, dst, x.blk as bs, y.blk as bd from e join blk x on x.v = src join blk y on y.v = dst),
conn as (select least(bs, bd) as r, greatest(bs, bd) as s, count(*) as m from lab group by 1, 2),
sym as (select src as u, dst as v from e union all select dst, src from e),
sym2 as (select src as u, dst as v from e2 union all select dst, src from e2),
deg as (select n.v, count(s.u) as degree from nodes n left join sym s on s.v = n.v group by 1),
deg2 as (select n.v, count(s.u) as degree from nodes n left join sym2 s on s.v = n.v group by 1),
pairs as (select x.blk as r, y.blk as s, case when x.blk = y.blk then cast(x.k * (x.k - 1) / 2 as bigint) else x.k * y.k end as n, x.k as kr, y.k as ks from sizes x join sizes y on x.blk <= y.blk),
full_conn as (select c.r, c.s, c.m, n, kr, ks from conn c join pairs using (r, s)),
zero as (select r, s, n from pairs anti join conn using (r, s)),
nb as (select s.u as v, b.blk as blk, count(*) as n from sym s join blk b on b.v = s.v group by 1, 2),
moves as (select src * 4294967296 + dst as move_id, src as i, bs as a, dst as j, bd as b from lab where bs <> bd),
prob as (select *, case when m = n then 1 - 1e-12 else m::double / n end as p from full_conn),
we as (select r, s, n, least(n / (2 * p * (1 - p)), 1e12) as w from prob union all select blk, blk, cast(k * (k - 1) / 2 as bigint), 1e12 from sizes where blk not in (select r from conn where r = s)),
wn as (select z.blk, least(coalesce(x, 0) + coalesce(y, 0), 1e12) as w from sizes z
  left join (select blk, sum(2 * n / (2 * p * (1 - p)) * p * p / (k * k)) as x from (select r as blk, kr as k, n, p from prob where r <> s union all select s, ks, n, p from prob where r <> s) group by 1) o using (blk)
  left join (select r as blk, least(n / (2 * p * (1 - p)), 1e12) * pow((2 * kr - 4)::double / (kr * (kr - 1)), 2) * p * p as y from prob where r = s and kr > 1) i using (blk)),
total as (select (select sum(sqrt(w)) from wn) + (select sum(sqrt({float(SENSITIVITY**2)!r} * w)) from we) + coalesce((select sum(sqrt({float(SENSITIVITY**2)!r} / n)) from zero where r <> s and n > 0), 0) as t),
sig as (select r, s, n, sqrt(sqrt({float(SENSITIVITY**2)!r} * w) * {(2 * gaussian_constant(EPS, DELTA)) ** 2!r} / t) as sigma from we, total)
"""

PRELUDE, FINE_PRELUDE = _GRAPHS + _BRANDS + _REST, _GRAPHS + _CHUNKS + _REST


def _u(seed: int, *key: str) -> str:
    return f"((('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(key)})), 1, 8))::bigint + 0.5) / 4294967296.0)"


def _z(seed: int, *key: str) -> str:
    return f"(sqrt(-2.0 * ln({_u(seed, *key)})) * cos(2.0 * pi() * {_u(seed + 1, *key)}))"


def _ll(e: str, n: str, sign: str = "-") -> str:
    p = f"greatest(1e-6, least(1 - 1e-6, ({e})::double / {n}))"
    return f"case when {n} > 0 then ({e}) * ln({p}) {sign} ({n} - ({e})) * ln(1 - {p}) else 0 end"


def query(sql: str | None = None, prelude: str = PRELUDE):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = prelude + sql
        return f

    return add


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return co_purchase(spark, d), part_nodes(spark, d), part_blocks(spark, d)


def _second(spark: SparkSession, d: str) -> DataFrame:
    return co_purchase(spark, d, "R")


def _pair(spark: SparkSession, d: str) -> tuple[M.Graph, M.Graph]:
    n = part_nodes(spark, d)
    return (packed.stored(co_purchase(spark, d)), n), (packed.stored(_second(spark, d)), n)


def _stats(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e, _, b = _parts(spark, d)
    return B.connectivity(e, b), B.sizes(b)


def _fine(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = B.uniform_blocks(part_nodes(spark, d), FINE)
    k = cut(B.sizes(b))
    return cut(B.connectivity(co_purchase(spark, d), b)), F.broadcast(k) if k.count() <= BROADCAST_BLOCKS else k


def _moves(e: DataFrame, b: DataFrame) -> DataFrame:
    """Every cross-block edge as a swap; the id is made of the pair, so no global order is needed."""
    return B.cross_edges(e, b).select((F.col("i") * 4294967296 + F.col("j")).alias("move_id"), "i", "a", "j", "b")


@query("select src, dst from e")
def canonical_edges(spark, d):
    return co_purchase(spark, d)


@query("select v, degree from deg")
def degree(spark, d):
    e, n, _ = _parts(spark, d)
    return G.degrees(e, n)


@query("select g as degree, round(coalesce(c, 0)::double / (select count(*) from deg), 8) as frequency from (select unnest(range(0, (select max(degree) from deg) + 1)) as g) left join (select degree, count(*) as c from deg group by 1) on g = degree")
def degree_histogram(spark, d):
    e, n, _ = _parts(spark, d)
    return G.degree_histogram(G.degrees(e, n)).select("degree", F.round("frequency", 8).alias("frequency"))


@query("select count(*) as n_asymmetric from (select u, v from sym) x anti join (select v as u, u as v from sym) y using (u, v)")
def edge_symmetry_check(spark, d):
    return G.asymmetric_edges(G.both_ways(co_purchase(spark, d))).agg(F.count(F.lit(1)).alias("n_asymmetric"))


@query("select line, u, v from (select l_orderkey * 10 + l_linenumber as line, l_partkey as u, l_suppkey as v, row_number() over (partition by least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey) order by l_orderkey * 10 + l_linenumber, l_partkey) as n from lineitem where l_partkey <> l_suppkey) where n = 1")
def keep_first_dedupe(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    raw = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v"))
    return keep_first(raw)


@query("select blk, k from sizes")
def block_sizes(spark, d):
    return B.sizes(part_blocks(spark, d))


@query("select blk, string_agg(v::varchar, ',' order by v) as members from (select v, blk from blk) group by 1")
def block_members(spark, d):
    return B.members(part_blocks(spark, d)).select("blk", F.array_join("members", ",").alias("members"))


@query("select r, s, m from conn")
def block_conn(spark, d):
    return _stats(spark, d)[0]


@query("select r, s, n from pairs")
def possible_pairs(spark, d):
    return B.possible_pairs(_stats(spark, d)[1])


@query("select r, s, n from zero", FINE_PRELUDE)
def zero_pairs(spark, d):
    return B.zero_pairs(*_fine(spark, d))


@query("select r, s, round(p, 10) as p from prob")
def edge_prob(spark, d):
    return N.probabilities(*_stats(spark, d)).select("r", "s", F.round("p", 10).alias("p"))


@query(f"select round(-sum({_ll('m', 'n')}), 2) as nll from full_conn")
def nll_ref(spark, d):
    return B.nll(*_stats(spark, d)).select(F.round("nll", 2).alias("nll"))


@query(f"select round(-sum({_ll('m', 'n', '+')}), 2) as nll from full_conn")
def nll_bernoulli(spark, d):
    return B.nll(*_stats(spark, d), 1.0).select(F.round("nll", 2).alias("nll"))


@query("select round(-sum(case when m = 0 then 0 else m * ln(greatest(m::double / n, 1e-6)) - (n - m) * ln(greatest(1 - m::double / n, 1e-6)) end), 2) as nll from full_conn where kr > 1 and n > 0")
def nll_slow(spark, d):
    return B.nll_slow(*_stats(spark, d)).select(F.round("nll", 2).alias("nll"))


@query("select v, blk, n from nb")
def neighbor_block_counts(spark, d):
    e, _, b = _parts(spark, d)
    return B.neighbour_blocks(e, b)


@query("select distinct v from (select src as v from lab where bs <> bd union all select dst from lab where bs <> bd)")
def boundary_vertices(spark, d):
    e, _, b = _parts(spark, d)
    return B.boundary(e, b)


@query(f"select blk, k, case when k > {K + 1} then 'over' when k = {K + 1} then 'one_over' when k = {K} then 'exact' else 'under' end as category from sizes")
def size_categories(spark, d):
    return B.categories(_stats(spark, d)[1], K)


@query("select p_partkey as v, dense_rank() over (order by p_size) - 1 as blk from part")
def reindex_blocks(spark, d):
    return part_blocks(spark, d, "p_size")


@query("select v, least(v // 7, (select count(*) from nodes) // 7 - 1) as blk from nodes")
def uniform_chunks(spark, d):
    return B.uniform_blocks(part_nodes(spark, d), 7)


_DELTA = """, x as (
  select move_id, a, b, t, sum(x) as x from (select move_id, a, b, nb.blk as t, -nb.n as x from moves join nb on nb.v = i union all select move_id, a, b, nb.blk, nb.n from moves join nb on nb.v = j) group by all
), adj as (select move_id, a, b from moves join e on src = least(i, j) and dst = greatest(i, j)
), delta as (select move_id, r, s, cast(sum(de) as bigint) as de from (
    select move_id, least(a, t) as r, greatest(a, t) as s, x as de from x union all select move_id, least(b, t), greatest(b, t), -x from x
    union all select move_id, least(a, b), greatest(a, b), 2 from adj union all select move_id, a, a, -1 from adj union all select move_id, b, b, -1 from adj) group by all having sum(de) <> 0
), dn as (select move_id, d.r, d.s, de, n, coalesce(m, 0) as m from delta d join pairs p on p.r = d.r and p.s = d.s left join conn c on c.r = d.r and c.s = d.s
), scored as (select move_id, -sum(""" + _ll("m + de", "n") + " - (" + _ll("m", "n") + ")) as delta_nll from dn group by 1) "


@query(_DELTA + "select move_id, r, s, de from delta")
def swap_delta_e(spark, d):
    e, _, b = _parts(spark, d)
    return W.cross_deltas(e, b)


@query(_DELTA + "select move_id, round(delta_nll, 4) as delta_nll from scored")
def swap_delta_nll(spark, d):
    e, _, b = _parts(spark, d)
    return W.cross_scores(e, b).select("move_id", F.round("delta_nll", 4).alias("delta_nll"))


@query(_DELTA + "select r, s, cast(sum(m) as bigint) as m from (select r, s, m from conn union all select r, s, de from delta where move_id = (select min(move_id) from moves)) group by 1, 2 having sum(m) <> 0")
def apply_swap_conn(spark, d):
    e, _, b = _parts(spark, d)
    e = cut(e)
    moves = _moves(e, b)
    first = moves.join(F.broadcast(moves.agg(F.min("move_id").alias("move_id"))), "move_id", "left_semi")
    return B.apply_delta(B.connectivity(e, b), B.swap_delta(first, e, b))


@query("select src as i, bs as a, dst as j, bd as b from lab where bs <> bd")
def cross_edge_candidates(spark, d):
    e, _, b = _parts(spark, d)
    return B.cross_edges(e, b)


@query("select nb.v as j, blk.blk as a, nb.blk as b, cast(n * (n - 1) / 2 as bigint) as wedges from nb join blk on blk.v = nb.v where nb.blk <> blk.blk and n > 1")
def wedge_candidates(spark, d):
    e, _, b = _parts(spark, d)
    return B.wedge_counts(e, b)


@query("select blk.blk as a, nb.blk as b, count(*) as n from nb join blk on blk.v = nb.v where nb.blk <> blk.blk group by 1, 2")
def triad_candidates(spark, d):
    e, _, b = _parts(spark, d)
    return B.triad_candidates(e, b)


@query("""select x.v as i, x.b as a, y.v as j, y.b as b from (select s.u as v, p.blk as b, q.blk as nb from (select u, min(v) as v from sym2 group by u having count(*) = 1) s join blk p on p.v = s.u join blk q on q.v = s.v where p.blk <> q.blk) x
 join (select s.u as v, p.blk as b, q.blk as nb from (select u, min(v) as v from sym2 group by u having count(*) = 1) s join blk p on p.v = s.u join blk q on q.v = s.v where p.blk <> q.blk) y on x.b = y.nb and y.b = x.nb and x.v < y.v""")
def twin_leaf_candidates(spark, d):
    return B.twin_leaves(co_purchase(spark, d, "R", 30), part_blocks(spark, d))


_TRI = """, tri as (select a.src as x, a.dst as y, b.dst as z from e a join e b on a.dst = b.src join e c on c.src = a.src and c.dst = b.dst
), tv as (select v, count(*) as t from (select x as v from tri union all select y from tri union all select z from tri) group by 1
), cl as (select v, case when degree < 2 then 0.0 else 2.0 * coalesce(t, 0) / (degree * (degree - 1)) end::double as clustering from deg left join tv using (v)
), tri2 as (select a.src as x, a.dst as y, b.dst as z from er a join er b on a.dst = b.src join er c on c.src = a.src and c.dst = b.dst
), tv2 as (select v, count(*) as t from (select x as v from tri2 union all select y from tri2 union all select z from tri2) group by 1
), cl2 as (select v, case when degree < 2 then 0.0 else 2.0 * coalesce(t, 0) / (degree * (degree - 1)) end::double as clustering from degr left join tv2 using (v)) """


@query(_TRI + "select v, round(clustering, 8) as clustering from cl")
def local_clustering(spark, d):
    e, n, _ = _parts(spark, d)
    return G.local_clustering(cut(e), n).select("v", F.round("clustering", 8).alias("clustering"))


@query(_TRI + "select round(abs((select avg(clustering) from cl) - (select avg(clustering) from cl2)), 8) as difference")
def avg_clustering_diff(spark, d):
    e, n, _ = _parts(spark, d)
    a, b = (G.local_clustering(cut(x), n).agg(F.avg("clustering").alias("c")) for x in (e, _second(spark, d)))
    return a.crossJoin(b.withColumnRenamed("c", "c2")).select(F.round(F.abs(F.col("c") - F.col("c2")), 8).alias("difference"))


@query("select round(abs((select corr(x.degree, y.degree) from sym s join deg x on x.v = s.u join deg y on y.v = s.v) - (select corr(x.degree, y.degree) from symr s join degr x on x.v = s.u join degr y on y.v = s.v)), 8) as difference")
def assortativity_diff(spark, d):
    e, n, _ = _parts(spark, d)
    a, b = (G.assortativity(x, n) for x in (e, _second(spark, d)))
    return a.crossJoin(b.withColumnRenamed("assortativity", "other")).select(F.round(F.abs(F.col("assortativity") - F.col("other")), 8).alias("difference"))


def _emd(a: str, b: str) -> str:
    return f""", h as (select x, sum(p) as p, sum(q) as q from (select x, 1 as p, 0 as q from ({a}) union all select x, 0, 1 from ({b})) group by 1
), w as (select sum(p) over (order by x)::double / sum(p) over () as f, sum(q) over (order by x)::double / sum(q) over () as g, lead(x) over (order by x) - x as dx from h) select round(coalesce(sum(abs(f - g) * dx), 0), 8) as emd from w"""


def _hist(t: str) -> str:
    return f"select coalesce(c, 0)::double / (select count(*) from {t}) as x from (select unnest(range(0, (select max(degree) from {t}) + 1)) as g) left join (select degree, count(*) as c from {t} group by 1) on g = degree"


@query(_emd(_hist("deg"), _hist("degr")))
def degree_ref_emd(spark, d):
    e, n, _ = _parts(spark, d)
    a, b = (G.degree_histogram(G.degrees(x, n)).select(F.col("frequency").alias("x")) for x in (e, _second(spark, d)))
    return G.wasserstein(a, b).select(F.round("emd", 8).alias("emd"))


@query(_emd("select degree as x from deg", "select degree as x from degr"))
def degree_emd(spark, d):
    e, n, _ = _parts(spark, d)
    a, b = (G.degrees(x, n).select(F.col("degree").alias("x")) for x in (e, _second(spark, d)))
    return G.wasserstein(a, b).select(F.round("emd", 8).alias("emd"))


@query("select round(sum(i / e - pow(d / (2.0 * e), 2)), 8) as modularity from (select c, sum(d) as d, sum(i)::double as i from (select r as c, m as d, case when r = s then m else 0 end as i from conn union all select s, m, 0 from conn) group by 1), (select sum(m)::double as e from conn)")
def modularity(spark, d):
    return B.modularity(_stats(spark, d)[0]).select(F.round("modularity", 8).alias("modularity"))


@query(""", t as (select 2.0 * count(*)::double as m2 from e), n as (select sum(case when degree > 0 then degree / m2 * log2(degree / m2) else 0 end) as hn from deg, t
), q as (select c, sum(x) / any_value(m2) as q, count(*) / any_value(m2) as p from (select bs as c, (bs <> bd)::int as x from lab union all select bd, (bs <> bd)::int from lab), t group by 1)
select round((case when sum(q) > 0 then sum(q) * log2(sum(q)) else 0 end) - 2 * sum(case when q > 0 then q * log2(q) else 0 end) - any_value(hn) + sum((q + p) * log2(q + p)), 8) as codelength from q, n""")
def map_equation(spark, d):
    e, _, b = _parts(spark, d)
    return B.map_equation(e, b).select(F.round("codelength", 8).alias("codelength"))


_COMP = """, reach(node, root) as (select v, v from nodes union select s.v, r.root from reach r join sym2 s on s.u = r.node), comp as (select node as v, min(root) as component from reach group by 1
), lcc as (select component from comp group by 1 order by count(*) desc, component limit 1) """


@query(_COMP + "select v, component from comp")
def components(spark, d):
    return G.components(co_purchase(spark, d, "R", 30), part_nodes(spark, d))


@query(_COMP + "select src, dst from e2 where src in (select v from comp where component = (select component from lcc))")
def lcc_edges(spark, d):
    e = cut(co_purchase(spark, d, "R", 30))
    return G.within(e, G.largest_component(G.components(e, part_nodes(spark, d))))


def _walk(name: str, sym: str, of: str) -> str:
    """All shortest distances from the nodes `of`, level by level; a pair once reached is not reached again."""
    return f"""{name}(s, v, d) using key (s, v) as (select v, v, 0 from {of} union select w.s, y.v, min(w.d) + 1 from {name} w join {sym} y on y.u = w.v
 where not exists (select 1 from recurring.{name} r where r.s = w.s and r.v = y.v) group by 1, 2)"""


_BFS = ", " + _walk("dist", "sym2", "nodes")


@query(_BFS + " select s, v, cast(d as bigint) as d from dist")
def bfs_distances(spark, d):
    return G.distances(co_purchase(spark, d, "R", 30), part_nodes(spark, d))


@query(_BFS + " select round(avg(d), 8) as mean_distance from dist where d > 0")
def avg_path_length(spark, d):
    counts = G.distance_counts(packed.stored(co_purchase(spark, d, "R", 30)), part_nodes(spark, d))
    return counts.agg(F.round(F.sum(F.col("d") * F.col("n")) / F.sum("n"), 8).alias("mean_distance"))


def _lcc(name: str, sym: str) -> str:
    return f"""{name}_reach(node, root) using key (node) as (select v, v from nodes union select y.v, min(r.root) from {name}_reach r join {sym} y on y.u = r.node join recurring.{name}_reach o on o.node = y.v where r.root < o.root group by 1
), {name} as (select node as v from {name}_reach where root = (select root from {name}_reach group by 1 order by count(*) desc, root limit 1)), {name}_sym as (select u, v from {sym} where u in (select v from {name}))"""


_BOTH_PATHS = ", " + ", ".join((_lcc("la", "sym"), _lcc("lb", "symr"), _walk("da", "la_sym", "la"), _walk("db", "lb_sym", "lb")))


@query(_BOTH_PATHS + " select round(abs((select avg(d) from da where d > 0) - (select avg(d) from db where d > 0)), 8) as difference")
def avg_path_length_diff(spark, d):
    """All pairs of the largest components count, as in the SQL."""
    return M.avg_path_length(*_pair(spark, d), samples=None).select(F.round("difference", 8).alias("difference"))


@query(_BOTH_PATHS + _emd("select d as x from da where d > 0", "select d as x from db where d > 0"))
def path_emd(spark, d):
    return M.shortest_path(*_pair(spark, d), samples=None).select(F.round("emd", 8).alias("emd"))


def _drawn(cells: str) -> str:
    """Pairs of nodes at the places drawn in cells (r, s, n, p, kr, ks), stretch by stretch, gaps by hash."""
    return f""", c0 as (select r, s, n, p::double as p, ks, greatest(1, ceil(n * p::double / {N.STRETCH}))::bigint as c from ({cells}) where n > 0 and p > 0
), c1 as (select *, ceil(n::double / c)::bigint as l, unnest(range(0, c)) as i from c0), c2 as (select *, least(l, n - i * l) as w from c1), c3 as (select *, least(w, ceil(w * p + 10 * sqrt(w * p) + 40)::bigint) as k from c2 where w > 0
), c4 as (select *, unnest(range(1, k + 1)) as d from c3), c5 as (select r, s, ks, w, i * l + sum(least(case when p >= 1 then 0 else floor(ln({_u(SEED, 'r', 's', 'i', 'd')}) / ln(1 - p)) end, w) + 1) over (partition by r, s, i order by d) - 1 as pl, sum(least(case when p >= 1 then 0 else floor(ln({_u(SEED, 'r', 's', 'i', 'd')}) / ln(1 - p)) end, w) + 1) over (partition by r, s, i order by d) - 1 as own from c4
), c6 as (select r, s, ks, cast(pl as bigint) as pl, cast(floor((1 + sqrt(1 + 8 * pl)) / 2) as bigint) as t from c5 where own < w), c7 as (select r, s, ks, pl, case when t * (t - 1) / 2 > pl then t - 1 when t * (t + 1) / 2 <= pl then t + 1 else t end as t from c6
), num as (select v, blk, row_number() over (partition by blk order by v) - 1 as n from blk)
select least(x.v, y.v) as src, greatest(x.v, y.v) as dst from (select r, s, case when r = s then t else pl // ks end as i, case when r = s then pl - cast(t * (t - 1) / 2 as bigint) else pl % ks end as j from c7) join num x on x.blk = r and x.n = i join num y on y.blk = s and y.n = j"""


@query(_drawn("select r, s, n, m::double / n as p, ks from full_conn"))
def sbm_sample(spark, d):
    e, _, b = _parts(spark, d)
    return N.sample_graph(b, B.connectivity(e, b), SEED)


@query(_drawn("select r, s, n, case when r = s then 0.05 else 0.002 end as p, ks from pairs"))
def planted_sample(spark, d):
    return N.planted_partition(part_blocks(spark, d), 0.05, 0.002, SEED)


@query(f"""select blk, cast(coalesce(c, 0) as bigint) as c from sizes left join (select blk, min(j) as c from (select blk, j, exp(sum(ln(greatest(f, 1e-300)))) as f from (
  select blk, t, j, sum(pmf) over (partition by blk, t order by j) as f from (select blk, t, j, exp(coalesce(list_sum([ln((k - i + 1)::double / i) for i in range(1, j + 1)]), 0) + j * ln(p) + (k - j) * ln(1 - p)) as pmf
  from (select *, unnest(range(0, k + 1)) as j from (select r as blk, s as t, kr as k, m::double / n as p from full_conn union all select s, r, ks, m::double / n from full_conn where r <> s)))) group by 1, 2) where f >= {ALPHA} group by 1) using (blk)""")
def max_binom_quantile(spark, d):
    return N.binomial_quantiles(*_stats(spark, d), ALPHA)


@query("select r, s, round(w, 2) as w from we")
def kl_weights(spark, d):
    return N.edge_weights(*_stats(spark, d)).select("r", "s", F.round("w", 2).alias("w"))


@query("select blk, round(w, 6) as w from wn")
def block_size_weights(spark, d):
    return N.block_weights(*_stats(spark, d)).select("blk", F.round("w", 6).alias("w"))


def _sigma(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, k = _fine(spark, d)
    return c, k, N.sigmas(c, k, EPS, DELTA, SENSITIVITY)[1]


_FACTOR = (2 * gaussian_constant(EPS, DELTA)) ** 2


def _lifted(full: str, lam: float) -> str:
    """Zero pairs that noise lifts: (r, s, m)."""
    return f"""select r, s, cast(least(f, round_even(greatest(z - {lam!r} * sg, 0), 0)) as bigint) as m from (select r, s, f, sg, sg * {_z(SEED + 20, 'r', 's')} as z
 from (select r, s, f, sqrt(sqrt({float(SENSITIVITY**2)!r} / f) * {_FACTOR!r} / t) as sg from (select r, s, {full} as f from zero where n > 0), total where f > 0)) where z >= 0.5 and round_even(greatest(z - {lam!r} * sg, 0), 0) > 0"""


_FULL = f"case when r = s then {FINE * (FINE - 1) // 2} else {FINE * FINE} end"


@query("select r, s, round(sigma, 6) as sigma from sig", FINE_PRELUDE)
def sigmas(spark, d):
    return _sigma(spark, d)[2].select("r", "s", F.round("sigma", 6).alias("sigma"))


@query(f"select r, s, round(m + sigma * {_z(SEED, 'r', 's')}, 5) as x from conn join sig using (r, s)", FINE_PRELUDE)
def noisy_counts(spark, d):
    c, _, s = _sigma(spark, d)
    return N.noisy_counts(c, s, SEED).select("r", "s", F.round("x", 5).alias("x"))


@query(f"select r, s, cast(least({_FULL}, trunc(greatest(0, m + sigma * {_z(SEED, 'r', 's')} + sigma * {_z(SEED + 10, 'r', 's')}))) as bigint) as m from conn join sig using (r, s) union all " + _lifted(_FULL, 0.0), FINE_PRELUDE)
def naive_clamp(spark, d):
    c, k, s = _sigma(spark, d)
    lifted = N.noisy_zero_pairs(c, k, _FACTOR / F.col("total"), SENSITIVITY, FINE, SEED)
    return N.naive_clamp(N.noisy_counts(c, s, SEED), s, k, FINE, SEED).union(lifted)


@query(f", x as (select r, s, sigma, m + sigma * {_z(SEED, 'r', 's')} as x from conn join sig using (r, s)) select r, s, cast(least({_FULL}, greatest(0, round_even(sign(x) * greatest(abs(x) - {activation_threshold()!r} * sigma, 0), 0))) as bigint) as m from x union all " + _lifted(_FULL, activation_threshold()), FINE_PRELUDE)
def lasso_post(spark, d):
    c, k, s = _sigma(spark, d)
    lifted = N.noisy_zero_pairs(c, k, _FACTOR / F.col("total"), SENSITIVITY, FINE, SEED, activation_threshold())
    return N.lasso(N.noisy_counts(c, s, SEED), s, FINE).union(lifted)


@query(f"select r, s, round(sqrt(sqrt({float(SENSITIVITY**2)!r} / n) * {_FACTOR!r} / t), 6) as sigma from zero, total where n > 0", FINE_PRELUDE)
def zero_pair_sigmas(spark, d):
    c, k = _fine(spark, d)
    z = B.zero_pairs(c, k).where("n > 0").crossJoin(F.broadcast(N.normaliser(c, k, SENSITIVITY)))
    return z.select("r", "s", F.round(F.sqrt(F.sqrt(F.lit(float(SENSITIVITY**2)) / F.col("n")) * _FACTOR / F.col("total")), 6).alias("sigma"))


_DOT = "select list_dot_product(a.embedding::double[], b.embedding::double[]) as x from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.label {} 5"


@query(_emd(_DOT.format("<"), _DOT.format(">=")))
def embedding_dot_emd(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")
    pair = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    dots = cut(pair.select("label", F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b).alias("x")))
    return G.wasserstein(dots.where("label < 5").select("x"), dots.where("label >= 5").select("x")).select(F.round("emd", 8).alias("emd"))


@query("select dense_rank() over (order by p_brand) - 1 as estimated, p_size as truth, count(*) as n from part group by p_brand, p_size")
def contingency(spark, d):
    t = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("long").alias("v"), F.col("p_size").alias("truth"))
    return part_blocks(spark, d).join(t, "v").groupBy(F.col("blk").alias("estimated"), "truth").agg(F.count(F.lit(1)).alias("n"))


def _trace(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 4).cast("long").alias("chain"), F.col("event_id").cast("long").alias("iteration"), F.coalesce("value", F.lit(0.0)).alias("val"), (F.col("event_type") == "click").cast("int").alias("accepted"))


_TRACE = ", tr as (select cast(user_id % 4 as bigint) as chain, cast(event_id as bigint) as iteration, coalesce(value, 0) as val, cast(event_type = 'click' as int) as accepted from events) "


@query(_TRACE + "select chain, iteration, round(avg(accepted) over (partition by chain order by iteration rows between 999 preceding and current row), 6) as rate from tr")
def rolling_accept(spark, d):
    w = Window.partitionBy("chain").orderBy("iteration").rowsBetween(-999, 0)
    return _trace(spark, d).select("chain", "iteration", F.round(F.avg("accepted").over(w), 6).alias("rate"))


@query(_TRACE + "select chain, iteration, row_number() over (partition by chain, g order by iteration) - case when g > 0 then 1 else 0 end as rejections from (select *, sum(accepted) over (partition by chain order by iteration) as g from tr)")
def patience_counter(spark, d):
    g = _trace(spark, d).withColumn("g", F.sum("accepted").over(Window.partitionBy("chain").orderBy("iteration")))
    return g.select("chain", "iteration", (F.row_number().over(Window.partitionBy("chain", "g").orderBy("iteration")) - F.when(F.col("g") > 0, 1).otherwise(0)).cast("long").alias("rejections"))


@query(_TRACE + "select chain, iteration, min(val) over (partition by chain order by iteration) as best from tr")
def running_best(spark, d):
    return _trace(spark, d).select("chain", "iteration", F.min("val").over(Window.partitionBy("chain").orderBy("iteration")).alias("best"))


@query("select cast(iteration as bigint) as iteration, round(pow(0.99, iteration), 12) as temperature from (select unnest(range(0, 200)) as iteration)")
def geometric_temperature(spark, d):
    return spark.range(200).select(F.col("id").alias("iteration"), F.round(F.pow(F.lit(0.99), "id"), 12).alias("temperature"))


@query(_TRACE + """, h as (select *, ntile(2) over (partition by chain order by iteration) as half from tr), c as (select chain, half, count(*)::double as n, avg(val) as m, var_samp(val) as v from h group by 1, 2)
select round(sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)), 8) as rhat from c""")
def rhat(spark, d):
    half = F.ntile(2).over(Window.partitionBy("chain").orderBy("iteration"))
    c = _trace(spark, d).withColumn("half", half).groupBy("chain", "half").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("val").alias("m"), F.var_samp("val").alias("v"))
    return c.agg(F.round(F.sqrt(((F.avg("n") - 1) / F.avg("n") * F.avg("v") + F.var_samp("m")) / F.avg("v")), 8).alias("rhat"))


@query("select k as size, count(*) as n, round(count(*)::double / sum(count(*)) over (), 8) as frequency from sizes group by 1")
def value_counts(spark, d):
    c = _stats(spark, d)[1].groupBy(F.col("k").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("size", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 8).alias("frequency"))


@query("select least(49, floor((degree - lo) * 50.0 / (hi - lo)))::bigint as bin, round(count(*) / (any_value(n) * any_value(hi - lo) / 50.0), 8) as density from deg, (select min(degree) as lo, max(degree) as hi, count(*) as n from deg) group by 1")
def density_histogram(spark, d):
    e, n, _ = _parts(spark, d)
    deg = G.degrees(e, n)
    ends = deg.agg(F.min("degree").alias("lo"), F.max("degree").alias("hi"), F.count(F.lit(1)).alias("n"))
    x = deg.crossJoin(F.broadcast(ends)).withColumn("bin", F.least(F.lit(49), F.floor((F.col("degree") - F.col("lo")) * 50.0 / (F.col("hi") - F.col("lo")))).cast("long"))
    return x.groupBy("bin", "lo", "hi", "n").agg(F.count(F.lit(1)).alias("c")).select("bin", F.round(F.col("c") / (F.col("n") * (F.col("hi") - F.col("lo")) / 50.0), 8).alias("density"))


@query("select v, round((degree - lo)::double / (hi - lo + 1e-9), 8) as scaled from deg, (select min(degree) as lo, max(degree) as hi from deg)")
def minmax_degree(spark, d):
    e, n, _ = _parts(spark, d)
    deg = G.degrees(e, n)
    ends = deg.agg(F.min("degree").alias("lo"), F.max("degree").alias("hi"))
    return deg.crossJoin(F.broadcast(ends)).select("v", F.round((F.col("degree") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9), 8).alias("scaled"))


@query("select p_brand as dataset, cast(p_size as bigint) as block_size, count(*) as n, round(avg(p_retailprice), 4) as mean, round(stddev_pop(p_retailprice), 4) as deviation from part group by 1, 2")
def metric_group_means(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.groupBy(F.col("p_brand").alias("dataset"), F.col("p_size").cast("long").alias("block_size")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean"), F.round(F.stddev_pop("p_retailprice"), 4).alias("deviation"))


@query(f"select v from (select v, {_u(SEED, 'v')} as u from nodes) order by u limit 50")
def hashed_shuffle_prefix(spark, d):
    return part_nodes(spark, d).orderBy(u01(SEED, "v")).limit(50)


@query("select k as mode from sizes group by 1 order by count(*) desc, k limit 1")
def block_size_mode(spark, d):
    return _stats(spark, d)[1].groupBy(F.col("k").alias("mode")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "mode").limit(1).select("mode")


@query("select blk, k, cast(sum(k) over (order by blk) - k as bigint) as first_node from sizes")
def prefix_offsets(spark, d):
    return _stats(spark, d)[1].select("blk", "k", (F.sum("k").over(Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("k")).alias("first_node"))


_CHANCES = {"uniform_swap": 0.25, "edge_based_swap": 0.45, "triadic_swap": 0.3}


@query(f"select cast(i as bigint) as i, case when {_u(SEED, 'i')} < 0.25 then 'uniform_swap' when {_u(SEED, 'i')} < 0.7 then 'edge_based_swap' else 'triadic_swap' end as move_type from (select unnest(range(0, 5000)) as i)")
def move_type_choice(spark, d):
    return spark.range(5000).select(F.col("id").alias("i")).select("i", C.move_type(u01(SEED, "i"), _CHANCES).alias("move_type"))


@query(_DELTA + f"select move_id, delta_nll < -1e-9 or {_u(SEED, 'move_id')} < exp(-least(round(delta_nll, 6) / 0.5, 700)) as accepted from scored")
def metropolis_acceptance(spark, d):
    e, _, b = _parts(spark, d)
    s = W.cross_scores(e, b).withColumn("delta_nll", F.round("delta_nll", 6))
    return s.select("move_id", C.accepted(F.col("delta_nll"), u01(SEED, "move_id"), F.lit(0.5), "metropolis").alias("accepted"))


@query(f"select cast(row_number() over (order by u, i, j) - 1 as bigint) as move_id, i, a, j, b from (select src as i, bs as a, dst as j, bd as b, {_u(SEED, 'src', 'dst')} as u from lab where bs <> bd order by u, i, j limit 25)")
def edge_swap_picks(spark, d):
    e, _, b = _parts(spark, d)
    return C.pick(B.cross_edges(e, b), 25, SEED)


@query(f"select x.blk as r, y.blk as s from sizes x join sizes y on x.blk < y.blk left join conn c on c.r = x.blk and c.s = y.blk order by case when c.m > 0 then 0 else 1 end, {_u(SEED, 'x.blk', 'y.blk')}, 1, 2 limit least(40, 2 * (select count(*) from sizes))")
def diagnostic_panel(spark, d):
    return C.panel(*_stats(spark, d), 40, SEED)


@query(f"""select cast(id as bigint) as move_id, i.v as i, p.blk as a, j.v as j, q.blk as b from (select id, x, case when y >= x then y + 1 else y end as y from (select id, floor({_u(SEED, 'id')} * n)::bigint as x, floor({_u(SEED + 1, 'id')} * (n - 1))::bigint as y from (select unnest(range(0, 300)) as id), (select count(*) as n from sizes)))
 join (select blk, k, row_number() over (order by blk) - 1 as at from sizes) p on p.at = x join (select blk, k, row_number() over (order by blk) - 1 as at from sizes) q on q.at = y
 join (select v, blk, row_number() over (partition by blk order by {_u(SEED + 2, 'v')}, v) - 1 as n from blk) i on i.blk = p.blk and i.n = floor({_u(SEED + 3, 'id')} * p.k)
 join (select v, blk, row_number() over (partition by blk order by {_u(SEED + 2, 'v')}, v) - 1 as n from blk) j on j.blk = q.blk and j.n = floor({_u(SEED + 4, 'id')} * q.k)""")
def uniform_swaps(spark, d):
    return C.uniform_swaps(part_blocks(spark, d), 300, SEED)


@query(f"select n as blocks, round(sqrt((n + n * (n + 1) / 2.0 * {SENSITIVITY**2}) / ({EPS**2} / (2 * ln(1.25 / {DELTA + 1 - ALPHA!r})))), 6) as sigma from (select count(*) as n from sizes)")
def homogeneous_sigma(spark, d):
    n = _stats(spark, d)[1].count()
    return spark.createDataFrame([(n, round(N.homogeneous_sigma(n, EPS, DELTA, 1 - ALPHA, SENSITIVITY), 6))], "blocks long, sigma double")


_HOM = f""", ks as (select z.blk, greatest(1.0, k + 5.0 * {_z(SEED, 'blk')}) as x from sizes z
), kt as (select blk, case when blk in (select r from conn union select s from conn) then round_even(x, 0) else x end as k from ks
), hx as (select r, s, trunc(m + 5.0 * {_z(SEED + 10, 'r', 's')})::bigint as m from conn) """


@query(_HOM + "select blk, round(k, 5) as k from kt")
def homogeneous_sizes(spark, d):
    return N.homogeneous_draw(*_stats(spark, d), 5.0, SEED)[0].select("blk", F.round("k", 5).alias("k"))


@query(_HOM + "select hx.r, hx.s, least(hx.m, trunc(case when hx.r = hx.s then a.k * (a.k - 1) / 2 else a.k * b.k end)::bigint) as m from hx join kt a on a.blk = hx.r join kt b on b.blk = hx.s where hx.m <> 0")
def homogeneous_counts(spark, d):
    return N.homogeneous_draw(*_stats(spark, d), 5.0, SEED)[1]


@query()
def balanced_blocks(spark, d):
    e, n, _ = _parts(spark, d)
    return P.balanced(cut(e), n, K)


@query()
def refined_blocks(spark, d):
    e, n, _ = _parts(spark, d)
    e = cut(e)
    return P.refine(e, cut(P.balanced(e, n, K)), 3)


@query()
def rebalanced_blocks(spark, d):
    e, _, b = _parts(spark, d)
    return P.rebalance(b, cut(e), K)


@query()
def coordinate_blocks(spark, d):
    e, n, _ = _parts(spark, d)
    return P.from_coordinates(E.spectral_features(cut(e), n, 8), K)


@query()
def leading_eigenvalues(spark, d):
    e, n, _ = _parts(spark, d)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(E.eigenvalues(cut(e), n, 10))], "place long, value double")


@query()
def eigen_centrality(spark, d):
    e, n, _ = _parts(spark, d)
    return E.centrality(cut(e), n)


@query()
def swap_fit(spark, d):
    e, n, _ = _parts(spark, d)
    return C.fit(e, B.uniform_blocks(n, K), 2).blocks


@query()
def communities(spark, d):
    e, n, _ = _parts(spark, d)
    return Q.local_moving(e, n, 6)[0]


@query("select time_bucket(interval 1 hour, ts::timestamp) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def windowed_event_counts(spark, d):
    return windowed_counts(spark.read.parquet(f"{d}/events.parquet")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query(_TRACE + "select chain, iteration, val from (select *, max(iteration) over (partition by chain) as top from tr) where iteration > top - 500")
def ring_buffer(spark, d):
    return C.last_draws(_trace(spark, d).select("chain", "iteration", "val"), 500)


@query()
def chain_diagnostics(spark, d):
    """R-hat and the smallest effective sample size of two statistics of four chains; draws are numbered inside their chain."""
    t = _trace(spark, d).withColumn("iteration", F.row_number().over(Window.partitionBy("chain").orderBy("iteration")))
    rows = t.select("chain", "iteration", F.lit("value").alias("stat"), "val").union(t.select("chain", "iteration", F.lit("accepted"), F.col("accepted").cast("double")))
    return C.diagnostics(rows, 100).select("stat", F.round("rhat", 8).alias("rhat"), F.round("ess", 6).alias("ess"))


@query("select move_id, least(a, b) as r, greatest(a, b) as s, arg_max(de, seq * 1000 + de) as de from (select l_orderkey % 50 as move_id, l_orderkey * 10 + l_linenumber as seq, l_partkey % 25 as a, l_suppkey % 25 as b, cast(l_quantity as bigint) as de from lineitem) group by 1, 2, 3")
def overwritten_deltas(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    x = li.select((F.col("l_orderkey") % 50).alias("move_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_partkey") % 25).alias("r"), (F.col("l_suppkey") % 25).alias("s"), F.col("l_quantity").cast("long").alias("de"))
    return B.overwritten(x)


@query("select sizes.blk, coalesce(m, 0) as m from sizes left join (select r as blk, m from conn where r = s) using (blk)", FINE_PRELUDE)
def diagonal_counts(spark, d):
    return B.diagonal_counts(*_fine(spark, d))


@query(f", panel as (select x.blk as r, y.blk as s, coalesce(c.m, 0) as m from sizes x join sizes y on x.blk < y.blk left join conn c on c.r = x.blk and c.s = y.blk order by case when c.m > 0 then 0 else 1 end, {_u(SEED, 'x.blk', 'y.blk')}, 1, 2 limit least(40, 2 * (select count(*) from sizes))) select r, s, m from panel")
def panel_counts(spark, d):
    c, k = _stats(spark, d)
    c = cut(c)
    return B.counts_for_pairs(c, C.panel(c, k, 40, SEED))


@query("select r - (r > 3)::bigint as r, s - (s > 3)::bigint as s, m from conn where r <> 3 and s <> 3")
def removed_block_counts(spark, d):
    c, k = _stats(spark, d)
    return B.remove_block(k, c, 3)[1]


@query("select blk, k from sizes union all select max(blk) + 1, 0 from sizes")
def added_block_sizes(spark, d):
    b = part_blocks(spark, d)
    return B.add_block(B.sizes(b), b)[0]


@query("select r, s, round_even(case when r = s then 0.05 else 0.002 end::double * n, 0)::bigint as m from pairs where round_even(case when r = s then 0.05 else 0.002 end::double * n, 0) > 0")
def expected_counts(spark, d):
    k = _stats(spark, d)[1]
    chances = B.possible_pairs(k).select("r", "s", F.when(F.col("r") == F.col("s"), 0.05).otherwise(0.002).alias("p"))
    return N.expected_counts(chances, k)


@query(_DELTA + f"select move_id, round(least(1.0, exp(-{EPS!r} * round(delta_nll, 4) / {2.0 * SENSITIVITY!r})), 6) as chance from scored")
def private_acceptance(spark, d):
    e, _, b = _parts(spark, d)
    s = W.cross_scores(e, b)
    return s.select("move_id", F.round(N.private_acceptance(F.round("delta_nll", 4), EPS, SENSITIVITY), 6).alias("chance"))


def _tries(trials: int, count: int) -> str:
    return f""", dr as (select id // {trials} as move_id, id % {trials} as t, y.u as i, p.blk as a, y.v as j, q.blk as b from (select unnest(range(0, {trials * count})) as id) x
 join (select v, row_number() over (order by v) - 1 as rk from blk) n on n.rk = floor({_u(SEED, 'id')} * (select count(*) from blk))::bigint join deg on deg.v = n.v
 join (select u, v, row_number() over (partition by u order by v) - 1 as ix from sym) y on y.u = n.v and y.ix = floor({_u(SEED + 1, 'id')} * degree)::bigint
 join blk p on p.v = y.u join blk q on q.v = y.v where degree > 0 and p.blk <> q.blk) """


_MOVES = "select cast(move_id as bigint) as move_id, x.i as i, x.a as a, x.j as j, x.b as b from (select move_id, arg_min({'i': i, 'a': a, 'j': j, 'b': b}, t) as x from found group by 1)"


@query(_tries(256, 100) + ", found as (select dr.* from dr join nb on nb.v = j and nb.blk = a where n > 1) " + _MOVES)
def cross_triangle_swaps(spark, d):
    e, _, b = _parts(spark, d)
    return C.cross_triangle_swaps(cut(e), b, 100, SEED, fill=False)


@query(_tries(128, 100) + f""", touch as (select nb.blk as a, blk.blk as b, nb.v as l, row_number() over (partition by nb.blk, blk.blk order by {_u(SEED + 2, 'nb.v')}, nb.v) - 1 as ix, count(*) over (partition by nb.blk, blk.blk) as n from nb join blk on blk.v = nb.v where nb.blk <> blk.blk
), pk as (select dr.move_id, dr.t, dr.i, dr.a, dr.b, w.ix as own, floor({_u(SEED + 3, 'dr.move_id', 'dr.t')} * (w.n - 1))::bigint as ix from dr join touch w on w.a = dr.a and w.b = dr.b and w.l = dr.j where w.n > 1
), found as (select pk.move_id, pk.t, pk.i, pk.a, pk.b, w.l as j from pk join touch w on w.a = pk.a and w.b = pk.b and w.ix = case when pk.ix >= own then pk.ix + 1 else pk.ix end) """ + _MOVES)
def triadic_swaps(spark, d):
    e, _, b = _parts(spark, d)
    return C.triadic_swaps(cut(e), b, 100, SEED, fill=False)


_SIX = f"""{_TRI}{_BOTH_PATHS}, hd as ({_hist('deg')}), hr as ({_hist('degr')})
, h1 as (select x, sum(p) as p, sum(q) as q from (select x, 1 as p, 0 as q from hd union all select x, 0, 1 from hr) group by 1), w1 as (select sum(p) over (order by x)::double / sum(p) over () as f, sum(q) over (order by x)::double / sum(q) over () as g, lead(x) over (order by x) - x as dx from h1)
, h2 as (select x, sum(p) as p, sum(q) as q from (select d as x, 1 as p, 0 as q from da where d > 0 union all select d, 0, 1 from db where d > 0) group by 1), w2 as (select sum(p) over (order by x)::double / sum(p) over () as f, sum(q) over (order by x)::double / sum(q) over () as g, lead(x) over (order by x) - x as dx from h2)
, c as (select abs((select avg(clustering) from cl) - (select avg(clustering) from cl2)) as d)
select metric, round(value::double, 8) as value from (select 'shortest_path' as metric, (select sum(abs(f - g) * dx) from w2) as value
 union all select 'avg_path_length', abs((select avg(d) from da where d > 0) - (select avg(d) from db where d > 0)) union all select 'degree', (select sum(abs(f - g) * dx) from w1) union all select 'clustering', d from c union all select 'avg_clustering', d from c
 union all select 'assortativity', abs((select corr(x.degree, y.degree) from sym s join deg x on x.v = s.u join deg y on y.v = s.v) - (select corr(x.degree, y.degree) from symr s join degr x on x.v = s.u join degr y on y.v = s.v)))"""


@query(_SIX)
def registry_metrics(spark, d):
    """The comparisons of the registry that SQL can say."""
    names = ["shortest_path", "avg_path_length", "degree", "clustering", "avg_clustering", "assortativity"]
    return M.compare_all(names, *_pair(spark, d), **{n: {"samples": None} for n in names[:2]}).select("metric", F.round("value", 8).alias("value"))


@query()
def registry_searches(spark, d):
    """The comparisons that rest on iterations: leading eigenvalues, centrality, communities."""
    return M.compare_all(["eigen_val", "eigen_centrality", "infomap", "leiden"], *_pair(spark, d))


@query()
def registry_embeddings(spark, d):
    """20 walks of 80 nodes from each node; 16 dimensions."""
    return M.compare_all(["embedding_node2vec", "embedding_prone"], *_pair(spark, d), **{n: {"dim": 16} for n in M.EMBEDDINGS})


@query()
def eigenvector_distance(spark, d):
    return M.eigen_vec(*_pair(spark, d), k=4).select(F.col("distance"))


@query()
def brand_misclassification(spark, d):
    truth = part_blocks(spark, d, "p_size")
    return spark.createDataFrame([(B.misclassification(part_blocks(spark, d), truth),)], "rate double")


@query()
def released_counts(spark, d):
    """A release of the fine blocks with calibrated noise, lasso-shrunk."""
    c, k = _fine(spark, d)
    return D.create_noise(D.Release(k, c), EPS, DELTA, ALPHA).draw(SEED, "lasso").conn


@query()
def directed_sample(spark, d):
    """A directed surrogate: counts of ordered pairs of blocks."""
    e, _, b = _parts(spark, d)
    conn = B.labelled(e, b).groupBy(F.col("bs").alias("r"), F.col("bd").alias("s")).agg(F.count(F.lit(1)).alias("m"))
    return N.sample_graph(b, conn, SEED, True)


@query("select dataset, block_size, count(*) as n from (select 'sbm_fit_' || p_brand || '_min_block_size_' || p_size || '_patience_9.csv' as f, p_brand as dataset, cast(p_size as bigint) as block_size from part) where contains(f, 'patience') group by 1, 2")
def files_by_name(spark, d):
    f = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("sbm_fit_"), "p_brand", F.lit("_min_block_size_"), "p_size", F.lit("_patience_9.csv")).alias("file"))
    x = S.named_with(f, "patience").select(S.dataset_in(F.col("file")).alias("dataset"), S.block_size_in(F.col("file")).alias("block_size"))
    return x.groupBy("dataset", "block_size").agg(F.count(F.lit(1)).alias("n"))
