"""Registered queries of the graph operators, each over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..net import Net
from ..operators import brokerage as br
from ..operators import census, cohesion, cug, dyads, equivalence, layout, paths, random_graphs, regress, spectral
from ..operators.centralization import centralization
from ..operators.degree import degreecent
from . import graphs
from .graphs import sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Decimals that both sides round to.
PLACES = 8

_nets = {
    "trade": graphs.trade,
    "trade125": lambda s, d: graphs.trade(s, d, 1.25),
    "partners": lambda s, d: graphs.trade(s, d, directed=False),
    "handoff": graphs.handoff,
    "handoff100": lambda s, d: graphs.handoff(s, d, 100.0),
    "handoff150": lambda s, d: graphs.handoff(s, d, 150.0),
    "supply": graphs.supply,
}


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*[(F.round(c, PLACES) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def add(name: str, net: str, function, text: str | None = None) -> None:
    """A query: an operator over a named network; ``text`` is its SQL after the network's CTEs."""

    def run(spark, folder):
        return tidy(function(_nets[net](spark, folder)))

    QUERIES[name] = run
    if text is not None:
        base = sql({"partners": "trade"}.get(net, net)) if net != "supply" else ""
        SQL[name] = f"with recursive {base}{text}" if base else text


def rnd(expr: str) -> str:
    return f"round({expr}, {PLACES}) + 0.0"


# ---------------------------------------------------------------- sources and views of ties

U = ", u as (select src x, dst y from a union select dst, src from a)"
MUT = ", u as (select a.src x, a.dst y from a join a b on a.src = b.dst and a.dst = b.src)"
add("edgelist_trade", "trade", lambda g: g.as_edgelist(), " select src, dst from e")
add("edgelist_valued_trade", "trade", lambda g: g.as_dataframe(), " select src, dst, weight from e")
add("sociomatrix_trade", "trade", lambda g: g.sociomatrix(), " select src i, dst j, 1.0::double as value from a")
add("sociomatrix_valued_diag_trade", "trade", lambda g: g.sociomatrix(True, False), " select src i, dst j, weight as value from e where weight <> 0")
add("symmetrized_weak_trade", "trade", lambda g: g.symmetrized("weak").drop("gid"), f"{U} select x u, y v from u")
add("symmetrized_strong_trade", "trade", lambda g: g.symmetrized("strong").drop("gid"), f"{MUT} select x u, y v from u")
add("undirected_partners", "partners", lambda g: g.as_edgelist(), " select distinct least(src, dst) src, greatest(src, dst) dst from e")
add("induced_trade", "trade", lambda g: g.induced(g.vertices.filter("cl = 1")).as_edgelist(), " select src, dst from e where src in (select vid from v where cl = 1) and dst in (select vid from v where cl = 1)")
add("without_vertices_trade", "trade", lambda g: g.without_vertices(g.vertices.filter("cl = 2")).as_edgelist(), " select src, dst from e where src not in (select vid from v where cl = 2) and dst not in (select vid from v where cl = 2)")
add("without_edges_trade", "trade", lambda g: g.without_edges(g.edges.join(g.edges.agg(F.avg("weight").alias("mean")), F.col("weight") > F.col("mean")).select("src", "dst")).as_edgelist(), " select src, dst from e where weight <= (select avg(weight) from e)")
add(
    "missing_dyads_trade",
    "trade",
    lambda g: g.set_missing_dyads(g.edges.filter("src < 5")).delete_missing_dyads(g.edges.filter("dst < 5")).missing_dyads(),
    " select src, dst from e where src < 5 and not dst < 5",
)
add("neighbors_trade", "trade", lambda g: g.outneighbors(3), " select dst vid from e where src = 3")
add("indegree_loops_trade", "trade", lambda g: g.indegree(), " select vid, count(e.src) as degree from v left join e on e.dst = vid group by vid")
add("vertex_attribute_trade", "trade", lambda g: g.get_vertex_attribute("cl"), " select vid, cl as value from v")

# ---------------------------------------------------------------- degree

_deg = "(select vid, coalesce((select {f} from a where src = vid), 0) o, coalesce((select {f} from a where dst = vid), 0) i from v)"


def _degree(expr: str, f: str = "count(*)") -> str:
    return f" select vid, {rnd(f'cast({expr} as double)')} score from {_deg.format(f=f)}"


add("degree_freeman_trade", "trade", lambda g: degreecent(g), _degree("o + i"))
add("degree_in_trade", "trade", lambda g: degreecent(g, "indegree"), _degree("i"))
add("degree_out_trade", "trade", lambda g: degreecent(g, "outdegree"), _degree("o"))
add("degree_valued_trade", "trade", lambda g: degreecent(g, ignore_eval=False), _degree("o + i", "sum(w)"))
add("degree_normalized_trade", "trade", lambda g: degreecent(g, normalized=True), _degree("(o + i) / (2.0 * ((select n from n) - 1))"))
add("degree_rescaled_trade", "trade", lambda g: degreecent(g, rescale=True), _degree("(o + i) / cast(sum(o + i) over () as double)"))
add("degree_diag_trade", "trade", lambda g: degreecent(g, diag=True), " select vid, " + rnd("cast((select count(*) from e where src = vid or dst = vid) as double)") + " score from v")
add("degree_freeman_handoff", "handoff", lambda g: degreecent(g), f" select vid, {rnd('cast(coalesce(o, 0) + coalesce(i, 0) as double)')} score from v left join (select src, count(*) o from a group by src) on src = vid left join (select dst, count(*) i from a group by dst) on dst = vid")
add("degree_partners", "partners", lambda g: degreecent(g), f"{U} select vid, {rnd('cast(count(y) as double)')} score from v left join u on x = vid group by vid")
QUERIES["degree_supply"] = lambda s, d: tidy(degreecent(graphs.supply(s, d)))
SQL["degree_supply"] = f"""
    with top as (select max(p_partkey) t from part), e as (select distinct l_partkey p, l_suppkey s from lineitem)
    select cast(p_partkey as bigint) vid, {rnd("cast(count(s) as double)")} score from part left join e on p = p_partkey group by 1
    union all select cast(s_suppkey + t + 1 as bigint), {rnd("cast(count(p) as double)")} from supplier cross join top left join e on s = s_suppkey group by 1
"""

# ---------------------------------------------------------------- density, dyads

add("gden_trade", "trade", lambda g: census.gden(g), f" select {rnd('(select count(*) from a) / cast(n * (n - 1) as double)')} density from n")
add("gden_diag_trade", "trade", lambda g: census.gden(g, diag=True), f" select {rnd('(select count(*) from e) / cast(n * n as double)')} density from n")
add("gden_partners", "partners", lambda g: census.gden(g), f"{U} select {rnd('(select count(*) from u where x < y) / (n * (n - 1) / 2.0)')} density from n")
QUERIES["gden_discount_supply"] = lambda s, d: tidy(census.gden(graphs.supply(s, d), discount_bipartite=True))
SQL["gden_discount_supply"] = f"select {rnd('(select count(*) from (select distinct l_partkey, l_suppkey from lineitem)) / cast((select count(*) from part) * (select count(*) from supplier) as double)')} density"
QUERIES["gden_supply"] = lambda s, d: tidy(census.gden(graphs.supply(s, d)))
SQL["gden_supply"] = f"select {rnd('(select count(*) from (select distinct l_partkey, l_suppkey from lineitem)) / (n * (n - 1) / 2.0)')} density from (select (select count(*) from part) + (select count(*) from supplier) n)"

DYADS = """, p as (select least(src, dst) x, greatest(src, dst) y, count(*) c from a group by 1, 2),
    dy as (select cast(count(*) filter (c = 2) as bigint) m, cast(count(*) filter (c = 1) as bigint) s from p),
    d as (select m, s, cast(n * (n - 1) // 2 - m - s as bigint) z, n from dy, n)"""
for _g in ("trade", "handoff"):
    add(f"dyad_census_{_g}", _g, lambda g: census.dyad_census(g), f"{DYADS} select m mutual, s asym, z n_null from d")
add("dyad_census_partners", "partners", lambda g: census.dyad_census(g), f"{U} select cast(count(*) as bigint) mutual, cast(0 as bigint) asym, cast(max(n.n) * (max(n.n) - 1) // 2 - count(*) as bigint) n_null from u, n where x < y")
add("mutuality_trade", "trade", lambda g: census.mutuality(g), f"{DYADS} select m mutual from d")
_recip = {
    "dyadic": "cast(m + z as double) / (m + s + z)",
    "dyadic_nonnull": "cast(m as double) / (m + s)",
    "edgewise": "2.0 * m / (2 * m + s)",
    "edgewise_lrr": "ln(m * cast(m + s + z as double) / pow(m + s / 2.0, 2))",
    "correlation": "(2.0 * m * n * (n - 1) - pow(2 * m + s, 2)) / ((2 * m + s) * cast(n * (n - 1) as double) - pow(2 * m + s, 2))",
}
for _m, _e in _recip.items():
    add(f"grecip_{_m}_trade", "trade", lambda g, m=_m: census.grecip(g, m), f"{DYADS} select {rnd(_e)} reciprocity from d")
add("hierarchy_reciprocity_trade", "trade", lambda g: paths.hierarchy(g), f"{DYADS} select {rnd('1 - cast(m + z as double) / (m + s + z)')} hierarchy from d")

# ---------------------------------------------------------------- transitivity

TWO = """, s2 as (select x.src i, y.dst k, count(*) s from a x join a y on x.dst = y.src and x.src <> y.dst group by 1, 2)"""
WEAK = TWO + ", t as (select cast(sum(s) as double) p, cast(sum(s) filter (exists (select 1 from a where src = i and dst = k)) as double) r from s2)"
for _g in ("trade", "handoff"):
    add(f"gtrans_weak_{_g}", _g, lambda g: census.gtrans(g), f"{WEAK} select {rnd('r / p')} transitivity from t")
add("transitivity_global_trade", "trade", lambda g: census.transitivity(g), f"{WEAK} select {rnd('r / p')} transitivity from t")
add("gtrans_weakcensus_trade", "trade", lambda g: census.gtrans(g, "weakcensus"), f"{WEAK} select {rnd('r')} transitivity from t")
# strong: over all ordered triples, whether the end tie is there exactly if the two-path is
STRONG = """, m as (select x.vid i, y.vid j, exists (select 1 from a where src = x.vid and dst = y.vid) t from v x, v y where x.vid <> y.vid),
    h as (select count(*) filter ((p.t and q.t) = r.t) hits, count(*) c from m p join m q on p.j = q.i and p.i <> q.j join m r on r.i = p.i and r.j = q.j)"""
add("gtrans_strong_trade", "trade", lambda g: census.gtrans(g, "strong"), f"{STRONG} select {rnd('hits / cast(c as double)')} transitivity from h")
add("gtrans_strongcensus_trade", "trade", lambda g: census.gtrans(g, "strongcensus"), f"{STRONG} select {rnd('cast(hits as double)')} transitivity from h")
CORR = TWO + """, c as (select case when exists (select 1 from a where src = x.vid and dst = y.vid) then 1.0 else 0.0 end t, coalesce((select s from s2 where i = x.vid and k = y.vid), 0) s
    from v x, v y where x.vid <> y.vid)"""
add("gtrans_correlation_trade", "trade", lambda g: census.gtrans(g, "correlation"), f"{CORR} select {rnd('corr(t, s)')} transitivity from c")


def _defined(df: DataFrame) -> DataFrame:
    return df.filter(~F.isnan("score"))


LOCAL = U + """, k as (select x vid, count(*) k from u group by x), cl as (select p.x vid, count(*) c from u p join u q on p.x = q.x and p.y < q.y join u r on r.x = p.y and r.y = q.y group by p.x),
    l as (select k.vid, 2.0 * coalesce(c, 0) / (k * (k - 1)) score from k left join cl on k.vid = cl.vid where k > 1)"""
for _g in ("trade", "handoff"):
    add(f"clustering_weak_{_g}", _g, lambda g: _defined(census.transitivity(g, "local", "weak")), f"{LOCAL} select vid, {rnd('score')} score from l")
add("clustering_weak_average_trade", "trade", lambda g: census.transitivity(g, "average", "weak"), f"{LOCAL} select {rnd('avg(score)')} transitivity from l")
FAG = """, s as (select x, y, count(*) s from (select src x, dst y from a union all select dst, src from a) group by x, y),
    d as (select x vid, sum(s) d, count(*) filter (s = 2) b from s group by x),
    t as (select p.x vid, sum(p.s * q.s * r.s) t from s p join s q on p.y = q.x join s r on q.y = r.x and r.y = p.x where q.y <> p.x group by p.x),
    l as (select d.vid, cast(coalesce(t, 0) as double) / (2 * (d * (d - 1) - 2 * b)) score from d left join t on d.vid = t.vid where d * (d - 1) - 2 * b > 0)"""
for _g in ("trade", "handoff"):
    add(f"clustering_directed_{_g}", _g, lambda g: _defined(census.transitivity(g, "local")), f"{FAG} select vid, {rnd('score')} score from l")
add("clustering_directed_average_trade", "trade", lambda g: census.transitivity(g, "average"), f"{FAG} select {rnd('avg(score)')} transitivity from l")

# ---------------------------------------------------------------- triads

TRIPLES = """, m as (select src x, dst y from a),
    t as (select p.vid a1, q.vid b1, r.vid c1, ab.x is not null ab, ba.x is not null ba, ac.x is not null ac, ca.x is not null ca, bc.x is not null bc, cb.x is not null cb
        from v p join v q on p.vid < q.vid join v r on q.vid < r.vid
        left join m ab on ab.x = p.vid and ab.y = q.vid left join m ba on ba.x = q.vid and ba.y = p.vid
        left join m ac on ac.x = p.vid and ac.y = r.vid left join m ca on ca.x = r.vid and ca.y = p.vid
        left join m bc on bc.x = q.vid and bc.y = r.vid left join m cb on cb.x = r.vid and cb.y = q.vid),
    f as (select (ab and ba)::int + (ac and ca)::int + (bc and cb)::int mu, (ab <> ba)::int + (ac <> ca)::int + (bc <> cb)::int s,
        [ab::int + ac::int, ba::int + bc::int, ca::int + cb::int] o, [ba::int + ca::int, ab::int + cb::int, ac::int + bc::int] i from t),
    g as (select mu::varchar || s::varchar || (3 - mu - s)::varchar man, list_max(o) mo, list_max(i) mi,
        case when o[1] + i[1] = 2 then o[1] when o[2] + i[2] = 2 then o[2] else o[3] end lone from f),
    named as (select man || case man when '021' then case when mo = 2 then 'D' when mi = 2 then 'U' else 'C' end when '111' then case when mi = 2 then 'D' else 'U' end
        when '030' then case when mo = 2 then 'T' else 'C' end when '120' then case lone when 2 then 'D' when 0 then 'U' else 'C' end else '' end triad from g),
    kinds as (select unnest(['003','012','102','021D','021U','021C','111D','111U','030T','030C','201','120D','120U','120C','210','300']) triad)
    select kinds.triad, count(named.triad) n from kinds left join named on named.triad = kinds.triad group by 1"""
for _g in ("trade", "handoff"):
    add(f"triad_census_directed_{_g}", _g, lambda g: census.triad_census(g), TRIPLES)
add(
    "triad_census_undirected_partners",
    "partners",
    lambda g: census.triad_census(g),
    U + """, t as (select (exists (select 1 from u where x = p.vid and y = q.vid))::int + (exists (select 1 from u where x = p.vid and y = r.vid))::int + (exists (select 1 from u where x = q.vid and y = r.vid))::int c
        from v p join v q on p.vid < q.vid join v r on q.vid < r.vid)
    select k.triad, count(c) n from (select unnest(['0', '1', '2', '3']) triad) k left join t on c::varchar = k.triad group by 1""",
)

# ---------------------------------------------------------------- brokerage

ROLES = """, o as (select p.src i, p.dst j, q.dst k from a p join a q on p.dst = q.src and p.src <> q.dst where not exists (select 1 from a z where z.src = p.src and z.dst = q.dst)),
    r as (select j, case when ci.cl = cj.cl and ck.cl = cj.cl then 'w_I' when ci.cl = cj.cl then 'b_IO' when ci.cl = ck.cl then 'w_O' when cj.cl = ck.cl then 'b_OI' else 'b_O' end role
        from o join v ci on ci.vid = i join v cj on cj.vid = j join v ck on ck.vid = k),
    raw as (select vid, v.cl, x.role, (select count(*) from r where r.j = vid and (x.role = 't' or r.role = x.role)) raw from v, (select unnest(['w_I', 'w_O', 'b_IO', 'b_OI', 'b_O', 't']) role) x)"""
add("brokerage_raw_trade", "trade", lambda g: br.brokerage(g, "cl").select("vid", "cl", "role", "raw"), f"{ROLES} select vid, cl, role, raw from raw")
add("brokerage_global_raw_trade", "trade", lambda g: br.brokerage_global(g, "cl").select("role", "raw"), f"{ROLES} select role, cast(sum(raw) as bigint) raw from raw group by role")
ALL_ROLES = """, s as (select cl, cast(count(*) as double) c from v group by cl), tot as (select cast(n as double) t, (select count(*) from a) / cast(n * (n - 1) as double) d from n),
    w as (select t, d * d * (1 - d) q, pow(d * (1 - d), 3) k, pow(d, 4) * pow(1 - d, 2) e, pow(d, 5) * (1 - d) f from tot),
    g as (select 'w_I' role, sum(c * (c - 1) * (c - 2)) m, sum(c * (c - 1) * (c - 2) * ((4 * c - 10) * k + (c - 3) * (f - 4 * e))) z from s, w
        union all select 'w_O', sum(c * (c - 1) * (t - c)), (select sum(x.c * (x.c - 1) * y.c * (2 * (x.c + y.c - 3) * k + (t - x.c - 1) * f)) from s x, s y, w) - sum(c * c * (c - 1) * ((4 * c - 6) * k + (t - c - 1) * f)) from s, w
        union all select r.r, sum(c * (c - 1) * (t - c)), sum(c * (c - 1) * (t - c) * ((t - 3) * k + (c - 2) * f)) from s, w, (select unnest(['b_IO', 'b_OI']) r) r group by r.r
        union all select 'b_O', (select sum(x.c * y.c * (t - x.c - y.c)) from s x, s y, w) - sum(c * c * (t - 2 * c)),
            (select sum(x.c * y.c * z.c * ((4 * (t - y.c) - 2 * (x.c + z.c + 1)) * k - (4 * (t - z.c) - 2 * (x.c + y.c + 1)) * e + (t - (x.c + z.c + 1)) * f)) from s x, s y, s z, w where x.cl <> y.cl and y.cl <> z.cl and x.cl <> z.cl) from s, w
        union all select 't', t * (t - 1) * (t - 2), t * (t - 1) * (t - 2) * ((4 * t - 10) * k + (t - 3) * (f - 4 * e)) from w)"""
add("brokerage_global_moments_trade", "trade", lambda g: br.brokerage_global(g, "cl").select("role", "exp", "sd"), f"{ALL_ROLES} select role, {rnd('m * q')} as exp, {rnd('sqrt(m * q * (1 - q) + z)')} sd from g, w")
CLASSES = """, s as (select cl, cast(count(*) as double) c from v group by cl), tot as (select cast(n as double) t, (select count(*) from a) / cast(n * (n - 1) as double) d from n),
    q as (select d * d * (1 - d) q, pow(d * (1 - d), 3) k, t from tot),
    b as (select cl, c, q, k, t, coalesce((select sum(o.c * (o.c - 1)) from s o where o.cl <> s.cl), 0) o2, coalesce((select sum(o.c * (o.c - 1) * (o.c - 2)) from s o where o.cl <> s.cl), 0) o3,
        coalesce((select sum(o.c * o.c) from s o where o.cl <> s.cl), 0) sq, coalesce((select sum(2 * o.c * (t - o.c - s.c) * (t - o.c - s.c - 1)) from s o where o.cl <> s.cl), 0) o5 from s, q),
    mv as (select cl, 'w_I' role, q * (c - 1) * (c - 2) m, 2 * (c - 1) * (c - 2) * (c - 3) * k s, q from b
        union all select cl, 'w_O', q * o2, 2 * o3 * k, q from b
        union all select cl, x.r, q * (t - c) * (c - 1), ((c - 1) * (t - c) * (t - c - 1) + (t - c) * (c - 1) * (c - 2)) * k, q from b, (select unnest(['b_IO', 'b_OI']) r) x
        union all select cl, 'b_O', q * ((t - c) * (t - c) - sq), o5 * k, q from b
        union all select cl, 't', q * (t - 1) * (t - 2), 2 * (t - 1) * (t - 2) * (t - 3) * k, q from b)"""
add("brokerage_moments_trade", "trade", lambda g: br.brokerage_classes(g, "cl").select(F.col("cl").cast("long").alias("cl"), "n", "role", "exp", "sd"), f"{CLASSES} select mv.cl, cast(s.c as bigint) n, role, {rnd('m')} as exp, {rnd('sqrt(m * (1 - mv.q) + mv.s)')} sd from mv join s on s.cl = mv.cl")
add(
    "brokerage_z_trade",
    "trade",
    lambda g: br.brokerage(g, "cl").filter("sd > 0").select("vid", "role", "z"),
    f"{ROLES}{CLASSES} select vid, raw.role, {rnd('(raw - m) / sqrt(m * (1 - mv.q) + mv.s)')} z from raw join mv on mv.cl = raw.cl and mv.role = raw.role where m * (1 - mv.q) + mv.s > 0",
)

# ---------------------------------------------------------------- structural equivalence

PROFILE = """, m as (select x.vid i, y.vid j, exists (select 1 from a where src = x.vid and dst = y.vid)::int t from v x, v y),
    c as (select x.vid i, y.vid j, p.t::double x, q.t::double y from v x, v y, v k join m p on p.i = x.vid and p.j = k.vid join m q on q.i = y.vid and q.j = k.vid where k.vid <> x.vid and k.vid <> y.vid
        union all select x.vid, y.vid, p.t, q.t from v x, v y, v k join m p on p.j = x.vid and p.i = k.vid join m q on q.j = y.vid and q.i = k.vid where k.vid <> x.vid and k.vid <> y.vid),
    z as (select i, j, sum(abs(x - y)) h, count(*) l, count(*) filter (x <> y) u, case when var_pop(x) > 1e-12 and var_pop(y) > 1e-12 then corr(x, y) else 0 end r from c group by i, j)"""
for _m, _e in {"hamming": "h", "euclidean": "sqrt(h)", "gamma": "(l - 2.0 * u) / l", "exact": "(u > 0)::int", "correlation": "r"}.items():
    add(f"sedist_{_m}_trade", "trade", lambda g, m=_m: equivalence.sedist(g, m), f"{PROFILE.replace('v x, v y, v k join', 'v x cross join v y cross join v k join')} select i, j, {rnd(f'cast({_e} as double)')} as value from z")
BLOCKS = """, s as (select cl, count(*) c from v group by cl), t as (select p.cl bi, q.cl bj, count(*) k from a join v p on p.vid = src join v q on q.vid = dst group by 1, 2)"""
add(
    "block_densities_trade",
    "trade",
    lambda g: equivalence.block_densities(g, g.vertices.select("gid", "vid", F.col("cl").alias("membership"))),
    f"{BLOCKS} select x.cl block_i, y.cl block_j, {rnd('coalesce(k, 0) / cast(x.c * y.c - case when x.cl = y.cl then x.c else 0 end as double)')} density from s x cross join s y left join t on bi = x.cl and bj = y.cl",
)


def _consensus(g: Net) -> DataFrame:
    v = g.vertices.select("vid", F.array(F.col("cl"), F.col("vid") % 3, F.expr("vid div 7")).alias("l")).select(F.posexplode("l").alias("part", "label"), "vid")
    return equivalence.consensus_clustering(v.select(F.col("part").cast("long").alias("part"), "vid", "label"))


add(
    "consensus_trade",
    "trade",
    _consensus,
    """, l as (select x.vid i, y.vid j from v x, v y where (x.cl = y.cl)::int + (x.vid % 3 = y.vid % 3)::int + (x.vid // 7 = y.vid // 7)::int >= 1.5),
    r as (select vid i, vid j from v union select r.i, l.j from r join l on r.j = l.i), c as (select i vid, min(j) c from r group by i)
    select vid, cast(dense_rank() over (order by c) as bigint) membership from c""",
)

# ---------------------------------------------------------------- paths


def levels(depth: int, arcs: str = "a") -> str:
    """CTEs up to ``g`` (i, j, d, paths) by one materialized level after another."""
    out = ", r0 as materialized (select vid i, vid j, 0 d, 1.0::double paths from v)"
    for k in range(1, depth + 1):
        out += f""", r{k} as materialized (select * from r{k - 1} union all select r.i, x.dst, {k}, sum(r.paths) from r{k - 1} r join {arcs} x on r.j = x.src and r.d = {k - 1}
            where not exists (select 1 from r{k - 1} o where o.i = r.i and o.j = x.dst) group by r.i, x.dst)"""
    return out + f", g as (select * from r{depth})"


WEAKARCS = ", ua as (select src, dst from a union select dst, src from a)"
_depth = {"trade": 12, "handoff100": 24}
for _g, _k in _depth.items():
    add(
        f"geodist_{_g}",
        _g,
        lambda g: paths.geodist(g, inf_replace=-1.0).select("i", "j", "gdist", "counts"),
        f"{levels(_k)} select x.vid i, y.vid j, coalesce(cast(d as double), -1.0) gdist, coalesce(paths, 0.0) counts from v x cross join v y left join g on g.i = x.vid and g.j = y.vid",
    )
    add(f"average_path_length_{_g}", _g, lambda g: paths.average_path_length(g), f"{levels(_k)} select {rnd('avg(d)')} average_path_length from g where d > 0")
REACH = ", rc as (select vid i, vid j from v union select rc.i, a.dst from rc join a on rc.j = a.src)"
add("reachability_handoff100", "handoff100", lambda g: paths.reachability(g), f"{REACH} select i, j from rc")
add("hierarchy_krackhardt_handoff100", "handoff100", lambda g: paths.hierarchy(g, "krackhardt"), f"{REACH}, p as (select least(i, j) x, greatest(i, j) y, count(*) c from rc where i <> j group by 1, 2) select {rnd('count(*) filter (c = 1) / cast(count(*) as double)')} hierarchy from p")
add("diameter_partners_core", "trade", lambda g: paths.diameter(g.replace(mask=None).induced(cohesion.largest_component(g, "strong"))), f"""{REACH}, mu as (select x.i, x.j from rc x join rc y on x.i = y.j and x.j = y.i), l as (select i, min(j) c, count(*) k from mu group by i),
    best as (select c from l group by c order by count(*) desc, c limit 1), keep as (select i vid from l where c = (select c from best)),
    ka as (select src, dst from a where src in (select vid from keep) and dst in (select vid from keep)){levels(12, "ka")} select max(cast(d as double)) diameter from g where i in (select vid from keep) and j in (select vid from keep)""")
CLOSE = ", s as (select vid, (select n from n) n, (select count(*) from g where i = vid and d > 0) c, (select sum(d) from g where i = vid and d > 0) t, coalesce((select sum(1.0 / d) from g where i = vid and d > 0), 0) inv from v)"
_close = {
    "directed": ("a", "case when c = n - 1 then (n - 1) / cast(t as double) else 0 end"),
    "undirected": ("ua", "case when c = n - 1 then (n - 1) / cast(t as double) else 0 end"),
    "suminvdir": ("a", "inv / (n - 1)"),
    "suminvundir": ("ua", "inv / (n - 1)"),
    "gil_schmidt": ("a", "case when c > 0 then inv / c else 0 end"),
}
for _m, (_arcs, _e) in _close.items():
    add(f"closeness_{_m}_trade", "trade", lambda g, m=_m: paths.closeness(g, m), f"{WEAKARCS if _arcs == 'ua' else ''}{levels(12, _arcs)}{CLOSE} select vid, {rnd(f'cast({_e} as double)')} score from s")
BET = ", bt as (select x.j vid, sum(x.paths * y.paths / z.paths) b from g x join g y on x.j = y.i join g z on z.i = x.i and z.j = y.j and z.d = x.d + y.d where x.d > 0 and y.d > 0 group by x.j)"
add("betweenness_directed_trade", "trade", lambda g: paths.betweenness(g), f"{levels(12)}{BET} select v.vid, {rnd('coalesce(b, 0.0)')} score from v left join bt on bt.vid = v.vid")
add("betweenness_undirected_trade", "trade", lambda g: paths.betweenness(g, "undirected"), f"{WEAKARCS}{levels(12, 'ua')}{BET} select v.vid, {rnd('coalesce(b, 0.0) / 2')} score from v left join bt on bt.vid = v.vid")
add("betweenness_normalized_trade", "trade", lambda g: paths.betweenness(g, normalized=True), f"{levels(12)}{BET} select v.vid, {rnd('coalesce(b, 0.0) / ((n - 1) * (n - 2))')} score from v cross join n left join bt on bt.vid = v.vid")
add("betweenness_handoff100", "handoff100", lambda g: paths.betweenness(g), f"{levels(24)}{BET} select v.vid, {rnd('coalesce(b, 0.0)')} score from v left join bt on bt.vid = v.vid")

# ---------------------------------------------------------------- components and cohesion


def reach(ties: str) -> str:
    return f", rc as (select vid i, vid j from v union select rc.i, x.dst from rc join {ties} x on rc.j = x.src), lab as (select i vid, min(j) c from rc group by i)"


_ties = {"weak": WEAKARCS + reach("ua"), "recursive": ", ma as (select x.src, x.dst from a x join a y on x.src = y.dst and x.dst = y.src)" + reach("ma"), "strong": REACH + ", mu as (select x.i, x.j from rc x join rc y on x.i = y.j and x.j = y.i), lab as (select i vid, min(j) c from mu group by i)"}
for _c, _t in _ties.items():
    add(f"components_{_c}_handoff100", "handoff100", lambda g, c=_c: cohesion.component_dist(g, c), f"{_t} select vid, cast(dense_rank() over (order by c) as bigint) membership, count(*) over (partition by c) csize from lab")
    add(f"component_sizes_{_c}_handoff100", "handoff100", lambda g, c=_c: cohesion.component_sizes(g, c), f"{_t} select csize, count(*) n from (select c, count(*) csize from lab group by c) group by csize")
    add(f"largest_component_{_c}_handoff100", "handoff100", lambda g, c=_c: cohesion.largest_component(g, c), f"{_t} select vid from lab where c = (select c from lab group by c order by count(*) desc, c limit 1)")
for _g in ("trade", "handoff100"):
    add(f"connectedness_{_g}", _g, lambda g: cohesion.connectedness(g), f"{_ties['weak']} select {rnd('(select sum(s * (s - 1)) from (select count(*) s from lab group by c)) / cast(n * (n - 1) as double)')} connectedness from n")
    add(
        f"efficiency_{_g}",
        _g,
        lambda g: cohesion.efficiency(g),
        f"{_ties['weak']}, s as (select count(*) s from lab group by c) select {rnd('1 - ((select count(*) from a) - sum(s - 1)) / cast(sum((s - 1) * (s - 1)) as double)')} efficiency from s",
    )
CUT = """, base as (select count(distinct c) k from lab), rem as (select x.vid cut, y.vid i, y.vid j from v x join v y on x.vid <> y.vid
        union select rem.cut, rem.i, t.dst from rem join {t} t on rem.j = t.src where t.dst <> rem.cut),
    parts as (select cut, count(distinct c) k from (select cut, i, min(j) c from {m} group by cut, i) group by cut)
    select cut vid from parts, base where parts.k > base.k"""
add("cutpoints_weak_handoff150", "handoff150", lambda g: cohesion.cutpoints(g, "weak"), _ties["weak"] + CUT.format(t="ua", m="rem"))
add("cutpoints_recursive_trade", "trade", lambda g: cohesion.cutpoints(g, "recursive"), _ties["recursive"] + CUT.format(t="ma", m="rem"))
add("cutpoints_strong_handoff150", "handoff150", lambda g: cohesion.cutpoints(g), _ties["strong"] + CUT.format(t="a", m="(select x.cut, x.i, x.j from rem x join rem y on x.cut = y.cut and x.i = y.j and x.j = y.i)"))
add(
    "cliques_trade",
    "trade",
    lambda g: cohesion.cliques(g).select("size", F.array_join("members", ",").alias("members")),
    MUT + """, q as (select [vid] m, vid last from v union all select list_append(q.m, u.y), u.y from q join u on u.x = q.last and u.y > q.last where not exists (select 1 from (select unnest(q.m) z) w where not exists (select 1 from u t where t.x = w.z and t.y = u.y)))
    select cast(len(m) as bigint) size, array_to_string(m, ',') members from q where len(m) >= 3
    and not exists (select 1 from v c where not list_contains(q.m, c.vid) and not exists (select 1 from (select unnest(q.m) z) w where not exists (select 1 from u t where t.x = w.z and t.y = c.vid)))""",
)


def cores(ends: str, rounds: int) -> str:
    """Core numbers as what degrees come to when each vertex takes the h-index of its neighbours' values again and again."""
    out = f", ne as ({ends}), h0 as materialized (select vid, coalesce((select count(*) from ne where x = vid), 0) c from v)"
    for k in range(1, rounds + 1):
        out += f""", h{k} as materialized (select v.vid, coalesce(max(least(r, c)), 0) c from v left join
            (select ne.x, h.c, row_number() over (partition by ne.x order by h.c desc) r from ne join h{k - 1} h on h.vid = ne.y) q on q.x = v.vid group by v.vid)"""
    return f"{out} select vid, cast(c as bigint) core from h{rounds}"


_ends = {"freeman": "select src x, dst y from a union all select dst, src from a", "indegree": "select dst x, src y from a", "outdegree": "select src x, dst y from a"}
for _c in ("freeman", "indegree", "outdegree"):
    add(f"kcores_{_c}_trade", "trade", lambda g, c=_c: cohesion.kcores(g, c), cores(_ends[_c], 25))
add("kcores_freeman_handoff", "handoff", lambda g: cohesion.kcores(g), cores(_ends["freeman"], 40))
# two ties of a vertex are in one block if their other ends reach each other without it
add(
    "bicomponents_weak_handoff100",
    "handoff100",
    lambda g: cohesion.bicomponents(g, "weak"),
    WEAKARCS + """, rem as (select x.vid cut, y.vid i, y.vid j from v x join v y on x.vid <> y.vid union select rem.cut, rem.i, t.dst from rem join ua t on rem.j = t.src where t.dst <> rem.cut),
    ed as (select distinct least(src, dst) x, greatest(src, dst) y from a), en as (select x s, y o, x, y from ed union all select y, x, x, y from ed),
    ln as (select p.x, p.y, q.x x2, q.y y2 from en p join en q on p.s = q.s join rem on rem.cut = p.s and rem.i = p.o and rem.j = q.o),
    cl as (select x, y, x x2, y y2 from ed union select cl.x, cl.y, ln.x2, ln.y2 from cl join ln on ln.x = cl.x2 and ln.y = cl.y2),
    lb as (select x, y, min({'x': x2, 'y': y2}) b from cl group by x, y),
    vs as (select b, list_sort(list_distinct(list_concat(list(x), list(y)))) vl from lb group by b),
    nb as (select b, dense_rank() over (order by vl) k from vs where len(vl) >= 3)
    select cast(k as bigint) bicomponent, x src, y dst from lb join nb on nb.b = lb.b""",
)

# ---------------------------------------------------------------- centralization

_D = ", sc as (select vid, cast({e} as double) s from " + _deg.format(f="count(*)") + ")"


def _central(scores: str, most: str) -> str:
    return f"{scores} select {rnd(f'(max(s) * count(*) - sum(s)) / ({most})')} centralization from sc, n group by n"


add("centralization_degree_trade", "trade", lambda g: centralization(g), _central(_D.format(e="o + i"), "(n - 1) * (2.0 * (n - 1) - 2)"))
add("centralization_in_trade", "trade", lambda g: centralization(g, mode="in"), _central(_D.format(e="i"), "cast((n - 1) * (n - 1) as double)"))
add("centralization_out_trade", "trade", lambda g: centralization(g, mode="out"), _central(_D.format(e="o"), "cast((n - 1) * (n - 1) as double)"))
add("centralization_raw_trade", "trade", lambda g: centralization(g, normalized=False), f"{_D.format(e='o + i')} select {rnd('max(s) * count(*) - sum(s)')} centralization from sc")
add("centralization_betweenness_trade", "trade", lambda g: centralization(g, "betweenness"), _central(f"{levels(12)}{BET}, sc as (select v.vid, coalesce(b, 0.0) s from v left join bt on bt.vid = v.vid)", "(n - 1) * (n - 1) * cast(n - 2 as double)"))
add("centralization_closeness_trade", "trade", lambda g: centralization(g, "closeness", cmode="suminvdir"), _central(f"{levels(12)}{CLOSE}, sc as (select vid, inv / (n - 1) s from s)", "cast((n - 1) * (n - 1) as double)"))


def leading(cells: str, squares: int = 10) -> str:
    """CTEs up to ``ev`` (vid, s): row sums of a high power of the matrix plus the identity, found by squaring, as a vector of length 1."""
    out = f", m0 as materialized (select i, j, sum(x) x from ({cells} union all select vid, vid, 1.0::double from v) group by i, j)"
    for k in range(1, squares + 1):
        out += f""", p{k} as materialized (select p.i, q.j, sum(p.x * q.x) x from m{k - 1} p join m{k - 1} q on p.j = q.i group by p.i, q.j),
            m{k} as materialized (select i, j, x / (select max(x) from p{k}) x from p{k})"""
    return out + f", rs as (select i vid, sum(x) s from m{squares} group by i), ev as (select vid, s / sqrt((select sum(s * s) from rs)) s from rs)"


_plain = leading("select src i, dst j, 1.0::double x from a")
add("centralization_eigenvector_trade", "trade", lambda g: centralization(g, "eigenvector"), _central(f"{_plain}, sc as (select vid, s from ev)", "n - 1.0"))

# ---------------------------------------------------------------- spectral, flow, positions (held against published values and residuals in tests)

add("evcent_trade", "trade", lambda g: spectral.evcent(g), f"{_plain} select vid, {rnd('s')} score from ev")
add("evcent_valued_trade", "trade", lambda g: spectral.evcent(g, ignore_eval=False, diag=True), leading("select src i, dst j, weight x from e") + f" select vid, {rnd('s')} score from ev")
add("bonpow_trade", "trade", lambda g: spectral.bonpow(g, 0.02), """, b as (select vid, 0 k, cast((select count(*) from a where src = vid) as double) x from v
        union all select a.src, y.k + 1, sum(0.02 * y.x) over (partition by a.src) from b y join a on a.dst = y.vid where false),
    it as materialized (select vid, x from b)""" + "".join(f", i{k} as materialized (select v.vid, (select count(*) from a where src = v.vid) + 0.02 * coalesce((select sum(p.x) from a join {'it' if k == 1 else f'i{k - 1}'} p on p.vid = a.dst where a.src = v.vid), 0) x from v)" for k in range(1, 41)) + f" select vid, {rnd('x * sqrt((select n from n) / (select sum(x * x) from i40))')} score from i40")


def inverse(n: int) -> str:
    """CTEs from ``b`` (i, j, x), a positive definite matrix of rows and columns 1..n, to ``c`` (i, j, x), its inverse: one pivot after another."""
    out = f", g0 as materialized (select i, j, x from b union all select i, {n} + j, (i = j)::int::double from b)"
    for k in range(1, n + 1):
        out += f""", g{k} as materialized (select g.i, g.j, case when g.i = {k} then g.x / p.x else g.x - f.x * r.x / p.x end x from g{k - 1} g
            join g{k - 1} r on r.i = {k} and r.j = g.j join g{k - 1} f on f.j = {k} and f.i = g.i join g{k - 1} p on p.i = {k} and p.j = {k})"""
    return out + f", c as (select i, j - {n} j, x from g{n} where j > {n})"


# vertices without ties are apart in the matrix, and have no information
add(
    "infocent_trade",
    "trade",
    lambda g: spectral.infocent(g),
    U + """, o as (select vid, row_number() over (order by vid) k, (select count(*) from u where x = vid) d from v),
    b as (select p.k i, q.k j, case when p.k = q.k then 1.0 + p.d when p.d = 0 or q.d = 0 then 0.0 else 1.0 - exists (select 1 from u where x = p.vid and y = q.vid)::int end::double x from o p cross join o q)"""
    + inverse(25)
    + f""", w as (select c.* from c join o p on p.k = c.i and p.d > 0 join o q on q.k = c.j and q.d > 0), t as (select sum(x) filter (i = j) t from w),
    r as (select i, sum(x) r, sum(x) filter (i = j) d from w group by i)
    select vid, coalesce({rnd('1 / (r.d + (t.t - 2 * r.r) / n.n)')}, 0.0) score from o cross join t cross join n left join r on r.i = o.k""",
)
add("flowbet_trade", "trade", lambda g: spectral.flowbet(g))
add("equiv_clust_trade", "trade", lambda g: equivalence.equiv_clust(g, 4))
add("blockmodel_trade", "trade", lambda g: equivalence.blockmodel(g, 4)[1])


def regular(rounds: int) -> str:
    """Regular equivalence, one materialized round after another; once a round changes less than 1e-6, later ones keep its values."""
    out = """, nb as materialized (select src i, dst k, 0 s from a union all select dst, src, 1 from a), sd as (select unnest([0, 1]) s),
        dg as materialized (select vid i, sd.s, count(k) d from v cross join sd left join nb on nb.i = vid and nb.s = sd.s group by vid, sd.s),
        s0 as materialized (select x.vid i, y.vid j, 1.0::double x, false done from v x cross join v y)"""
    for k in range(1, rounds + 1):
        out += f""", b{k} as materialized (select nb.i, nb.s, t.j l, max(t.x) x from nb join s{k - 1} t on t.i = nb.k group by nb.i, nb.s, t.j),
        m{k} as materialized (select b.i, nb.i j, b.s, avg(b.x) x from b{k} b join nb on nb.k = b.l and nb.s = b.s group by b.i, nb.i, b.s),
        n{k} as materialized (select di.i, dj.i j, case when di.i = dj.i then 1.0 else sum(0.5 * case when di.d = 0 and dj.d = 0 then 1.0 when di.d = 0 or dj.d = 0 then 0.0 else (p.x + q.x) / 2 end) end x
            from dg di join dg dj on dj.s = di.s left join m{k} p on p.i = di.i and p.j = dj.i and p.s = di.s left join m{k} q on q.i = dj.i and q.j = di.i and q.s = di.s group by di.i, dj.i),
        s{k} as materialized (select n.i, n.j, case when o.done then o.x else n.x end x, o.done or (select max(abs(z.x - y.x)) from n{k} z join s{k - 1} y on y.i = z.i and y.j = z.j) < 1e-6 done
            from n{k} n join s{k - 1} o on o.i = n.i and o.j = n.j)"""
    return f"{out} select i, j, {rnd('x')} as value from s{rounds}"


add("regular_equivalence_trade", "trade", lambda g: equivalence.regular_equivalence(g), regular(60))

# ---------------------------------------------------------------- random graphs and layouts


def _u01(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::bigint / 4294967296.0)"


def add_plain(name: str, function, text: str | None = None) -> None:
    QUERIES[name] = lambda s, d: tidy(function(s, d))
    if text is not None:
        SQL[name] = text


_PAIRS = "(select x.i src, y.i dst, g.g gid from (select unnest(range(1, {n} + 1)) i) x, (select unnest(range(1, {n} + 1)) i) y, (select unnest(range(0, {m})) g) g where x.i {op} y.i)"
add_plain("rgnp", lambda s, d: random_graphs.rgnp(s, 60, 0.1, seed=5).as_edgelist(), f"select src, dst from {_PAIRS.format(n=60, m=1, op='<>')} where {_u01(chr(39) + '5:' + chr(39) + ' || gid || ' + chr(39) + ':' + chr(39) + ' || src || ' + chr(39) + ':' + chr(39) + ' || dst')} < 0.1")
_key = "'{seed}:' || gid || ':' || src || ':' || dst"
add_plain("rgraph_many", lambda s, d: random_graphs.rgraph(s, 12, 20, 0.3, "graph", 7).as_edgelist(), f"select gid, src, dst from {_PAIRS.format(n=12, m=20, op='<')} where {_u01(_key.format(seed=7))} < 0.3")
add_plain("rgnm", lambda s, d: random_graphs.rgnm(s, 40, 100, seed=3, m=5).as_edgelist(), f"select gid, src, dst from (select *, row_number() over (partition by gid order by md5({_key.format(seed=3)}), src, dst) r from {_PAIRS.format(n=40, m=5, op='<>')}) where r <= 100")
_UMAN = f"(select *, row_number() over (partition by gid order by md5({_key.format(seed=11)}), src, dst) r, {_u01(chr(39) + '11:way:' + chr(39) + ' || gid || ' + chr(39) + ':' + chr(39) + ' || src || ' + chr(39) + ':' + chr(39) + ' || dst')} < 0.5 f from {_PAIRS.format(n=25, m=4, op='<')})"
add_plain("rguman", lambda s, d: random_graphs.rguman(s, 25, 30, 40, 11, 4).as_edgelist(), f"with t as {_UMAN} select gid, src, dst from t where r <= 30 or (r <= 70 and f) union all select gid, dst, src from t where r <= 30 or (r <= 70 and not f)")
PERM = ", vv as (select vid, row_number() over (order by vid) o from v), pm as (select rep, x.vid, y.vid nw from (select rep, vid, row_number() over (partition by rep order by md5('{seed}:' || rep || ':' || vid), vid) o from v, (select unnest(range(0, {n})) rep)) x join vv y on y.o = x.o)"
add("permutations_trade", "trade", lambda g: random_graphs.permutations(g.vertices, 20, 9), f"{PERM.format(seed=9, n=20)} select rep, vid, nw as new from pm")
add("layout_circle_trade", "trade", lambda g: layout.layout_circle(g), f", o as (select vid, 2 * pi() * (row_number() over (order by vid) - 1) / (select n from n) t from v) select vid, {rnd('cos(t)')} x, {rnd('sin(t)')} y from o")
add("layout_random_trade", "trade", lambda g: layout.layout_random(g, 4), f" select vid, {rnd('2 * ' + _u01(chr(39) + '4:x:0:' + chr(39) + ' || vid') + ' - 1')} x, {rnd('2 * ' + _u01(chr(39) + '4:y:0:' + chr(39) + ' || vid') + ' - 1')} y from v")
add("layout_fruchterman_reingold_trade", "trade", lambda g: layout.layout_fruchterman_reingold(g))
add("layout_kamada_kawai_trade", "trade", lambda g: layout.layout_kamada_kawai(g))

# ---------------------------------------------------------------- correlation, permutation tests, regression

TRADE125 = ", a2 as (select src, dst from w0 where weight > (select avg(weight) * 1.25 from w0) and src <> dst)"
DY = TRADE125 + """, dd as (select x.vid i, y.vid j, exists (select 1 from a where src = x.vid and dst = y.vid)::int::double y, exists (select 1 from a2 where src = x.vid and dst = y.vid)::int::double x from v x, v y where x.vid <> y.vid)"""


def add_pair(name: str, function, text: str | None = None) -> None:
    add_plain(name, lambda s, d: function(graphs.trade(s, d), graphs.trade(s, d, 1.25)), f"with recursive {sql('trade')}{text}" if text else None)


add_pair("gcor_trade", lambda g, h: dyads.gcor(g, h), f"{DY} select {rnd('corr(y, x)')} gcor from dd")
add_pair("gcov_trade", lambda g, h: dyads.gcov(g, h), f"{DY} select {rnd('covar_samp(y, x)')} gcov from dd")
QUERIES["gcor_two_mode_supply"] = lambda s, d: tidy(dyads.gcor(graphs.supply(s, d), graphs.supply(s, d, 25.0)))
SQL["gcor_two_mode_supply"] = f"""
    with x as (select distinct l_partkey p, l_suppkey s from lineitem), y as (select distinct l_partkey p, l_suppkey s from lineitem where l_quantity >= 25),
    t as (select cast((select count(*) from part) * (select count(*) from supplier) as double) n, cast((select count(*) from x) as double) sx, cast((select count(*) from y) as double) sy)
    select {rnd('(n * sy - sx * sy) / sqrt((n * sx - sx * sx) * (n * sy - sy * sy))')} gcor from t
"""
N_SIM = 50
_sums = "(select count(*) n, sum(x) sx, sum(y) sy, sum(x * x) sxx, sum(y * y) syy, sum(x * y) sxy from dd)"
MOVED = PERM.format(seed=13, n=N_SIM) + ", mv as (select p.rep, p.nw i, q.nw j from a join pm p on p.vid = src join pm q on q.vid = dst and q.rep = p.rep), mx as (select reps.rep, coalesce(c, 0) c from (select unnest(range(0, {n})) rep) reps left join (select rep, count(*) c from mv join a2 on a2.src = i and a2.dst = j group by rep) k on k.rep = reps.rep)".format(n=N_SIM)
add_pair("qaptest_gcor_trade", lambda g, h: dyads.qaptest(g, h, n_sim=N_SIM, seed=13).dist, f"{DY}{MOVED}, s as {_sums} select rep, {rnd('(n * c - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))')} as value from mx, s")
add_pair("qaptest_p_trade", lambda g, h: dyads.qaptest(g, h, n_sim=N_SIM, seed=13).summary().drop("n_sim"), f"{DY}{MOVED}, s as {_sums} select {rnd('max((n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)))')} testval, count(*) filter (c >= sxy) / {N_SIM}.0::double pgreq, count(*) filter (c <= sxy) / {N_SIM}.0::double pleeq from mx, s")
add_pair(
    "netlm_trade",
    lambda g, h: regress.netlm(g, h, nullhyp="classical", dependent="nan").coef_table().select("term", "coef", "se", "tstat"),
    f"""{DY}, s as {_sums}, f as (select n, sx, sxx, (n * sxy - sx * sy) / (n * sxx - sx * sx) b, syy, sy, sxy from s), h as (select *, (sy - b * sx) / n b0 from f),
    k as (select *, (syy - b0 * sy - b * sxy) / (n - 2) v, n * sxx - sx * sx d from h)
    select '(intercept)' term, {rnd("b0")} coef, {rnd("sqrt(v * sxx / d)")} se, {rnd("b0 / sqrt(v * sxx / d)")} tstat from k union all select 'x1', {rnd("b")}, {rnd("sqrt(v * n / d)")}, {rnd("b / sqrt(v * n / d)")} from k""",
)
add_pair(
    "netlm_qapy_trade",
    lambda g, h: regress.netlm(g, h, nullhyp="qapy", n_sim=N_SIM, seed=13, dependent="nan").dist_table(),
    f"""{DY}{MOVED}, s as {_sums}, f as (select rep, n, sx, sxx, syy, sy, c, (n * c - sx * sy) / (n * sxx - sx * sx) b from mx, s), h as (select *, (sy - b * sx) / n b0 from f),
    k as (select *, (syy - b0 * sy - b * c) / (n - 2) v, n * sxx - sx * sx d from h)
    select rep, '(intercept)' term, {rnd("b0 / sqrt(v * sxx / d)")} as value from k union all select rep, 'x1', {rnd("b / sqrt(v * n / d)")} from k""",
)
add_plain("netlm_qapspp_trade", lambda s, d: regress.netlm(graphs.trade(s, d), [graphs.trade(s, d, 1.25), graphs.trade(s, d, 0.75)], nullhyp="qapspp", n_sim=N_SIM, seed=2, dependent="nan").coef_table())
add_plain("netlm_qapx_trade", lambda s, d: regress.netlm(graphs.trade(s, d), [graphs.trade(s, d, 1.25), graphs.trade(s, d, 0.75)], nullhyp="qapx", n_sim=N_SIM, seed=2, dependent="nan").coef_table())
add_plain("netlogit_trade", lambda s, d: regress.netlogit(graphs.trade(s, d), _region(graphs.trade(s, d)), nullhyp="qapy", n_sim=20, seed=2).coef_table())


def _region(g: Net) -> Net:
    """Ties of nations of one region, a predictor that separates nothing."""
    v = g.vertices.select("vid", "cl")
    ties = v.join(v.withColumnRenamed("vid", "dst"), "cl").filter("vid <> dst").select(F.col("vid").alias("src"), "dst")
    return Net.build(ties, g.vertices, True)


SIMS = 30
DRAWN = ", dr as (select gid, src, dst from (select gid, src, dst, {u} u, row_number() over (partition by gid order by md5({key}), src, dst) r from (select x.i src, y.i dst, g.g gid from n, (select unnest(range(1, 26)) i) x, (select unnest(range(1, 26)) i) y, (select unnest(range(0, {m})) g) g where x.i <> y.i)) where {pick})"
TRANS = ", t2 as (select x.gid, count(*) p, count(z.src) r from dr x join dr y on x.gid = y.gid and x.dst = y.src and x.src <> y.dst left join dr z on z.gid = x.gid and z.src = x.src and z.dst = y.dst group by x.gid) select gid rep, {v} as value from t2".format(v=rnd("cast(r as double) / p"))
add("cug_size_gtrans_trade", "trade", lambda g: cug.cug_test(g, census.gtrans, "size", SIMS, 21).dist, DRAWN.format(u=_u01(_key.format(seed=21)), key=_key.format(seed=21), m=SIMS, pick="u < 0.5") + TRANS)
add("cug_edges_gtrans_trade", "trade", lambda g: cug.cug_test(g, census.gtrans, "edges", SIMS, 22).dist, DRAWN.format(u="0", key=_key.format(seed=22), m=SIMS, pick="r <= (select count(*) from a)") + TRANS)
add(
    "cug_dyad_census_gtrans_trade",
    "trade",
    lambda g: cug.cug_test(g, census.gtrans, "dyad_census", SIMS, 23).dist,
    DYADS + f""", rk as (select gid, src, dst, row_number() over (partition by gid order by md5({_key.format(seed=23)}), src, dst) r, {_u01("'23:way:' || gid || ':' || src || ':' || dst")} < 0.5 f
        from (select x.i src, y.i dst, g.g gid from (select unnest(range(1, 26)) i) x, (select unnest(range(1, 26)) i) y, (select unnest(range(0, {SIMS})) g) g where x.i < y.i)),
    dr as (select gid, src, dst from rk, d where r <= m or (r <= m + s and f) union all select gid, dst, src from rk, d where r <= m or (r <= m + s and not f))""" + TRANS,
)
