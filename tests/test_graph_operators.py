"""Operators on a corpus of random graphs, all as one net, against plain versions."""

import math

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from kithgraph.net import Net
from kithgraph.operators import brokerage, census, cohesion, equivalence, paths, spectral
from kithgraph.operators.centralization import centralization
from kithgraph.operators.degree import degreecent


@pytest.fixture(scope="module", params=[True, False], ids=["directed", "undirected"])
def corpus(request, spark):
    rng, graphs = np.random.default_rng(7), {}
    for g in range(12):
        n = int(rng.integers(1, 10))
        graphs[g] = brute.random_graph(rng, n, rng.choice([0.0, 0.15, 0.3, 0.6, 1.0]), request.param, loops=g % 3 == 0)
    ties = [(g, int(i) + 1, int(j) + 1) for g, a in graphs.items() for i, j in zip(*np.nonzero(a), strict=True)]
    vertices = [(g, v + 1, v % 3) for g, a in graphs.items() for v in range(len(a))]
    net = Net.build(spark.createDataFrame(ties, "gid long, src long, dst long"), spark.createDataFrame(vertices, "gid long, vid long, cl long"), request.param, True, many=True)
    return net, {g: a - np.diag(np.diag(a)) for g, a in graphs.items()}, graphs


def values(df, key=("vid",)):
    out = {}
    for r in df.collect():
        out.setdefault(r["gid"], {})[tuple(r[k] for k in key)] = r
    return out


def same(x, y):
    return (math.isnan(x) and math.isnan(y)) or x == y or abs(x - y) < 1e-9


def test_degree(corpus):
    net, graphs, loops = corpus
    both = values(degreecent(net))
    into = values(degreecent(net, "indegree"))
    diag = values(degreecent(net, diag=True))
    for g, a in graphs.items():
        for v in range(len(a)):
            total = a[v].sum() + a[:, v].sum() if net.directed else a[v].sum()
            assert both[g][v + 1,]["score"] == total
            assert into[g][v + 1,]["score"] == a[:, v].sum()
            assert diag[g][v + 1,]["score"] == total + loops[g][v, v]


def test_dyads_and_triads(corpus):
    net, graphs, _ = corpus
    dyads, triads = values(census.dyad_census(net), ()), values(census.triad_census(net), ("triad",))
    for g, a in graphs.items():
        n = len(a)
        mutual = int((a * a.T).sum() // 2)
        asym = int((a + a.T > 0).sum() // 2) - mutual
        r = dyads[g][()]
        assert (r["mutual"], r["asym"], r["n_null"]) == (mutual, asym, n * (n - 1) // 2 - mutual - asym)
        found = {}
        for (name,), row in triads[g].items():
            key = tuple(map(int, name[:3])) if net.directed else (int(name), 0, 3 - int(name))
            found[key] = found.get(key, 0) + row["n"]
        assert {k: c for k, c in found.items() if c} == brute.triad_counts(a)


def test_transitivity(corpus):
    net, graphs, _ = corpus
    weak, count = values(census.gtrans(net), ()), values(census.gtrans(net, "weakcensus"), ())
    corr = values(census.gtrans(net, "correlation"), ())
    for g, a in graphs.items():
        share, closed = brute.transitivity(a)
        assert same(weak[g][()]["transitivity"], share)
        assert count[g][()]["transitivity"] == closed
        off = ~np.eye(len(a), dtype=bool)
        x, y = a[off], (a @ a)[off]
        if len(x) > 1 and x.std() > 0 and y.std() > 0:
            assert abs(corr[g][()]["transitivity"] - np.corrcoef(x, y)[0, 1]) < 1e-9


def test_paths(corpus):
    net, graphs, _ = corpus
    dist, between = values(paths.geodist(net), ("i", "j")), values(paths.betweenness(net))
    close, gil = values(paths.closeness(net, "suminvdir")), values(paths.closeness(net, "gil_schmidt"))
    for g, a in graphs.items():
        n = len(a)
        d, c = brute.bfs(a)
        for i in range(n):
            for j in range(n):
                r = dist[g][i + 1, j + 1]
                assert r["gdist"] == d[i, j] and r["counts"] == c[i, j]
            inv = [1 / d[i, j] for j in range(n) if j != i and d[i, j] < math.inf]
            assert same(close[g][i + 1,]["score"], sum(inv) / (n - 1) if n > 1 else math.nan)
            assert same(gil[g][i + 1,]["score"], sum(inv) / len(inv) if inv else 0.0)
        b = brute.betweenness(a) / (1 if net.directed else 2)
        for v in range(n):
            assert abs(between[g][v + 1,]["score"] - b[v]) < 1e-9


def test_paths_by_joins(corpus, monkeypatch):
    net, graphs, _ = corpus
    keep = sorted(graphs)[3:6]
    few = net.replace(vertices=net.vertices.filter(F.col("gid").isin(keep)), edges=net.edges.filter(F.col("gid").isin(keep)))
    plain = [few_result(f, few) for f in (paths.geodist, paths.betweenness, cohesion.kcores, cohesion.component_dist)]
    monkeypatch.setattr("kithgraph.net.SMALL_TIES", 0)
    monkeypatch.setattr("kithgraph.net.DENSE_VERTICES", 10_000)
    assert [few_result(f, few) for f in (paths.geodist, paths.betweenness, cohesion.kcores, cohesion.component_dist)] == plain


def few_result(f, net):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f(net).collect())


def test_components(corpus):
    net, graphs, _ = corpus
    for connected, plain in (("strong", brute.strong), ("weak", brute.weak), ("recursive", lambda a: brute.weak(a * a.T))):
        got = values(cohesion.component_dist(net, connected))
        for g, a in graphs.items():
            low = plain(a)
            names = {c: k + 1 for k, c in enumerate(sorted(set(low)))}
            for v, c in enumerate(low):
                r = got[g][v + 1,]
                assert (r["membership"], r["csize"]) == (names[c], low.count(c))
    with pytest.raises(ValueError):
        cohesion.component_dist(net, "unilateral")


def test_cores_and_cutpoints(corpus):
    net, graphs, _ = corpus
    core, cut = values(cohesion.kcores(net)), values(cohesion.cutpoints(net, "weak"))
    for g, a in graphs.items():
        expect = brute.cores(a if net.directed else a / 2)
        assert [core[g][v + 1,]["core"] for v in range(len(a))] == expect
        und = ((a + a.T) > 0).astype(float)
        base = len(set(brute.weak(und)))
        for v in range(len(a)):
            keep = [u for u in range(len(a)) if u != v]
            more = len(set(brute.weak(und[np.ix_(keep, keep)]))) > base
            assert ((v + 1,) in cut.get(g, {})) == more


def test_cliques_and_bicomponents(corpus):
    net, graphs, _ = corpus
    got = {}
    for r in cohesion.cliques(net, 1, "weak").collect():
        got.setdefault(r["gid"], set()).add(frozenset(r["members"]))
    for g, a in graphs.items():
        n, und = len(a), (a + a.T) > 0
        whole = [frozenset(v + 1 for v in range(n) if m >> v & 1) for m in range(1, 1 << n) if all(und[i, j] for i in range(n) for j in range(i) if m >> i & 1 and m >> j & 1)]
        assert got[g] == {c for c in whole if not any(c < d for d in whole)}
    edges = {}
    for r in cohesion.bicomponents(net, "weak", 2).collect():
        edges.setdefault(r["gid"], []).append((r["src"], r["dst"]))
    for g, a in graphs.items():
        und = np.triu((a + a.T) > 0, 1)
        assert sorted(edges.get(g, [])) == sorted((int(i) + 1, int(j) + 1) for i, j in zip(*np.nonzero(und), strict=True))


def test_brokerage(corpus):
    net, graphs, _ = corpus
    got = values(brokerage.brokerage(net, "cl"), ("vid", "role"))
    whole = values(brokerage.brokerage_global(net, "cl"), ("role",))
    for g, a in graphs.items():
        expect = brute.open_paths(a, [v % 3 for v in range(len(a))])
        for k, role in enumerate(brokerage.ROLES):
            assert [got[g][v + 1, role]["raw"] for v in range(len(a))] == expect[:, k].tolist()
            assert whole[g][role,]["raw"] == expect[:, k].sum()


def test_brokerage_expectations_by_simulation():
    """The moments of a graph of given density, against draws of it."""
    rng, cl, p = np.random.default_rng(5), np.array([0, 0, 0, 1, 1, 2]), 0.35
    draws = []
    for _ in range(4000):
        a = brute.random_graph(rng, 6, p, True)
        b = 1 - a
        np.fill_diagonal(b, 0)
        draws.append(sum(a[i, 0] * a[0, k] * b[i, k] for i in range(1, 6) for k in range(1, 6) if i != k))
    mean, var = brokerage.class_moments(np.array([3.0, 2.0, 1.0]), p)
    assert abs(np.mean(draws) - mean[0, 5]) < 0.1
    assert var[0, 5] > 0 and cl.size == 6


def test_structural_equivalence(corpus):
    net, graphs, _ = corpus
    found = {m: values(equivalence.sedist(net, m), ("i", "j")) for m in equivalence.METHODS}
    for g, a in graphs.items():
        for i in range(len(a)):
            for j in range(len(a)):
                x, y = brute.profile(a, i, j)
                get = {m: found[m][g][i + 1, j + 1]["value"] for m in found}
                assert same(get["hamming"], abs(x - y).sum()) and same(get["euclidean"], math.sqrt(((x - y) ** 2).sum()))
                assert get["exact"] == float((x != y).any())
                assert same(get["gamma"], (2 * (x == y).sum() - len(x)) / len(x) if len(x) else math.nan)
                assert same(get["correlation"], np.corrcoef(x, y)[0, 1] if len(x) > 1 and x.std() > 0 and y.std() > 0 else 0.0)


def test_spectral(corpus):
    net, graphs, _ = corpus
    eig, power, flow = values(spectral.evcent(net)), values(spectral.bonpow(net, 0.1)), values(spectral.flowbet(net))
    for g, a in graphs.items():
        n = len(a)
        x = np.array([eig[g][v + 1,]["score"] for v in range(n)])
        if not np.isnan(x).any():
            top = max(np.linalg.eigvals(a).real)
            assert abs(np.linalg.norm(x) - 1) < 1e-9 and (not net.directed or True)
            if not net.directed:
                assert np.abs(a @ x - top * x).max() < 1e-6
        c = np.array([power[g][v + 1,]["score"] for v in range(n)])
        if a.any():
            raw = np.linalg.solve(np.eye(n) - 0.1 * a, a.sum(axis=1))
            assert np.abs(c - raw * math.sqrt(n / (raw**2).sum())).max() < 1e-9
        else:
            assert np.isnan(c).all()
        f = np.zeros(n)
        for s in range(n):
            for t in range(n) if net.directed else range(s + 1, n):
                base = brute.flow(a, s, t) if s != t else 0
                for v in range(n):
                    if base and v not in (s, t):
                        keep = a.copy()
                        keep[v] = keep[:, v] = 0
                        f[v] += base - brute.flow(keep, s, t)
        assert [flow[g][v + 1,]["score"] for v in range(n)] == f.tolist()


def test_centralization_and_cohesion_indices(corpus):
    net, graphs, _ = corpus
    raw, conn = values(centralization(net, normalized=False), ()), values(cohesion.connectedness(net), ())
    for g, a in graphs.items():
        d = a.sum(axis=0) + a.sum(axis=1) if net.directed else a.sum(axis=0)
        assert raw[g][()]["centralization"] == (d.max() - d).sum()
        low, n = brute.weak(a), len(a)
        pairs = sum(low[i] == low[j] for i in range(n) for j in range(i))
        assert same(conn[g][()]["connectedness"], pairs / (n * (n - 1) / 2) if n > 1 else 1.0)
    with pytest.raises(ValueError):
        centralization(net, lambda n: degreecent(n))


def test_cores_of_a_sparse_graph_beyond_dense(spark):
    ring = [(v, v % 3500 + 1) for v in range(1, 3501)]
    net = Net.of(spark, 3600, [*ring, *[(i, j) for i in (10, 20, 30, 40) for j in (10, 20, 30, 40) if i < j], (5, 3550)], directed=False)
    got = {r["vid"]: r["core"] for r in cohesion.kcores(net).collect()}
    assert got == {v: 0 if v > 3500 and v != 3550 else 1 if v == 3550 else 3 if v in (10, 20, 30, 40) else 2 for v in range(1, 3601)}


def test_cutpoints_bicomponents_and_cliques_beyond_dense(spark):
    # a path of triangles: (1, 2, 3), (3, 4, 5), ...
    ties = [(v + i, v + j) for v in range(1, 4000, 2) for i, j in ((0, 1), (1, 2), (0, 2))]
    net = Net.of(spark, 4010, ties, directed=False)
    middle = list(range(3, 4000, 2))
    assert sorted(r["vid"] for r in cohesion.cutpoints(net, "weak").collect()) == middle
    blocks = cohesion.bicomponents(net).collect()
    assert sorted((r["bicomponent"], r["src"], r["dst"]) for r in blocks) == sorted(((u + 1) // 2 if u % 2 else u // 2, u, v) for u, v in ties)
    got = {r["clique"]: r["members"] for r in cohesion.cliques(net, 1).collect()}
    assert got == {k + 1: [2 * k + 1, 2 * k + 2, 2 * k + 3] if k < 2000 else [k + 2002] for k in range(2009)}
    rings = Net.of(spark, 4010, [t for v in range(1, 4000, 2) for t in ((v, v + 1), (v + 1, v + 2), (v + 2, v))])
    assert sorted(r["vid"] for r in cohesion.cutpoints(rings).collect()) == list(range(1, 4002))


def test_strong_cutpoints_are_those_that_split():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 9))
        a = brute.random_graph(rng, n, rng.choice([0.15, 0.25, 0.4, 0.6]), True)
        parts = len(set(brute.strong(a)))
        split = {v for v in range(n) if len(set(brute.strong(np.delete(np.delete(a, v, 0), v, 1)))) > parts}
        assert cohesion.strong_cutpoints(n, *np.nonzero(a)) == split


def test_evcent_beyond_dense(spark, monkeypatch):
    chain = Net.of(spark, 3500, [(v, v + 1) for v in range(1, 3500)])
    assert all(math.isnan(r["score"]) for r in spectral.evcent(chain).collect())
    path = Net.of(spark, 3501, [(v, v + 1) for v in range(1, 3500)], directed=False)
    got = {r["vid"]: r["score"] for r in spectral.evcent(path).collect()}
    true = np.sin(np.pi * np.arange(1, 3501) / 3501) * math.sqrt(2 / 3501)
    assert np.allclose([got[v] for v in range(1, 3501)], true, atol=1e-9) and got[3501] == 0
    monkeypatch.setattr("kithgraph.net.DENSE_VERTICES", 3)
    monkeypatch.setattr("kithgraph.net.SMALL_TIES", 0)
    short = Net.of(spark, 4, [(1, 2), (2, 3), (3, 4)])
    assert all(math.isnan(r["score"]) for r in spectral.evcent(short).collect())
    whole = Net.of(spark, 4, [(1, 2), (2, 3), (1, 3)], directed=False)
    assert np.allclose(sorted(r["score"] for r in spectral.evcent(whole, tol=1e-2).collect()), [0] + [3**-0.5] * 3, atol=1e-2)
    with pytest.raises(RuntimeError):
        spectral._power_iteration(path, path.arcs(), 1e-10, most=2)


def test_geodist_sends_no_pairs_to_the_driver(spark, monkeypatch):
    net = Net.of(spark, 4, [(1, 2), (2, 3), (1, 4), (4, 3)])
    expect = [(1, 1, 0, 1), (1, 2, 1, 1), (1, 3, 2, 2), (1, 4, 1, 1), (2, 1, -1, 0), (2, 2, 0, 1), (2, 3, 1, 1), (2, 4, -1, 0), (3, 1, -1, 0), (3, 2, -1, 0), (3, 3, 0, 1), (3, 4, -1, 0), (4, 1, -1, 0), (4, 2, -1, 0), (4, 3, 1, 1), (4, 4, 0, 1)]
    got = paths.geodist(net, -1.0)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == expect
    monkeypatch.setattr("kithgraph.net.SMALL_TIES", 0)
    got = paths.geodist(net, -1.0)
    assert got._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 1  # the vertices alone
    assert sorted(map(tuple, got.collect())) == expect


def test_many_searches_at_once():
    rng = np.random.default_rng(8)
    for n in (1, 5, 40, 150):
        for p in (0.01, 0.05, 0.5):
            a = brute.random_graph(rng, n, p, True)
            adj = paths.Adjacency(np.zeros(n, np.int64), np.arange(n), np.zeros(int(a.sum()), np.int64), *np.nonzero(a))
            adj.backward()
            got = np.full((n, n), math.inf)
            np.fill_diagonal(got, 0)

            def level(step, rows, new, got=got):
                j, i = np.nonzero(np.unpackbits(new.view(np.uint8), axis=1, bitorder="little"))
                got[i, rows[j]] = step

            adj.search_many(np.arange(n), 0, n, level)
            assert (got == brute.bfs(a)[0]).all()


@pytest.mark.parametrize("directed", [True, False])
def test_hierarchy_lists_no_pairs(spark, monkeypatch, directed):
    monkeypatch.setattr(paths, "distances", None)
    rng = np.random.default_rng(9)
    graphs = {g: brute.random_graph(rng, n, 1.3 / n, directed) for g, n in enumerate((2, 9, 30, 140))}
    ties = [(g, int(i), int(j)) for g, a in graphs.items() for i, j in zip(*np.nonzero(a), strict=True)]
    net = Net.build(spark.createDataFrame(ties, "gid long, src long, dst long"), spark.createDataFrame([(g, v) for g, a in graphs.items() for v in range(len(a))], "gid long, vid long"), directed, many=True)
    got = {r["gid"]: r["hierarchy"] for r in paths.hierarchy(net, "krackhardt").collect()}
    for g, a in graphs.items():
        r = np.isfinite(brute.bfs(a)[0])
        one, any_ = int((r != r.T).sum()) // 2, int(np.triu(r | r.T, 1).sum())
        assert same(got[g], one / any_ if any_ else math.nan)


def test_reachability_takes_little_room(spark, tmp_path):
    net = Net.of(spark, 1510, [(v, v % 1500 + 1) for v in range(1, 1501)])
    got = paths.reachability(net)
    got.write.parquet(str(tmp_path / "pairs"))
    again = spark.read.parquet(str(tmp_path / "pairs"))
    assert again.count() == again.distinct().count() == 1500 * 1500 + 10
    assert again.filter("i > 1500 and i <> j or j > 1500 and i <> j").isEmpty()
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * 1500 * 1500


def test_mean_distance_and_diameter_list_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(paths, "distances", None)
    ring = Net.of(spark, 200, [(v, v % 200 + 1) for v in range(1, 201)])
    assert paths.average_path_length(ring).first()[0] == 100
    assert paths.diameter(ring).first()[0] == 199
    assert paths.average_path_length(Net.of(spark, 3, [])).first()[0] == math.inf
    assert paths.diameter(Net.of(spark, 3, [(1, 2)])).first()[0] == math.inf


def test_betweenness_of_folded_sources():
    rng = np.random.default_rng(10)
    for k in range(200):
        n = int(rng.integers(1, 11))
        a = brute.random_graph(rng, n, rng.choice([0.05, 0.1, 0.2, 0.4]), k % 3 > 0)
        adj = paths.Adjacency(np.zeros(n, np.int64), np.arange(n), np.zeros(int(a.sum()), np.int64), *np.nonzero(a))
        adj.fold()
        total = np.zeros(n)
        for root in adj.roots:
            adj.depend(int(root), 0, n, total)
        assert np.allclose(total, brute.betweenness(a))


def test_cores_of_many_ties_take_one_task(spark, monkeypatch):
    monkeypatch.setattr("kithgraph.net.SMALL_TIES", 50)
    monkeypatch.setattr(cohesion, "stored", None)  # no rounds of joins
    rng = np.random.default_rng(11)
    for directed, cmode in ((True, "freeman"), (True, "indegree"), (True, "outdegree"), (False, "freeman")):
        a = brute.random_graph(rng, 60, 0.08, directed)
        net = Net.of(spark, 60, [(i + 1, j + 1) for i, j in zip(*np.nonzero(a), strict=True)], directed)
        near = a + a.T if directed and cmode == "freeman" else a.T if cmode == "indegree" else a
        core, left, level = {}, set(range(60)), 0
        while left:
            degree = {v: near[v, list(left)].sum() for v in left}
            v = min(left, key=degree.get)
            core[v + 1] = level = max(level, degree[v])
            left.remove(v)
        assert {r["vid"]: r["core"] for r in cohesion.kcores(net, cmode).collect()} == core
