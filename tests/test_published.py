"""Published networks and hand-made graphs with known results."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from kithgraph import net as net_module
from kithgraph.net import MaskedDyads, Net
from kithgraph.operators import census, cohesion, cug, dyads, equivalence, layout, paths, random_graphs, regress, spectral
from kithgraph.operators.centralization import centralization
from kithgraph.operators.degree import degreecent
from kithgraph.sources.datasets import WEALTH, load_dataset
from kithgraph.sources.files import read_edgelist_csv, read_pajek, read_parquet, write_edgelist_csv, write_graphml, write_pajek, write_parquet


def one(df):
    return df.first()[0]


def scores(df):
    return [r["score"] for r in df.orderBy("vid").collect()]


@pytest.fixture(scope="module")
def flo(spark):
    return load_dataset(spark, "florentine_marriage")


@pytest.fixture(scope="module")
def biz(spark):
    return load_dataset(spark, "florentine_business")


@pytest.fixture(scope="module")
def wealth(spark):
    w = np.array([float(x) for x in WEALTH.split()])
    return Net.from_matrix(spark, abs(np.subtract.outer(w, w)), directed=False, store_values=True)


def test_florentine(flo):
    assert (flo.nv(), flo.ne()) == (16, 20)
    assert abs(one(census.gtrans(flo)) - 9 / 47) < 1e-12
    assert [r["n"] for r in census.triad_census(flo).orderBy("triad").collect()] == [324, 195, 38, 3]
    assert scores(degreecent(flo)) == [1, 3, 2, 3, 3, 1, 4, 1, 6, 1, 3, 0, 3, 2, 4, 3]
    assert scores(spectral.flowbet(flo)) == [0, 20, 19, 17, 22, 0, 38, 0, 68, 0, 11, 0, 14, 13, 18, 11]
    assert [r["vid"] for r in cohesion.cutpoints(flo).orderBy("vid").collect()] == [2, 7, 9, 14]
    assert abs(one(cohesion.efficiency(flo)) - 0.86734693877551017) < 1e-12
    assert abs(one(centralization(flo, "betweenness")) - 0.3834920634920635) < 1e-12
    assert {tuple(r["members"]) for r in cohesion.cliques(flo).collect()} == {(4, 11, 15), (5, 11, 15), (9, 13, 16)}


def test_correlation_and_regression(spark, flo, biz, wealth):
    assert abs(one(dyads.gcor(flo, biz)) - 0.37186787208054728) < 1e-12
    fit = regress.netlm(flo, [biz, wealth], nullhyp="classical")
    assert np.allclose(fit.coef(), [0.0115567909714949, 0.4292240761249415, 0.0026646583369548025], atol=1e-12)
    assert np.allclose(fit.tstat, [0.24696580041546243, 4.612455499396228, 3.0852487650084677], atol=1e-9)
    assert np.allclose(fit.pgreqabs, [0.8053675128184354, 1.0246842090086228e-05, 0.0025385757718844205], atol=1e-12)
    assert abs(fit.r_squared - 0.20311761295477815) < 1e-12 and fit.nobs() == 120 and fit.dof() == 4
    logit = regress.netlogit(flo, [biz, wealth], nullhyp="classical")
    assert np.allclose(logit.coef(), [-3.0417761907135157, 2.4966227608190428, 0.019947577734350925], atol=1e-5)
    assert abs(logit.deviance - 86.96187034914168) < 1e-8 and abs(logit.bic() - 101.32434557748782) < 1e-8
    assert fit.fit_metadata()["objective"] == "least_squares" and logit.estimand() == "network_logit_regression"
    assert "0.429" in str(fit) and fit.confint()[1][0] > 0


def dense_vector(a, directed):
    n = len(a)
    return np.array([a[i, j] for i in range(n) for j in range(n) if (i != j if directed else i > j)])


@pytest.mark.parametrize("null", ["qapy", "qapx", "qapspp"])
def test_permutation_nulls_refit_by_hand(spark, flo, biz, wealth, null):
    n_sim, nets = 4, [flo, biz, wealth]
    fit = regress.netlm(flo, [biz, wealth], nullhyp=null, n_sim=n_sim, seed=5)
    mats = [g.as_matrix("weight" if g.valued else None, diag=False) for g in nets]
    x = np.stack([np.ones(120), *(dense_vector(m, False) for m in mats[1:])], axis=1)
    y = dense_vector(mats[0], False)

    def t_values(x, y):
        b = np.linalg.lstsq(x, y, rcond=None)[0]
        e = y - x @ b
        return b / np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (e @ e) / (len(y) - x.shape[1]))

    def moved(m, seed, rep):
        new = {r["vid"]: r["new"] for r in random_graphs.permutations(flo.vertices, n_sim, seed).filter(F.col("rep") == rep).collect()}
        out = np.zeros_like(m)
        for i in range(16):
            for j in range(16):
                out[new[i + 1] - 1, new[j + 1] - 1] = m[i, j]
        return out

    for rep in (0, 3):
        if null == "qapy":
            expect = t_values(x, dense_vector(moved(mats[0], 5, rep), False))
        else:
            expect = []
            for i in range(3):
                xp = x.copy()
                if null == "qapx":
                    if i:
                        xp[:, i] = dense_vector(moved(mats[i], 5 + i, rep), False)
                    expect.append(t_values(xp, y)[i])
                else:
                    others = [j for j in range(3) if j != i]
                    e = x[:, i] - x[:, others] @ np.linalg.lstsq(x[:, others], x[:, i], rcond=None)[0]
                    m = np.zeros((16, 16))
                    m[[(a, b) for a in range(16) for b in range(16) if a > b][0]] = 0
                    for v, (a, b) in zip(e, [(a, b) for a in range(16) for b in range(16) if a > b], strict=True):
                        m[a, b] = m[b, a] = v
                    xp = np.concatenate([x[:, others], dense_vector(moved(m, 5 + i, rep), False)[:, None]], axis=1)
                    expect.append(t_values(xp, y)[-1])
        assert np.allclose(fit.dist[rep], expect, atol=1e-8)


def test_logit_permutations(flo, biz):
    fit = regress.netlogit(flo, biz, n_sim=40, seed=3)
    assert fit.dist.shape == (40, 2) and np.isfinite(fit.dist).all() and fit.pgreqabs[1] < 0.1
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        wald = regress.netlogit(flo, biz, statistic="wald", n_sim=60, seed=3)
    assert np.isnan(wald.pgreqabs[1]) and any("separated" in str(w.message) for w in said)
    assert any("withheld" in a for a in wald.approximations())


@pytest.mark.parametrize(
    ("x", "y", "separated", "certified", "units"),
    [([-1, -1e-16, 1e-16, 1], [0, 1, 0, 1], True, False, (0, 3)), ([-1, -1e-16, 1e-16, 1], [0, 0, 1, 1], True, True, (0, 3)), ([-1, 0, 0, 1], [0, 1, 0, 1], True, True, (0, 3)), ([-1, -1, 1, 1], [0, 1, 0, 1], False, True, ())],
)
def test_separation(x, y, separated, certified, units):
    got = regress.separation(np.stack([np.ones(4), np.array(x, float)], axis=1), np.array(y, float))
    assert (got.separated, got.certified, got.units) == (separated, certified, units)
    assert got.terms == ((1,) if separated else ())


def test_separated_design_withholds_inference(spark):
    y = Net.of(spark, 4, [(1, 2), (2, 1), (3, 4), (4, 3)])
    x = Net.of(spark, 4, [(1, 2)])
    with pytest.warns(UserWarning, match="separated"):
        fit = regress.netlogit(y, x)
    assert not fit.converged and fit.separated == ["x1"] and np.isnan(fit.pgreqabs).all() and fit.dist is None


def test_qaptest_agrees_with_dense_statistic(flo, biz):
    fast = dyads.qaptest(flo, biz, n_sim=20, seed=2)

    def statistic(a, b):
        below = np.tril_indices(len(a), -1)
        return np.corrcoef(a[below], b[below])[0, 1]

    slow = dyads.qaptest(flo, biz, statistic, n_sim=20, seed=2)
    x, y = ([r["value"] for r in t.dist.orderBy("rep").collect()] for t in (fast, slow))
    assert np.allclose(x, y) and abs(fast.testval - slow.testval) < 1e-12 and "<0.05" in str(fast)


def test_two_mode(spark):
    net = Net.of(spark, 5, [(1, 3), (1, 4), (2, 5)], directed=False, mode1=2)
    assert abs(one(census.gden(net)) - 0.3) < 1e-12 and one(census.gden(net, discount_bipartite=True)) == 0.5
    directed = Net.of(spark, 5, [(1, 3), (1, 4), (2, 5), (3, 2)], mode1=2)
    assert abs(one(census.gden(directed, discount_bipartite=True)) - 4 / 12) < 1e-12
    rng = np.random.default_rng(1)
    b, x = (rng.random((8, 12)) < 0.4).astype(float), rng.normal(size=(8, 12))
    y_net, x_net = Net.from_incidence(spark, b), Net.from_incidence(spark, x)
    assert abs(one(dyads.gcor(y_net, x_net)) - np.corrcoef(b.ravel(), x.ravel())[0, 1]) < 1e-9
    fit = regress.netlm(y_net, x_net, nullhyp="classical")
    assert fit.nobs() == 96 and np.allclose(fit.coef(), np.polyfit(x.ravel(), b.ravel(), 1)[::-1])
    test = dyads.qaptest(y_net, x_net, lambda p, q: float((p * q).sum()), n_sim=5)
    assert abs(test.testval - (b * x).sum()) < 1e-9
    with pytest.raises(ValueError):
        cug.cug_test(net, census.gtrans)


def test_empty_and_single(spark):
    net = Net.empty(spark, 3)
    assert one(census.gtrans(net)) == 1.0 and math.isnan(one(census.grecip(net, "edgewise"))) and math.isnan(one(census.grecip(net, "dyadic_nonnull")))
    assert one(cohesion.connectedness(Net.empty(spark, 1))) == 1.0 and math.isnan(one(cohesion.efficiency(net)))
    assert one(paths.average_path_length(net)) == math.inf and one(paths.diameter(net)) == math.inf
    assert scores(spectral.bonpow(net))[0] != scores(spectral.bonpow(net))[0]


def test_valued_and_loops(spark):
    a = np.array([[0, 2, 1], [1, 0, 3], [4, 2, 0.0]])
    net = Net.from_matrix(spark, a, store_values=True)
    assert scores(degreecent(net, ignore_eval=False)) == [8, 8, 10]
    assert scores(spectral.flowbet(net, ignore_eval=False)) == [3, 3, 4]
    looped = Net.of(spark, 4, [(1, 1), (1, 2), (2, 3), (3, 4)], loops=True)
    assert scores(degreecent(looped)) == [1, 2, 2, 1] and scores(degreecent(looped, diag=True)) == [2, 2, 2, 1]
    assert one(census.gden(looped)) == 0.25 and one(census.gden(looped, diag=True)) == 0.25
    with pytest.raises(ValueError):
        spectral.flowbet(Net.from_matrix(spark, -a, store_values=True), ignore_eval=False)


def test_cycle(spark):
    net = Net.of(spark, 4, [(1, 2), (2, 3), (3, 1)])
    assert [r["vid"] for r in cohesion.cutpoints(net).orderBy("vid").collect()] == [1, 2, 3]
    assert scores(paths.closeness(net)) == [0, 0, 0, 0] and cohesion.cliques(net).isEmpty()
    assert sorted(r["vid"] for r in cohesion.largest_component(net).collect()) == [1, 2, 3]


def test_matching_is_well_conditioned(spark):
    net = Net.of(spark, 200, [(v, v + 1) for v in range(1, 200, 2)], directed=False)
    assert np.allclose(scores(spectral.bonpow(net, 0.5)), 1)


MEASURES = [
    degreecent, paths.betweenness, paths.closeness, spectral.evcent, spectral.bonpow, spectral.infocent, spectral.flowbet, census.gden, census.grecip, census.gtrans, census.transitivity, census.dyad_census,
    census.triad_census, paths.hierarchy, cohesion.efficiency, cohesion.connectedness, census.mutuality, paths.reachability, cohesion.component_dist, cohesion.largest_component, cohesion.cliques, cohesion.kcores,
    cohesion.cutpoints, cohesion.bicomponents, paths.geodist, paths.average_path_length, equivalence.sedist, equivalence.regular_equivalence, equivalence.equiv_clust, centralization,
]


@pytest.mark.parametrize("measure", MEASURES, ids=lambda f: f.__name__)
def test_masked_dyads_are_refused(spark, measure):
    net = Net.of(spark, 6, [(1, 2), (2, 3), (3, 1), (1, 3), (2, 6), (3, 4), (5, 6)])
    masked = net.set_missing_dyads([(1, 2), (4, 5)])
    with pytest.raises(MaskedDyads, match=f"{measure.__name__}.*unobserved.*missing='face'"):
        measure(masked)
    with pytest.raises(ValueError, match="missing must be one of"):
        measure(masked, missing="faec")
    assert sorted(map(str, measure(masked, missing="face").collect())) == sorted(map(str, measure(net).collect()))


def test_mask_and_changes(spark):
    net = Net.of(spark, 4, [(1, 2), (3, 2)], directed=False)
    masked = net.set_missing_dyads([(2, 1), (3, 4)])
    assert masked.n_missing_dyads() == 2 and masked.is_missing_dyad(1, 2) and masked.is_missing_dyad(4, 3)
    assert masked.delete_missing_dyads([(1, 2)]).n_missing_dyads() == 1 and masked.clear_missing_dyads().n_missing_dyads() == 0
    more = net.with_edges(spark.createDataFrame([(4, 3), (2, 1)], "src long, dst long"))
    assert more.ne() == 3 and more.has_edge(3, 4) and more.has_edge(4, 3)
    assert more.without_edges(spark.createDataFrame([(4, 3)], "src long, dst long")).ne() == 2
    assert more.without_vertices(spark.createDataFrame([(3,)], "vid long")).ne() == 1
    assert net.with_vertices(spark.createDataFrame([(9,)], "vid long")).nv() == 5
    named = net.set_vertex_attribute("k", F.col("vid") * 2).set_network_attribute("a", 1).set_edge_attribute("z", F.lit(3))
    assert named.list_vertex_attributes() == ["k"] and named.get_network_attribute("a") == 1 and named.list_edge_attributes() == ["weight", "z"]
    assert named.delete_vertex_attribute("k").list_vertex_attributes() == [] and named.delete_network_attribute("a").list_network_attributes() == []
    assert [r["degree"] for r in net.degree().orderBy("vid").collect()] == [1, 2, 1, 0]


def test_files(spark, flo, tmp_path):
    write_parquet(flo.set_missing_dyads([(1, 2)]).set_network_attribute("name", "x"), f"file://{tmp_path}/net")
    back = read_parquet(spark, f"file://{tmp_path}/net")
    assert back.ne() == 20 and not back.directed and back.n_missing_dyads() == 1 and back.attributes == {"name": "x"}
    write_pajek(flo, f"file://{tmp_path}/pajek")
    net = read_pajek(spark, f"file://{tmp_path}/pajek")
    assert not net.directed and sorted(net.as_edgelist().collect()) == sorted(flo.as_edgelist().collect())
    write_edgelist_csv(flo, f"file://{tmp_path}/csv")
    assert read_edgelist_csv(spark, f"file://{tmp_path}/csv", directed=False, n=16).ne() == 20
    write_graphml(flo, f"file://{tmp_path}/graphml")
    text = "\n".join(r["value"] for r in spark.read.text(f"file://{tmp_path}/graphml").collect())
    import xml.etree.ElementTree as tree

    root = tree.fromstring("".join(p.read_text() for p in (tmp_path / "graphml").glob("part-*")).strip())
    assert text.count("<edge ") == 20 and len(root[-1]) == 36


def test_random_graphs(spark):
    net = random_graphs.rgnp(spark, 30, 0.2, seed=1, m=20)
    each = [r["count"] for r in net.edges.groupBy("gid").count().collect()]
    assert abs(np.mean(each) - 0.2 * 30 * 29) < 15 and net.nv() == 600
    assert random_graphs.rgnm(spark, 10, 17, directed=False, seed=2).ne() == 17
    drawn = random_graphs.rguman(spark, 12, 9, 14, 3, 5)
    assert {(r["mutual"], r["asym"]) for r in census.dyad_census(drawn).collect()} == {(9, 14)}
    again = random_graphs.rgnp(spark, 30, 0.2, seed=1, m=20)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert again.edges.exceptAll(net.edges.repartition(7)).isEmpty()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for bad in (lambda: random_graphs.rgnp(spark, 5, 1.5), lambda: random_graphs.rgnm(spark, 3, 9), lambda: random_graphs.rguman(spark, 3, 4, 0)):
        with pytest.raises(ValueError):
            bad()


def test_cug(flo):
    edges = cug.cug_test(flo, census.gtrans, "edges", 60, 1)
    assert abs(edges.obs - 9 / 47) < 1e-12 and edges.dist.count() == 60 and 0 < edges.pgreq < 1
    given = cug.cug_test(load_dataset(flo.spark, "sampson_liking"), census.grecip, "dyad_census", 20, 1)
    assert given.pgreq == given.pleeq == 1.0


def test_layouts(spark):
    path = Net.of(spark, 4, [(1, 2), (2, 3), (3, 4)], directed=False)
    p = np.array([[r["x"], r["y"]] for r in layout.layout_kamada_kawai(path).orderBy("vid").collect()])
    assert np.allclose(np.linalg.norm(np.diff(p, axis=0), axis=1), 1, atol=1e-3)
    circle = [(r["x"], r["y"]) for r in layout.layout_circle(path).orderBy("vid").collect()]
    assert np.allclose(circle, [(1, 0), (0, 1), (-1, 0), (0, -1)], atol=1e-12)
    assert layout.layout_fruchterman_reingold(path, 20).count() == 4
    assert all(-1 <= r["x"] < 1 for r in layout.layout_random(path).collect())


def test_positions(spark):
    got = equivalence.consensus_clustering([[1, 1, 2, 2, 3], [1, 1, 1, 2, 3], [2, 2, 1, 1, 3]], spark=spark)
    assert [r["membership"] for r in got.orderBy("vid").collect()] == [1, 1, 2, 2, 3]
    triangle = Net.of(spark, 4, [(1, 2), (2, 3), (1, 3)], directed=False)
    member, density = equivalence.blockmodel(triangle, 2)
    assert [r["membership"] for r in member.orderBy("vid").collect()] == [1, 1, 1, 2]
    cells = {(r["block_i"], r["block_j"]): r["density"] for r in density.collect()}
    assert cells[1, 1] == 1.0 and cells[1, 2] == 0.0 and math.isnan(cells[2, 2])
    sim = {(r["i"], r["j"]): r["value"] for r in equivalence.regular_equivalence(triangle).collect()}
    assert sim[1, 2] == 1.0 and sim[1, 4] == 0.0
    for bad in (lambda: equivalence.consensus_clustering([], spark=spark), lambda: equivalence.consensus_clustering([[1]], 0, spark), lambda: equivalence.consensus_clustering([[1], [1, 2]], spark=spark)):
        with pytest.raises(ValueError):
            bad()


def test_options_are_checked(spark, flo):
    for bad in (lambda: degreecent(flo, "x"), lambda: paths.betweenness(flo, "x"), lambda: census.grecip(flo, "x"), lambda: cohesion.kcores(flo, k=2), lambda: cohesion.bicomponents(flo, min_size=1), lambda: Net.from_matrix(spark, [[1, 2]]), lambda: Net.from_matrix(spark, [[math.inf]]), lambda: degreecent(flo, rescale=True, normalized=True)):
        with pytest.raises(ValueError):
            bad()
    assert net_module.missing_policies() == ("error", "face") and not net_module.supports_missing(degreecent)


def test_power_iteration_beyond_dense(flo, monkeypatch):
    dense = scores(spectral.evcent(flo.induced(flo.vertices.filter("vid <> 12"))))
    monkeypatch.setattr("kithgraph.net.DENSE_VERTICES", 5)
    sparse = scores(spectral.evcent(flo.induced(flo.vertices.filter("vid <> 12")), tol=1e-8))
    assert np.allclose(dense, sparse, atol=1e-5)
