"""Structural and regular equivalence, positional clustering, blockmodels and consensus of partitions."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import nan_div
from ..functions.tables import components
from ..net import Net, check_option, observed, per_graph
from .paths import first_rank

METHODS = ("hamming", "correlation", "euclidean", "gamma", "exact")


@observed
def sedist(net: Net, method: str = "hamming", diag: bool = False, ignore_eval: bool = True, attr: str = "weight") -> DataFrame:
    """(i, j, value) for all ordered pairs: how vertices' rows and columns of the sociomatrix differ, without the cells
    between the two unless ``diag``.

    Sums over common neighbours replace the comparison of whole profiles: with x the profile of i and y that of j, the sums of
    x, x^2 and xy over the compared cells give hamming, euclidean and correlation, numbers of cells alike give the others.
    """
    check_option("method", method, METHODS)
    if not ignore_eval:
        net.check_values(attr)
    arcs = net.arcs(diag, ignore_eval, attr)
    # a profile's cells: out-ties under their target, in-ties under their source
    cells = arcs.select("gid", F.col("src").alias("v"), F.lit("o").alias("side"), F.col("dst").alias("w_"), F.col("w").alias("x"))
    cells = cells.unionAll(arcs.select("gid", F.col("dst").alias("v"), F.lit("i").alias("side"), F.col("src").alias("w_"), F.col("w").alias("x")))
    own = cells.groupBy("gid", "v").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.sum(F.abs("x")).alias("m"), F.count(F.lit(1)).alias("c"))
    a, b = cells.select("gid", "side", "w_", F.col("v").alias("i"), F.col("x").alias("x")), cells.select("gid", "side", "w_", F.col("v").alias("j"), F.col("x").alias("y"))
    both = a.join(b, ["gid", "side", "w_"])
    if not diag:
        both = both.filter("w_ <> i and w_ <> j")
    x, y = F.col("x"), F.col("y")
    both = both.groupBy("gid", "i", "j").agg(
        F.sum(x * y).alias("xy"), F.sum(F.abs(x) + F.abs(y) - F.abs(x - y)).alias("shared"), F.count(F.lit(1)).alias("met"), F.sum((x == y).cast("long")).alias("alike")
    )
    v = net.vertices.select("gid", "vid")
    pairs = net.with_n(v.select("gid", F.col("vid").alias("i")).join(v.select("gid", F.col("vid").alias("j")), "gid"))
    ones = {"s": "s", "q": "q", "m": "m", "c": "c"}
    left, right = own.select("gid", F.col("v").alias("i"), *[F.col(k).alias(f"{k}i") for k in ones]), own.select("gid", F.col("v").alias("j"), *[F.col(k).alias(f"{k}j") for k in ones])
    got = pairs.join(left, ["gid", "i"], "left").join(right, ["gid", "j"], "left").join(both, ["gid", "i", "j"], "left")
    if not diag:
        # the cells between i and j stand in both profiles and are left out of both
        tie = arcs.filter("src <> dst")
        there = tie.select("gid", F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("wij"))
        back = tie.select("gid", F.col("dst").alias("i"), F.col("src").alias("j"), F.col("w").alias("wji"))
        got = got.join(there, ["gid", "i", "j"], "left").join(back, ["gid", "i", "j"], "left").fillna(0.0, ["wij", "wji"])
    else:
        got = got.withColumns({"wij": F.lit(0.0), "wji": F.lit(0.0)})
    names = [f"{k}{e}" for k in ones for e in "ij"]
    got = got.fillna(0.0, [*names, "xy", "shared"]).fillna(0, ["met", "alike", "ci", "cj"])
    out, p, r = F.col("i") != F.col("j"), F.col("wij"), F.col("wji")

    def less(total: str, part) -> F.Column:
        return F.when(out, F.col(total) - part).otherwise(F.col(total))

    length = 2 * F.when(out & F.lit(not diag), F.col("n") - 2).otherwise(F.col("n") - (0 if diag else 1)).cast("double")
    sx, sy = less("si", p + r), less("sj", p + r)
    qx, qy = less("qi", p * p + r * r), less("qj", p * p + r * r)
    mx, my = less("mi", F.abs(p) + F.abs(r)), less("mj", F.abs(p) + F.abs(r))
    tied = (p != 0).cast("int") + (r != 0).cast("int")
    cx, cy = less("ci", tied), less("cj", tied)
    hamming = F.greatest(F.lit(0.0), mx + my - F.col("shared"))
    square = F.greatest(F.lit(0.0), qx + qy - 2 * F.col("xy"))
    unlike = cx + cy - F.col("met") - F.col("alike")
    if method == "hamming":
        value = hamming
    elif method == "euclidean":
        value = F.sqrt(square)
    elif method == "gamma":
        value = nan_div(length - 2 * unlike, length)
    elif method == "exact":
        value = (unlike > 0).cast("double")
    else:
        spread = (length * qx - sx * sx) * (length * qy - sy * sy)
        value = F.when((length * qx - sx * sx > 1e-12) & (length * qy - sy * sy > 1e-12), (length * F.col("xy") - sx * sy) / F.sqrt(F.when(spread > 0, spread))).otherwise(F.lit(0.0))
    return net.out(got.select("gid", "i", "j", value.alias("value")))


def regular_similarity(m: np.ndarray, maxiter: int, tol: float) -> np.ndarray:
    n = len(m)
    sim = np.ones((n, n))
    sides = [[np.flatnonzero(row) for row in side != 0] for side in (m, m.T)]
    for _ in range(maxiter if n > 1 else 0):
        new = np.zeros((n, n))
        for near in sides:
            # best[i, l]: the best match of l among the neighbours of i
            best = np.stack([sim[k].max(axis=0) if len(k) else np.zeros(n) for k in near])
            mean = np.stack([best[:, k].mean(axis=1) if len(k) else np.zeros(n) for k in near], axis=1)
            none = np.array([not len(k) for k in near])
            side = (mean + mean.T) / 2
            side[none[:, None] | none[None, :]] = 0.0
            side[none[:, None] & none[None, :]] = 1.0
            new += side / 2
        np.fill_diagonal(new, 1.0)
        gap = np.abs(new - sim).max()
        sim = new
        if gap < tol:
            return sim
    if n > 1:
        warnings.warn("regular_equivalence: similarities still change by more than tol after maxiter rounds", stacklevel=1)
    return sim


@observed
def regular_equivalence(net: Net, maxiter: int = 100, tol: float = 1e-6, ignore_eval: bool = True) -> DataFrame:
    """(i, j, value): similarity of vertices whose neighbours are similar, iterated from all ones."""
    if not ignore_eval:
        raise ValueError("weighted regular equivalence is not implemented")
    if maxiter <= 0 or tol <= 0:
        raise ValueError("maxiter and tol must be positive")

    def found(ids, m):
        n = len(ids)
        return {"i": np.repeat(ids, n), "j": np.tile(ids, n), "value": regular_similarity(m, maxiter, tol).ravel()}

    return net.out(per_graph(net, found, "i long, j long, value double"))


def agglomerate(dist: np.ndarray, k: int, linkage: str) -> np.ndarray:
    """Labels 1.. of ``k`` clusters: the closest pair, first in order, is merged into its lower index again and again."""
    n = len(dist)
    d, size, label, live = np.array(dist, dtype=float), np.ones(n), np.arange(n), np.ones(n, bool)
    d[np.tril_indices(n)] = np.inf
    for _ in range(n - k):
        a, b = np.unravel_index(np.argmin(d), d.shape)
        whole = np.minimum(d, d.T)
        x, y = whole[a], whole[b]
        if linkage == "complete":
            new = np.maximum(x, y)
        elif linkage == "single":
            new = np.minimum(x, y)
        else:
            new = (size[a] * x + size[b] * y) / (size[a] + size[b])
        live[b] = False
        label[label == b] = a
        size[a] += size[b]
        new[~live] = np.inf
        new[a] = np.inf
        later = np.arange(n) > a
        d[a, :] = np.where(later, new, np.inf)
        d[:, a] = np.where(~later, new, np.inf)
        d[b, :] = d[:, b] = np.inf
    return np.searchsorted(np.unique(label), label) + 1


LINKAGES = ("complete", "average", "single")


@observed
def equiv_clust(net: Net, k: int | None = None, equiv_fun: str = "sedist", method: str = "hamming", cluster_method: str = "complete", ignore_eval: bool = True, attr: str = "weight") -> DataFrame:
    """(vid, membership): vertices clustered by their structural or regular equivalence into ``k`` (default: n div 4, 2 at least)."""
    check_option("cluster_method", cluster_method, LINKAGES)
    check_option("equiv_fun", equiv_fun, ("sedist", "regular_equivalence"))
    whole = net.replace(many=True, mask=None)
    if equiv_fun == "sedist":
        far = sedist(whole, method, ignore_eval=ignore_eval, attr=attr)
        far = far.withColumn("value", -F.col("value")) if method in ("correlation", "gamma") else far
    else:
        far = regular_equivalence(whole, ignore_eval=ignore_eval).withColumn("value", 1 - F.col("value"))

    def found(ids, m):
        n = len(ids)
        return {"vid": ids, "membership": agglomerate(m, min(n, max(1, k if k is not None else max(2, n // 4))), cluster_method)}

    return net.out(per_graph(net, found, "vid long, membership long", arcs=far.select("gid", "i", "j", F.col("value").alias("w"))))


@observed
def block_densities(net: Net, membership: DataFrame, ignore_eval: bool = True, attr: str = "weight") -> DataFrame:
    """(block_i, block_j, density) given (vid, membership): mean value over ordered pairs of different vertices; NaN without any."""
    if "gid" not in membership.columns:
        membership = membership.withColumn("gid", F.lit(0).cast("long"))
    m = membership.select("gid", "vid", "membership")
    arcs = net.arcs(False, ignore_eval, attr)
    arcs = arcs.join(m.select("gid", F.col("vid").alias("src"), F.col("membership").alias("block_i")), ["gid", "src"]).join(m.select("gid", F.col("vid").alias("dst"), F.col("membership").alias("block_j")), ["gid", "dst"])
    sums = arcs.groupBy("gid", "block_i", "block_j").agg(F.sum("w").alias("ties"))
    size = m.groupBy("gid", "membership").agg(F.count(F.lit(1)).alias("s"))
    pairs = size.select("gid", F.col("membership").alias("block_i"), F.col("s").alias("si")).join(size.select("gid", F.col("membership").alias("block_j"), F.col("s").alias("sj")), "gid")
    got = pairs.join(sums, ["gid", "block_i", "block_j"], "left").fillna(0.0, ["ties"])
    cells = F.col("si") * F.col("sj") - F.when(F.col("block_i") == F.col("block_j"), F.col("si")).otherwise(0)
    return net.out(got.select("gid", "block_i", "block_j", nan_div(F.col("ties"), cells).alias("density")))


@observed
def blockmodel(net: Net, k: int, equiv_fun: str = "sedist", method: str = "hamming", cluster_method: str = "complete", ignore_eval: bool = True, attr: str = "weight") -> tuple[DataFrame, DataFrame]:
    """(memberships (vid, membership), densities (block_i, block_j, density)) of ``k`` positions."""
    member = equiv_clust(net.replace(many=True, mask=None), k, equiv_fun, method, cluster_method, ignore_eval, attr)
    return net.out(member), block_densities(net.replace(mask=None), member, ignore_eval, attr)


def consensus_clustering(clusterings: DataFrame | Sequence[Sequence[int]], threshold: float = 0.5, spark: SparkSession | None = None) -> DataFrame:
    """(vid, membership): vertices that share a cluster in at least ``threshold`` of the partitions, and whom these link, together.

    ``clusterings``: (part, vid, label), or lists of labels of vertices 1..n. Equal label vectors are one vertex in the comparison.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    if not isinstance(clusterings, DataFrame):
        if not clusterings:
            raise ValueError("consensus_clustering needs at least one clustering")
        if len({len(c) for c in clusterings}) > 1:
            raise ValueError("clusterings differ in their number of vertices")
        rows = [(p, v + 1, int(x)) for p, c in enumerate(clusterings) for v, x in enumerate(c)]
        clusterings = (spark or SparkSession.getActiveSession()).createDataFrame(rows, "part long, vid long, label long")
    parts = clusterings.select("part").distinct().count()
    if not parts:
        raise ValueError("consensus_clustering needs at least one clustering")
    uneven = clusterings.groupBy("vid").agg(F.countDistinct("part").alias("c")).filter(F.col("c") < parts)
    if not uneven.isEmpty():
        raise ValueError("every clustering must label the same vertices")
    told = clusterings.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("part", "label"))).alias("labels"))
    profile = told.groupBy("labels").agg(F.min("vid").alias("first"))
    member = told.join(profile, "labels").select("vid", "first")
    flat = profile.select("first", F.explode("labels").alias("l")).select("first", "l.part", "l.label")
    other = flat.withColumnRenamed("first", "second")
    same = flat.join(other, ["part", "label"]).filter("first < second").groupBy("first", "second").agg(F.count(F.lit(1)).alias("c"))
    links = same.filter(F.col("c") >= threshold * parts).select(F.col("first").alias("a"), F.col("second").alias("b"))
    groups = components(links)
    got = member.join(groups, F.col("first") == F.col("node"), "left").select(F.lit(0).cast("long").alias("gid"), "vid", F.coalesce("component", "first").alias("label"))
    return first_rank(got).drop("gid")
