"""Conditional uniform graph tests: a graph-level index against random graphs of the same size, ties or dyad census."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import stored
from ..net import Net, check_option, require_observed
from .census import dyad_census
from .dyads import show_p
from .random_graphs import rgnm, rgnp, rguman


@dataclasses.dataclass(frozen=True, eq=False)
class CUGTest:
    obs: float
    dist: DataFrame
    cmode: str
    directed: bool
    pleeq: float
    pgreq: float
    n_sim: int

    def summary(self) -> DataFrame:
        return self.dist.sparkSession.createDataFrame([(self.obs, self.pgreq, self.pleeq, self.n_sim)], "obs double, pgteobs double, plteobs double, n_sim long")

    def __str__(self) -> str:
        return f"CUG test given {self.cmode}, {self.n_sim} graphs: statistic {self.obs:.6g}, p(>=) {show_p(self.pgreq, self.n_sim)}, p(<=) {show_p(self.pleeq, self.n_sim)}"


def cug_test(net: Net, index, cmode: str = "size", n_sim: int = 1000, seed: int = 0, missing: str = "error", **options) -> CUGTest:
    """``index`` maps a net to one row a graph with one value column. All random graphs are one net of many graphs, so the
    index runs on them as one job. Undefined values count on neither side."""
    require_observed(net, missing, "cug_test")
    check_option("cmode", cmode, ("size", "edges", "dyad_census"))
    if n_sim <= 0:
        raise ValueError("n_sim must be positive")
    if net.mode1 is not None:
        raise ValueError("cug_test: two-mode networks are not implemented")
    spark = net.spark
    plain = net.replace(edges=net.edges.filter("src <> dst"), mask=None, many=True, loops=False)
    n, d = net.nv(), dyad_census(plain).first()
    ties = 2 * d["mutual"] + d["asym"] if net.directed else d["mutual"]
    if cmode == "size":
        drawn = rgnp(spark, n, 0.5, net.directed, seed, n_sim)
    elif cmode == "edges" or not net.directed:
        drawn = rgnm(spark, n, ties, net.directed, seed, n_sim)
    else:
        drawn = rguman(spark, n, d["mutual"], d["asym"], seed, n_sim)
    drawn = drawn.replace(many=True, edges=stored(drawn.edges, "drawn"))

    def values(of: Net) -> DataFrame:
        got = index(of, **options)
        name = next(c for c in got.columns if c != "gid")
        return got.select(F.col("gid").alias("rep"), F.col(name).cast("double").alias("value"))

    obs = values(plain).first()["value"]
    dist = stored(values(drawn), "dist")
    real = ~F.isnan("value")
    sums = dist.agg(F.sum((real & (F.col("value") <= obs)).cast("long")), F.sum((real & (F.col("value") >= obs)).cast("long"))).first()
    below, above = (sums[0] or 0, sums[1] or 0) if obs == obs else (0, 0)
    return CUGTest(obs, dist, cmode, net.directed, below / n_sim, above / n_sim, n_sim)
