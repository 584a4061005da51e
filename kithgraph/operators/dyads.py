"""The dyads that network correlation and regression compare, graph correlation, and permutation tests of it."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import nan_div
from ..net import Net, check_option, require_observed
from .random_graphs import permutations

MODES = ("auto", "digraph", "graph")


@dataclasses.dataclass(frozen=True, eq=False)
class Frame:
    """k networks over the same vertices: their dyads (i, j, v0, v1, ...), and what tells which pairs those are."""

    nets: Sequence[Net]
    directed: bool
    mode1: int | None
    reverse: bool

    def cells(self, net: Net, diag: bool = False) -> DataFrame:
        """(i, j, v): a network's cells among the dyads that are not 0."""
        arcs = net.arcs(diag, not net.valued).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("v"))
        kept = self.keep(arcs)
        return kept.unionAll(arcs.filter("i = j")) if diag and self.mode1 is None else kept

    def tied(self, diag: bool = False) -> DataFrame:
        """(i, j, v0, ...): the dyads in which any network has a value other than 0."""
        names = [f"v{k}" for k in range(len(self.nets))]
        parts = [self.cells(net, diag).select("i", "j", *[F.col("v").alias(c) if k == at else F.lit(0.0).alias(c) for at, c in enumerate(names)]) for k, net in enumerate(self.nets)]
        both = parts[0]
        for more in parts[1:]:
            both = both.unionAll(more)
        return both.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names])

    def keep(self, pairs: DataFrame) -> DataFrame:
        if self.mode1 is None:
            return pairs.filter("i <> j" if self.directed else "i > j")
        p = self.mode1
        forward, back = (F.col("i") <= p) & (F.col("j") > p), (F.col("i") > p) & (F.col("j") <= p)
        if not self.directed:
            return pairs.filter(back)
        return pairs.filter(forward | back if self.reverse else forward)

    def dyads(self, diag: bool = False) -> DataFrame:
        """(i, j, v0, ...): every dyad with each network's value."""
        v = self.nets[0].vertices.select("vid")
        pairs = v.select(F.col("vid").alias("i")).join(v.select(F.col("vid").alias("j")))
        all_ = self.keep(pairs)
        if diag and self.mode1 is None:
            all_ = all_.unionAll(v.select(F.col("vid").alias("i"), F.col("vid").alias("j")))
        for k, net in enumerate(self.nets):
            arcs = net.arcs(diag, not net.valued).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias(f"v{k}"))
            all_ = all_.join(arcs, ["i", "j"], "left")
        return all_.fillna(0.0, [f"v{k}" for k in range(len(self.nets))])

    def size(self, diag: bool = False) -> int:
        """Number of dyads, from the vertices alone."""
        n = self.nets[0].nv()
        if self.mode1 is None:
            return n * (n - 1) // (1 if self.directed else 2) + (n if diag else 0)
        p = self.nets[0].vertices.filter(F.col("vid") <= self.mode1).count()
        return p * (n - p) * (2 if self.directed and self.reverse else 1)


def frame(nets: Sequence[Net], mode: str = "auto", missing: str = "error", context: str = "") -> Frame:
    """The common frame of ``nets``, the first of which decides on direction unless ``mode`` says it."""
    check_option("mode", mode, MODES)
    for net in nets:
        require_observed(net, missing, context)
        net.check_values()
    parts = {net.mode1 for net in nets}
    if len(parts) > 1:
        raise ValueError("all networks must split their vertices into the same two modes")
    first = nets[0].vertices.select("vid")
    for net in nets[1:]:
        other = net.vertices.select("vid")
        if not first.exceptAll(other).isEmpty() or not other.exceptAll(first).isEmpty():
            raise ValueError(f"{context}: the networks must have the same vertices")
    mode1 = parts.pop()
    if mode != "auto":
        directed = mode == "digraph"
    elif nets[0].valued:  # a matrix: undirected if all are symmetric
        directed = any(net.directed for net in nets)
    else:
        directed = nets[0].directed
    reverse = False
    if mode1 is not None and directed:
        reverse = any(not net.arcs().filter((F.col("src") > mode1) & (F.col("dst") <= mode1)).isEmpty() for net in nets)
    return Frame(nets, directed, mode1, reverse)


def _moments(f: Frame, diag: bool) -> DataFrame:
    """Sums over all dyads. Those in which neither network has a tie add to their number only."""
    x, y = F.col("v0"), F.col("v1")
    return f.tied(diag).agg(
        F.lit(f.size(diag)).cast("long").alias("n"), F.coalesce(F.sum(x), F.lit(0.0)).alias("sx"), F.coalesce(F.sum(y), F.lit(0.0)).alias("sy"), F.coalesce(F.sum(x * x), F.lit(0.0)).alias("sxx"), F.coalesce(F.sum(y * y), F.lit(0.0)).alias("syy"), F.coalesce(F.sum(x * y), F.lit(0.0)).alias("sxy")
    )


def gcor(g1: Net, g2: Net, mode: str = "auto", diag: bool = False, missing: str = "error") -> DataFrame:
    """gcor: Pearson correlation of two networks' values over their dyads."""
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    spread = (n * sxx - sx * sx) * (n * syy - sy * sy)
    got = _moments(frame([g1, g2], mode, missing, "gcor"), diag)
    return got.select(nan_div(n * sxy - sx * sy, F.sqrt(F.greatest(spread, F.lit(0.0)))).alias("gcor"))


def gcov(g1: Net, g2: Net, mode: str = "auto", diag: bool = False, missing: str = "error") -> DataFrame:
    """gcov: their sample covariance."""
    got = _moments(frame([g1, g2], mode, missing, "gcov"), diag)
    n, sx, sy, sxy = (F.col(c) for c in ("n", "sx", "sy", "sxy"))
    return got.select(nan_div(sxy - sx * sy / F.when(n > 0, n), n - 1).alias("gcov"))


@dataclasses.dataclass(frozen=True, eq=False)
class QAPTest:
    """An observed statistic, its permutation distribution (rep, value) and the shares of it on either side."""

    testval: float
    dist: DataFrame
    pgreq: float
    pleeq: float
    n_sim: int

    def summary(self) -> DataFrame:
        return self.dist.sparkSession.createDataFrame([(self.testval, self.pgreq, self.pleeq, self.n_sim)], "testval double, pgreq double, pleeq double, n_sim long")

    def __str__(self) -> str:
        return f"QAP test of {self.n_sim} permutations: statistic {self.testval:.6g}, p(>=) {show_p(self.pgreq, self.n_sim)}, p(<=) {show_p(self.pleeq, self.n_sim)}"


def show_p(p: float, n_sim: int) -> str:
    return f"<{1 / n_sim:g}" if p == 0 and n_sim else f"{p:.4g}"


def permuted_cells(f: Frame, net: Net, n_sim: int, seed: int) -> DataFrame:
    """(rep, i, j, v): a network's cells after each of ``n_sim`` relabellings of its vertices, among the dyads."""
    perm = permutations(net.vertices.select("vid"), n_sim, seed, f.mode1)
    arcs = net.arcs(False, not net.valued)
    got = arcs.join(perm.select("rep", F.col("vid").alias("src"), F.col("new").alias("i")), "src").join(perm.select("rep", F.col("vid").alias("dst"), F.col("new").alias("j")), ["rep", "dst"])
    return f.keep(got.select("rep", "i", "j", F.col("w").alias("v")))


def qaptest(g1: Net, g2: Net, statistic="gcor", n_sim: int = 1000, mode: str = "auto", seed: int = 0, missing: str = "error") -> QAPTest:
    """A statistic of two networks against its distribution over relabellings of the first.

    gcor and gcov run as one job over all relabellings: of them only the sum of products varies. Any other
    function of two matrices gets both as dense arrays (the incidence matrices of two-mode networks), a task a relabelling.
    """
    if n_sim <= 0:
        raise ValueError("n_sim must be positive")
    spark = g1.spark
    f = frame([g1, g2], mode, missing, "qaptest")
    if callable(statistic):
        return _qaptest_dense(f, statistic, n_sim, seed)
    check_option("statistic", statistic, ("gcor", "gcov"))
    m = _moments(f, False).first()
    cells = permuted_cells(f, g1, n_sim, seed).join(f.cells(g2).withColumnRenamed("v", "y"), ["i", "j"])
    sums = spark.range(n_sim).select(F.col("id").alias("rep")).join(cells.groupBy("rep").agg(F.sum(F.col("v") * F.col("y")).alias("sxy")), "rep", "left").fillna(0.0, ["sxy"])
    n, gap = m["n"], lambda s: m["n"] * s - m["sx"] * m["sy"]
    if statistic == "gcor":
        spread = (n * m["sxx"] - m["sx"] ** 2) * (n * m["syy"] - m["sy"] ** 2)
        scale = spread**0.5 if spread > 0 else float("nan")
    else:
        scale = float(n) * (n - 1)
    # whole sums are compared, so that rounding splits no ties
    dist = sums.select("rep", ((n * F.col("sxy") - m["sx"] * m["sy"]) / F.lit(scale)).alias("value"), "sxy")
    edge = 1e-9 * max(1.0, abs(m["sxy"]))
    counts = dist.agg(F.sum((F.col("sxy") >= m["sxy"] - edge).cast("long")), F.sum((F.col("sxy") <= m["sxy"] + edge).cast("long"))).first()
    return QAPTest(gap(m["sxy"]) / scale, dist.drop("sxy"), counts[0] / n_sim, counts[1] / n_sim, n_sim)


def _qaptest_dense(f: Frame, statistic, n_sim: int, seed: int) -> QAPTest:
    g1, g2 = f.nets
    spark = g1.spark
    a, b = (g.as_matrix("weight" if g.valued else None, diag=False) for g in (g1, g2))
    p = f.mode1
    if p is not None:
        for m in (a, b):
            if (m[p:, :p] != 0).any() and (m[p:, :p] != m[:p, p:].T).any():
                raise ValueError("qaptest: two-mode networks with ties of their own from mode 2 to mode 1 are not implemented")
    block = (lambda m: m) if p is None else (lambda m: m[:p, p:])
    obs = float(statistic(block(a), block(b)))
    ids = sorted(r["vid"] for r in g1.vertices.select("vid").collect())
    sent = spark.sparkContext.broadcast((a, block(b), {v: i for i, v in enumerate(ids)}))
    perm = permutations(g1.vertices.select("vid"), n_sim, seed, p)

    def one(key, table):
        m, other, at = sent.value
        new = np.zeros(len(at), np.int64)
        new[[at[v] for v in table.column("vid").to_pylist()]] = [at[v] for v in table.column("new").to_pylist()]
        back = np.argsort(new)
        value = float(statistic(block(m[np.ix_(back, back)]), other))
        return pa.table({"rep": pa.array([key[0].as_py()], pa.int64()), "value": pa.array([value], pa.float64())})

    from ..functions.tables import stored

    dist = stored(perm.groupBy("rep").applyInArrow(one, "rep long, value double"), "dist")
    n = dist.agg(F.sum((F.col("value") >= obs).cast("long")), F.sum((F.col("value") <= obs).cast("long"))).first()
    return QAPTest(obs, dist, (n[0] or 0) / n_sim, (n[1] or 0) / n_sim, n_sim)
