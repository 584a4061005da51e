"""Brokerage roles between classes of vertices, with moments under a random graph of the same density."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..net import Net, observed

ROLES = ("w_I", "w_O", "b_IO", "b_OI", "b_O", "t")


def _classes(net: Net, cl: str) -> DataFrame:
    if cl not in net.vertices.columns:
        raise ValueError(f"brokerage: the vertices have no attribute {cl!r}")
    return net.vertices.select("gid", "vid", F.col(cl).alias("cl"))


def _raw(net: Net, cl: str) -> DataFrame:
    """(gid, vid, cl, one count a role): open two-paths i -> j -> k through j = vid by their classes."""
    cls = _classes(net, cl)
    arcs = net.arcs()
    x = arcs.select("gid", F.col("src").alias("i"), F.col("dst").alias("j"))
    y = arcs.select("gid", F.col("src").alias("j"), F.col("dst").alias("k"))
    direct = arcs.select("gid", F.col("src").alias("i"), F.col("dst").alias("k"))
    open_ = x.join(y, ["gid", "j"]).filter("i <> k").join(direct, ["gid", "i", "k"], "left_anti")
    for v in "ijk":
        open_ = open_.join(cls.select("gid", F.col("vid").alias(v), F.col("cl").alias(f"c{v}")), ["gid", v])
    ij, ik, jk = (F.col(a).eqNullSafe(F.col(b)) for a, b in (("ci", "cj"), ("ci", "ck"), ("cj", "ck")))
    role = F.when(ij & jk, "w_I").when(ij, "b_IO").when(ik, "w_O").when(jk, "b_OI").otherwise("b_O")
    counts = open_.groupBy("gid", F.col("j").alias("vid")).agg(*[F.sum((role == r).cast("long")).alias(r) for r in ROLES[:5]], F.count(F.lit(1)).alias("t"))
    return cls.join(counts, ["gid", "vid"], "left").fillna(0, list(ROLES))


@observed
def brokerage(net: Net, cl: str) -> DataFrame:
    """vid, role, raw, exp, sd, z: for every vertex and role. ``cl`` names a vertex attribute."""
    raw = _long(_raw(net, cl), ["gid", "vid", "cl"])
    moments = _moments(net, cl).filter("level = 'class'").select("gid", "cl", "role", "exp", "sd")
    got = raw.join(moments.withColumnRenamed("cl", "c").withColumnRenamed("gid", "g").withColumnRenamed("role", "r"), (F.col("gid") == F.col("g")) & F.col("cl").cast("string").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")))
    return net.out(got.select("gid", "vid", "cl", "role", "raw", "exp", "sd", _z().alias("z")))


@observed
def brokerage_classes(net: Net, cl: str) -> DataFrame:
    """cl, n, role, exp, sd: per class, classes in order of their smallest vertex (``place``)."""
    return net.out(_moments(net, cl).filter("level = 'class'").select("gid", "cl", "place", "n", "role", "exp", "sd"))


@observed
def brokerage_global(net: Net, cl: str) -> DataFrame:
    """role, raw, exp, sd, z: of the whole network."""
    raw = _long(_raw(net, cl).groupBy("gid").agg(*[F.sum(r).alias(r) for r in ROLES]), ["gid"])
    moments = _moments(net, cl).filter("level = 'graph'").select("gid", "role", "exp", "sd")
    return net.out(raw.join(moments, ["gid", "role"]).select("gid", "role", "raw", "exp", "sd", _z().alias("z")))


def _z():
    gap = F.col("raw") - F.col("exp")
    plain = gap / F.when(F.col("sd") > 0, F.col("sd"))
    none = F.when(gap == 0, float("nan")).when(gap > 0, float("inf")).otherwise(float("-inf"))
    return F.when(F.isnan("sd"), float("nan")).when(F.col("sd") > 0, plain).otherwise(none)


def _long(wide: DataFrame, keys: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).cast("long").alias("raw")) for r in ROLES])
    return wide.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.role", "p.raw")


def _moments(net: Net, cl: str) -> DataFrame:
    """(gid, level, cl, place, n, role, exp, sd) from class sizes and density; a row of sizes a graph."""
    sizes = _classes(net, cl).groupBy("gid", F.col("cl").cast("string").alias("cl")).agg(F.count(F.lit(1)).alias("n"), F.min("vid").alias("first"))
    arcs = net.arcs().groupBy("gid").agg(F.count(F.lit(1)).alias("m"))
    rows = sizes.join(arcs, "gid", "left").fillna(0, ["m"])
    schema = "gid long, level string, cl string, place int, n long, role string, exp double, sd double"

    def run(key, frame):
        import pandas as pd

        frame = frame.sort_values("first", kind="stable")
        n = frame["n"].to_numpy(float)
        total = n.sum()
        with np.errstate(divide="ignore", invalid="ignore"):
            d = frame["m"].iloc[0] / (total * (total - 1)) if total > 1 else np.nan
            own, own_v = class_moments(n, d)
            all_, all_v = graph_moments(n, d)
            own_sd, all_sd = np.sqrt(own_v), np.sqrt(all_v)
        out = []
        for i, (name, size) in enumerate(zip(frame["cl"], frame["n"], strict=True)):
            out += [(key[0], "class", name, i + 1, int(size), r, own[i, j], own_sd[i, j]) for j, r in enumerate(ROLES)]
        out += [(key[0], "graph", None, 0, int(total), r, all_[j], all_sd[j]) for j, r in enumerate(ROLES)]
        return pd.DataFrame(out, columns=["gid", "level", "cl", "place", "n", "role", "exp", "sd"])

    got = rows.groupBy("gid").applyInPandas(run, schema)
    # pandas' missing values come back as nulls
    return got.withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in ("exp", "sd")})


def class_moments(n: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """(expectations, variances), classes by roles: of an open two-path through a vertex of a class.

    An open two-path has probability q = d^2 (1 - d); two that share one end, and so all arcs but a pair of each
    other's, covary with weight c = d^3 (1 - d)^3.
    """
    total, q, c = n.sum(), d * d * (1 - d), d**3 * (1 - d) ** 3
    rest = total - n
    mean, shared = np.zeros((len(n), 6)), np.zeros((len(n), 6))
    mean[:, 0] = (n - 1) * (n - 2)
    shared[:, 0] = 2 * (n - 1) * (n - 2) * (n - 3)
    mean[:, 1] = (n * (n - 1)).sum() - n * (n - 1)
    shared[:, 1] = 2 * ((n * (n - 1) * (n - 2)).sum() - n * (n - 1) * (n - 2))
    mean[:, 2] = mean[:, 3] = rest * (n - 1)
    shared[:, 2] = shared[:, 3] = (n - 1) * rest * (rest - 1) + rest * (n - 1) * (n - 2)
    squares = (n**2).sum() - n**2
    mean[:, 4] = rest**2 - squares
    for i in range(len(n)):
        o = np.delete(n, i)
        far = rest[i] - o
        shared[i, 4] = 2 * (o * far * (far - 1)).sum()
    mean[:, 5] = (total - 1) * (total - 2)
    shared[:, 5] = 2 * (total - 1) * (total - 2) * (total - 3)
    mean = mean * q
    return mean, mean * (1 - q) + shared * c


def graph_moments(n: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """(expectations, variances) of the six counts over the whole network.

    Over all triples of a role, the covariances of pairs of triples enter with weights c = d^3 (1 - d)^3,
    e = d^4 (1 - d)^2 and f = d^5 (1 - d).
    """
    total = n.sum()
    q, c, e, f = d * d * (1 - d), d**3 * (1 - d) ** 3, d**4 * (1 - d) ** 2, d**5 * (1 - d)
    mean, cover = np.zeros(6), np.zeros(6)
    within = n * (n - 1) * (n - 2)
    mean[0] = within.sum()
    cover[0] = (within * ((4 * n - 10) * c + (n - 3) * (f - 4 * e))).sum()
    across = n * (n - 1) * (total - n)
    mean[1:4] = across.sum()
    x, y = n[:, None], n[None, :]
    pairs = x * (x - 1) * y * (2 * (x + y - 3) * c + (total - x - 1) * f)
    cover[1] = pairs.sum() - (n * n * (n - 1) * ((4 * n - 6) * c + (total - n - 1) * f)).sum()
    cover[2] = cover[3] = (across * ((total - 3) * c + (n - 2) * f)).sum()
    mean[4] = (x * y * (total - x - y)).sum() - (n * n * (total - 2 * n)).sum()
    a, b, z = n[:, None, None], n[None, :, None], n[None, None, :]
    k = np.arange(len(n))
    apart = (k[:, None, None] != k[None, :, None]) & (k[None, :, None] != k[None, None, :]) & (k[:, None, None] != k[None, None, :])
    triple = (4 * (total - b) - 2 * (a + z + 1)) * c - (4 * (total - z) - 2 * (a + b + 1)) * e + (total - (a + z + 1)) * f
    cover[4] = (np.where(apart, a * b * z, 0.0) * triple).sum()
    mean[5] = total * (total - 1) * (total - 2)
    cover[5] = mean[5] * ((4 * total - 10) * c + (total - 3) * (f - 4 * e))
    mean = mean * q
    return mean, mean * (1 - q) + cover
