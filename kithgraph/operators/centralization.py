"""Freeman centralization of any vertex index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import nan_div
from ..net import Net, check_option, require_observed
from .degree import degreecent
from .paths import betweenness, closeness
from .spectral import bonpow, evcent

NAMED = {"degree": degreecent, "betweenness": betweenness, "closeness": closeness, "eigenvector": evcent}
MODES = {"total": "freeman", "in": "indegree", "out": "outdegree"}


def centralization(net: Net, index="degree", normalized: bool = True, mode: str | None = None, missing: str = "error", **options) -> DataFrame:
    """centralization: how far the scores lie below the largest, over the most that is possible.

    ``index`` is an operator that gives (vid, score), or a name (degree, betweenness, closeness, eigenvector). Only the built-in
    indices have a known most; others need ``normalized=False``.
    """
    require_observed(net, missing, "centralization")
    if isinstance(index, str):
        check_option("index", index, tuple(NAMED))
        index = NAMED[index]
    if mode is not None:
        check_option("mode", mode, tuple(MODES))
        options["cmode"] = MODES[mode]
    scores = index(net.replace(many=True, mask=None), **options)
    sums = scores.groupBy("gid").agg((F.max("score") * F.count(F.lit(1)) - F.sum("score")).alias("gap"), F.count(F.lit(1)).cast("double").alias("n"))
    if not normalized:
        return net.out(sums.select("gid", F.col("gap").alias("centralization")))
    return net.out(sums.select("gid", nan_div(F.col("gap"), most_deviation(net, index, options)).alias("centralization")))


def most_deviation(net: Net, index, options: dict) -> F.Column:
    """The largest sum of deviations that any graph of n vertices has, as an expression of n."""
    n, undirected = F.col("n"), not net.directed
    cmode, d = options.get("cmode"), 1.0 if options.get("diag") else 0.0
    if index is degreecent:
        if undirected:
            return (n - 1) * (n - 2 + d)
        return (n - 1) * (2 * (n - 1) - 2 + d) if cmode in (None, "freeman") else (n - 1) * (n - 1 + d)
    if index is betweenness:
        whole = (n - 1) * (n - 1) * (n - 2)
        return whole / 2 if undirected or cmode == "undirected" else whole
    if index is closeness:
        cmode = cmode or "directed"
        if undirected:
            cmode = {"directed": "undirected", "suminvdir": "suminvundir"}.get(cmode, cmode)
        if cmode == "undirected":
            return nan_div((n - 2) * (n - 1), 2 * n - 3)
        if cmode == "directed":
            return (n - 1) * (1 - 1 / n)
        if cmode == "suminvdir":
            return (n - 1) * (n - 1)
        if cmode == "suminvundir":
            return n - 1 - n / 2
        return (n - 2) / 2 if undirected else n - 1
    if index is evcent:
        return F.lit(2.0**0.5 / 2) * (n - 2) if undirected else n - 1
    if index is bonpow:
        return (n - 2) * F.sqrt(n / 2) if undirected else F.sqrt(n) * (n - 1)
    raise ValueError("the most that this index can deviate is unknown; use normalized=False")
