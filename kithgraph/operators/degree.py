"""Degree centrality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import nan_div
from ..net import Net, check_option, observed

CMODES = ("freeman", "indegree", "outdegree")


@observed
def degreecent(net: Net, cmode: str = "freeman", rescale: bool = False, normalized: bool = False, diag: bool = False, ignore_eval: bool = True, attr: str = "weight") -> DataFrame:
    """(vid, score): ties of a vertex. Directed: in- and out-ties (freeman; a loop counts once), or either. Undirected
    ties count once at both ends, whatever ``cmode``. ``normalized`` divides by the most there can be, ``rescale`` by the sum."""
    check_option("cmode", cmode, CMODES)
    if rescale and normalized:
        raise ValueError("rescale and normalized exclude each other")
    if not ignore_eval:
        net.check_values(attr)
    arcs = net.arcs(diag, ignore_eval, attr)
    total = net.directed and cmode == "freeman"
    out = arcs.select("gid", F.col("src").alias("vid"), "w")
    into = arcs.select("gid", F.col("dst").alias("vid"), "w")
    if total:
        ends = out.unionAll(arcs.filter("src <> dst").select("gid", F.col("dst").alias("vid"), "w"))
    else:
        ends = into if net.directed and cmode == "indegree" else out
    sums = ends.groupBy("gid", "vid").agg(F.sum("w").alias("score"))
    got = net.vertices.select("gid", "vid").join(sums, ["gid", "vid"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    if normalized:
        most = F.lit(2.0 if total else 1.0) * (F.col("n") - 1) + F.lit(1.0 if diag else 0.0)
        got = net.with_n(got).withColumn("score", F.when(F.col("n") > 1, F.col("score") / F.when(most != 0, most)).otherwise(F.col("score"))).drop("n")
    return net.out(rescaled(got) if rescale else got)


def rescaled(scores: DataFrame) -> DataFrame:
    """Scores divided by their graph's sum."""
    sums = scores.groupBy("gid").agg(F.sum("score").alias("total"))
    return scores.join(sums, "gid").withColumn("score", nan_div(F.col("score"), F.col("total"))).drop("total")
