"""Random graphs. Every draw is a function of (seed, graph, dyad), so results don't depend on partitions or engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import digest, uniform
from ..net import Net, check_option


def _dyads(spark: SparkSession, n: int, m: int, directed: bool) -> DataFrame:
    """(gid, src, dst) of all dyads of ``m`` graphs of vertices 1..n, made from one range."""
    cells = spark.range(m * n * n)
    rows = cells.select(F.expr(f"id div {max(1, n * n)}").alias("gid"), (F.expr(f"(id div {max(1, n)}) % {max(1, n)}") + 1).alias("src"), (F.col("id") % max(1, n) + 1).alias("dst"))
    return rows.filter("src <> dst" if directed else "src < dst")


def _net(spark: SparkSession, n: int, m: int, ties: DataFrame, directed: bool, many: bool) -> Net:
    vertices = spark.range(m * n).select(F.expr(f"id div {max(1, n)}").alias("gid"), (F.col("id") % max(1, n) + 1).alias("vid"))
    return Net(vertices, ties.select("gid", "src", "dst", F.lit(1.0).alias("weight")), directed, many=many)


def rgnp(spark: SparkSession, n: int, p: float, directed: bool = True, seed: int = 0, m: int = 1) -> Net:
    """``m`` graphs in which every dyad is tied with probability ``p``, independently."""
    if not 0 <= p <= 1:
        raise ValueError("p must be between 0 and 1")
    ties = _dyads(spark, n, m, directed).filter(uniform(seed, F.col("gid"), F.col("src"), F.col("dst")) < p)
    return _net(spark, n, m, ties, directed, m > 1)


def rgnm(spark: SparkSession, n: int, ties: int, directed: bool = True, seed: int = 0, m: int = 1) -> Net:
    """``m`` graphs of exactly ``ties`` ties, any set of dyads as likely as any other."""
    most = n * (n - 1) // (1 if directed else 2)
    if not 0 <= ties <= most:
        raise ValueError(f"the number of ties must be between 0 and {most}")
    ranked = _ranked(_dyads(spark, n, m, directed), seed, ties, most)
    return _net(spark, n, m, ranked, directed, m > 1)


def _ranked(dyads: DataFrame, seed: int, first: int, all_: int) -> DataFrame:
    """The ``first`` dyads of each graph in the order of their digests, with their rank.

    Only dyads of small digests are ranked: about ``first`` of all ``all_`` and twelve standard deviations more, so that no more
    than about those of a graph meet in a task. That too few pass has a chance below 1e-30 a graph.
    """
    parts = seed, F.col("gid"), F.col("src"), F.col("dst")
    share = (first + 12 * first**0.5 + 72) / max(1, all_)
    if share < 1:
        dyads = dyads.filter(uniform(*parts) <= share)
    order = Window.partitionBy("gid").orderBy(digest(*parts), "src", "dst")
    return dyads.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)


def rgraph(spark: SparkSession, n: int, m: int = 1, tprob: float = 0.5, mode: str = "digraph", seed: int = 0) -> Net:
    """``m`` graphs of independent ties of probability ``tprob``."""
    check_option("mode", mode, ("digraph", "graph"))
    if m < 1:
        raise ValueError("m must be positive")
    return rgnp(spark, n, tprob, mode == "digraph", seed, m)


def rguman(spark: SparkSession, n: int, mutual: int, asym: int, seed: int = 0, m: int = 1) -> Net:
    """``m`` directed graphs with exactly this dyad census: ranked dyads are mutual, then asymmetric in a drawn direction."""
    if mutual < 0 or asym < 0 or mutual + asym > n * (n - 1) // 2:
        raise ValueError("the dyad census doesn't fit n")
    r = _ranked(_dyads(spark, n, m, False), seed, mutual + asym, n * (n - 1) // 2)
    forward = uniform(seed, F.lit("way"), F.col("gid"), F.col("src"), F.col("dst")) < 0.5
    r = r.withColumn("way", F.when(F.col("rank") <= mutual, 2).when(forward, 1).otherwise(0))
    there = r.filter("way >= 1").select("gid", "src", "dst")
    back = r.filter("way <> 1").select("gid", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return _net(spark, n, m, there.unionAll(back), True, m > 1)


def permutations(vertices: DataFrame, n_sim: int, seed: int = 0, mode1: int | None = None) -> DataFrame:
    """(rep, vid, new): ``n_sim`` uniform permutations of the vertices (vid); of a two-mode net within each mode."""
    spark = vertices.sparkSession
    side = (F.col("vid") <= mode1) if mode1 is not None else F.lit(True)
    v = vertices.select("vid", side.alias("side"))
    reps = spark.range(n_sim).select(F.col("id").alias("rep"))
    drawn = v.join(reps).withColumn("place", F.row_number().over(Window.partitionBy("rep", "side").orderBy(digest(seed, F.col("rep"), F.col("vid")), "vid")))
    named = v.withColumn("place", F.row_number().over(Window.partitionBy("side").orderBy("vid"))).withColumnRenamed("vid", "new")
    return drawn.join(named, ["side", "place"]).select("rep", "vid", "new")
