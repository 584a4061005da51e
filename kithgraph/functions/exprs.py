"""Column expressions: divisions that give NaN and infinities, and reproducible random numbers."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def nan_div(a: Column, b: Column) -> Column:
    """a / b as IEEE doubles divide: 0/0 is NaN and x/0 infinite, where Spark's own division raises."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, a / b).when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))


def text_key(*parts) -> Column:
    return F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def digest(*parts) -> Column:
    """A random-looking order of the parts' values, the same on every engine and partitioning."""
    return F.md5(text_key(*parts))


def uniform(*parts) -> Column:
    """A number in [0, 1) made from the parts' values."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def t_tail(spark: SparkSession, t: float, df: float) -> tuple[float, float]:
    """(P(T <= t), P(T >= t)) of Student's t with ``df`` degrees of freedom."""
    if t != t or df <= 0:
        return NAN, NAN
    dist = spark._jvm.org.apache.commons.math3.distribution.TDistribution(float(df))
    return float(dist.cumulativeProbability(float(t))), float(dist.cumulativeProbability(-float(t)))


def t_quantile(spark: SparkSession, p: float, df: float) -> float:
    return float(spark._jvm.org.apache.commons.math3.distribution.TDistribution(float(df)).inverseCumulativeProbability(float(p)))
