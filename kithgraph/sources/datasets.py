"""Published networks."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..net import Net, check_option

# Ties of the Florentine families and of Sampson's monks, and the families' wealth.
MARRIAGE = "1-9 2-6 2-7 2-9 3-5 3-9 4-7 4-11 4-15 5-11 5-15 7-8 7-16 9-13 9-14 9-16 10-14 11-15 13-15 13-16"
BUSINESS = "3-5 3-6 3-9 3-11 4-7 4-8 4-11 5-8 5-11 6-9 7-8 8-11 9-10 9-14 9-16"
WEALTH = "10 36 55 44 20 32 8 42 103 48 49 3 27 10 146 48"
LIKING = (
    "1-2 1-3 1-5 1-8 1-12 1-14 2-1 2-7 2-12 2-14 2-15 3-1 3-2 3-13 3-17 3-18 4-5 4-6 4-10 4-11 5-1 5-4 5-9 5-11 5-13 6-1 6-4 6-5 6-9 "
    "7-1 7-2 7-8 7-12 7-16 8-1 8-2 8-4 8-6 8-9 8-10 9-5 9-8 9-12 9-16 10-4 10-5 10-8 10-9 10-13 10-14 11-4 11-5 11-8 11-14 11-16 "
    "12-1 12-2 12-7 12-14 13-5 13-7 13-18 14-1 14-2 14-11 14-12 14-15 15-1 15-2 15-5 15-7 15-12 15-14 16-1 16-2 16-7 16-12 16-15 "
    "17-2 17-3 17-13 17-18 18-1 18-2 18-3 18-7 18-13 18-17"
)


def _ties(text: str) -> list[tuple[int, int]]:
    return [tuple(map(int, t.split("-"))) for t in text.split()]


def load_dataset(spark: SparkSession, name: str) -> Net:
    """florentine_marriage and florentine_business (16 families, undirected, with wealth), sampson_liking (18 monks, directed)."""
    check_option("name", name, ("florentine_marriage", "florentine_business", "sampson_liking"))
    if name == "sampson_liking":
        return Net.of(spark, 18, _ties(LIKING))
    net = Net.of(spark, 16, _ties(MARRIAGE if name.endswith("marriage") else BUSINESS), directed=False)
    wealth = spark.createDataFrame([(v, int(w)) for v, w in enumerate(WEALTH.split(), 1)], "vid long, value long")
    return net.set_vertex_attribute("wealth", wealth)
