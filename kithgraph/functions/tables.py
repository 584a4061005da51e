"""Intermediate tables on storage that all executors share, and connected components over them."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ship import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a fresh temporary one only where that is unset and all tasks are local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kithgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/kg-{tag}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget_path(spark: SparkSession, path: str) -> None:
    try:
        delete_path(spark, path)
    except Exception:  # the session is gone
        pass


def stored(df: DataFrame, tag: str, share: int = 1) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage and survives lost executors.

    Slim tables are written by fewer tasks, one for ``share`` shuffle partitions, as small files cost more than what is in them.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    if share > 1:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // share))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kg_path = path
    atexit.register(forget_path, spark, path)
    return out


def unstore(df: DataFrame) -> None:
    """Deletes a table made by ``stored`` that no later plan reads."""
    delete_path(df.sparkSession, df._kg_path)


#: Links that one task joins into components; more are contracted in rounds over stored tables.
LINKS_PER_TASK = 500_000


def contract(p: np.ndarray, q: np.ndarray, size: int) -> np.ndarray:
    """The smallest node that each of 0 .. size - 1 reaches by the links p, q: roots hook to smaller ones until none can."""
    low = np.arange(size)
    while True:
        m = np.minimum(low[p], low[q])
        new = low.copy()
        for end in (p, q):
            np.minimum.at(new, low[end], m)
            np.minimum.at(new, end, m)
        while (new[new] != new).any():
            new = new[new]
        if (new == low).all():
            return low
        low = new


def _values(column: pa.Array) -> np.ndarray:
    """The values of a column, as numpy orders them; a struct's as records."""
    if pa.types.is_struct(column.type):
        return np.rec.fromarrays([_values(x) for x in column.flatten()], names=[f.name for f in column.type])
    return np.asarray(column, dtype=object if pa.types.is_string(column.type) else None)


def _column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays([_column(values[f.name], f.type) for f in kind], fields=list(kind))
    return pa.array(values, kind)


def _contracted(batches):
    """(node, component) of links (a, b) that one task holds."""
    held = [x for x in batches if x.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    both = pa.concat_arrays([table.column(c).combine_chunks() for c in (0, 1)])
    node, at = np.unique(_values(both), return_inverse=True)
    low = contract(at[: table.num_rows], at[table.num_rows :], len(node))
    yield pa.RecordBatch.from_arrays([_column(x, both.type) for x in (node, node[low])], ["node", "component"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the smallest node reachable.

    Alternating large-star and small-star rounds; each round's edges are written to the shared folder,
    so no round's lineage grows and no links reach the driver. Both stars replace an edge by an edge to
    the neighbourhood's minimum, which ``min`` pre-aggregates, so a node with very many links stays cheap.
    Up to LINKS_PER_TASK links, counted first, one task contracts all at once, with the same result.
    Nodes are of any type with an order. Null ends and self links are ignored; an empty table gives an empty result.
    """
    cur = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "cc", 16)
    number = cur.count()
    kind = cur.schema["a"].dataType.simpleString()
    if number <= LINKS_PER_TASK and set(re.sub(r"struct<|\w+:|>", "", kind).split(",")) <= {"int", "bigint", "string"}:
        ship(cur.sparkSession)
        out = stored(cur.coalesce(1).mapInArrow(_contracted, f"node {kind}, component {kind}"), "cc")
        unstore(cur)
        return out
    for _ in range(most_rounds):
        if not number:
            break
        both = cur.unionAll(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: every larger neighbour of v is linked to the smallest of v and its neighbours
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        # small star: every smaller neighbour of v, and v, are linked to the smallest
        low = large.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("m"))
        joined = large.join(low, large.b == low.v)
        small = joined.select(F.col("m").alias("x"), F.col("a").alias("y")).unionAll(low.select(F.col("m").alias("x"), F.col("v").alias("y")))
        small = small.filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        new = stored(small, "cc")
        before, number = number, new.count()
        # a star's edges are distinct: equal numbers and none that is new
        same = number == before and new.join(cur, ["a", "b"], "left_anti").isEmpty()
        unstore(cur)
        cur = new
        if same:
            break
    else:
        raise RuntimeError("components did not converge")
    out = cur.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    return out.unionAll(cur.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
