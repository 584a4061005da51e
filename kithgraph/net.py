"""Networks as DataFrames.

A ``Net`` is a table of vertices (gid, vid, attributes), a table of ties (gid, src, dst, weight, attributes) and
flags. ``gid`` tells graphs apart: every operator groups by it, so one job serves one graph or thousands. Undirected
ties are stored once, src <= dst; repeated ties are one.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POLICIES = ("error", "face")
#: Ties up to which adjacency is sent to all executors whole; larger networks use joins.
SMALL_TIES = 2_000_000
#: Vertices up to which a graph is handled as a dense matrix.
DENSE_VERTICES = 3000


class MaskedDyads(ValueError):
    """An operator met unobserved dyads under the policy ``error``."""


def check_option(name: str, value, allowed) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(map(repr, allowed))}; got {value!r}")


@dataclasses.dataclass(frozen=True, eq=False)
class Net:
    vertices: DataFrame
    edges: DataFrame
    directed: bool = True
    loops: bool = False
    #: two-mode networks: vertices up to this id are mode 1, all others mode 2
    mode1: int | None = None
    #: (gid, src, dst) of unobserved dyads; of an undirected network src <= dst
    mask: DataFrame | None = None
    #: whether results keep their gid column
    many: bool = False
    #: values are part of the data, as those of a matrix are (network regression reads them)
    valued: bool = False
    attributes: dict = dataclasses.field(default_factory=dict)

    # ------------------------------------------------------------ construction

    @classmethod
    def build(cls, edges: DataFrame, vertices: DataFrame | None = None, directed: bool = True, loops: bool = False, mode1: int | None = None, many: bool = False, valued: bool = False) -> Net:
        """From ties (src, dst[, weight, ...][, gid]) and vertices (vid[, ...][, gid]; default: the ties' ends).

        Repeated ties are one, with the largest weight. Loops go unless ``loops``. Ties to null ends go.
        """
        if "gid" not in edges.columns:
            edges = edges.withColumn("gid", F.lit(0).cast("long"))
        if "weight" not in edges.columns:
            edges = edges.withColumn("weight", F.lit(1.0))
        more = [c for c in edges.columns if c not in ("gid", "src", "dst", "weight")]
        ties = edges.select(F.col("gid").cast("long").alias("gid"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight"), *more)
        ties = ties.filter("src is not null and dst is not null")
        if not directed:
            ties = ties.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
        if not loops:
            ties = ties.filter("src <> dst")
        ties = ties.groupBy("gid", "src", "dst").agg(F.max("weight").alias("weight"), *[F.first(c, True).alias(c) for c in more])
        if vertices is None:
            vertices = ties.select("gid", F.col("src").alias("vid")).union(ties.select("gid", "dst")).distinct()
        if "gid" not in vertices.columns:
            vertices = vertices.withColumn("gid", F.lit(0).cast("long"))
        rest = [c for c in vertices.columns if c not in ("gid", "vid")]
        vertices = vertices.select(F.col("gid").cast("long").alias("gid"), F.col("vid").cast("long").alias("vid"), *rest)
        return cls(vertices, ties, directed, loops, mode1, None, many, valued)

    @classmethod
    def empty(cls, spark: SparkSession, n: int, directed: bool = True, loops: bool = False, mode1: int | None = None) -> Net:
        """``n`` vertices 1..n without ties."""
        return cls.build(spark.createDataFrame([], "src long, dst long"), spark.range(1, n + 1).select(F.col("id").alias("vid")), directed, loops, mode1)

    @classmethod
    def of(cls, spark: SparkSession, n: int, ties: Iterable[tuple], directed: bool = True, loops: bool = False, mode1: int | None = None) -> Net:
        """``n`` vertices 1..n and ties (src, dst) or (src, dst, weight)."""
        rows = [(int(t[0]), int(t[1]), float(t[2]) if len(t) > 2 else 1.0) for t in ties]
        return cls.build(spark.createDataFrame(rows, "src long, dst long, weight double"), spark.range(1, n + 1).select(F.col("id").alias("vid")), directed, loops, mode1)

    @classmethod
    def from_matrix(cls, spark: SparkSession, matrix, directed: bool | None = None, store_values: bool = False, loops: bool = True) -> Net:
        """From a square matrix: nonzero cells are ties, their values weights if ``store_values``."""
        a = np.asarray(matrix, dtype=float)
        if a.ndim != 2 or a.shape[0] != a.shape[1]:
            raise ValueError("a sociomatrix must be square")
        if not np.isfinite(a).all():
            raise ValueError("a sociomatrix must hold finite values")
        directed = bool((a != a.T).any()) if directed is None else directed
        rows = [(int(i) + 1, int(j) + 1, float(a[i, j]) if store_values else 1.0) for i, j in zip(*np.nonzero(a), strict=True)]
        net = cls.of(spark, len(a), rows, directed, loops)
        return dataclasses.replace(net, valued=store_values)

    @classmethod
    def from_incidence(cls, spark: SparkSession, matrix) -> Net:
        """From a p x q incidence matrix: an undirected two-mode network of p + q actors with the cells' values."""
        b = np.asarray(matrix, dtype=float)
        if not np.isfinite(b).all():
            raise ValueError("an incidence matrix must hold finite values")
        p, q = b.shape
        net = cls.of(spark, p + q, [(int(i) + 1, p + int(j) + 1, b[i, j]) for i, j in zip(*np.nonzero(b), strict=True)], False, False, p)
        return dataclasses.replace(net, valued=True)

    def replace(self, **changes) -> Net:
        return dataclasses.replace(self, **changes)

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    # ------------------------------------------------------------ size and topology

    def nv(self) -> int:
        return self.vertices.count()

    def ne(self) -> int:
        return self.edges.count()

    def has_vertex(self, v: int) -> bool:
        return not self.vertices.filter(F.col("vid") == v).isEmpty()

    def has_edge(self, i: int, j: int) -> bool:
        hit = (F.col("src") == i) & (F.col("dst") == j)
        if not self.directed:
            hit |= (F.col("src") == j) & (F.col("dst") == i)
        return not self.edges.filter(hit).isEmpty()

    def is_directed(self) -> bool:
        return self.directed

    def sizes(self) -> DataFrame:
        """(gid, n): a row a graph, empty graphs too if they have vertices."""
        return self.vertices.groupBy("gid").agg(F.count(F.lit(1)).alias("n"))

    def with_n(self, frame: DataFrame) -> DataFrame:
        """``frame`` (gid, ...) with its graph's n."""
        return frame.join(self.sizes(), "gid")

    def out(self, frame: DataFrame) -> DataFrame:
        """A result: without gid unless the net holds many graphs."""
        return frame if self.many else frame.drop("gid")

    # ------------------------------------------------------------ ties as arcs

    def arcs(self, diag: bool = False, ignore_eval: bool = True, attr: str = "weight") -> DataFrame:
        """(gid, src, dst, w): the cells of the sociomatrix that are not 0, both ways for undirected ties."""
        value = F.lit(1.0) if ignore_eval else F.col(attr).cast("double")
        ties = self.edges.select("gid", "src", "dst", value.alias("w"))
        if not diag:
            ties = ties.filter("src <> dst")
        if not ignore_eval:
            ties = ties.filter("w <> 0")
        if self.directed:
            return ties
        return ties.unionAll(ties.filter("src <> dst").select("gid", F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))

    def symmetrized(self, rule: str = "weak") -> DataFrame:
        """(gid, u, v), both ways, without loops: ties in either direction (weak) or in both (strong)."""
        check_option("symmetrize", rule, ("weak", "strong"))
        arcs = self.arcs().select("gid", F.col("src").alias("u"), F.col("dst").alias("v"))
        if not self.directed:
            return arcs
        back = arcs.select("gid", F.col("v").alias("u"), F.col("u").alias("v"))
        return arcs.intersect(back) if rule == "strong" else arcs.union(back).distinct()

    def check_values(self, attr: str = "weight") -> None:
        bad = self.edges.filter(F.col(attr).isNull() | F.isnan(attr) | (F.abs(attr) == float("inf")))
        if not bad.isEmpty():
            raise ValueError(f"tie values of {attr!r} must be finite")

    # ------------------------------------------------------------ neighbours

    def outneighbors(self, v: int) -> DataFrame:
        return self.arcs(diag=True).filter(F.col("src") == v).select(F.col("dst").alias("vid"))

    def inneighbors(self, v: int) -> DataFrame:
        return self.arcs(diag=True).filter(F.col("dst") == v).select(F.col("src").alias("vid"))

    neighbors = outneighbors

    def outdegree(self) -> DataFrame:
        return self._degrees("src")

    def indegree(self) -> DataFrame:
        return self._degrees("dst")

    def _degrees(self, end: str) -> DataFrame:
        got = self.arcs(diag=True).groupBy("gid", F.col(end).alias("vid")).agg(F.count(F.lit(1)).alias("degree"))
        return self.out(self.vertices.select("gid", "vid").join(got, ["gid", "vid"], "left").fillna(0, ["degree"]))

    def degree(self) -> DataFrame:
        """In- plus out-ties of a directed network's vertices, ties of an undirected one's."""
        if not self.directed:
            return self.outdegree()
        arcs = self.arcs(diag=True)
        both = arcs.select("gid", F.col("src").alias("vid")).unionAll(arcs.select("gid", F.col("dst").alias("vid")))
        got = both.groupBy("gid", "vid").agg(F.count(F.lit(1)).alias("degree"))
        return self.out(self.vertices.select("gid", "vid").join(got, ["gid", "vid"], "left").fillna(0, ["degree"]))

    # ------------------------------------------------------------ changed copies

    def with_vertices(self, more: DataFrame) -> Net:
        if "gid" not in more.columns:
            more = more.withColumn("gid", F.lit(0).cast("long"))
        return self.replace(vertices=self.vertices.unionByName(more.withColumn("vid", F.col("vid").cast("long")), allowMissingColumns=True).dropDuplicates(["gid", "vid"]))

    def without_vertices(self, gone: DataFrame) -> Net:
        """Without these vertices (vid) and their ties."""
        gone = gone.select(F.col("vid").cast("long").alias("gone")).distinct()
        ties = self.edges.join(gone, F.col("src") == F.col("gone"), "left_anti").join(gone, F.col("dst") == F.col("gone"), "left_anti")
        return self.replace(vertices=self.vertices.join(gone, F.col("vid") == F.col("gone"), "left_anti"), edges=ties)

    def induced(self, keep: DataFrame) -> Net:
        """The network of these vertices (vid) and the ties among them."""
        keep = keep.select(F.col("vid").cast("long").alias("keep")).distinct()
        ties = self.edges.join(keep, F.col("src") == F.col("keep"), "left_semi").join(keep, F.col("dst") == F.col("keep"), "left_semi")
        return self.replace(vertices=self.vertices.join(keep, F.col("vid") == F.col("keep"), "left_semi"), edges=ties)

    def with_edges(self, more: DataFrame) -> Net:
        new = Net.build(self.edges.unionByName(_gid(more).withColumn("src", F.col("src").cast("long")), allowMissingColumns=True).fillna(1.0, ["weight"]), self.vertices, self.directed, self.loops)
        return self.replace(edges=new.edges)

    def without_edges(self, gone: DataFrame) -> Net:
        gone = gone.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        if not self.directed:
            gone = gone.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        return self.replace(edges=self.edges.join(gone.distinct(), ["src", "dst"], "left_anti").select(self.edges.columns))

    # ------------------------------------------------------------ attributes

    def set_vertex_attribute(self, name: str, value: DataFrame | Column) -> Net:
        """``value``: a column over the vertices, or a table (vid, value)."""
        if isinstance(value, Column):
            return self.replace(vertices=self.vertices.withColumn(name, value))
        keep = self.vertices.drop(name)
        return self.replace(vertices=keep.join(value.select("vid", F.col("value").alias(name)), "vid", "left").select(*keep.columns, name))

    def get_vertex_attribute(self, name: str) -> DataFrame:
        return self.out(self.vertices.select("gid", "vid", F.col(name).alias("value")))

    vertex_attribute_vector = get_vertex_attribute

    def delete_vertex_attribute(self, name: str) -> Net:
        return self.replace(vertices=self.vertices.drop(name))

    def set_edge_attribute(self, name: str, value: Column) -> Net:
        return self.replace(edges=self.edges.withColumn(name, value))

    def get_edge_attribute(self, name: str) -> DataFrame:
        return self.out(self.edges.select("gid", "src", "dst", F.col(name).alias("value")))

    def delete_edge_attribute(self, name: str) -> Net:
        return self.replace(edges=self.edges.drop(name))

    def set_network_attribute(self, name: str, value) -> Net:
        return self.replace(attributes={**self.attributes, name: value})

    def get_network_attribute(self, name: str):
        return self.attributes[name]

    def delete_network_attribute(self, name: str) -> Net:
        return self.replace(attributes={k: v for k, v in self.attributes.items() if k != name})

    def list_vertex_attributes(self) -> list[str]:
        return [c for c in self.vertices.columns if c not in ("gid", "vid")]

    def list_edge_attributes(self) -> list[str]:
        return [c for c in self.edges.columns if c not in ("gid", "src", "dst")]

    def list_network_attributes(self) -> list[str]:
        return sorted(self.attributes)

    # ------------------------------------------------------------ export

    def as_edgelist(self) -> DataFrame:
        return self.out(self.edges.select("gid", "src", "dst"))

    def as_dataframe(self) -> DataFrame:
        return self.out(self.edges)

    def sociomatrix(self, diag: bool = False, ignore_eval: bool = True, attr: str = "weight") -> DataFrame:
        """(i, j, value) of all cells that are not 0."""
        if not ignore_eval:
            self.check_values(attr)
        return self.out(self.arcs(diag, ignore_eval, attr).select("gid", F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("value")))

    def as_matrix(self, attr: str | None = None, diag: bool = True) -> np.ndarray:
        """The dense sociomatrix of one graph with vertices in order of their ids."""
        if self.nv() > DENSE_VERTICES:
            raise ValueError(f"{self.nv()} vertices are too many for a dense matrix")
        ids = [r["vid"] for r in self.vertices.select("vid").orderBy("vid").collect()]
        at = {v: k for k, v in enumerate(ids)}
        out = np.zeros((len(ids), len(ids)))
        for r in self.arcs(diag, attr is None, attr or "weight").collect():
            out[at[r["src"]], at[r["dst"]]] = r["w"]
        return out

    def as_incidence(self) -> np.ndarray:
        """The p x q incidence matrix of a two-mode network."""
        if self.mode1 is None:
            raise ValueError("only a two-mode network has an incidence matrix")
        a = self.as_matrix("weight" if self.valued else None)
        return a[: self.mode1, self.mode1 :]

    as_adjacency_matrix = as_matrix

    # ------------------------------------------------------------ unobserved dyads

    def _pairs(self, pairs) -> DataFrame:
        if not isinstance(pairs, DataFrame):
            pairs = self.spark.createDataFrame([(int(i), int(j)) for i, j in pairs], "src long, dst long")
        pairs = _gid(pairs).select("gid", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        if self.directed:
            return pairs.distinct()
        return pairs.select("gid", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()

    def set_missing_dyads(self, pairs) -> Net:
        new = self._pairs(pairs)
        return self.replace(mask=new if self.mask is None else self.mask.union(new).distinct())

    def delete_missing_dyads(self, pairs) -> Net:
        return self if self.mask is None else self.replace(mask=self.mask.join(self._pairs(pairs), ["gid", "src", "dst"], "left_anti"))

    def clear_missing_dyads(self) -> Net:
        return self.replace(mask=None)

    def missing_dyads(self) -> DataFrame:
        found = self.mask if self.mask is not None else self.spark.createDataFrame([], "gid long, src long, dst long")
        return self.out(found)

    def n_missing_dyads(self) -> int:
        return 0 if self.mask is None else self.mask.count()

    def is_missing_dyad(self, i: int, j: int) -> bool:
        return self.mask is not None and not self.mask.join(self._pairs([(i, j)]), ["gid", "src", "dst"], "left_semi").isEmpty()


def _gid(frame: DataFrame) -> DataFrame:
    return frame if "gid" in frame.columns else frame.withColumn("gid", F.lit(0).cast("long"))


def missing_policies() -> tuple[str, ...]:
    return POLICIES


def require_observed(net: Net, policy: str, context: str) -> None:
    """Raises if ``policy`` is error and the net has unobserved dyads; under face their stored values count."""
    if policy not in POLICIES:
        raise ValueError(f"{context}: missing must be one of {POLICIES}, not {policy!r}")
    if policy == "error" and net.mask is not None and not net.mask.isEmpty():
        raise MaskedDyads(f"{context}: some dyads of the network are unobserved; pass missing='face' to take them at their stored values")


def supports_missing(operator) -> bool:
    """No operator estimates unobserved dyads; all refuse them or take their face values."""
    return False


def observed(operator):
    """Adds the option ``missing`` to an operator over a net."""

    @functools.wraps(operator)
    def run(net, *args, missing: str = "error", **kwargs):
        require_observed(net, missing, operator.__name__)
        return operator(net, *args, **kwargs)

    return run


def per_graph(net: Net, function, schema: str, diag: bool = False, ignore_eval: bool = True, attr: str = "weight", arcs: DataFrame | None = None) -> DataFrame:
    """``function(vids, matrix)`` -> dict of columns, for each graph as a dense matrix, in one task a graph.

    For graphs of at most DENSE_VERTICES vertices; larger ones raise inside their task.
    """
    arcs = net.arcs(diag, ignore_eval, attr) if arcs is None else arcs
    rows = net.vertices.select("gid", F.col("vid").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(0.0).alias("w"))
    rows = rows.unionAll(arcs.select("gid", F.col(arcs.columns[1]).alias("a"), F.col(arcs.columns[2]).alias("b"), F.col("w") if "w" in arcs.columns else F.lit(1.0).alias("w")))
    names = [x.split()[0] for x in schema.split(",")]
    types = rows.sparkSession.createDataFrame([], "gid long, " + schema).schema

    def run(key, table):
        a, w = np.asarray(table.column("a")), np.asarray(table.column("w"))
        b = table.column("b").to_pandas().to_numpy(dtype=float, na_value=np.nan)
        vertex = np.isnan(b)
        ids = np.sort(a[vertex])
        if len(ids) > DENSE_VERTICES:
            raise ValueError(f"a graph of {len(ids)} vertices is too large for this operator")
        m = np.zeros((len(ids), len(ids)))
        m[np.searchsorted(ids, a[~vertex]), np.searchsorted(ids, b[~vertex].astype(np.int64))] = w[~vertex]
        got = function(ids, m)
        size = len(next(iter(got.values())))
        gid = key[0].as_py()
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(types)
        return pa.Table.from_arrays([pa.array([gid] * size, pa.int64())] + [pa.array(got[c], kinds.field(c).type, from_pandas=False) for c in names], ["gid", *names])

    return rows.groupBy("gid").applyInArrow(run, "gid long, " + schema)


def per_graph_ties(net: Net, function, schema: str, arcs: DataFrame, alone: bool = False) -> DataFrame:
    """``function(vids, a, b, w)`` -> dict of columns, for each graph as its ties, places in the sorted vids, in one task a graph.

    Of any number of vertices. Those without ties, and so graphs without any, are left out unless ``alone``.
    """
    u, v = arcs.columns[1:3]
    rows = arcs.select("gid", F.col(u).alias("a"), F.col(v).alias("b"), F.col("w") if "w" in arcs.columns else F.lit(1.0).alias("w"))
    if alone:
        rows = rows.unionAll(net.vertices.select("gid", F.col("vid").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(0.0).alias("w")))
    names = [x.split()[0] for x in schema.split(",")]
    types = rows.sparkSession.createDataFrame([], "gid long, " + schema).schema

    def run(key, table):
        from pyspark.sql.pandas.types import to_arrow_schema

        ties = table.filter(table.column("b").is_valid())
        every, a, b, w = (np.asarray(c) for c in (table.column("a"), ties.column("a"), ties.column("b"), ties.column("w")))
        ids = np.unique(np.concatenate([every, b]))
        got = function(ids, np.searchsorted(ids, a), np.searchsorted(ids, b), w)
        size, kinds = len(got[names[0]]), to_arrow_schema(types)
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * size, pa.int64())] + [pa.array(got[c], kinds.field(c).type, from_pandas=False) for c in names], ["gid", *names])

    return rows.groupBy("gid").applyInArrow(run, "gid long, " + schema)
