"""Reading and writing networks: Parquet, edge-list CSV, Pajek and GraphML."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..net import Net


def write_parquet(net: Net, path: str) -> None:
    """Vertices, ties, mask and flags under one folder."""
    net.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    net.edges.write.mode("overwrite").parquet(f"{path}/edges")
    mask = net.mask if net.mask is not None else net.spark.createDataFrame([], "gid long, src long, dst long")
    mask.write.mode("overwrite").parquet(f"{path}/mask")
    flags = {"directed": net.directed, "loops": net.loops, "mode1": net.mode1, "many": net.many, "valued": net.valued, "masked": net.mask is not None, "attributes": net.attributes}
    net.spark.createDataFrame([(json.dumps(flags),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/flags")


def read_parquet(spark: SparkSession, path: str) -> Net:
    flags = json.loads(spark.read.text(f"{path}/flags").first()["value"])
    masked = flags.pop("masked")
    return Net(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"), mask=spark.read.parquet(f"{path}/mask") if masked else None, **flags)


def write_edgelist_csv(net: Net, path: str) -> None:
    """src, dst, weight and other tie attributes, with a header, as one folder of CSV files."""
    net.out(net.edges).write.mode("overwrite").option("header", True).csv(path)


def read_edgelist_csv(spark: SparkSession, path: str, directed: bool = True, loops: bool = False, n: int | None = None) -> Net:
    rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
    vertices = spark.range(1, n + 1).select(F.col("id").alias("vid")) if n else None
    return Net.build(rows, vertices, directed, loops)


def write_pajek(net: Net, path: str) -> None:
    """A Pajek .net text: vertices numbered from 1 in order of their ids, labelled by them (and two-mode sizes), then arcs or edges."""
    place = _places(net)
    n = place.count()
    two = "" if net.mode1 is None else f" {place.filter(F.col('vid') <= net.mode1).count()}"
    lines = place.select(F.lit(1).alias("part"), "place", F.lit(0).cast("long").alias("second"), F.format_string('%d "%d"', "place", "vid").alias("value"))
    ties = _placed(net, place).select(F.lit(3).alias("part"), F.col("a").alias("place"), F.col("b").alias("second"), F.concat_ws(" ", F.col("a"), F.col("b"), F.col("weight")).alias("value"))
    heads = net.spark.createDataFrame([(0, 0, 0, f"*Vertices {n}{two}"), (2, 0, 0, "*Arcs" if net.directed else "*Edges")], "part int, place long, second long, value string")
    _text(heads.unionAll(lines).unionAll(ties), path)


def read_pajek(spark: SparkSession, path: str, loops: bool = False) -> Net:
    """From a Pajek .net text with *Vertices and *Arcs, *Edges, *Arcslist or *Edgeslist sections (case ignored, % comments).

    Both kinds of sections together make a directed network in which an edge is an arc each way. Vertex labels become the
    attribute ``label``.
    """
    rows = spark.read.text(path, wholetext=True).select("value")
    text = "\n".join(r["value"] for r in rows.collect())  # Pajek's format is one file
    labels, arcs, edges, part, n, first = [], [], [], "", 0, None
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] == "%":
            continue
        if line[0] == "*":
            words = line.split()
            part = words[0].lower()
            if part == "*vertices":
                n, first = int(words[1]), int(words[2]) if len(words) > 2 else None
        elif part == "*vertices":
            number, _, rest = line.partition(" ")
            rest = rest.strip()
            label = rest[1:].split('"')[0] if rest[:1] == '"' else rest.split()[0] if rest else number
            labels.append((int(number), label))
        elif part in ("*arcs", "*edges"):
            a, b, *w = line.split()
            (arcs if part == "*arcs" else edges).append((int(a), int(b), float(w[0]) if w else 1.0))
        elif part in ("*arcslist", "*edgeslist"):
            a, *more = line.split()
            (arcs if part == "*arcslist" else edges).extend((int(a), int(b), 1.0) for b in more)
    directed = bool(arcs) or not edges
    if directed:
        arcs += edges + [(b, a, w) for a, b, w in edges]
    net = Net.of(spark, n, arcs if directed else edges, directed, loops, first)
    return net.set_vertex_attribute("label", spark.createDataFrame(labels or [], "vid long, value string"))


def write_graphml(net: Net, path: str) -> None:
    """A GraphML text with vertex and tie attributes as data."""
    kinds = {"bigint": "long", "int": "int", "double": "double", "float": "float", "boolean": "boolean"}
    keys, node, edge = [], [], []
    for frame, of, held in ((net.vertices, "node", node), (net.edges, "edge", edge)):
        for name, kind in frame.dtypes:
            if name not in ("gid", "vid", "src", "dst"):
                keys.append(f'<key id={quoteattr(of + "_" + name)} for="{of}" attr.name={quoteattr(name)} attr.type="{kinds.get(kind, "string")}"/>')
                held.append(F.when(F.col(name).isNotNull(), F.concat(F.lit(f"<data key={quoteattr(of + '_' + name)}>"), _escaped(F.col(name).cast("string")), F.lit("</data>"))).otherwise(""))
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, f'<graph edgedefault="{"directed" if net.directed else "undirected"}">']
    zero = F.lit(0).cast("long")
    nodes = net.vertices.select(F.lit(1).alias("part"), F.col("vid").alias("place"), zero.alias("second"), F.concat(F.format_string('<node id="n%d">', "vid"), *node, F.lit("</node>")).alias("value"))
    ties = net.edges.select(F.lit(2).alias("part"), F.col("src").alias("place"), F.col("dst").alias("second"), F.concat(F.format_string('<edge source="n%d" target="n%d">', "src", "dst"), *edge, F.lit("</edge>")).alias("value"))
    frame = net.spark.createDataFrame([(0, k, 0, x) for k, x in enumerate(head)] + [(3, 0, 0, "</graph>"), (3, 1, 0, "</graphml>")], "part int, place long, second long, value string")
    _text(frame.unionAll(nodes).unionAll(ties), path)


def _escaped(c):
    for plain in "&<>":
        c = F.replace(c, F.lit(plain), F.lit(escape(plain)))
    return c


def _places(net: Net) -> DataFrame:
    """(vid, place): vertices numbered from 1 in order of their ids."""
    from pyspark.sql import Window

    return net.vertices.select("vid", F.row_number().over(Window.orderBy("vid")).cast("long").alias("place"))


def _placed(net: Net, place: DataFrame) -> DataFrame:
    a, b = place.select(F.col("vid").alias("src"), F.col("place").alias("a")), place.select(F.col("vid").alias("dst"), F.col("place").alias("b"))
    return net.edges.join(a, "src").join(b, "dst")


def _text(lines: DataFrame, path: str) -> None:
    """One text file in order: these formats are single files."""
    lines.coalesce(1).sortWithinPartitions("part", "place", "second").select("value").write.mode("overwrite").text(path)
