"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells (operator 7).

Vectors equal in label and every component are one class. Classes are assigned to the cell of their nearest centre and
to every cell whose border they lie close to; a cell's classes are dealt into blocks by a hash, and every pair
of blocks of a cell and label is one product. A product sends no pairs on: per vector its number of links, and links
that span what it found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored

#: Vectors that centres are fitted on (about), vectors of a cell (about), most cells, rounds of k-means.
FIT, PER_CELL, MOST_CELLS, ROUNDS = 20_000, 512, 2048, 12
#: Allowance for rounding, in squared distance and in a vector's distance from a border.
ROUNDING = 1e-9
#: Classes of a block: a product's matrix holds its square of doubles.
BLOCK = 1024


def exact_margin(least: float) -> float:
    """Distance to the border with a cell within which a vector is compared in that cell too.

    Two vectors of cosine ``least`` are sqrt(2 - 2 least) apart. If they are at home on different sides of a border, one of them
    is within half of that of it, and so stands in the other's home: every pair of at least that cosine meets in a home.
    """
    return float(np.sqrt(max(0.0, 2 - 2 * least) + ROUNDING)) / 2


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def spherical_kmeans(sample: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """``k`` unit centres of unit vectors; an empty cell takes the vector that fits its own worst."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        home, fits = np.zeros(len(sample), np.int64), np.zeros(len(sample))
        for lo in range(0, len(sample), 2048):
            dots = sample[lo : lo + 2048] @ centres.T
            home[lo : lo + 2048], fits[lo : lo + 2048] = dots.argmax(axis=1), dots.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        norms = np.linalg.norm(sums, axis=1)
        worst = iter(np.argsort(fits, kind="stable"))
        for c in np.flatnonzero(norms < 1e-9):
            sums[c] = sample[next(worst)]
            norms[c] = 1.0
        centres = sums / norms[:, None]
    return centres


def assign(vectors: np.ndarray, centres: np.ndarray, margin: float) -> list[np.ndarray]:
    """For each unit vector its home cell, then the cells whose border with the home is within ``margin``."""
    dots = vectors @ centres.T
    home = dots.argmax(axis=1)
    gap = dots[np.arange(len(vectors)), home][:, None] - dots
    # a root of what rounds near 0 may be too small by the root of the rounding
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (centres @ centres.T)) + ROUNDING)[home]
    near = gap <= margin * apart + ROUNDING
    near[np.arange(len(vectors)), home] = False
    return [np.concatenate([[h], np.flatnonzero(row)]) for h, row in zip(home, near, strict=True)]


def batch_matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column without nulls, all of one length, as doubles."""
    flat = column.flatten()
    return np.asarray(flat, dtype=np.float64).reshape(len(column), -1)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, per_cell: int = PER_CELL, margin: float = 0.0, fit: int = FIT) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id, kept.

    Two vectors link if their labels are equal and not null and their cosine in doubles is at least ``least``. Vectors that are
    null, empty, zero or hold a null or non-finite component link with nothing: their component is themselves. Vectors
    of different lengths never link. Of a component the smallest identifier is kept; a null identifier links as others do but is
    no component's smallest unless all are null. Rows that repeat an identifier are vectors of their own. Other
    columns are ignored; an empty table gives an empty result. Centres are fitted on about ``fit`` vectors; all are
    assigned and compared. Equal vectors are compared once. All links are found: the margin of cells follows from ``least``,
    and ``margin`` can only widen it.
    """
    spark = vectors.sparkSession
    margin = max(margin, exact_margin(least))
    v = F.col(vector_col).cast("array<double>")
    usable = F.col(label_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v"), F.coalesce(usable, F.lit(False)).alias("usable"))
    # -0.0 and 0.0 are equal; a hash of the components tells classes apart, the components themselves decide
    key = F.when(F.col("usable"), F.sha2(F.concat_ws(",", F.col("label"), F.transform("v", lambda x: (x + 0.0).cast("string"))), 256))
    rows = stored(rows.withColumn("class", key), "vectors")
    classes = rows.filter("usable").groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = stored(classes.withColumn("dim", F.size("v")).withColumn("node", F.monotonically_increasing_id()), "classes")

    # centres only where vectors of one length are many enough for several cells; all others of a length are one cell
    centres = {}
    for dim, number in sorted((r["dim"], r["count"]) for r in classes.groupBy("dim").count().filter(F.col("count") >= 2 * per_cell).collect()):
        own = classes.filter(F.col("dim") == dim)
        pick = own if number <= fit else own.filter(F.pmod(F.xxhash64("class"), F.lit(1_000_000)) < 1_000_000 * fit // number)
        sample = np.array([r["v"] for r in pick.orderBy("class").select("v").collect()], dtype=np.float64).reshape(-1, dim)
        if len(sample):
            sample = unit(sample / np.abs(sample).max(axis=1, keepdims=True))
            centres[dim] = spherical_kmeans(sample, min(MOST_CELLS, number // per_cell, len(sample)))
    sent = spark.sparkContext.broadcast(centres)
    names = ["node", "label", "n", "dim", "cell", "home", "cells", "x"]

    def to_cells(batches):
        for batch in batches:
            dims = np.asarray(batch.column(4))
            for dim in np.unique(dims):
                some = pa.Table.from_batches([batch]).filter(pa.array(dims == dim)).combine_chunks().to_batches()
                for part in (x.slice(lo, 2048) for x in some for lo in range(0, x.num_rows, 2048)):
                    x = batch_matrix(part.column(2))
                    x = unit(x / np.abs(x).max(axis=1, keepdims=True))
                    found = assign(x, sent.value[dim], margin) if dim in sent.value else [np.zeros(1, np.int64)] * len(x)
                    at = np.repeat(np.arange(len(found)), [len(f) for f in found])
                    cell = np.concatenate(found).astype(np.int32)
                    homes = np.array([f[0] for f in found], dtype=np.int32)[at]
                    blob, lists = [row.tobytes() for row in x], [f.astype(np.int32).tobytes() for f in found]
                    take = pa.array(at, pa.int64())
                    own = [part.column(k).take(take) for k in (0, 1, 3, 4)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(cell), pa.array(homes), pa.array(lists, pa.binary()).take(take), pa.array(blob, pa.binary()).take(take)], names)

    placed = classes.select("node", "label", "v", "n", "dim").mapInArrow(to_cells, "node long, label string, n long, dim int, cell int, home int, cells binary, x binary")
    edges, links = block_links(stored(placed, "cells"), least)

    groups = components(edges)
    told = classes.join(groups.withColumnRenamed("node", "g"), F.col("node") == F.col("g"), "left").withColumn("component", F.coalesce("component", "node"))
    told = told.join(links.groupBy(F.col("node").alias("l")).agg(F.sum("links").alias("links")), F.col("node") == F.col("l"), "left")
    told = stored(told.select("class", "n", "first", "component", F.coalesce("links", F.lit(0)).alias("links")), "told")
    least_id = told.groupBy(F.col("component").alias("c")).agg(F.min("first").alias("component_id"))
    told = told.join(least_id, F.col("component") == F.col("c")).select(F.col("class").alias("k"), (F.col("n") - 1 + F.col("links")).alias("n_links"), "component_id")
    told = stored(told, "links")
    out = rows.join(told, rows["class"] == told.k, "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def block_links(placed: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(links (a, b) that span what each product found; (node, links) to be summed) of all pairs of blocks."""
    sizes = placed.groupBy("dim", "label", "cell").count().select(F.col("dim").alias("d"), F.col("label").alias("l"), F.col("cell").alias("c"), F.greatest(F.lit(1), F.ceil(F.col("count") / BLOCK)).cast("int").alias("blocks"))
    sizes = stored(sizes, "sizes")
    dealt = placed.join(sizes, (F.col("dim") == F.col("d")) & (F.col("label") == F.col("l")) & (F.col("cell") == F.col("c"))).drop("d", "l", "c")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a block meets itself and all others of its cell: it is sent to each pair (i, j), i <= j
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sent = dealt.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def compare(key, table):
        i, j = (int(k.as_py()) for k in key[3:])
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float64).reshape(table.num_rows, -1)
        node, n, block, home = (np.asarray(table.column(c)) for c in ("node", "n", "block", "home"))
        cell = int(key[2].as_py())
        left, right = (np.flatnonzero(block == b) for b in (i, j))
        # the cells, apart from this one, in which a vector at home here stands too
        lists = [np.frombuffer(c, np.int32) for c in table.column("cells").to_pylist()]
        width = max(int(c.max()) for c in lists) + 1
        stands = np.sort(np.concatenate([r * width + c for r, c in enumerate(lists) if home[r] == cell] or [np.zeros(0, np.int64)]))
        out_a, out_b, degree = [], [], np.zeros(table.num_rows, np.int64)
        for lo in range(0, len(left), BLOCK):
            rows = left[lo : lo + BLOCK]
            for ro in range(0, len(right), BLOCK):
                cols = right[ro : ro + BLOCK]
                p, q = np.nonzero(x[rows] @ x[cols].T >= least)
                p, q = rows[p], cols[q]
                # a pair counts once: in the smaller home of the two if both stand there, else in the larger
                use = (p < q) if i == j else np.ones(len(p), bool)
                use &= (home[p] == cell) | (home[q] == cell)
                p, q = p[use], q[use]
                here, there = np.where(home[p] == cell, p, q), np.where(home[p] == cell, home[q], home[p])
                once = (there >= cell) | ~np.isin(here * width + there, stands)
                p, q = p[once], q[once]
                degree += np.bincount(p, weights=n[q], minlength=len(degree)).astype(np.int64)
                degree += np.bincount(q, weights=n[p], minlength=len(degree)).astype(np.int64)
                a, b = spanning(p, q, len(degree))
                out_a.append(a)
                out_b.append(b)
        a, b = (np.concatenate([*z, np.zeros(0, np.int64)]).astype(np.int64) for z in (out_a, out_b))
        some = np.flatnonzero(degree)
        return pa.Table.from_arrays(
            [pa.array(np.concatenate([node[a], node[some]])), pa.array(np.concatenate([node[b], np.full(len(some), -1)])), pa.array(np.concatenate([np.zeros(len(a), np.int64), degree[some]]))],
            ["a", "b", "links"],
        )

    found = sent.groupBy("dim", "label", "cell", "i", "j").applyInArrow(compare, "a long, b long, links long")
    found = stored(found, "products")
    return found.filter("b >= 0").select("a", "b"), found.filter("b < 0").select(F.col("a").alias("node"), "links")


def spanning(p: np.ndarray, q: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (each vector to the smallest of its group) that span the pairs: at most one a vector."""
    low = np.arange(size)
    while True:
        new = low.copy()
        np.minimum.at(new, p, low[q])
        np.minimum.at(new, q, low[p])
        new = new[new]
        if (new == low).all():
            break
        low = new
    a = np.flatnonzero(low != np.arange(size))
    return low[a], a
