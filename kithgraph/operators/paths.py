"""Shortest paths: one breadth-first search a source over adjacency that is sent to all executors, or, for
networks beyond SMALL_TIES ties, level by level as joins."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import net as sizes
from ..functions.exprs import INF, NAN, nan_div
from ..functions.tables import stored, unstore
from ..net import Net, check_option, observed
from .degree import rescaled


#: Sources searched at once, a bit each.
BLOCK = 512
#: In-neighbours that are gathered for all vertices together; the rest of a hub's come by themselves.
HUB = 32
#: Cells of bits that are turned into pairs at once.
PAIRS = 1 << 20


class Adjacency:
    """Out-neighbours of every graph as index arrays over its sorted vertices."""

    def __init__(self, gid: np.ndarray, vid: np.ndarray, eg: np.ndarray, src: np.ndarray, dst: np.ndarray):
        order = np.lexsort((vid, gid))
        gid, self.vid = gid[order], vid[order]
        self.graphs, first = np.unique(gid, return_index=True)
        self.start = np.append(first, len(gid))
        self.at = {int(g): k for k, g in enumerate(self.graphs)}
        s, t = self.place(eg, src), self.place(eg, dst)
        order = np.lexsort((t, s))
        self.target = t[order]
        self.index = np.searchsorted(s[order], np.arange(len(gid) + 1))

    def place(self, gid: np.ndarray, vid: np.ndarray) -> np.ndarray:
        out = np.zeros(len(gid), np.int64)
        for g in np.unique(gid):
            k = self.at[int(g)]
            lo, hi = self.start[k], self.start[k + 1]
            use = gid == g
            out[use] = lo + np.searchsorted(self.vid[lo:hi], vid[use])
        return out

    def neighbours(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, neighbour) of all arcs out of ``nodes``."""
        size = self.index[nodes + 1] - self.index[nodes]
        owner = np.repeat(nodes, size)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        return owner, self.target[self.index[owner] + inner]

    def backward(self) -> None:
        """Adds in-neighbours and an order of vertices by graph, those without out-arcs last, for ``search_many``."""
        graph = np.repeat(np.arange(len(self.graphs)), np.diff(self.start))
        self.order = np.lexsort((np.diff(self.index) == 0, graph))
        owner = np.repeat(np.arange(len(self.vid)), np.diff(self.index))
        order = np.argsort(self.target, kind="stable")
        self.origin = owner[order]
        self.back = np.searchsorted(self.target[order], np.arange(len(self.vid) + 1))
        indegree = np.diff(self.back)
        self.rank = np.argsort(-indegree, kind="stable")  # vertices by falling in-degree
        self.fed = self.rank[: np.count_nonzero(indegree)]

    def gather(self, rows: np.ndarray, front: np.ndarray, lo: int) -> np.ndarray:
        """For each of ``rows`` (by falling in-degree) the union of its in-neighbours' bits."""
        first, size = self.back[rows], self.back[rows + 1] - self.back[rows]
        out = front.take(self.origin[first] - lo, axis=0)
        most = min(int(size[0]), HUB) if len(size) else 0
        for k in range(1, most):
            c = int(np.searchsorted(-size, -k, side="left"))
            out[:c] |= front.take(self.origin[first[:c] + k] - lo, axis=0)
        for r in range(int(np.searchsorted(-size, -HUB, side="left"))):
            out[r] |= np.bitwise_or.reduce(front[self.origin[first[r] + HUB : first[r] + size[r]] - lo], axis=0)
        return out

    def search_many(self, sources: np.ndarray, lo: int, hi: int, level_of=None) -> np.ndarray:
        """Searches from up to 64 x words vertices of lo .. hi - 1 at once, a bit each: bits (vertex, source) of what is in reach.

        ``level_of(step, rows, new)`` gets each level's new bits. A level costs what its arcs do, for all sources together.
        """
        words = -(-len(sources) // 64)
        k = np.arange(len(sources))
        front = np.zeros((hi - lo, words), np.uint64)
        np.bitwise_or.at(front, (sources - lo, k // 64), np.uint64(1) << (k % 64).astype(np.uint64))
        seen, active, step = front.copy(), np.unique(sources), 0
        place = np.empty(hi - lo, np.int64)
        place[self.rank[(self.rank >= lo) & (self.rank < hi)] - lo] = np.arange(hi - lo)
        by_rank = self.rank[(self.rank >= lo) & (self.rank < hi)]
        fed = self.fed[(self.fed >= lo) & (self.fed < hi)]
        while len(active):
            step += 1
            if 4 * len(active) > hi - lo:
                rows = fed
            else:
                near = place[self.neighbours(active)[1] - lo]
                if 8 * len(near) < hi - lo:
                    rows = by_rank[np.unique(near)]
                else:
                    mark = np.zeros(hi - lo, bool)
                    mark[near] = True
                    rows = by_rank[np.flatnonzero(mark)]
            new = self.gather(rows, front, lo)
            new &= ~seen[rows - lo]
            alive = new.any(axis=1)
            rows, new = rows[alive], new[alive]
            front[active - lo] = 0
            front[rows - lo] = new
            seen[rows - lo] |= new
            active = rows
            if level_of is not None and len(rows):
                level_of(step, rows, new)
        return seen

    def fold(self) -> None:
        """Finds vertices of one out-arc: each leads, without a choice, to a root (of other out-degree, or on a ring of such)."""
        n = len(self.vid)
        single = np.diff(self.index) == 1
        self.next = np.arange(n)
        self.next[single] = self.target[self.index[:-1][single]]
        rounds = range(max(1, n).bit_length())
        jump = self.next
        for _ in rounds:
            jump = jump[jump]
        ring = np.unique(jump[single & single[jump]])
        single[ring], self.next[ring] = False, ring
        self.depth, jump = single.astype(np.int64), self.next
        for _ in rounds:
            self.depth, jump = self.depth + self.depth[jump], jump[jump]
        self.size = single.astype(np.int64)  # folded vertices whose way passes a folded one, itself too
        folded = np.flatnonzero(single)
        folded = folded[np.argsort(self.depth[folded], kind="stable")]
        cuts = np.searchsorted(self.depth[folded], np.arange(2, self.depth.max(initial=0) + 2))
        for lo, hi in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
            np.add.at(self.size, self.next[folded[lo:hi]], self.size[folded[lo:hi]])
        order = np.argsort(jump[folded], kind="stable")
        self.folded, owner = folded[order], jump[folded][order]  # by root, then depth
        self.roots = np.flatnonzero(~single)
        self.first = np.searchsorted(owner, np.arange(n + 1))

    def depend(self, root: int, lo: int, hi: int, total: np.ndarray) -> None:
        """Adds to ``total`` what depends on each vertex in shortest paths from ``root`` and from the vertices folded into it.

        Those start with their way to the root and go on as the root's paths do, but to vertices of that way: a target counts
        for the root and each folded vertex whose way doesn't pass it.
        """
        inner = self.folded[self.first[root] : self.first[root + 1]]
        reached, hit = 1, np.zeros(len(inner), bool)
        if self.index[root + 1] > self.index[root]:
            d, count, levels = self.search(root, lo, hi)
            reached, hit = int(np.count_nonzero(d >= 0)), d[inner - lo] >= 0
            x = np.full(hi - lo, 1.0 + len(inner))
            x[inner - lo] -= self.size[inner]
            before = x.copy()
            for u, v in reversed(levels):
                np.add.at(x, u, count[u] / count[v] * x[v])
            x -= before
            x[root - lo] = 0
            total[lo:hi] += x
        if not len(inner):
            return
        # on the ways themselves: what the root reaches beyond a way depends on the root and on every later vertex of the way
        met, beyond = {}, {}
        for v, h in zip(inner.tolist(), hit.tolist(), strict=True):
            met[v] = h + met.get(int(self.next[v]), 0)
        for v in reversed(inner.tolist()):
            own = reached - 1 - met[v]
            total[root] += own
            past = beyond.get(v, 0)
            total[v] += past + (self.size[v] - 1) * self.depth[v]
            up = int(self.next[v])
            beyond[up] = beyond.get(up, 0) + past + own

    def search(self, source: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(distance, -1 if out of reach; number of shortest paths; arcs between levels) from one vertex of a graph."""
        d, count, slot = np.full(hi - lo, -1, np.int64), np.zeros(hi - lo), np.zeros(hi - lo, np.int64)
        d[source - lo], count[source - lo] = 0, 1
        level, levels, step = np.array([source]), [], 0
        while len(level):
            step += 1
            u, v = self.neighbours(level)
            new = (d[v - lo] < 0) & (u != v)
            u, v = u[new], v[new]
            if not len(v):
                break
            u, v = u - lo, v - lo
            np.add.at(count, v, count[u])
            d[v] = step
            slot[v] = np.arange(len(v))  # one arc of each new vertex stands for it
            level = v[slot[v] == np.arange(len(v))] + lo
            levels.append((u, v))
        return d, count, levels


def adjacency(net: Net, arcs: DataFrame) -> Adjacency:
    v = net.vertices.select("gid", "vid").toArrow()
    e = arcs.toArrow()
    return Adjacency(*(np.asarray(c.combine_chunks()) if len(c) else np.zeros(0, np.int64) for c in (*v.columns, *e.columns)))


def tasks(net: Net) -> int:
    return max(int(net.spark.conf.get("spark.sql.shuffle.partitions")), net.spark.sparkContext.defaultParallelism)


def per_source(net: Net, arcs: DataFrame, function, schema: str) -> DataFrame:
    """``function(adjacency, place, lo, hi)`` -> columns, for every vertex of the net."""
    sent = net.spark.sparkContext.broadcast(adjacency(net, arcs))
    names = ["gid", *[x.split()[0] for x in schema.split(",")]]

    def run(batches):
        a = sent.value
        for batch in batches:
            gid, vid = (np.asarray(c) for c in batch.columns)
            for g, node in zip(gid, a.place(gid, vid), strict=True):
                k = a.at[int(g)]
                got = function(a, int(node), int(a.start[k]), int(a.start[k + 1]))
                if len(got[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got[0]), g)), *[pa.array(c) for c in got]], names)

    return net.vertices.select("gid", "vid").repartition(tasks(net)).mapInArrow(run, "gid long, " + schema)


def per_block(net: Net, arcs: DataFrame, function, schema: str) -> DataFrame:
    """``function(adjacency, places, lo, hi)`` -> batches of columns, for blocks of vertices of a few graphs; lo .. hi - 1 are
    all vertices of those."""
    a = adjacency(net, arcs)
    n, parts = len(a.vid), tasks(net)
    a.backward()
    width = min(BLOCK, max(64, -(-n // (4 * parts) // 64) * 64))
    sent = net.spark.sparkContext.broadcast(a)
    names = ["gid", *[x.split()[0] for x in schema.split(",")]]

    def run(batches):
        a = sent.value
        for batch in batches:
            for block in batch.column(0).to_pylist():
                places = a.order[block * width : (block + 1) * width]
                ends = np.searchsorted(a.start, places[[0, -1]], side="right")
                for got in function(a, places, int(a.start[ends[0] - 1]), int(a.start[ends[1]])):
                    if len(got[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names)

    blocks = -(-n // width)
    return net.spark.range(0, blocks, 1, max(1, min(blocks, 4 * parts))).mapInArrow(run, "gid long, " + schema)


def path_arcs(net: Net, cmode: str = "directed") -> DataFrame:
    """(gid, src, dst) that paths follow: the arcs, or both directions of each."""
    if cmode == "undirected" and net.directed:
        return net.symmetrized("weak").select("gid", F.col("u").alias("src"), F.col("v").alias("dst"))
    return net.arcs().select("gid", "src", "dst")


def too_large(net: Net, arcs: DataFrame) -> bool:
    """Whether ties or vertices are too many to be sent to all executors."""
    return arcs.count() > sizes.SMALL_TIES or net.nv() > sizes.SMALL_TIES


def distances(net: Net, cmode: str = "directed") -> DataFrame:
    """(gid, i, j, d, paths) of all pairs in reach, each vertex to itself at 0 by 1 path."""
    arcs = path_arcs(net, cmode)
    if too_large(net, arcs):
        return _distances_by_joins(net, arcs)

    def reached(a, node, lo, hi):
        d, count, _ = a.search(node, lo, hi)
        at = np.flatnonzero(d >= 0)
        return np.full(len(at), a.vid[node]), a.vid[lo + at], d[at], count[at]

    return per_source(net, arcs, reached, "i long, j long, d long, paths double")


def distance_counts(net: Net, cmode: str = "directed") -> DataFrame:
    """(gid, d, c): how many ordered pairs are at each distance, each vertex to itself at 0. No pairs are listed up to SMALL_TIES."""
    arcs = path_arcs(net, cmode)
    if too_large(net, arcs):
        return _distances_by_joins(net, arcs).groupBy("gid", "d").agg(F.count(F.lit(1)).alias("c"))

    def counted(a, places, lo, hi):
        graph = np.searchsorted(a.start, np.arange(lo, hi), side="right") - 1
        found = {0: np.bincount(graph[places - lo], minlength=len(a.graphs))}

        def level(step, rows, new):
            bits = np.bitwise_count(new).sum(axis=1, dtype=np.int64)
            if hi - lo == a.start[graph[0] + 1] - a.start[graph[0]]:
                found[step] = np.zeros(len(a.graphs), np.int64)
                found[step][graph[0]] = bits.sum()
            else:
                found[step] = np.bincount(graph[rows - lo], bits, len(a.graphs)).astype(np.int64)

        a.search_many(places, lo, hi, level)
        for step, c in found.items():
            at = np.flatnonzero(c)
            yield a.graphs[at], np.full(len(at), step), c[at]

    return per_block(net, arcs, counted, "d long, c long").groupBy("gid", "d").agg(F.sum("c").alias("c"))


def _distances_by_joins(net: Net, arcs: DataFrame) -> DataFrame:
    """The same by one join, aggregation and anti-join a level, until one is empty; each level is written to the shared folder."""
    arcs = stored(arcs, "arcs")
    found = stored(net.vertices.select("gid", F.col("vid").alias("i"), F.col("vid").alias("j"), F.lit(0).cast("long").alias("d"), F.lit(1.0).alias("paths")), "level")
    all_, level = [found], found
    for step in itertools.count(1):
        on = (level.gid == arcs.gid) & (level.j == arcs.src)
        new = level.join(arcs, on).groupBy(level.gid, level.i, arcs.dst.alias("j")).agg(F.sum("paths").alias("paths"))
        seen = all_[0]
        for more in all_[1:]:
            seen = seen.unionAll(more)
        new = new.join(seen.select("gid", "i", "j"), ["gid", "i", "j"], "left_anti")
        level = stored(new.select("gid", "i", "j", F.lit(step).cast("long").alias("d"), "paths"), "level")
        if level.isEmpty():
            break
        all_.append(level)
        if len(all_) > 8:  # one table again, so that plans stay short
            merged = all_[0]
            for more in all_[1:]:
                merged = merged.unionAll(more)
            merged = stored(merged, "levels")
            for old in all_[:-1]:
                unstore(old)
            all_ = [merged]
    out = all_[0]
    for more in all_[1:]:
        out = out.unionAll(more)
    return out


@observed
def geodist(net: Net, inf_replace: float = INF) -> DataFrame:
    """i, j, gdist, counts of all ordered pairs: distance and number of shortest paths; out of reach ``inf_replace`` and 0."""
    arcs = path_arcs(net)
    if too_large(net, arcs):
        v = net.vertices.select("gid", "vid")
        pairs = v.select("gid", F.col("vid").alias("i")).repartition(tasks(net)).join(F.broadcast(v.select("gid", F.col("vid").alias("j"))), "gid")
        # Spark can't know how many pairs there are, so it must not choose to broadcast them
        got = pairs.join(_distances_by_joins(net, arcs).hint("merge"), ["gid", "i", "j"], "left")
        return net.out(got.select("gid", "i", "j", F.coalesce(F.col("d").cast("double"), F.lit(float(inf_replace))).alias("gdist"), F.coalesce("paths", F.lit(0.0)).alias("counts")))

    def row(a, node, lo, hi):
        d, count, _ = a.search(node, lo, hi)
        return np.full(hi - lo, a.vid[node]), a.vid[lo:hi], np.where(d < 0, float(inf_replace), d), count

    return net.out(per_source(net, arcs, row, "i long, j long, gdist double, counts double"))


@observed
def reachability(net: Net) -> DataFrame:
    """(i, j) of all pairs of which j is in reach of i; every vertex reaches itself.

    Up to SMALL_TIES pairs come by j, those of a block of i together: both columns repeat, so they take little room written.
    """
    arcs = path_arcs(net)
    if too_large(net, arcs):
        return net.out(_distances_by_joins(net, arcs).select("gid", "i", "j"))

    def pairs(a, places, lo, hi):
        seen = a.search_many(places, lo, hi)
        rows = np.flatnonzero(seen.any(axis=1))
        graph = a.graphs[np.searchsorted(a.start, np.arange(lo, hi), side="right") - 1]
        size = max(1, PAIRS // len(places))
        for k in range(0, len(rows), size):
            some = rows[k : k + size]
            j, i = np.nonzero(np.unpackbits(seen[some].astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little"))
            yield graph[some[j]], a.vid[places[i]], a.vid[lo + some[j]]

    return net.out(per_block(net, arcs, pairs, "i long, j long"))


@observed
def average_path_length(net: Net) -> DataFrame:
    """Mean distance of different vertices in reach; infinite if there are none."""
    mean = distance_counts(net).filter("d > 0").groupBy("gid").agg((F.sum(F.col("d") * F.col("c")).cast("double") / F.sum("c")).alias("a"))
    return net.out(net.sizes().join(mean, "gid", "left").select("gid", F.coalesce("a", F.lit(INF)).alias("average_path_length")))


@observed
def diameter(net: Net) -> DataFrame:
    """The largest distance; infinite if any vertex is out of another's reach."""
    most = distance_counts(net).groupBy("gid").agg(F.max("d").alias("d"), F.sum("c").alias("c"))
    whole = F.col("c") == F.col("n") * F.col("n")
    return net.out(net.sizes().join(most, "gid").select("gid", F.when(whole, F.col("d").cast("double")).otherwise(F.lit(INF)).alias("diameter")))


CLOSENESS = ("directed", "undirected", "suminvdir", "suminvundir", "gil_schmidt")


@observed
def closeness(net: Net, cmode: str = "directed", rescale: bool = False) -> DataFrame:
    """(vid, score). directed/undirected: n - 1 over the sum of distances, 0 if a vertex is out of reach. suminvdir/suminvundir:
    mean of inverse distances. gil_schmidt: mean of inverse distances over the vertices in reach, 0 if none."""
    check_option("cmode", cmode, CLOSENESS)
    both = cmode in ("undirected", "suminvundir")
    d = distances(net, "undirected" if both else "directed").filter("d > 0")
    sums = d.groupBy("gid", F.col("i").alias("vid")).agg(F.count(F.lit(1)).alias("c"), F.sum("d").alias("s"), F.sum(1.0 / F.col("d")).alias("inv"))
    got = net.with_n(net.vertices.select("gid", "vid")).join(sums, ["gid", "vid"], "left").fillna(0, ["c", "s"]).fillna(0.0, ["inv"])
    others = F.col("n") - 1
    if cmode in ("directed", "undirected"):
        score = F.when(F.col("n") == 1, F.lit(NAN)).when(F.col("c") == others, nan_div(others, F.col("s"))).otherwise(F.lit(0.0))
    elif cmode == "gil_schmidt":
        score = F.when(F.col("c") > 0, F.col("inv") / F.when(F.col("c") > 0, F.col("c"))).otherwise(F.lit(0.0))
    else:
        score = nan_div(F.col("inv"), others)
    got = got.select("gid", "vid", score.alias("score"))
    return net.out(rescaled(got) if rescale else got)


@observed
def betweenness(net: Net, cmode: str = "directed", rescale: bool = False, normalized: bool = False) -> DataFrame:
    """(vid, score): sum over pairs of the share of their shortest paths that pass through. Undirected pairs count once."""
    check_option("cmode", cmode, ("directed", "undirected"))
    if rescale and normalized:
        raise ValueError("rescale and normalized exclude each other")
    arcs = path_arcs(net, cmode)
    half = not net.directed or cmode == "undirected"
    if too_large(net, arcs):
        sums = _betweenness_by_joins(net, arcs)
    else:
        sums = _dependencies(net, arcs)
    got = net.vertices.select("gid", "vid").join(sums, ["gid", "vid"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)) * F.lit(0.5 if half else 1.0))
    if normalized:
        most = (F.col("n") - 1) * (F.col("n") - 2) / F.lit(2.0 if half else 1.0)
        got = net.with_n(got).withColumn("score", F.when(F.col("n") > 2, F.col("score") / F.when(F.col("n") > 2, most)).otherwise(F.col("score"))).drop("n")
    return net.out(rescaled(got) if rescale else got)


def _dependencies(net: Net, arcs: DataFrame) -> DataFrame:
    """(gid, vid, score): Brandes' dependencies, added up in each task. One search a root serves all vertices whose only way leads to it."""
    a = adjacency(net, arcs)
    a.fold()
    sent = net.spark.sparkContext.broadcast(a)

    def run(batches):
        a, total = sent.value, np.zeros(len(sent.value.vid))
        for batch in batches:
            for node in a.roots[np.asarray(batch.column(0))]:
                k = int(np.searchsorted(a.start, node, side="right")) - 1
                a.depend(int(node), int(a.start[k]), int(a.start[k + 1]), total)
        at = np.flatnonzero(total)
        gid = a.graphs[np.searchsorted(a.start, at, side="right") - 1]
        yield pa.RecordBatch.from_arrays([pa.array(gid), pa.array(a.vid[at]), pa.array(total[at])], ["gid", "vid", "part"])

    parts = max(1, min(len(a.roots), 3 * net.spark.sparkContext.defaultParallelism))
    return net.spark.range(0, len(a.roots), 1, parts).mapInArrow(run, "gid long, vid long, part double").groupBy("gid", "vid").agg(F.sum("part").alias("score"))


def _betweenness_by_joins(net: Net, arcs: DataFrame) -> DataFrame:
    """Dependencies pass back over the arcs of shortest paths, level by level from the farthest."""
    d = stored(_distances_by_joins(net, arcs), "distances")
    u = d.select("gid", "i", F.col("j").alias("src"), F.col("d").alias("du"), F.col("paths").alias("pu"))
    v = d.select("gid", "i", F.col("j").alias("dst"), F.col("d").alias("dv"), F.col("paths").alias("pv"))
    steps = stored(u.join(arcs, ["gid", "src"]).join(v, ["gid", "i", "dst"]).filter("dv = du + 1"), "steps")
    far = d.agg(F.max("d")).first()[0] or 0
    delta, parts = None, []
    for level in range(far, 0, -1):
        here = steps.filter(F.col("dv") == level)
        if delta is not None:
            here = here.join(delta, ["gid", "i", "dst"], "left")
        gain = F.col("pu") / F.col("pv") * (1 + (F.coalesce("delta", F.lit(0.0)) if delta is not None else F.lit(0.0)))
        delta = stored(here.groupBy("gid", "i", F.col("src").alias("dst")).agg(F.sum(gain).alias("delta")), "delta")
        parts.append(delta)
    if not parts:
        return net.vertices.select("gid", "vid", F.lit(0.0).alias("score")).limit(0)
    all_ = parts[0]
    for more in parts[1:]:
        all_ = all_.unionAll(more)
    return all_.filter("i <> dst").groupBy("gid", F.col("dst").alias("vid")).agg(F.sum("delta").alias("score"))


@observed
def hierarchy(net: Net, measure: str = "reciprocity") -> DataFrame:
    """1 - dyadic reciprocity, or (krackhardt) of the pairs of which one is in reach of the other, the share not both ways."""
    check_option("measure", measure, ("reciprocity", "krackhardt"))
    if measure == "reciprocity":
        from .census import grecip

        inner = grecip(net.replace(many=True, mask=None))
        return net.out(inner.select("gid", (1 - F.col("reciprocity")).alias("hierarchy")))
    from .cohesion import strong_labels

    # both ways go the pairs within strong components; all others in reach go one way
    size = strong_labels(net).groupBy("gid", "label").agg(F.count(F.lit(1)).alias("s")) if net.directed else None
    reach = distance_counts(net).filter("d > 0").groupBy("gid").agg(F.sum("c").alias("c"))
    got = net.sizes().join(reach, "gid", "left").fillna(0, ["c"])
    if size is None:
        got = got.withColumn("both", F.expr("c div 2"))
    else:
        got = got.join(size.groupBy("gid").agg(F.sum(F.expr("s * (s - 1) div 2")).alias("both")), "gid", "left")
    one = F.col("c") - 2 * F.col("both")
    return net.out(got.select("gid", nan_div(one, one + F.col("both")).alias("hierarchy")))


def first_rank(labels: DataFrame) -> DataFrame:
    """(gid, vid, membership): groups numbered from 1 by their smallest vertex. Only the groups are ranked."""
    groups = labels.select("gid", "label").distinct()
    groups = groups.withColumn("membership", F.row_number().over(Window.partitionBy("gid").orderBy("label")).cast("long"))
    return labels.join(groups, ["gid", "label"]).select("gid", "vid", "membership")
