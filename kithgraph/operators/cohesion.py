"""Components, cores, cliques, cutpoints and bicomponents."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import net as sizes
from ..functions.exprs import nan_div
from ..functions.tables import components, stored, unstore
from ..net import Net, check_option, observed, per_graph_ties
from .paths import first_rank
from .spectral import cyclic_arcs

CONNECTED = ("strong", "weak", "recursive")
#: Times SMALL_TIES, the ends of ties up to which a graph's cores are found in one task; beyond, each round is a join.
CORE_TIES = 15


def tie_labels(net: Net, rule: str) -> DataFrame:
    """(gid, vid, label): the smallest vertex of each vertex's component over symmetrized ties."""
    ties = net.symmetrized(rule).filter("u < v").select(F.struct("gid", F.col("u").alias("vid")).alias("a"), F.struct("gid", F.col("v").alias("vid")).alias("b"))
    got = components(ties).select(F.col("node.gid").alias("gid"), F.col("node.vid").alias("vid"), F.col("component.vid").alias("label"))
    return net.vertices.select("gid", "vid").join(got, ["gid", "vid"], "left").withColumn("label", F.coalesce("label", "vid"))


def strong_labels(net: Net) -> DataFrame:
    """(gid, vid, label): the smallest vertex of each vertex's strong component: one search a graph over its ties up to SMALL_TIES."""
    arcs = net.arcs().select("gid", "src", "dst")
    if arcs.count() <= sizes.SMALL_TIES:

        def found(ids, a, b, w):
            part = strong_parts(adjacency_lists(len(ids), a, b))
            low = np.full(part.max(initial=-1) + 1, len(ids))
            np.minimum.at(low, part, np.arange(len(ids)))
            return {"vid": ids, "label": ids[low[part]]}

        got = per_graph_ties(net, found, "vid long, label long", arcs)
    else:
        got = _strong_by_joins(arcs)
    return net.vertices.select("gid", "vid").join(got, ["gid", "vid"], "left").withColumn("label", F.coalesce("label", "vid"))


def _strong_by_joins(arcs: DataFrame) -> DataFrame:
    """(gid, vid, label) of strong components of several vertices, without any pairs in reach: what lies on no cycle goes; each other
    vertex takes the largest that reaches it as its colour; those that reach their colour's vertex within it are its component."""
    left, parts = cyclic_arcs(arcs), []
    while not left.isEmpty():
        colour = stored(left.select("gid", F.col("src").alias("vid")).distinct().withColumn("colour", F.col("vid")), "colour")
        while True:
            came = left.join(colour, (left.gid == colour.gid) & (left.src == colour.vid)).groupBy(left.gid, left.dst.alias("vid")).agg(F.max("colour").alias("came"))
            new = colour.join(came, ["gid", "vid"], "left").select("gid", "vid", F.greatest("colour", "came").alias("colour"), (F.col("came") > F.col("colour")).alias("changed"))
            new = stored(new, "colour")
            unstore(colour)
            colour = new.select("gid", "vid", "colour")
            colour._kg_path = new._kg_path
            if new.filter("changed").isEmpty():
                break
        there = colour.select("gid", F.col("vid").alias("src"), "colour")
        inner = left.join(there, ["gid", "src"]).join(colour.select("gid", F.col("vid").alias("dst"), F.col("colour").alias("other")), ["gid", "dst"]).filter("colour = other")
        inner = stored(inner.select("gid", "src", "dst"), "inner")
        level = stored(colour.filter("vid = colour"), "level")
        found = level
        while True:
            back = inner.join(level, (inner.gid == level.gid) & (inner.dst == level.vid)).select(inner.gid, inner.src.alias("vid"), "colour").distinct()
            level = stored(back.join(found, ["gid", "vid"], "left_anti"), "level")
            if level.isEmpty():
                break
            found = stored(found.unionAll(level), "found")
        low = found.groupBy("gid", "colour").agg(F.min("vid").alias("label"))
        parts.append(stored(found.join(low, ["gid", "colour"]).select("gid", "vid", "label"), "part"))
        gone = parts[-1].select("gid", "vid")
        rest = left.join(gone, (left.gid == gone.gid) & (left.src == gone.vid), "left_anti")
        left = cyclic_arcs(rest.join(gone, (rest.gid == gone.gid) & (rest.dst == gone.vid), "left_anti"))
    out = arcs.select("gid", F.col("src").alias("vid"), F.col("src").alias("label")).limit(0)
    for more in parts:
        out = out.unionAll(more)
    return out


def labels(net: Net, connected: str) -> DataFrame:
    if connected == "unilateral":
        raise ValueError("unilateral components are not implemented")
    check_option("connected", connected, CONNECTED)
    if connected == "recursive":
        return tie_labels(net, "strong")
    return strong_labels(net) if net.directed and connected == "strong" else tie_labels(net, "weak")


@observed
def component_dist(net: Net, connected: str = "strong") -> DataFrame:
    """vid, membership, csize: components numbered by their smallest vertex. weak ignores direction, recursive takes mutual ties."""
    got = first_rank(labels(net, connected))
    size = got.groupBy("gid", "membership").agg(F.count(F.lit(1)).alias("csize"))
    return net.out(got.join(size, ["gid", "membership"]).select("gid", "vid", "membership", "csize"))


@observed
def component_sizes(net: Net, connected: str = "strong") -> DataFrame:
    """csize, n: how many components have each size that occurs."""
    size = labels(net, connected).groupBy("gid", "label").agg(F.count(F.lit(1)).alias("csize"))
    return net.out(size.groupBy("gid", "csize").agg(F.count(F.lit(1)).alias("n")))


@observed
def largest_component(net: Net, connected: str = "strong") -> DataFrame:
    """The vertices of the largest component; of equal ones, of that with the smallest vertex."""
    got = labels(net, connected)
    size = got.groupBy("gid", "label").agg(F.count(F.lit(1)).alias("csize"))
    best = size.groupBy("gid").agg(F.max(F.struct("csize", (-F.col("label")).alias("low"))).alias("m")).select("gid", (-F.col("m.low")).alias("label"))
    return net.out(got.join(best, ["gid", "label"]).select("gid", "vid"))


@observed
def connectedness(net: Net) -> DataFrame:
    """The share of pairs in the same weak component; 1 of fewer than two vertices."""
    size = tie_labels(net, "weak").groupBy("gid", "label").agg(F.count(F.lit(1)).alias("s"))
    sums = size.groupBy("gid").agg(F.sum("s").alias("n"), F.sum(F.col("s") * (F.col("s") - 1)).alias("joined"))
    value = F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(nan_div(F.col("joined"), F.col("n") * (F.col("n") - 1)))
    return net.out(sums.select("gid", value.alias("connectedness")))


@observed
def efficiency(net: Net) -> DataFrame:
    """1 less the share of arcs beyond those that keep the weak components whole, of all there could be; NaN if none could."""
    size = tie_labels(net, "weak").groupBy("gid", "label").agg(F.count(F.lit(1)).alias("s"))
    sums = size.groupBy("gid").agg(F.sum(F.col("s") - 1).alias("least"), F.sum((F.col("s") - 1) * (F.col("s") - 1)).alias("spare"))
    arcs = net.arcs().groupBy("gid").agg(F.count(F.lit(1)).alias("m"))
    got = sums.join(arcs, "gid", "left").fillna(0, ["m"])
    return net.out(got.select("gid", (1 - nan_div(F.col("m") - F.col("least"), F.col("spare"))).alias("efficiency")))


@observed
def kcores(net: Net, cmode: str = "freeman", k=None) -> DataFrame:
    """(vid, core): the largest k for which the vertex stays when vertices of degree below k go again and again."""
    if k is not None:
        raise ValueError("kcores gives every vertex's core number; filter core >= k for the k-core")
    check_option("cmode", cmode, ("freeman", "indegree", "outdegree"))
    arcs = net.arcs().select("gid", "src", "dst")
    if net.directed and cmode == "freeman":
        ends = arcs.unionAll(arcs.select("gid", F.col("dst").alias("src"), F.col("src").alias("dst")))
    elif net.directed and cmode == "indegree":
        ends = arcs.select("gid", F.col("dst").alias("src"), F.col("src").alias("dst"))
    else:
        ends = arcs
    # ends: (vertex, the vertex whose removal takes one of its degrees)
    if ends.count() <= CORE_TIES * sizes.SMALL_TIES:
        got = per_graph_ties(net, _core_numbers, "vid long, core long", ends)
        return net.out(net.vertices.select("gid", "vid").join(got, ["gid", "vid"], "left").fillna(0, ["core"]))
    return net.out(_cores_by_joins(net, ends))


def adjacency_lists(n: int, a: np.ndarray, b: np.ndarray) -> list[list[int]]:
    """The sorted ``b`` of each ``a`` from 0 to n - 1."""
    order = np.lexsort((b, a))
    return [x.tolist() for x in np.split(b[order], np.searchsorted(a[order], np.arange(1, n)))]


def _core_numbers(ids: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> dict:
    """Bulk peeling: all vertices of at most the level's degree go at once and take their neighbours' degrees along. Each tie is read once."""
    n = len(ids)
    degree, core = np.bincount(a, minlength=n), np.zeros(n, np.int64)
    order = np.argsort(b, kind="stable")
    pulls = a[order].astype(np.int32)
    index = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(b, minlength=n), out=index[1:])
    left, level = np.arange(n), 0
    while len(left):
        level = max(level, int(degree[left].min()))
        go = left[degree[left] <= level]
        while len(go):
            core[go], degree[go] = level, -1
            size = index[go + 1] - index[go]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            hit = pulls[np.repeat(index[go], size) + inner]
            hit = hit[degree[hit] >= 0]
            hit, gone = np.unique(hit, return_counts=True)
            degree[hit] -= gone
            go = hit[degree[hit] <= level]
        left = left[degree[left] >= 0]
    return {"vid": ids, "core": core}


def _cores_by_joins(net: Net, ends: DataFrame) -> DataFrame:
    """Bulk peeling: at each level all vertices of at most that degree go until none is left, then the level rises."""
    left, ends, done, level = stored(net.vertices.select("gid", "vid"), "left"), stored(ends, "ends"), [], 0
    while True:
        degree = left.join(ends.groupBy("gid", F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("k")), ["gid", "vid"], "left").fillna(0, ["k"])
        degree = stored(degree, "degree")
        lowest = degree.agg(F.min("k")).first()[0]
        if lowest is None:
            break
        level = max(level, lowest)
        go = degree.filter(F.col("k") <= level).select("gid", "vid")
        done.append(stored(go.withColumn("core", F.lit(level).cast("long")), "core"))
        left = stored(degree.filter(F.col("k") > level).select("gid", "vid"), "left")
        # a vertex that went takes its neighbours' degrees along
        ends = stored(ends.join(go, (ends.gid == go.gid) & (ends.dst == go.vid), "left_anti").join(go, (ends.gid == go.gid) & (ends.src == go.vid), "left_anti"), "ends")
    out = done[0] if done else net.vertices.select("gid", "vid", F.lit(0).cast("long").alias("core")).limit(0)
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def articulation(near: list[list[int]]) -> tuple[set[int], list[list[tuple[int, int]]]]:
    """(cut vertices, edges of each biconnected component) of an undirected graph, by one depth-first search without recursion."""
    n = len(near)
    number, low, cut, blocks, clock = [0] * n, [0] * n, set(), [], 0
    for root in range(n):
        if number[root]:
            continue
        clock += 1
        number[root] = low[root] = clock
        path, edges, children = [(root, -1, iter(near[root]))], [], 0
        while path:
            v, up, rest = path[-1]
            for w in rest:
                if w == up or w == v:
                    continue
                if not number[w]:
                    clock += 1
                    number[w] = low[w] = clock
                    edges.append((v, w))
                    path.append((w, v, iter(near[w])))
                    children += v == root
                    break
                if number[w] < number[v]:
                    edges.append((v, w))
                    low[v] = min(low[v], number[w])
            else:
                path.pop()
                if up < 0:
                    continue
                low[up] = min(low[up], low[v])
                if low[v] >= number[up]:
                    if up != root:
                        cut.add(up)
                    block = []
                    while True:
                        block.append(edges.pop())
                        if block[-1] == (up, v):
                            break
                    blocks.append(block)
        if children > 1:
            cut.add(root)
    return cut, blocks


def strong_parts(near: list[list[int]]) -> np.ndarray:
    """The number of each vertex's strongly connected component, by one depth-first search without recursion."""
    n, clock, parts = len(near), 0, 0
    number, low, part, stack = [0] * n, [0] * n, [-1] * n, []
    for root in range(n):
        if number[root]:
            continue
        clock += 1
        number[root] = low[root] = clock
        stack.append(root)
        path = [(root, iter(near[root]))]
        while path:
            v, rest = path[-1]
            for w in rest:
                if not number[w]:
                    clock += 1
                    number[w] = low[w] = clock
                    stack.append(w)
                    path.append((w, iter(near[w])))
                    break
                if part[w] < 0:
                    low[v] = min(low[v], number[w])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[v])
                if low[v] == number[v]:
                    while part[v] < 0:
                        part[stack.pop()] = parts
                    parts += 1
    return np.array(part, np.int64)


def dominating(near: list[list[int]], back: list[list[int]], root: int) -> set[int]:
    """The vertices other than ``root`` that all paths from it to some further vertex pass (Cooper, Harvey and Kennedy)."""
    seen, path, order = {root}, [(root, iter(near[root]))], []
    while path:
        v, rest = path[-1]
        for w in rest:
            if w not in seen:
                seen.add(w)
                path.append((w, iter(near[w])))
                break
        else:
            order.append(v)
            path.pop()
    place, up, changed = {v: i for i, v in enumerate(order)}, {root: root}, True
    while changed:
        changed = False
        for v in reversed(order[:-1]):
            best = -1
            for u in back[v]:
                if u not in up:
                    continue
                if best < 0:
                    best = u
                    continue
                while u != best:
                    while place[u] < place[best]:
                        u = up[u]
                    while place[best] < place[u]:
                        best = up[best]
            if up.get(v) != best:
                up[v], changed = best, True
    return {u for v, u in up.items() if v != root} - {root}


def reached(near: list[list[int]], start: int, without: int) -> int:
    """How many vertices paths from ``start`` reach that avoid ``without``, itself included."""
    seen, todo = {start, without}, [start]
    while todo:
        for w in near[todo.pop()]:
            if w not in seen:
                seen.add(w)
                todo.append(w)
    return len(seen) - 1


def strong_cutpoints(n: int, a: np.ndarray, b: np.ndarray) -> set[int]:
    """The vertices without which their strongly connected component falls apart: those that dominate others from one vertex of it,
    along the arcs or against them, and that vertex itself if the others don't reach each other."""
    part = strong_parts(adjacency_lists(n, a, b))
    inner = part[a] == part[b]
    a, b = a[inner], b[inner]
    near, back, cut = adjacency_lists(n, a, b), adjacency_lists(n, b, a), set()
    roots, size = np.unique(part, return_index=True)[1].tolist(), np.bincount(part).tolist()
    for root, k in zip(roots, size, strict=True):
        if k > 2:
            cut |= dominating(near, back, root) | dominating(back, near, root)
            other = next(w for w in near[root] if w != root)
            if min(reached(near, other, root), reached(back, other, root)) < k - 1:
                cut.add(root)
    return cut


@observed
def cutpoints(net: Net, connected: str = "strong", symmetrize: str | None = None) -> DataFrame:
    """The vertices whose removal leaves more components: of the ties in either (weak) or both directions (recursive), or
    strong ones of a directed network."""
    if symmetrize is None:
        check_option("connected", connected, CONNECTED)
        rule = "strong" if connected == "recursive" else "weak"
    else:
        rule = symmetrize
    if net.directed and connected == "strong" and symmetrize is None:
        return net.out(per_graph_ties(net, lambda ids, a, b, w: {"vid": ids[sorted(strong_cutpoints(len(ids), a, b))]}, "vid long", net.arcs()))
    return net.out(per_graph_ties(net, lambda ids, a, b, w: {"vid": ids[sorted(articulation(adjacency_lists(len(ids), a, b))[0])]}, "vid long", net.symmetrized(rule)))


@observed
def bicomponents(net: Net, symmetrize: str = "strong", min_size: int = 3) -> DataFrame:
    """bicomponent, src, dst: the edges of the biconnected components of at least ``min_size`` vertices, numbered by their vertices."""
    if min_size < 2:
        raise ValueError("min_size must be at least 2")

    def found(ids, a, b, w):
        blocks = [b for b in articulation(adjacency_lists(len(ids), a, b))[1] if len({v for e in b for v in e}) >= min_size]
        blocks.sort(key=lambda b: sorted({v for e in b for v in e}))
        rows = [(k + 1, min(e), max(e)) for k, b in enumerate(blocks) for e in sorted(b)]
        k, u, v = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        return {"bicomponent": k, "src": ids[u], "dst": ids[v]}

    return net.out(per_graph_ties(net, found, "bicomponent long, src long, dst long", net.symmetrized(symmetrize)))


def maximal_cliques(near: list[set[int]]):
    """Bron-Kerbosch with pivots, from each vertex in order of degeneracy, without recursion."""
    n, left, order = len(near), {v: len(near[v]) for v in range(len(near))}, []
    queue = [(d, v) for v, d in left.items()]
    heapq.heapify(queue)
    while queue:
        d, v = heapq.heappop(queue)
        if left.get(v) != d:
            continue
        del left[v]
        order.append(v)
        for w in near[v]:
            if w in left:
                left[w] -= 1
                heapq.heappush(queue, (left[w], w))
    place = {v: i for i, v in enumerate(order)}
    for v in range(n):
        todo = [([v], {w for w in near[v] if place[w] > place[v]}, {w for w in near[v] if place[w] < place[v]})]
        while todo:
            have, could, gone = todo.pop()
            if not could:
                if not gone:
                    yield sorted(have)
                continue
            pivot = max(could | gone, key=lambda u: len(could & near[u]))
            for w in sorted(could - near[pivot]):
                todo.append(([*have, w], could & near[w], gone & near[w]))
                could = could - {w}
                gone = gone | {w}


@observed
def cliques(net: Net, min_size: int = 3, symmetrize: str = "strong") -> DataFrame:
    """clique, size, members (array, sorted): the maximal cliques of at least ``min_size`` vertices, in order of their members."""

    def found(ids, a, b, w):
        got = sorted(c for c in maximal_cliques([set(x) for x in adjacency_lists(len(ids), a, b)]) if len(c) >= min_size)
        return {"clique": np.arange(1, len(got) + 1), "size": np.array([len(c) for c in got], np.int64), "members": [ids[c].tolist() for c in got]}

    return net.out(per_graph_ties(net, found, "clique long, size long, members array<long>", net.symmetrized(symmetrize), alone=True))
