"""Graph-level indices over dyads and triads: joins and aggregations only, grouped by graph.

Notation: m arcs, n vertices, S_ik two-paths from i to k; P = sum of S_ik over i != k, R the part of it whose ends are
tied, Q = sum of S_ik squared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import INF, NAN, nan_div
from ..functions.tables import stored
from ..net import Net, check_option, observed


def _zero(frame: DataFrame, names: list[str]) -> DataFrame:
    return frame.fillna(0, names)


def _dyads(net: Net) -> DataFrame:
    """(gid, n, mutual, asym, n_null)."""
    if net.directed:
        pairs = net.arcs().groupBy("gid", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.count(F.lit(1)).alias("c"))
        sums = pairs.groupBy("gid").agg(F.sum((F.col("c") == 2).cast("long")).alias("mutual"), F.sum((F.col("c") == 1).cast("long")).alias("asym"))
    else:
        sums = net.edges.filter("src <> dst").groupBy("gid").agg(F.count(F.lit(1)).alias("mutual"), F.lit(0).cast("long").alias("asym"))
    got = _zero(net.sizes().join(sums, "gid", "left"), ["mutual", "asym"])
    pairs = F.expr("n * (n - 1) div 2")
    return got.select("gid", "n", "mutual", "asym", (pairs - F.col("mutual") - F.col("asym")).alias("n_null"))


@observed
def dyad_census(net: Net) -> DataFrame:
    """mutual, asym, n_null: unordered pairs with both, one or no arc; an undirected tie is mutual."""
    return net.out(_dyads(net).drop("n"))


@observed
def mutuality(net: Net) -> DataFrame:
    return net.out(_dyads(net).select("gid", "mutual"))


@observed
def gden(net: Net, diag: bool = False, discount_bipartite: bool = False) -> DataFrame:
    """density: ties over possible ties. ``diag`` counts loops; two-mode networks may be held against cross-mode pairs only."""
    ties = net.edges if diag else net.edges.filter("src <> dst")
    counts = ties.groupBy("gid").agg(F.count(F.lit(1)).alias("m"))
    sizes = net.sizes()
    if discount_bipartite:
        if net.mode1 is None:
            raise ValueError("discount_bipartite needs a two-mode network")
        first = net.vertices.groupBy("gid").agg(F.sum((F.col("vid") <= net.mode1).cast("long")).alias("p"))
        sizes = sizes.join(first, "gid")
        possible = F.col("p") * (F.col("n") - F.col("p")) * (2 if net.directed else 1)
    else:
        possible = F.col("n") * (F.col("n") - 1)
        possible = possible if net.directed else F.expr("n * (n - 1) div 2")
        possible = possible + F.col("n") if diag else possible
    got = _zero(sizes.join(counts, "gid", "left"), ["m"])
    return net.out(got.select("gid", nan_div(F.col("m"), possible).alias("density")))


RECIPROCITY = ("dyadic", "dyadic_nonnull", "edgewise", "edgewise_lrr", "correlation")


@observed
def grecip(net: Net, measure: str = "dyadic") -> DataFrame:
    """reciprocity: the share of dyads that are symmetric (dyadic), of tied dyads that are mutual (dyadic_nonnull), of
    arcs that are returned (edgewise); the log ratio of the latter to density; the correlation of both halves."""
    check_option("measure", measure, RECIPROCITY)
    m, a, o, n = (F.col(c).cast("double") for c in ("mutual", "asym", "n_null", "n"))
    if measure == "dyadic":
        value = nan_div(m + o, m + a + o)
    elif measure == "dyadic_nonnull":
        value = nan_div(m, m + a)
    elif measure == "edgewise":
        value = nan_div(2 * m, 2 * m + a)
    elif measure == "edgewise_lrr":
        value = F.when(m > 0, F.log(m * (m + a + o) / F.pow(m + a / 2, F.lit(2.0)))).when(m + a > 0, F.lit(-INF)).otherwise(F.lit(NAN))
    else:
        value = correlation_of_halves(m, a, n)
    return net.out(_dyads(net).select("gid", value.alias("reciprocity")))


def correlation_of_halves(m, a, n):
    """Correlation of the sociomatrix with its transpose over ordered pairs, of m mutual and a asymmetric dyads."""
    cells, ties = n * (n - 1), 2 * m + a
    spread = ties * cells - ties * ties
    plain = F.when(spread != 0, (2 * m * cells - ties * ties) / spread).otherwise(F.lit(1.0))
    return F.when(n < 2, F.lit(NAN)).when(n == 2, F.when(a == 0, 1.0).otherwise(0.0)).when(ties == 0, F.lit(1.0)).otherwise(plain)


def _two_paths(net: Net) -> DataFrame:
    """(gid, i, k, s): two-paths between each ordered pair with any, i != k."""
    arcs = net.arcs()
    x = arcs.select("gid", F.col("src").alias("i"), F.col("dst").alias("j"))
    y = arcs.select("gid", F.col("src").alias("j"), F.col("dst").alias("k"))
    return x.join(y, ["gid", "j"]).filter("i <> k").groupBy("gid", "i", "k").agg(F.count(F.lit(1)).alias("s"))


def _path_sums(net: Net) -> DataFrame:
    """(gid, n, m, P, R, Q)."""
    arcs = net.arcs().select("gid", F.col("src").alias("i"), F.col("dst").alias("k"), F.lit(1).alias("tied"))
    s = _two_paths(net).join(arcs, ["gid", "i", "k"], "left")
    sums = s.groupBy("gid").agg(F.sum("s").alias("P"), F.sum(F.when(F.col("tied").isNotNull(), F.col("s")).otherwise(0)).alias("R"), F.sum(F.col("s") * F.col("s")).alias("Q"))
    ties = arcs.groupBy("gid").agg(F.count(F.lit(1)).alias("m"))
    return _zero(net.sizes().join(ties, "gid", "left").join(sums, "gid", "left"), ["m", "P", "R", "Q"])


TRANSITIVITY = ("weak", "weakcensus", "strong", "strongcensus", "correlation")


@observed
def gtrans(net: Net, measure: str = "weak") -> DataFrame:
    """transitivity: the share of two-paths whose ends are tied (weak); of ordered triples whose end tie is there exactly
    if the two-path is (strong); both counts; the correlation of ties with numbers of two-paths. None at all is 1."""
    check_option("measure", measure, TRANSITIVITY)
    n, m, p, r, q = (F.col(c).cast("double") for c in ("n", "m", "P", "R", "Q"))
    agree = r + (n - 2) * (n * (n - 1) - m) - (p - r)
    triples = n * (n - 1) * (n - 2)
    if measure == "weak":
        value = F.when(p > 0, r / F.when(p > 0, p)).otherwise(F.lit(1.0))
    elif measure == "weakcensus":
        value = r
    elif measure == "strongcensus":
        value = F.when(n < 3, F.lit(0.0)).otherwise(agree)
    elif measure == "strong":
        value = F.when(triples > 0, agree / F.when(triples > 0, triples)).otherwise(F.lit(1.0))
    else:
        cells = n * (n - 1)
        tie_spread, path_spread = cells * m - m * m, cells * q - p * p
        both = tie_spread * path_spread
        value = F.when(cells < 2, F.lit(1.0)).when(both > 0, (cells * r - m * p) / F.sqrt(F.when(both > 0, both))).when(m - 2 * r + q == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return net.out(_path_sums(net).select("gid", value.alias("transitivity")))


@observed
def transitivity(net: Net, type: str = "global", cmode: str = "total", measure: str = "weak") -> DataFrame:
    """Global (see ``gtrans``), local per vertex, or the average of the local values that are defined.

    Local: of an undirected network, or with ``cmode="weak"``, the share of a vertex's pairs of neighbours that are
    tied; of a directed one the directed triangles over those there could be. Undefined values are NaN.
    """
    check_option("type", type, ("global", "local", "average"))
    check_option("cmode", cmode, ("total", "weak"))
    if type == "global":
        return gtrans(net.replace(mask=None), measure)
    got = _local_directed(net) if net.directed and cmode == "total" else _local_weak(net)
    if type == "local":
        return net.out(got)
    mean = F.avg(F.when(~F.isnan("score"), F.col("score")))
    return net.out(got.groupBy("gid").agg(F.coalesce(mean, F.lit(NAN)).alias("transitivity")))


def _local_weak(net: Net) -> DataFrame:
    und = net.symmetrized("weak")
    degree = und.groupBy("gid", F.col("u").alias("vid")).agg(F.count(F.lit(1)).alias("k"))
    x, y = und.select("gid", F.col("u").alias("vid"), F.col("v").alias("a")), und.select("gid", F.col("u").alias("vid"), F.col("v").alias("b"))
    closed = x.join(y, ["gid", "vid"]).filter("a < b").join(und.select("gid", F.col("u").alias("a"), F.col("v").alias("b")), ["gid", "a", "b"], "left_semi")
    closed = closed.groupBy("gid", "vid").agg(F.count(F.lit(1)).alias("c"))
    got = _zero(net.vertices.select("gid", "vid").join(degree, ["gid", "vid"], "left").join(closed, ["gid", "vid"], "left"), ["k", "c"])
    pairs = F.col("k") * (F.col("k") - 1)
    return got.select("gid", "vid", nan_div(2 * F.col("c"), pairs).alias("score"))


def _local_directed(net: Net) -> DataFrame:
    arcs = net.arcs().select("gid", F.col("src").alias("u"), F.col("dst").alias("v"))
    both = arcs.unionAll(arcs.select("gid", F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("gid", "u", "v").agg(F.count(F.lit(1)).alias("s"))
    degree = both.groupBy("gid", F.col("u").alias("vid")).agg(F.sum("s").alias("d"), F.sum((F.col("s") == 2).cast("long")).alias("back"))
    a = both.select("gid", F.col("u").alias("i"), F.col("v").alias("j"), F.col("s").alias("s1"))
    b = both.select("gid", F.col("u").alias("j"), F.col("v").alias("h"), F.col("s").alias("s2"))
    c = both.select("gid", F.col("u").alias("h"), F.col("v").alias("i"), F.col("s").alias("s3"))
    cubes = a.join(b, ["gid", "j"]).filter("i <> h").join(c, ["gid", "h", "i"]).groupBy("gid", F.col("i").alias("vid")).agg(F.sum(F.col("s1") * F.col("s2") * F.col("s3")).alias("t"))
    got = _zero(net.vertices.select("gid", "vid").join(degree, ["gid", "vid"], "left").join(cubes, ["gid", "vid"], "left"), ["d", "back", "t"])
    most = 2 * (F.col("d") * (F.col("d") - 1) - 2 * F.col("back"))
    return got.select("gid", "vid", F.when(most > 0, F.col("t") / F.when(most > 0, most)).otherwise(F.lit(NAN)).alias("score"))


#: The classes of directed triads in their customary order.
TRIADS = ("003", "012", "102", "021D", "021U", "021C", "111D", "111U", "030T", "030C", "201", "120D", "120U", "120C", "210", "300")


def triad_class(code: int) -> str:
    """The class of the triad a, b, c whose arcs are the bits ab, ba, ac, ca, bc, cb of ``code``."""
    arcs = {p for bit, p in enumerate(("ab", "ba", "ac", "ca", "bc", "cb")) if code >> bit & 1}
    mutual = sum(p in arcs and p[::-1] in arcs for p in ("ab", "ac", "bc"))
    asym = len(arcs) - 2 * mutual
    name = f"{mutual}{asym}{3 - mutual - asym}"
    out = {v: sum(p[0] == v for p in arcs) for v in "abc"}
    into = {v: sum(p[1] == v for p in arcs) for v in "abc"}
    if name == "021":
        return name + ("D" if 2 in out.values() else "U" if 2 in into.values() else "C")
    if name == "111":
        # the asymmetric arc points to (D) or away from (U) the vertex in the mutual pair
        return name + ("D" if 2 in into.values() else "U")
    if name == "030":
        return name + ("T" if 2 in out.values() else "C")
    if name == "120":
        # the vertex outside the mutual pair sends both (D), gets both (U) or one of each (C)
        lone = next(v for v in "abc" if not any(v in p and p in arcs and p[::-1] in arcs for p in ("ab", "ac", "bc")))
        return name + {2: "D", 0: "U", 1: "C"}[out[lone]]
    return name


def _flip(d: int) -> int:
    """A dyad's two arcs (bit 0: from the first vertex, bit 1: to it) seen from its other end."""
    return (d & 1) << 1 | d >> 1


def _kind(d: int, directed: bool) -> str:
    return ("102" if d == 3 else "012") if directed else "1"


def _class(d1: int, d2: int, d3: int, directed: bool) -> str:
    return triad_class(d1 + 4 * d2 + 16 * d3) if directed else str((d1 > 0) + (d2 > 0) + (d3 > 0))


def _wedge_rules(directed: bool) -> list[tuple[int, str, int]]:
    """(types p <= q of a wedge's dyads as 4 p + q, triad, times it counts): an open triad, and none with one tied dyad less for each."""
    return [(4 * p + q, triad, times) for p in (1, 2, 3) for q in range(p, 4) for triad, times in ((_class(p, q, 0, directed), 1), (_kind(p, directed), -1), (_kind(q, directed), -1))]


def _triangle_rules(directed: bool) -> list[tuple[int, str, int]]:
    """(code of a triangle, triad, times): the triangle itself; each of its three wedges is no open triad; each dyad is in two of them."""
    out = []
    for code in range(64):
        ab, ac, bc = code & 3, code >> 2 & 3, code >> 4
        if ab and ac and bc:
            out.append((code, _class(ab, ac, bc, directed), 1))
            out += [(code, _class(*wedge, 0, directed), -1) for wedge in ((ab, ac), (_flip(ab), bc), (_flip(ac), _flip(bc)))]
            out += [(code, _kind(d, directed), 1) for d in (ab, ac, bc)]
    return out


@observed
def triad_census(net: Net) -> DataFrame:
    """triad, n: a row a class. Directed: 16 classes; undirected: 4, by number of ties.

    Only triangles are enumerated, each at its vertex of lowest degree, so a hub's pairs of neighbours never are. Pairs of ties that
    meet follow from the degrees of each kind; those that close a triangle are taken off; triads with one tied dyad follow
    from the dyads and these, empty ones from the total.
    """
    spark, directed = net.spark, net.directed
    # each dyad's two arcs as one number, seen from its smaller vertex; an undirected tie is both
    dyad = net.arcs().groupBy("gid", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.sum(F.when(F.col("src") < F.col("dst"), 1).otherwise(2)).cast("int").alias("d"))
    dyad = stored(dyad, "dyads")
    flipped = F.when(F.col("d") == 3, 3).otherwise(3 - F.col("d")).cast("int")
    seen = dyad.unionAll(dyad.select("gid", F.col("v").alias("u"), F.col("u").alias("v"), flipped.alias("d")))
    kinds = seen.groupBy("gid", F.col("u").alias("vid")).agg(F.count(F.lit(1)).alias("k"), *[F.sum((F.col("d") == t).cast("long")).alias(f"k{t}") for t in (1, 2, 3)])
    pair = lambda p, q: F.col(f"k{p}") * (F.col(f"k{p}") - 1) / 2 if p == q else F.col(f"k{p}") * F.col(f"k{q}")
    sums = kinds.groupBy("gid").agg(F.sum("k1").alias("asym"), (F.sum("k3") / 2).cast("long").alias("mutual"), *[F.sum(pair(p, q)).cast("long").alias(f"w{4 * p + q}") for p in (1, 2, 3) for q in range(p, 4)])

    # triangles: ties lead from lower to higher degree, so few leave any vertex
    low = kinds.select("gid", F.col("vid").alias("u"), F.col("k").alias("ku"))
    high = kinds.select("gid", F.col("vid").alias("v"), F.col("k").alias("kv"))
    ends = stored(seen.join(low, ["gid", "u"]).join(high, ["gid", "v"]).filter(F.struct("ku", "u") < F.struct("kv", "v")), "ends")

    def tie(a: str, b: str, d: str):
        return ends.select("gid", F.col("u").alias(a), F.col("v").alias(b), F.col("kv").alias(f"k{b}"), F.col("d").alias(d))

    wedges = tie("a", "b", "d1").join(tie("a", "c", "d2"), ["gid", "a"]).filter(F.struct("kb", "b") < F.struct("kc", "c"))
    closed = wedges.join(tie("b", "c", "d3").drop("kc"), ["gid", "b", "c"])
    triangles = closed.groupBy("gid", (F.col("d1") + 4 * F.col("d2") + 16 * F.col("d3")).alias("code")).agg(F.count(F.lit(1)).alias("n"))

    def ruled(counts: DataFrame, rules) -> DataFrame:
        table = spark.createDataFrame(rules, "code int, triad string, times int")
        return counts.join(F.broadcast(table), "code").select("gid", "triad", (F.col("n") * F.col("times")).alias("n"))

    found = ruled(triangles, _triangle_rules(directed))
    wide = F.explode(F.array(*[F.struct(F.lit(4 * p + q).alias("code"), F.col(f"w{4 * p + q}").alias("n")) for p in (1, 2, 3) for q in range(p, 4)]))
    found = found.unionAll(ruled(sums.select("gid", wide.alias("w")).select("gid", "w.code", "w.n"), _wedge_rules(directed)))
    for name, kind in (("mutual", 3), ("asym", 1)):  # each tied dyad with every third vertex
        found = found.unionAll(net.with_n(sums).select("gid", F.lit(_kind(kind, directed)).alias("triad"), (F.col(name) * (F.col("n") - 2)).alias("n")))
    found = found.groupBy("gid", "triad").agg(F.sum("n").alias("n"))
    names, empty = (TRIADS, "003") if directed else (("0", "1", "2", "3"), "0")
    every = net.sizes().withColumn("triad", F.explode(F.array(*[F.lit(x) for x in names])))
    got = every.withColumnRenamed("n", "size").join(found, ["gid", "triad"], "left").fillna(0, ["n"])
    tied = Window.partitionBy("gid")  # a row a class
    all_ = F.expr("size * (size - 1) * (size - 2) div 6")
    got = got.withColumn("n", F.when(F.col("triad") == empty, all_ - F.sum("n").over(tied)).otherwise(F.col("n")))
    return net.out(got.select("gid", "triad", F.col("n").cast("long").alias("n")))
