"""Mixing sources to target weights (operator 8, DataFrame functions only).

Every source's documents fall into blocks by a hash of their identity, so block numbers are a random
permutation. A source's quota of words is met by whole passes over its blocks, then by a run of blocks, then by
the largest documents that fit of the one block in which the quota ends. The quotas, counted in blocks, are dealt to the output
shards by a multivariate-hypergeometric splitting tree: a shard draws a run of each source's permuted blocks, disjoint from
other shards' (what a document adds to the mix is the shards that draw its block). Each shard is one partition of the mix and
orders its rows by a hash of its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, free_name, stored, unstore

#: Weights of the sources in code point order, repeating; the share of all words that the mix takes; the most repeats.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Documents of a block, about; blocks whose words are summed before sources' runs are.
BLOCK_DOCS, CHUNK_BLOCKS = 512, 1000
#: Words of a shard, about: small ones up to so many shards, larger ones where a mix would need more.
SHARD_WORDS, SHARDS, LARGE_SHARD_WORDS = 1 << 22, 4096, 1 << 27


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], budget: float, most: float) -> list[float]:
    """Targets in proportion to ``weights``; none above ``most`` times its size, the excess reshared by weight.

    Sources of size 0 get 0. If all stop at their most, the rest of the budget stays unspent.
    """
    target, open_ = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s > 0}
    left = budget
    while open_:
        total = sum(weights[i] for i in sorted(open_))
        full = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        if not full:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in sorted(full):
            target[i] = most * sizes[i]
            left -= target[i]
        open_ -= full
    return target


def splitting_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (column) for each shard (row): exact quotas, split in halves down a tree.

    At a node the left half's blocks are a multivariate-hypergeometric draw from the node's; its size is the
    node's blocks in proportion to the shards on the left.
    """
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    todo = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid, n = (lo + hi) // 2, int(have.sum())
        rng = np.random.default_rng([seed, lo, hi])
        take, rest, left = np.zeros_like(have), n, n * (mid - lo) // (hi - lo)
        for i, k in enumerate(have.tolist()):  # one source after another, from what is left
            rest -= k
            take[i] = _hypergeometric(rng, k, rest, left)
            left -= int(take[i])
        todo += [(lo, mid, take), (mid, hi, have - take)]
    return out


def _hypergeometric(rng, good: int, bad: int, n: int) -> int:
    if good == 0 or n == 0:
        return 0
    if bad == 0 or n == good + bad:
        return min(n, good)
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    # numpy's limit; the normal limit within the support
    p, size = good / (good + bad), good + bad
    x = round(rng.normal(n * p, (n * p * (1 - p) * (size - n) / (size - 1)) ** 0.5))
    return max(n - bad, 0, min(x, good, n))


def shard_count(words: float) -> int:
    return max(1, int(-(-words // LARGE_SHARD_WORDS)), min(SHARDS, int(-(-words // SHARD_WORDS))))


def identity(seed: int, doc_id, text) -> F.Column:
    """Equal for rows that repeat an identifier and text only (but for clashes, which do no harm)."""
    return F.xxhash64(F.lit(seed), doc_id, F.xxhash64(text))


class Plan:
    """What a mix of the rows of ``docs`` draws: a row a source, and the documents that are drawn of sources' last blocks."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share: float, most: float, shards: int | None, block_docs: int, seed: int):
        spark = docs.sparkSession
        self.columns, self.seed = (id_col, text_col, source_col), seed
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
        self.sized = stored(rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), identity(seed, F.col("doc_id"), F.col("text")).alias("h")), "sized")
        stats = self.sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
        stats.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
        sizes = [int(r["size"]) for r in stats]
        target = water_fill(sizes, [weights[i % len(weights)] for i in range(len(stats))], share * sum(sizes), most)
        passes = [min(int(t // s), int(most)) if s else 0 for s, t in zip(sizes, target, strict=True)]
        rest = [float(t - p * s) for s, t, p in zip(sizes, target, passes, strict=True)]
        blocks = [max(1, -(-r.n // block_docs)) for r in stats]
        kinds = "source string, rest double, blocks long"
        known = spark.createDataFrame([(r.source, x, n) for r, x, n in zip(stats, rest, blocks, strict=True)], kinds).coalesce(1)
        named = self._named(self.sized, known)

        # where a source's rest ends: words up to each chunk of blocks, then within the chunk, so that no task holds all blocks
        per_block = named.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
        per_block = stored(per_block.withColumn("chunk", F.floor(F.col("block") / CHUNK_BLOCKS)), "blocks")
        chunks = per_block.groupBy("source", "chunk").agg(F.sum("words").alias("held"))
        before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        chunks = chunks.select(F.col("source").alias("s1"), F.col("chunk").alias("c1"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("source", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        run = per_block.join(chunks, F.col("source").eqNullSafe(F.col("s1")) & (F.col("chunk") == F.col("c1"))).withColumn("upto", upto)
        ends = run.filter((F.col("rest") > 0) & (F.col("upto") > F.col("rest"))).groupBy("source").agg(F.min(F.struct("block", (F.col("rest") - F.col("upto") + F.col("words")).alias("room"))).alias("m"))
        edge = {r.source: (int(r.m.block), float(r.m.room)) for r in ends.collect()}  # a row a source
        unstore(per_block)

        # a run of blocks from 0 on, the block it ends in included
        quotas = [p * n + (edge[r.source][0] + 1 if r.source in edge else 0) for r, p, n in zip(stats, passes, blocks, strict=True)]
        self.shards = shards or shard_count(sum(target))
        tree = splitting_tree(quotas, self.shards, seed).cumsum(axis=0) if stats else np.zeros((self.shards, 0), np.int64)
        table = [(r.source, s, float(t), p, n, q, edge.get(r.source, (-1, 0.0))[0], tree[:, i].tolist()) for i, (r, s, t, p, n, q) in enumerate(zip(stats, sizes, target, passes, blocks, quotas, strict=True))]
        self.sources = spark.createDataFrame(table, "source string, source_size long, target double, passes int, blocks long, quota long, edge long, bounds array<long>").coalesce(1)

        # the block in which a source's rest ends: its documents from the largest on, each that still fits
        rooms = spark.createDataFrame([(k, b, x) for k, (b, x) in edge.items()], "s2 string, b2 long, room double").coalesce(1)
        last = named.join(F.broadcast(rooms), F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2")))
        # rows that repeat an identity are one entry, so a block's entries are about as many as ``block_docs``
        entries = last.groupBy("source", "h", "doc_id", "size").agg(F.count(F.lit(1)).alias("rows"), F.first("room").alias("room"))
        entry = F.struct((-F.col("size")).alias("less"), "h", "doc_id", "size", "rows")
        held = entries.groupBy("source").agg(F.sort_array(F.collect_list(entry)).alias("docs"), F.first("room").alias("room"))

        def fit(room, d):
            return F.when(d["size"] > 0, F.least(d["rows"], F.floor(room / d["size"]).cast("long"))).otherwise(d["rows"])

        # the room that is left before each entry, then what fits into it
        rooms = F.aggregate("docs", F.array("room"), lambda acc, d: F.concat(acc, F.array(F.element_at(acc, -1) - d["size"] * fit(F.element_at(acc, -1), d))))
        taken = F.zip_with("docs", F.slice(rooms, 1, F.size("docs")), lambda d, room: F.struct(d["h"].alias("h"), d["doc_id"].alias("doc_id"), d["size"].alias("size"), d["rows"].alias("rows"), fit(room, d).alias("fit")))
        chosen = held.select("source", F.explode(taken).alias("d")).select("source", "d.*").filter("fit > 0")
        self.chosen = stored(chosen, "edge")
        self.partial = not self.chosen.filter("fit < rows").isEmpty()

    def _named(self, rows: DataFrame, known: DataFrame) -> DataFrame:
        named = rows.join(F.broadcast(known), rows.source.eqNullSafe(known.source)).drop(known.source)
        return named.withColumn("block", F.pmod("h", "blocks"))

    def drawn(self, rows: DataFrame, doc_id, source, size, h, names: dict[str, str]) -> DataFrame:
        """``rows`` with columns named ``names``[..]: shards (of each copy), source_size and target."""
        at = {c: free_name(rows, f"kg_{c}") for c in (*self.sources.columns, *(f"of_{c}" for c in self.chosen.columns), "nth")}
        sources = self.sources.withColumnsRenamed({c: at[c] for c in self.sources.columns})
        # at most a block's entries a source
        chosen = self.chosen.withColumnsRenamed({c: at[f"of_{c}"] for c in self.chosen.columns})
        out = rows.join(F.broadcast(sources), source.eqNullSafe(F.col(at["source"])))
        match = source.eqNullSafe(F.col(at["of_source"])) & (h == F.col(at["of_h"])) & doc_id.eqNullSafe(F.col(at["of_doc_id"])) & (size == F.col(at["of_size"]))
        out = out.join(F.broadcast(chosen), match, "left")
        block = F.pmod(h, F.col(at["blocks"]))
        is_in = F.col(at["of_fit"]).isNotNull()
        if self.partial:  # of r rows that repeat an identity the first n that fit are drawn; other rows need no order
            some = F.col(at["of_fit"]) < F.col(at["of_rows"])
            nth = F.row_number().over(Window.partitionBy(at["of_source"], at["of_h"], at["of_doc_id"], at["of_size"]).orderBy(at["of_h"]))
            out = out.filter(~F.coalesce(some, F.lit(False))).withColumn(at["nth"], F.lit(0)).unionByName(out.filter(some).withColumn(at["nth"], nth))
            is_in = is_in & (F.col(at["nth"]) <= F.col(at["of_fit"]))
        # a block's units: one a pass, numbered through all passes
        units = F.transform(F.sequence(F.lit(0), F.col(at["passes"])), lambda p: p * F.col(at["blocks"]) + block)
        last = F.col(at["passes"]) * F.col(at["blocks"]) + F.col(at["edge"])
        units = F.filter(units, lambda u: (u < F.col(at["quota"])) & ((F.col(at["edge"]) < 0) | (u != last) | is_in))
        steps = F.sequence(F.lit(1), F.lit(max(1, self.shards.bit_length())))

        def shard(u):
            """The number of shards whose runs end at or before the unit, by halving."""

            def half(acc, _):
                mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
                right = (acc["lo"] < acc["hi"]) & (F.get(F.col(at["bounds"]), mid) <= u)
                return F.struct(F.when(right, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(right | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(mid).alias("hi"))

            return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(self.shards).alias("hi")), half)["lo"]

        out = out.withColumns({names["shards"]: F.transform(units, shard), names["source_size"]: F.col(at["source_size"]), names["target"]: F.col(at["target"])})
        return out.drop(*at.values())


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, shards: int | None = None, block_docs: int = BLOCK_DOCS, seed: int = 17) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size (words), source_size, target, copies, taken (size * copies),
    shards (the shard of each copy).

    Sources in code point order, the null source last, weigh ``weights`` in turn; see ``water_fill``. The last,
    partial pass takes whole blocks in permuted order and of the block in which it ends the largest documents that still
    fit; so a source ends within that block's smallest document left out of its target. Null texts and texts of white space have size 0 and are copied as their
    block is, adding no words. Rows that repeat an identifier are rows of their own. Reruns agree: nothing depends on
    partitions. An empty table gives an empty result. Other columns are ignored. Sources are a mix's
    configuration: one row a source reaches the driver. ``shards``: derived from the mix's words if None.
    """
    plan = Plan(docs, id_col, text_col, source_col, weights, share, most, shards, block_docs, seed)
    out = plan.drawn(plan.sized, *(F.col(c) for c in ("doc_id", "source", "size", "h")), {c: c for c in ("shards", "source_size", "target")})
    copies = F.size("shards")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), "shards")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, shards: int | None = None, block_docs: int = BLOCK_DOCS, seed: int = 17) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as ``mix_plan`` takes them, with all their columns, whatever their names.

    Each shard is one partition, its rows in an order of its own. Texts move once, to their shards.
    """
    plan = Plan(docs, id_col, text_col, source_col, weights, share, most, shards, block_docs, seed)
    at = {c: free_name(docs, f"kg_{c}") for c in ("id", "origin", "size", "h", "shards", "source_size", "target")}
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    keyed = docs.withColumns({at["id"]: doc_id, at["origin"]: F.col(source_col).cast("string"), at["size"]: word_count(text), at["h"]: identity(seed, doc_id, text)})
    out = plan.drawn(keyed, *(F.col(at[c]) for c in ("id", "origin", "size", "h")), {c: at[c] for c in ("shards", "source_size", "target")})
    out = out.withColumn(at["shards"], F.explode(at["shards"]))
    out = out.repartitionById(plan.shards, F.col(at["shards"])).sortWithinPartitions(F.xxhash64(F.lit(seed + 1), at["shards"], at["h"]), at["h"])
    return out.drop(*at.values())
