"""N-gram Jaccard join with rare-first prefix filtering (operator 6).

1. All shingles of all documents are counted into a sketch whose cells grow with the texts; its counts, then the shingles'
   hashes, give the order: rare first. Any order is a right one, so counts that share a cell cost time only.
2. Each document leaves the digest and size of its set, a histogram of its hashes and its prefix: the first
   n - ceil(t * n) + 1 shingles in that order. Two sets that reach the threshold t share one of their prefixes.
3. Equal sets are one node. The nodes' prefix shingles are sorted together and streamed: a shingle of one node alone
   goes, a short list of nodes gives all its pairs, the rows of a long list are kept.
4. Long lists give a pair of each node with a few leaders of its list: groups of near copies grow together without
   their pairs.
5. Of a list that still holds several groups, up to MIDDLE nodes give the pairs across its groups, by the same filters. A longer
   one is not paired up either. Its nodes are compared with one pivot, a node of the list's largest group, and leave what they differ in. Two sets x, y link if and only if they differ in few enough
   shingles, and how many they differ in follows from how many of their differences from the pivot they share; unless both
   link with the pivot, they must share at least one. So prefix and positional filters hold on differences as they do on sets:
   only nodes that share a prefix of their differences are paired. Copies that were each changed elsewhere never meet.
6. Pairs pass the length and positional filters as they are made, the suffix filter (histograms bound the overlap), and
   are verified once with both sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, components, free_name, large, lean, mix64, shuffles_dropped, slim_join, stored, tasks, unstore, utf8

WORDS, PERCENT = 5, 80
#: Cells of a slice of the sketch, lists that give all pairs, leaders of a list and span of sizes, parts that a list's rows are
#: dealt into to meet them, histogram cells.
SLICE, SHORT, LEADERS, SALTS, HISTOGRAM = 1 << 16, 16, 4, 16, 64
#: Nodes of a list that give all pairs across the groups that are left.
MIDDLE = 128
#: Bits of the sketch's cells: the least, the most (64 MB of ranks), and bytes of text for a cell in between: where a cell counts too
#: many shingles, frequent ones don't stand out.
LEAST_BITS, MOST_BITS, CELL_BYTES = 21, 25, 512
#: Shingles that a task holds before it sends its counts (4 MB).
HELD = 1 << 20
#: Shuffle partitions for each task that writes a slim table.
SLIM = 16
#: Ranks of the sketch grow by this with each doubling of a cell's count, so that 64 bits of count fit 16 bits of rank.
STEPS = 1023
#: Bytes of text handled at once.
CHUNK = 1 << 20
#: Bits of the filter that tells which documents' sets are needed: the least, the most (32 MB), and for a document.
LEAST_FILTER, MOST_FILTER, FILTER_SHARE = 23, 28, 16

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random odd number for each byte, the same for A-Z as for a-z.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 1024) - 1, _STEP))]).astype(np.uint64)
    return _powers


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, byte at which it starts) of texts that start at ``starts`` in ``raw``."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~_SPACE[raw]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    edge = starts[starts < len(raw)]
    begin[edge] |= word[edge]
    first = np.flatnonzero(begin)
    if not len(first):
        return np.zeros(0, np.uint64), first
    size = np.diff(np.append(first, len(raw)))
    inner = np.arange(first[0], len(raw)) - np.repeat(first, size)
    value = _BYTE[raw[first[0] :]] * powers(int(size.max()))[inner]
    value[~word[first[0] :]] = 0
    return mix64(np.add.reduceat(value, first - first[0])), first


def shingles(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hashes of all runs of ``k`` words; of the whole sequence if it is shorter; none of none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h = h * _STEP + words[i : n - k + 1 + i]
    return mix64(h + np.uint64(k))


def sets(column: pa.Array, k: int = WORDS):
    """Yields (row, sorted distinct shingle hashes) for every text; a long text is hashed in parts cut at white space."""
    raw, at = utf8(large(column))
    row, n = 0, len(at) - 1
    while row < n:
        end = row
        while end < n and (end == row or at[end + 1] - at[row] <= CHUNK):
            end += 1
        if at[end] - at[row] > 2 * CHUNK:  # one long text
            parts, lo = [], at[row]
            while lo < at[end]:
                hi = min(at[end], lo + CHUNK)
                while hi < at[end] and not _SPACE[raw[hi]]:
                    hi += 1
                parts.append(word_hashes(raw[lo:hi], np.zeros(1, np.int64))[0])
                lo = hi
            yield row, np.unique(shingles(np.concatenate(parts), k))
        else:
            words, first = word_hashes(raw[at[row] : at[end]], at[row:end] - at[row])
            cut = np.searchsorted(first, at[row : end + 1] - at[row])
            for i in range(row, end):
                yield i, np.unique(shingles(words[cut[i - row] : cut[i - row + 1]], k))
        row = end


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def bits_for(number: float, least: int, most: int) -> int:
    """The bits of at least ``number`` cells, within bounds."""
    return min(most, max(least, int(np.ceil(np.log2(max(1.0, number))))))


def gaps(cells: np.ndarray) -> bytes:
    """Sorted cells, repeated ones too, as bytes: the steps between them, 255 for each 255 that a step has besides."""
    step = np.diff(cells, prepend=0)
    more = step // 255
    at = np.cumsum(more + 1) - 1
    out = np.full(int(at[-1]) + 1, 255, np.uint8)
    out[at] = step % 255
    return out.tobytes()


def cells_of(raw: bytes) -> np.ndarray:
    """What ``gaps`` made bytes of."""
    step = np.frombuffer(raw, np.uint8)
    return np.cumsum(step, dtype=np.int64)[step < 255]


def count_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """For each cell a rank (16 bits) that grows with the shingles counted in it, over all of ``docs`` (text); their number, a power
    of two, grows with the texts."""
    text = docs.agg(F.sum(F.octet_length("text").cast("double"))).first()[0] or 0.0
    bits = bits_for(text / CELL_BYTES, LEAST_BITS, MOST_BITS)
    size, shift = 1 << bits, np.uint64(64 - bits)

    def sent(cells):
        cells.sort()
        cut = np.searchsorted(cells, np.arange(0, size + SLICE, SLICE).astype(np.uint32))
        some = np.flatnonzero(np.diff(cut))
        raw = [gaps(cells[cut[s] : cut[s + 1]].astype(np.int64) - s * SLICE) for s in some]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(raw, pa.binary())], ["slice", "counts"])

    @lean
    def count(batches):
        held, number = np.empty(HELD, np.uint32), 0
        for batch in batches:
            for _, h in sets(batch.column(0), k):
                while len(h):
                    some = h[: HELD - number]
                    held[number : number + len(some)] = some >> shift
                    number, h = number + len(some), h[len(some) :]
                    if number == HELD:
                        yield sent(held)
                        number = 0
        if number:
            yield sent(held[:number])

    @lean
    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.bincount(cells_of(raw), minlength=SLICE)
                held[s] = held[s] + part if s in held else part
        for s, part in held.items():
            rank = (STEPS * np.log2(1.0 + part)).astype("<u2")
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([rank.tobytes()], pa.binary())], ["slice", "ranks"])

    parts = docs.mapInArrow(count, "slice int, counts binary").repartition(min(tasks(docs.sparkSession), size // SLICE), "slice").mapInArrow(add, "slice int, ranks binary")
    out = np.zeros(size, np.uint16)
    for r in parts.collect():  # 2 bytes a cell, 64 MB at most
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["ranks"], "<u2")
    return out


def ranks_of(rank: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The sketch's ranks of shingles."""
    return rank[(h >> np.uint64(65 - len(rank).bit_length())).astype(np.int64)]


def rare_first(rank: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Keys that put shingles in order: 16 bits of rank, then the hash."""
    return (ranks_of(rank, h).astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))


def counts(rank: np.ndarray, h: np.ndarray) -> np.ndarray:
    """About how often shingles stand in all sets, by their ranks."""
    return np.exp2(ranks_of(rank, h) / STEPS) - 1


def signatures(docs: DataFrame, ranks, k: int, percent: int) -> DataFrame:
    """Per row of ``docs`` (doc_id, mark, text): doc_id, mark, n, digest, histogram, prefix."""

    @lean
    def run(batches):
        rank = ranks.value
        for batch in batches:
            number, digest, hist, prefix = [], [], [], []
            for _, h in sets(batch.column(2), k):
                n = len(h)
                number.append(n)
                digest.append(xxhash.xxh3_128_digest(h.tobytes()))
                cells = np.bincount((h >> np.uint64(58)).astype(np.int64), minlength=HISTOGRAM)
                hist.append(cells.astype("<u2").tobytes() if n and cells.max() < 65536 else None)
                p = prefix_size(n, percent)
                order = rare_first(rank, h)
                first = np.argpartition(order, p - 1)[:p] if p < n else np.arange(n)
                first = first[np.argsort(order[first], kind="stable")]
                prefix.append(h[first].view(np.int64))
            size = np.concatenate([[0], np.cumsum([len(x) for x in prefix])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(size), pa.array(np.concatenate([*prefix, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(number, pa.int32()), pa.array(digest, pa.binary()), pa.array(hist, pa.binary()), lists], ["doc_id", "mark", "n", "digest", "histogram", "prefix"])

    return docs.mapInArrow(run, "doc_id long, mark long, n int, digest binary, histogram binary, prefix array<long>")


def postings(sorted_rows: DataFrame, percent: int) -> DataFrame:
    """From (token, node, n, pos) sorted by token within partitions: pairs (a, b, na, nb) of the lists of at most SHORT nodes
    that pass the length and positional filters, and the rows of longer lists (token, a, na, pos; b null).

    A list is held only up to SHORT rows; from there on its rows stream through.
    """
    names = ["token", "a", "b", "na", "nb", "pos"]

    def frame(token, a, b, na, nb, pos):
        none = b is None
        return pa.RecordBatch.from_arrays(
            [pa.array(token), pa.array(a), pa.nulls(len(a), pa.int64()) if none else pa.array(b), pa.array(na), pa.nulls(len(a), pa.int32()) if none else pa.array(nb), pa.array(pos)], names
        )

    @lean
    def run(batches):
        held, streaming = None, None
        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            if not len(cols[0]):
                continue
            if streaming is not None:
                k = int(np.searchsorted(cols[0] != streaming, True)) if cols[0][0] == streaming else 0
                if k:
                    yield frame(cols[0][:k], cols[1][:k], None, cols[2][:k], None, cols[3][:k])
                    cols = [c[k:] for c in cols]
                if not len(cols[0]):
                    continue
                streaming = None
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            cut = np.append(np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1])), len(cols[0]))
            last = cut[-2]
            yield from lists(cols, cut[:-1])
            held = [c[last:] for c in cols]
            if len(held[0]) > SHORT:
                yield frame(held[0], held[1], None, held[2], None, held[3])
                held, streaming = None, held[0][0]
        if held is not None:
            yield from lists(held, np.array([0, len(held[0])]))

    def lists(cols, cut):
        """Whole lists, from each cut to the next."""
        token, node, n, pos = cols
        size = np.diff(cut)
        big = np.flatnonzero(size > SHORT)
        if len(big):
            at = np.concatenate([np.arange(cut[i], cut[i + 1]) for i in big])
            yield frame(token[at], node[at], None, n[at], None, pos[at])
        for length in np.unique(size[(size > 1) & (size <= SHORT)]):
            first = cut[:-1][size == length]
            i, j = np.triu_indices(int(length), 1)
            x, y = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
            nx, ny = n[x].astype(np.int64), n[y].astype(np.int64)
            most = np.minimum(nx - pos[x], ny - pos[y])
            good = (100 * nx >= percent * ny) & (100 * ny >= percent * nx) & ((100 + percent) * most >= percent * (nx + ny)) & (node[x] != node[y])
            x, y = x[good], y[good]
            swap = node[x] > node[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            yield frame(token[x], node[x], node[y], n[x], n[y], pos[x])

    return sorted_rows.mapInArrow(run, "token long, a long, b long, na int, nb int, pos int")


class Links:
    """Links between nodes: pairs are screened by histograms and verified once with both sets."""

    def __init__(self, nodes: DataFrame, docs: DataFrame, k: int, percent: int):
        """``nodes``: node, doc_id, n, digest, histogram of all nodes; ``docs``: doc_id, text."""
        self.nodes, self.docs, self.k, self.percent = nodes, docs, k, percent
        self.found: list[DataFrame] = []
        self.spent: list[DataFrame] = []
        self.sets = None

    def hold(self, needed: DataFrame) -> None:
        """Keeps the sets of ``needed`` (node) and a few others, hashed from their texts again: digest, shingles.

        A set comes once a task that reads its text, so tables of many equal rows stay small; a repeated set repeats links only.
        """
        docs, k = self.docs, self.k
        spark = docs.sparkSession
        # which documents are needed, as a filter of a few bits each: others' texts needn't be hashed again
        wanted = self.nodes.join(needed.select(F.col("node").alias("w")).distinct(), F.col("node") == F.col("w"), "left_semi").filter("doc_id is not null")
        wanted = stored(wanted.select("doc_id"), "wanted", SLIM)
        bits = bits_for(FILTER_SHARE * wanted.count(), LEAST_FILTER, MOST_FILTER)
        h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
        parts = wanted.select(F.shiftright(h, 15).alias("w"), h.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit")).groupBy("w").agg(F.bitmap_construct_agg("bit").alias("b"))
        have = np.zeros((1 << bits) >> 3, np.uint8)
        for r in parts.collect():
            have[r["w"] << 12 : (r["w"] + 1) << 12] = np.frombuffer(r["b"], np.uint8)
        unstore(wanted)
        sent = spark.sparkContext.broadcast(have)

        @lean
        def run(batches):
            have, seen = sent.value, set()
            for batch in batches:
                cell = np.asarray(batch.column(2))
                use = (have[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
                use |= np.asarray(batch.column(0).is_null())
                part = pa.Table.from_batches([batch]).filter(pa.array(use))
                digest, blob, size = [], [], 0
                for _, s in sets(part.column(1), k) if part.num_rows else ():
                    raw = s.tobytes()
                    key = xxhash.xxh3_128_digest(raw)
                    if key not in seen:  # copies of a needed document: one a task
                        seen.add(key)
                        digest.append(key)
                        blob.append(raw)
                        size += len(raw)
                    if size > 4 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(blob, pa.binary())], ["digest", "shingles"])
                        digest, blob, size = [], [], 0
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(blob, pa.binary())], ["digest", "shingles"])

        with batches_of(spark, 256):
            self.sets = stored(docs.select("doc_id", "text", h.alias("cell")).mapInArrow(run, "digest binary, shingles binary"), "sets")

    def screen(self, pairs: DataFrame) -> DataFrame:
        """The distinct ``pairs`` (a, b, na, nb) that histograms don't rule out, with their digests: a, b, da, db."""
        percent = self.percent
        pairs = pairs.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"))

        @lean
        def suffix(batches):
            for batch in batches:
                ha, hb = (batch.column(i).to_pylist() for i in (6, 7))
                keep = []
                for na, nb, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), ha, hb, strict=True):
                    most = min(na, nb) if x is None or y is None else int(np.minimum(np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2")).sum())
                    keep.append((100 + percent) * most >= percent * (na + nb))
                out = pa.Table.from_batches([batch]).filter(pa.array(keep, pa.bool_())).select(["a", "b", "da", "db"])
                yield from out.to_batches()

        left = self.nodes.select(F.col("node").alias("a"), F.col("digest").alias("da"), F.col("histogram").alias("ha"))
        right = self.nodes.select(F.col("node").alias("b"), F.col("digest").alias("db"), F.col("histogram").alias("hb"))
        with batches_of(self.docs.sparkSession, 4096):
            return stored(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "da", "db", "ha", "hb").mapInArrow(suffix, "a long, b long, da binary, db binary"), "pairs", 4)

    def with_sets(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (.., da, db; a stored table) with both sets, sa and sb. Only sets of these pairs move."""
        used = stored(pairs.select(F.col("da").alias("used")).unionAll(pairs.select("db")).distinct(), "used", SLIM)
        self.spent.append(used)
        sets_ = slim_join(self.sets, used, F.col("digest") == F.col("used"), "left_semi")
        left, right = sets_.select(F.col("digest").alias("da"), F.col("shingles").alias("sa")), sets_.select(F.col("digest").alias("db"), F.col("shingles").alias("sb"))
        return pairs.join(right, "db").join(left, "da")

    def verify(self, told: DataFrame) -> None:
        """Adds the links among the screened pairs ``told``."""
        percent = self.percent

        @lean
        def whole(batches):
            for batch in batches:
                a, b, keep = batch.column(2), batch.column(3), []
                for x, y in zip(a, b, strict=True):
                    p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    if len(p) > len(q):
                        p, q = q, p
                    both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                    keep.append(100 * both >= percent * (len(p) + len(q) - both))
                out = pa.Table.from_batches([batch]).select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
                yield from out.to_batches()

        def linked(part: DataFrame) -> DataFrame:
            with batches_of(part.sparkSession, 64):  # two whole sets a row
                return stored(self.with_sets(part).select("a", "b", "sa", "sb").mapInArrow(whole, "a long, b long"), "links", 4)

        # first each node with one partner; then the pairs that these links leave apart
        one = stored(told.groupBy("b").agg(F.min(F.struct("a", "da", "db")).alias("m")).select("m.a", "b", "m.da", "m.db"), "one", SLIM)
        self.found.append(linked(one))
        group = self.groups()
        apart = told.join(one.select("a", "b"), ["a", "b"], "left_anti")
        for end in "ab":
            apart = apart.join(group.select(F.col("node").alias(end), F.col("group").alias(f"g{end}")), end, "left").withColumn(f"g{end}", F.coalesce(f"g{end}", end))
        apart = stored(apart.filter("ga <> gb").select("a", "b", "da", "db"), "apart", SLIM)
        self.found.append(linked(apart))
        for gone in (one, group, apart):
            unstore(gone)

    def groups(self) -> DataFrame:
        links = self.found[0]
        for more in self.found[1:]:
            links = links.unionAll(more)
        return stored(components(links).select("node", F.col("component").alias("group")), "groups", SLIM)

    def forget(self) -> None:
        for gone in (*self.found, *self.spent, self.sets):
            unstore(gone)


def leaders_of(long: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of the nodes of long lists (token, node, n) with LEADERS of their list and span of sizes.

    A list's rows are dealt into SALTS parts, each of which gets the list's leaders, so a hot list is no task's.
    """
    part = long.withColumn("span", F.floor(F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.12))) / 2))
    # the same for lists of the same nodes
    lucky = [F.min(F.struct(F.xxhash64("node", F.lit(k)), "node", "n")) for k in range(LEADERS)]
    lead = part.groupBy(F.col("token").alias("lt"), F.col("span").alias("ls")).agg(F.array(*lucky).alias("leaders")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    part = part.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    # a leader may stand behind the first shingle that a pair shares, so only lengths count here
    apart = F.filter("leaders", lambda l: (l["node"] != F.col("node")) & (100 * l["n"] >= percent * F.col("n")) & (100 * F.col("n") >= percent * l["n"]))
    found = part.join(lead, (F.col("token") == F.col("lt")) & (F.col("span") == F.col("ls")) & (F.col("salt") == F.col("part"))).select(F.col("node").alias("a"), F.col("n").alias("na"), apart.alias("leaders"))
    # a node meets a leader once, however many lists both stand in: at most LEADERS for each shingle of its prefix
    found = found.groupBy("a").agg(F.first("na").alias("na"), F.array_distinct(F.flatten(F.collect_set("leaders"))).alias("leaders"))
    found = found.select("a", "na", F.explode("leaders").alias("l")).select("a", "na", F.col("l.node").alias("b"), F.col("l.n").alias("nb"))
    low = F.col("a") < F.col("b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(low, F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(low, F.col("nb")).otherwise(F.col("na")).alias("nb"))


def across(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) across the groups of each list of (token, node, n, pos, group) that pass the length and positional filters."""
    # a node's place may leave too little behind it for a partner of any size
    some = lists.filter((100 + percent) * (F.col("n") - F.col("pos")) >= percent * (F.col("n") + F.ceil(F.col("n") * percent / 100.0)))
    x, y = (some.select("token", *(F.col(c).alias(to + e) for c, to in (("node", ""), ("n", "n"), ("pos", "pos"), ("group", "g")))) for e in "ab")
    most = F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb"))
    fits = (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na")) & ((100 + percent) * most >= percent * (F.col("na") + F.col("nb")))
    return x.join(y, "token").filter((F.col("a") < F.col("b")) & (F.col("ga") != F.col("gb")) & fits).select("a", "b", "na", "nb")


def differing(long: DataFrame, check: Links, ranks, percent: int) -> DataFrame | None:
    """Pairs (a, b, da, db), screened, that can still link across the groups of long lists (token, node, n, pos, group); None if none is left.

    Adds the links between nodes and pivots to ``check`` on the way; see step 5 of the module's text. With d(x) the shingles in
    which x differs from the pivot and p for ``percent``, x and y link if and only if they share at least
    (u(x) + u(y)) / (2 (100 + p)) differences, where u(x) = (100 + p) |d(x)| - (100 - p) |x|. A node's difference at a place
    after which (itself included) r are left can be the first that it shares with y only if u(y) <= 2 (100 + p) r - u(x), its cap.
    """
    both, apart = 100 + percent, 100 - percent
    per = long.groupBy("token", "group").agg(F.count(F.lit(1)).alias("c"))
    open_ = per.groupBy(F.col("token").alias("t")).agg(F.max(F.struct("c", "group")).alias("m"), F.count(F.lit(1)).alias("k"), F.sum("c").alias("nodes")).filter("k > 1")
    open_ = stored(open_.select("t", F.col("m.group").alias("home"), (F.col("nodes") <= MIDDLE).alias("few")), "open", SLIM)
    few = stored(long.join(open_.filter("few"), F.col("token") == F.col("t"), "left_semi"), "few", SLIM)
    found = across(few, percent)
    cells = stored(long.join(open_.filter("not few"), F.col("token") == F.col("t")).groupBy("node", "home").agg(F.first("group").alias("group"), F.first("n").alias("n")), "cells", SLIM)
    if cells.isEmpty():
        out = None if few.isEmpty() else check.screen(found)
        for gone in (open_, few, cells):
            unstore(gone)
        return out
    # a group's pivot: its node that stands in most long lists, which tends to be the text that others are copies of
    often = long.groupBy("group", "node").agg(F.count(F.lit(1)).alias("c")).groupBy(F.col("group").alias("g")).agg(F.max(F.struct("c", (-F.col("node")).alias("less"))).alias("m")).select("g", (-F.col("m.less")).alias("pivot"))
    digest = check.nodes.select(F.col("node").alias("v"), "digest")
    named = cells.join(often, F.col("home") == F.col("g")).drop("g")
    named = named.join(digest.withColumnRenamed("digest", "da"), F.col("node") == F.col("v")).drop("v")
    named = stored(named.join(digest.withColumnRenamed("digest", "db"), F.col("pivot") == F.col("v")).drop("v"), "named", SLIM)

    @lean
    def compare(batches):
        rank = ranks.value
        for batch in batches:
            linked, u, lists = [], [], []
            for n, x, y in zip(batch.column(4).to_pylist(), batch.column(5), batch.column(6), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                more, less = np.setdiff1d(p, q, assume_unique=True), np.setdiff1d(q, p, assume_unique=True)
                # rare first: as many nodes lack one of the pivot's shingles as its commonest one is held by more
                often = np.concatenate([counts(rank, more), counts(rank, q).max() - counts(rank, less)])
                own = np.concatenate([more, less])
                lists.append(own[np.lexsort((own, often))].view(np.int64))
                size = len(own)
                linked.append(both * size <= apart * (n + len(q)))
                u.append(both * size - apart * n)
            at = np.concatenate([[0], np.cumsum([len(z) for z in lists])]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*lists, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(linked, pa.bool_()), pa.array(u, pa.int64()), tokens], ["node", "home", "group", "pivot", "n", "linked", "u", "differences"])

    with batches_of(long.sparkSession, 64):
        compared = check.with_sets(named).select("node", "home", "group", "pivot", "n", "sa", "sb").mapInArrow(compare, "node long, home long, group long, pivot long, n int, linked boolean, u long, differences array<long>")
        # a set that came from several tasks repeats its rows
        compared = stored(compared.dropDuplicates(["node", "pivot"]), "compared", 4)
    check.found.append(stored(compared.filter("linked and node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")), "links", SLIM))

    # the pivot itself differs in nothing; it has been compared with all
    inside = F.col("linked") | (F.col("group") == F.col("home"))
    some = compared.filter("node <> pivot").withColumn("inside", inside).withColumn("group", F.when(inside, F.col("home")).otherwise(F.col("group")))
    lows = some.groupBy(F.col("pivot").alias("p")).agg(F.min(F.when(F.col("inside"), F.col("u"))).alias("low_in"), F.min(F.when(~F.col("inside"), F.col("u"))).alias("low_out")).filter("low_out is not null")
    some = some.join(lows, F.col("pivot") == F.col("p"))
    partner = F.when(F.col("inside"), F.col("low_out")).otherwise(F.least("low_in", "low_out"))
    size = F.size("differences")
    least_left = F.greatest(F.lit(1), F.ceil((partner + F.col("u")) / (2.0 * both))).cast("int")
    some = some.withColumn("size", size).withColumn("kept", F.slice("differences", F.lit(1), F.greatest(F.lit(0), size - least_left + 1)))
    some = some.select("pivot", "node", "group", "n", "u", "size", F.posexplode("kept").alias("pos", "token")).withColumn("cap", 2 * both * (F.col("size") - F.col("pos")).cast("long") - F.col("u")).drop("size", "pos")
    some = stored(some, "differences", SLIM)
    keys = some.groupBy(F.col("pivot").alias("p"), F.col("token").alias("t")).agg(F.min("u").alias("low"), F.min("group").alias("g0"), F.max("group").alias("g1")).filter("g0 < g1").drop("g0", "g1")
    kept = stored(some.join(keys, (F.col("pivot") == F.col("p")) & (F.col("token") == F.col("t")) & (F.col("cap") >= F.col("low"))).drop("p", "t", "low"), "kept", SLIM)
    x, y = (kept.select("pivot", "token", F.col("node").alias(e), F.col("n").alias(f"n{e}"), F.col("group").alias(f"g{e}"), F.col("u").alias(f"u{e}"), F.col("cap").alias(f"cap{e}")) for e in "ab")
    changed = x.join(y, ["pivot", "token"]).filter((F.col("a") < F.col("b")) & (F.col("ga") != F.col("gb")) & (F.col("ua") <= F.col("capb")) & (F.col("ub") <= F.col("capa")) & (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na")))
    out = check.screen(found.unionAll(changed.select("a", "b", "na", "nb")))
    for gone in (open_, few, cells, named, compared, some, kept):
        unstore(gone)
    return out


def row_groups(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, mark, n, component_id, node, first) of every row of ``docs`` (doc_id, mark, text): ``first`` tells the row, of
    those with the smallest identifier of a component (nulls last), that has the smallest mark; null without shingles."""
    with shuffles_dropped(docs.sparkSession):
        return _row_groups(docs, k, percent)


def _row_groups(docs: DataFrame, k: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    used: list[DataFrame] = []

    def keep(df: DataFrame, tag: str, rows: int = 256, share: int = 1) -> DataFrame:
        with batches_of(spark, rows):
            used.append(stored(df, tag, share))
        return used[-1]

    with batches_of(spark, 256):
        ranks = spark.sparkContext.broadcast(count_sketch(docs.select("text"), k))
    rows = stored_rows = keep(signatures(docs, ranks, k, percent).withColumn("row", F.monotonically_increasing_id()), "signatures")

    # equal sets are one node, named by its smallest row
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "mark")).alias("best")
    classes = keep(rows.filter("n > 0").groupBy("digest").agg(F.min("row").alias("node"), best), "classes", share=4)
    copies = keep(rows.filter("n > 0").select("row", "digest").join(classes.select(F.col("digest").alias("d"), "node"), F.col("digest") == F.col("d")).filter("row <> node").select(F.col("row").alias("copy")), "copies", share=SLIM)
    single = slim_join(rows.filter("n > 0"), copies, F.col("row") == F.col("copy"), "left_anti").withColumnRenamed("row", "node")
    check = Links(keep(single.select("node", "doc_id", "n", "digest", "histogram"), "nodes"), docs.select("doc_id", "text"), k, percent)

    posting = single.select(F.posexplode("prefix").alias("pos", "token"), "node", "n").select("token", "node", "n", "pos")
    found = keep(postings(posting.repartition(tasks(spark), "token").sortWithinPartitions("token"), percent), "postings", 8192)
    first = found.filter("b is not null").select("a", "b", "na", "nb")
    long = found.filter("b is null").select("token", F.col("a").alias("node"), F.col("na").alias("n"), "pos")

    told = check.screen(first.unionAll(leaders_of(long, percent)))
    check.hold(told.select(F.col("a").alias("node")).unionAll(told.select("b")).unionAll(long.select("node")))
    check.verify(told)
    unstore(told)
    group = check.groups()
    grouped = long.join(group.withColumnRenamed("node", "v"), F.col("node") == F.col("v"), "left").withColumn("group", F.coalesce("group", "node")).select("token", "node", "n", "pos", "group")
    grouped = keep(grouped, "grouped", share=4)
    unstore(group)
    told = differing(grouped, check, ranks, percent)
    if told is not None:
        check.verify(told)
        unstore(told)

    group = check.groups()
    named = classes.join(group.withColumnRenamed("node", "v"), F.col("node") == F.col("v"), "left").withColumn("group", F.coalesce("group", "node"))
    least = named.groupBy(F.col("group").alias("g")).agg(F.min("best").alias("first"))
    named = stored(named.join(least, F.col("group") == F.col("g")).select(F.col("digest").alias("d"), "node", "first"), "told", 4)
    check.forget()
    for gone in (group, *used):
        if gone is not stored_rows:
            unstore(gone)
    fields = "doc_id", "mark", "n"
    out = rows.filter("n > 0").join(named, F.col("digest") == F.col("d")).select(*fields, F.col("first.doc_id").alias("component_id"), "node", "first")
    none = rows.filter("n = 0").select(*fields, F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("node"), F.lit(None).cast(named.schema["first"].dataType).alias("first"))
    return out.unionAll(none)


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id.

    A text's set holds its distinct ``k``-word shingles (words between ASCII white space, A-Z lower-cased); a shorter text's
    whole sequence is its one shingle; null texts and texts without words have none and link with nothing. Two rows link when
    100 * intersection >= percent * union; component_id is the smallest identifier reachable by links. Rows that
    repeat an identifier are rows of their own; null identifiers are never the smallest unless a group has no other. Other
    columns are ignored; an empty table gives an empty result. Links are exact but for 64-bit hashes of shingles. No list,
    group or candidate is capped: see the module's text for how long lists keep their links.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("mark"), F.col(text_col).cast("string").alias("text"))
    return row_groups(slim, k, percent).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each group of ``docs``, with all its columns; see ``jaccard_groups``.

    Of a group the row with the smallest identifier stays (nulls last), of rows that repeat it the one whose text has the smallest
    hash, of rows that repeat that too any one. Rows without words stay. Columns of any name are kept.
    """
    i, m = free_name(docs, "kg_id"), free_name(docs, "kg_mark")
    keyed = docs.withColumns({i: F.col(id_col).cast("long"), m: F.xxhash64(F.col(text_col).cast("string"))})
    rows = stored(row_groups(keyed.select(F.col(i).alias("doc_id"), F.col(m).alias("mark"), F.col(text_col).cast("string").alias("text")), k, percent).filter("n > 0").select("doc_id", "mark", "first"), "rows", 4)
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    gone = rows.filter(~stays).select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct()
    gone = stored(gone, "gone", SLIM)
    same = lambda df, a, b: keyed_on(df, i, m, a, b)
    kept = keyed.join(gone, same(keyed, gone.gone_id, gone.gone_mark), "left_anti")
    again = rows.groupBy("doc_id", "mark").count().filter("count > 1").select(F.col("doc_id").alias("again_id"), F.col("mark").alias("again_mark"))
    again = stored(again, "again", SLIM)
    if not again.isEmpty():
        on = same(kept, again.again_id, again.again_mark)
        kept = kept.join(again, on, "left_anti").unionAll(kept.join(again, on, "left_semi").dropDuplicates([i, m]))
    return kept.drop(i, m)


def keyed_on(df: DataFrame, i: str, m: str, a, b):
    return df[i].eqNullSafe(a) & (df[m] == b)
