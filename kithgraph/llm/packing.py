"""Pattern packing by non-negative least squares (operator 4).

1. Every document is tokenized in Arrow functions; it leaves one slim row per piece.
2. The histogram of piece lengths (at most ``capacity`` rows) reaches the driver. All patterns of up to three
   lengths that fill a sequence are enumerated, their repeat counts fitted to the histogram by non-negative
   least squares, rounded within what the histogram holds, and the residual lengths packed best-fit.
3. Each pattern slot is an interval of ranks of its length. Pieces are ranked within (length, salt) groups, so a
   length that a third of all pieces have is spread over all tasks, and find their slot by their rank.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, lean, stored, tasks
from .token_counts import tokenizer

CAPACITY, END_ID = 1024, 2
SPECIAL = "<|endoftext|>"
#: Characters of which both libraries are known to make the same words; other texts go the slower way.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ɏ]*")
_fast: dict = {}


class Encoder:
    """Ids of the tokenizers file ``path``: the library itself, or its merges as ranks in the quicker tiktoken.

    Both apply the same merges to the same words, so ids agree (a test compares them). The quicker form
    needs a byte-level BPE file whose words are split by the usual pattern, and takes texts of
    ASCII and Latin letters without special strings; all other texts are encoded by the library.
    """

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        self.quick = _tiktoken(path)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        slow = []
        for i, text in enumerate(texts):
            if self.quick is not None and PLAIN.fullmatch(text) and "<|" not in text:
                out[i] = np.asarray(self.quick.encode_ordinary(text), dtype="<u4")
            else:
                slow.append(i)
        for i, found in zip(slow, self.tok.encode_batch([texts[i] for i in slow], add_special_tokens=False), strict=True):
            out[i] = np.asarray(found.ids, dtype="<u4")
        return out


def _tiktoken(path: str):
    """A tiktoken encoding with the vocabulary of a byte-level BPE file, or None."""
    import json

    import tiktoken

    if path in _fast:
        return _fast[path]
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges")
    plain = plain and not any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    if plain and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _fast[path] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    else:
        _fast[path] = None
    return _fast[path]


def token_pieces(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    @lean
    def run(batches):
        encode = Encoder(path)
        for batch in batches:
            owner, piece, start, length, crc = [], [], [], [], []
            for at, ids in enumerate(encode([x or "" for x in batch.column(1).to_pylist()])):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                n = len(ids)
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for k in range(len(cuts) - 1):
                    owner.append(at)
                    piece.append(k)
                    start.append(cuts[k])
                    length.append(cuts[k + 1] - cuts[k])
                    crc.append(zlib.crc32(ids[cuts[k] : cuts[k + 1]].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- patterns, on the histogram


def patterns(capacity: int, present: np.ndarray) -> np.ndarray:
    """All (a, b, c), a >= b >= c >= 0, a + b + c = capacity, of lengths that occur (0: no third or second)."""
    has = np.zeros(capacity + 1, bool)
    has[present] = True
    has[0] = True
    a, b = np.meshgrid(np.arange(1, capacity + 1), np.arange(capacity), indexing="ij")
    c = capacity - a - b
    good = (b <= a) & (c >= 0) & (c <= b)
    a, b, c = a[good], b[good], c[good]
    used = has[a] & has[b] & has[c]
    return np.stack([a[used], b[used], c[used]], axis=1)


def fit_repeats(pats: np.ndarray, counts: np.ndarray, tol: float = 1e-3, most: int = 20_000) -> np.ndarray:
    """Non-negative x that brings sum of x * pattern near ``counts``: least squares, longer lengths weighing more.

    Accelerated projected gradient over the sparse pattern matrix; the step comes from its norm. Ends when 50 rounds take less
    than ``tol`` off the remainder, relative to it or to the counts, and raises if ``most`` don't bring that.
    """
    size = len(counts)
    if not len(pats):
        return np.zeros(0)
    weight = np.sqrt(np.arange(size) / (size - 1) + 0.05)
    weight[0] = 0.0
    target = counts * weight

    def forward(x):
        return weight * sum(np.bincount(pats[:, k], weights=x, minlength=size) for k in range(3))

    def back(r):
        r = r * weight
        return r[pats[:, 0]] + r[pats[:, 1]] + r[pats[:, 2]]

    v = np.ones(len(pats))
    norm = 1.0
    for _ in range(12):  # power method
        v = back(forward(v))
        norm = float(np.linalg.norm(v))
        v /= norm
    x = y = np.zeros(len(pats))
    t, before = 1.0, np.inf
    for turn in range(1, most + 1):
        new = np.maximum(0.0, y - back(forward(y) - target) / norm)
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
        if turn % 50 == 0:
            left = float(np.linalg.norm(forward(x) - target))
            if before - left < tol * max(left, 1e-3 * float(np.linalg.norm(target))):
                return x
            before = min(before, left)
    raise RuntimeError("the fit of the repeats did not converge")


#: Shares of the fitted repeats that are tried, each most of them; what a share leaves over is packed best-fit.
SHARES = (1.0, 0.9, 0.8, 0.7, 0.6)


def plan_sequences(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, times) that hold every length exactly ``counts`` times.

    The repeats are fitted once. Rounding leaves residual lengths; keeping back a share of all repeats leaves them
    better partners, so a few shares are tried on the histogram and the plan of fewest sequences is taken.
    """
    left = counts.astype(np.int64).copy()
    full = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    pats = patterns(capacity, np.flatnonzero(left))
    x = fit_repeats(pats, left.astype(float))
    plans = [held + best_fit(rest, capacity) for held, rest in (rounded(pats, x, left, share) for share in SHARES)]
    return full + min(plans, key=lambda plan: sum(times for _, times in plan))


def rounded(pats: np.ndarray, x: np.ndarray, counts: np.ndarray, share: float) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """(pattern, times) of about ``share`` of the repeats x, and the counts that are left.

    Patterns are taken in order of their repeats, each rounded but once at least, as often as lengths are left, until the sum
    of the repeats is used up.
    """
    left, plan, open_ = counts.copy(), [], int(share * x.sum())
    for p in np.argsort(-x, kind="stable"):
        if open_ <= 0:
            break
        lengths = [int(v) for v in pats[p] if v]
        need = {v: lengths.count(v) for v in lengths}
        n = min([open_, max(1, int(x[p] + 0.5)), *(int(left[v]) // k for v, k in need.items())])
        if n > 0:
            plan.append((tuple(lengths), n))
            open_ -= n
            for v, k in need.items():
                left[v] -= n * k
    return plan, left


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: equal open sequences are one entry, so the work follows lengths, not pieces."""
    open_: dict[int, list[list]] = {}  # room -> [[lengths, times]]
    for length in range(capacity, 0, -1):
        n = int(left[length])
        for room in sorted(r for r in open_ if r >= length):
            while n and open_.get(room):
                bins, times = open_[room].pop()
                k = min(room // length, -(-n // times)) if times <= n else 1
                use = min(times, n // k) if n >= k else 0
                if not use:
                    k, use = 1, min(times, n)
                if times > use:
                    open_[room].append([bins, times - use])
                open_.setdefault(room - k * length, []).append([(*bins, *[length] * k), use])
                n -= k * use
            if not open_.get(room):
                open_.pop(room, None)
        if n:
            k = capacity // length
            if n // k:
                open_.setdefault(capacity - k * length, []).append([(length,) * k, n // k])
            if n % k:
                open_.setdefault(capacity - n % k * length, []).append([(length,) * (n % k), 1])
    return [(tuple(b), t) for bins in open_.values() for b, t in bins]


def slot_table(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """Intervals of ranks: a piece of ``length`` and rank in [first, next first) is in sequence base + rank - first."""
    rows, used, base = [], np.zeros(capacity + 1, np.int64), 0
    for lengths, times in plan:
        at = 0
        for v in lengths:
            rows.append((v, int(used[v]), base, at))
            used[v] += times
            at += v
        base += times
    rows.sort()
    got = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"length": got[:, 0], "first": got[:, 1], "base": got[:, 2], "offset": got[:, 3]}


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; only longer ones are cut, into full pieces after a first, shorter one.
    Null and empty texts are the end id alone. Rows that repeat an identifier are packed each; null
    identifiers are kept; other columns are ignored; an empty table gives an empty result. A sequence's
    pieces lie gapless from offset 0. The slots' table is bounded by ``capacity``, not by the input.
    """
    spark = docs.sparkSession
    with batches_of(spark, 256):
        found = stored(token_pieces(docs, path, id_col, text_col, capacity, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    salts = tasks(spark)
    salted = found.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    sums = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = np.zeros(capacity + 1, np.int64)
    for r in salted.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    slots = slot_table(plan_sequences(counts, capacity), capacity)
    table = spark.sparkContext.broadcast(slots)

    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1
    ranked = salted.withColumn("own", own).join(starts.drop("n"), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("ahead")).alias("rank"))

    @lean
    def place(batches):
        s = table.value
        # one ascending key of (length, first): ranks stay below 2**52
        width = np.int64(1) << np.int64(52)
        key = s["length"] * width + s["first"]
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            at = np.searchsorted(key, length * width + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(s["base"][at] + rank - s["first"][at], pa.int64()), pa.array(s["offset"][at], pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
