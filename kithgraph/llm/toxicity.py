"""Toxicity by a character n-gram linear classifier with naive Bayes log-count ratios (operator 2).

Features are the presence of character n-grams (3 to 6 lower-cased characters). Each is scaled by the log of the ratio
of its smoothed document shares in toxic and other training texts; logistic regression is fitted on the
scaled features that tell the classes apart best.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, codepoints, large, mix64, small_batches, stored, tasks, unstore

#: Lengths of n-grams, features kept, labelled texts of a class that are fitted on (at most), least texts with a feature.
ORDERS, FEATURES, FIT_TEXTS, LEAST = (3, 4, 5, 6), 4096, 4000, 4
#: Characters handled at once, which bounds a worker's arrays whatever a text's length.
CHUNK = 1 << 20
THRESHOLD = 0.7
THRESHOLD_LOGIT = float(np.log(THRESHOLD / (1 - THRESHOLD)))
NEAR = 0.3
#: Parts of the fitted texts, each of which is held out once to place the operating point.
FOLDS = 5


def grams(points: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams at all positions; 0 where one would reach over the end of a text (a zero character)."""
    p = points.astype(np.uint64)
    if len(p) < n:
        return np.zeros(0, np.uint64)
    m = len(p) - n + 1
    h = np.full(m, n, np.uint64)
    for k in range(n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += p[k : m + k]
    h = mix64(h)
    ends = np.flatnonzero(points == 0)
    for k in range(n):
        at = ends - k
        h[at[(at >= 0) & (at < m)]] = 0
    return h


def chunks(texts: pa.Array):
    """(code points, text of each, in order) of runs of about CHUNK characters; a longer text comes in overlapping parts.

    Every text is padded with one space on both sides, so that n-grams see its first and last words' ends.
    """
    low = pc.utf8_lower(texts)
    sizes = np.asarray(pc.utf8_length(low)).astype(np.int64) + 3
    at, n = 0, len(low)
    while at < n:
        end, total = at, 0
        while end < n and (end == at or total + sizes[end] <= CHUNK):
            total += sizes[end]
            end += 1
        padded = pc.binary_join_element_wise(pa.scalar("", low.type), low.slice(at, end - at), pa.scalar("", low.type), pa.scalar(" ", low.type))
        points, start = codepoints(padded)
        owner = np.repeat(np.arange(at, end), np.diff(start))
        step = CHUNK if end - at == 1 else len(points)
        for lo in range(0, max(1, len(points)), max(1, step)):
            part = slice(lo, min(len(points), lo + step + max(ORDERS) - 1))
            yield points[part], owner[part]
        at = end


class Model:
    """Sorted feature hashes, their weights and the bias; a bit table lets most n-grams skip the search."""

    BITS = 22

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[order], weights[order].astype(np.float64), float(bias)

    def table(self) -> np.ndarray:
        if not hasattr(self, "_table"):
            t = np.zeros(1 << self.BITS, bool)
            t[(self.keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True
            self._table = t
        return self._table

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) of every feature that a text holds, once each, sorted."""
        found = []
        for points, owner in chunks(texts):
            for n in ORDERS:
                h = grams(points, n)
                at = np.flatnonzero(self.table()[(h >> np.uint64(64 - self.BITS)).astype(np.int64)])
                place = np.minimum(np.searchsorted(self.keys, h[at]), max(0, len(self.keys) - 1))
                good = self.keys[place] == h[at] if len(self.keys) else np.zeros(len(at), bool)
                found.append(np.unique(owner[at[good]] * np.int64(len(self.keys)) + place[good]))
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return np.divmod(both, max(1, len(self.keys)))

    def predict(self, texts: pa.Array) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        if len(self.keys):
            text, feature = self.hits(texts)
            z += np.bincount(text, weights=self.weights[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def regression(text: np.ndarray, feature: np.ndarray, scale: np.ndarray, label: np.ndarray, size: int, c: float = 0.1, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights (of unscaled features) and bias of logistic regression with an L2 penalty of ``c``: Newton steps, each
    solved by conjugate gradients and halved until the loss falls."""
    n = len(label)
    sign, value = label * 2.0 - 1, scale[feature]

    def margins(w):
        return np.bincount(text, weights=value * w[feature], minlength=n) + w[size]

    def gathered(r):
        return np.append(np.bincount(feature, weights=value * r[text], minlength=size), r.sum())

    ridge = np.append(np.full(size, c), 1e-6)

    def loss(w):
        return float(np.logaddexp(0, -sign * margins(w)).sum() + 0.5 * (ridge * w * w).sum())

    w = np.zeros(size + 1)
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(margins(w), -500, 500)))
        grad = gathered(p - label) + ridge * w
        if np.linalg.norm(grad) < 1e-6 * max(1, n):
            break
        curve = p * (1 - p)
        d, r = np.zeros(size + 1), -grad
        q, rr = r.copy(), float(r @ r)
        for _ in range(60):
            hq = gathered(curve * margins(q)) + ridge * q
            step = rr / float(q @ hq)
            d += step * q
            r -= step * hq
            new = float(r @ r)
            if new < 1e-4 * float(grad @ grad):
                break
            q, rr = r + new / rr * q, new
        t = 1.0
        while t > 1e-4 and loss(w + t * d) > now:
            t /= 2
        w = w + t * d
        before, now = now, loss(w)
        if before - now < 1e-7 * before:
            break
    return w[:size] * scale, float(w[size])


def text_key(text):
    """A hash of a text, null as empty: what ``fit`` tells texts apart by."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")), F.lit(2))


def fit(train: DataFrame, text_col: str = "text", label_col: str = "toxic", most_texts: int = FIT_TEXTS, features: int = FEATURES, key_col: str | None = None) -> Model:
    """The model of rows whose label is 0 or 1, from at most ``most_texts`` different texts of each class.

    The sample holds the texts of the smallest hashes, each once however many rows repeat it, so it depends on neither partitions nor
    copies. The bias is an operating point; see
    ``boundary``. Without texts of both classes the model scores the share of toxic ones. ``key_col`` names a column of
    ``text_key``, if the rows have one: made before a join, it moves in place of the text until the sample is known.
    """
    with batches_of(train.sparkSession, 1024):
        return _fitted(train, text_col, label_col, most_texts, features, key_col)


def _fitted(train: DataFrame, text_col: str, label_col: str, most_texts: int, features: int, key_col: str | None) -> Model:
    spark = train.sparkSession
    key = F.col(key_col) if key_col else text_key(F.col(text_col))
    rows = train.filter(F.col(label_col).isin(0, 1)).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("label"), key.alias("h"))
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not n.get(0) or not n.get(1):
        share = np.clip(n.get(1, 0) / max(1, sum(n.values())), 1e-6, 1 - 1e-6)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    keys = stored(rows.groupBy("label", "h").count(), "keys")
    upto = {c: keys.filter(F.col("label") == c).select("h").orderBy("h").limit(most_texts).agg(F.max("h").alias("m")).first()["m"] for c in (0, 1)}
    unstore(keys)
    picked = rows.filter(F.col("h") <= F.when(F.col("label") == 1, upto[1]).otherwise(upto[0]))
    # copies meet in their tasks first
    picked = stored(picked.groupBy("label", "h").agg(F.min("text").alias("text")).select("text", "label").repartition(tasks(spark)), "picked")

    def document_counts(batches):
        """Per batch of texts: in how many of each class an n-gram stands."""
        for batch in batches:
            label = np.asarray(batch.column(1))
            found = []
            for points, owner in chunks(large(batch.column(0))):
                own = owner.astype(np.uint64)
                for k in ORDERS:
                    h = grams(points, k)
                    good = h != 0
                    h, o = h[good], own[: len(good)][good]
                    order = np.lexsort((h, o))
                    h, o = h[order], o[order]
                    first = np.ones(len(h), bool)
                    first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
                    found.append((h[first], label[o[first].astype(np.int64)]))
            if found:
                keys, inv = np.unique(np.concatenate([h for h, _ in found]), return_inverse=True)
                marks = np.concatenate([x for _, x in found])
                pos = np.bincount(inv, weights=marks, minlength=len(keys)).astype(np.int64)
                neg = np.bincount(inv, minlength=len(keys)) - pos
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(pos), pa.array(neg)], ["key", "pos", "neg"])

    sizes = {r["label"]: r["count"] for r in picked.groupBy("label").count().collect()}
    p, q = sizes.get(1, 0), sizes.get(0, 0)
    counts = picked.mapInArrow(document_counts, "key long, pos long, neg long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # distance from chance: (observed - expected)^2 / expected, summed over both classes
    seen, share = F.col("pos") + F.col("neg"), p / max(1, p + q)
    gap = F.col("pos") - seen * share
    counts = counts.filter(seen >= LEAST).withColumn("chi", gap * gap / (seen * share * (1 - share) + 1e-9))
    top = counts.orderBy(F.desc("chi"), "key").limit(features).collect()
    keys = np.array([r["key"] for r in top], np.int64).view(np.uint64)
    pos, neg = (np.array([r[k] for r in top], float) for k in ("pos", "neg"))
    ratio = np.log(((pos + 1) / (p + 2)) / ((neg + 1) / (q + 2)))
    model = Model(keys, ratio, 0.0)
    sent = spark.sparkContext.broadcast(pickle.dumps(model))

    def held_features(batches):
        m = pickle.loads(sent.value)
        for batch in batches:
            text, feature = m.hits(large(batch.column(0)))
            lists = np.split(feature.astype(np.int32), np.searchsorted(text, np.arange(1, batch.num_rows)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x.tobytes() for x in lists], pa.binary())], ["label", "features"])

    found = picked.mapInArrow(held_features, "label int, features binary").collect()
    unstore(picked)
    found.sort(key=lambda r: (r["label"], bytes(r["features"])))
    label = np.array([r["label"] for r in found], float)
    lists = [np.frombuffer(r["features"], np.int32) for r in found]
    text = np.repeat(np.arange(len(found)), [len(x) for x in lists])
    feature = np.concatenate([*lists, np.zeros(0, np.int32)]).astype(np.int64)
    size = len(model.keys)
    weights, _ = regression(text, feature, model.weights, label, size)
    # the operating point comes from margins of texts that the weights weren't fitted on
    fold = np.array([zlib.crc32(r["features"]) % FOLDS for r in found])
    margin = np.zeros(len(label))
    for part in range(FOLDS):
        use = fold[text] != part
        place = np.cumsum(fold != part) - 1
        w, _ = regression(place[text[use]], feature[use], model.weights, label[fold != part], size)
        z = np.bincount(text, weights=w[feature], minlength=len(label))
        margin[fold == part] = z[fold == part]
    return Model(model.keys, weights, THRESHOLD_LOGIT - boundary(margin, label))


def boundary(margin: np.ndarray, label: np.ndarray) -> float:
    """The margin that shall score THRESHOLD: the share NEAR of the way from where other texts end to where toxic ones are.

    Other texts end at their 99.9th percentile. Toxic texts' 10th percentile marks where they are; if that is not
    above, classes overlap, and the margin of the best F1 is taken.
    """
    neg, pos = np.sort(margin[label == 0]), np.sort(margin[label == 1])
    lo, hi = np.quantile(neg, 0.999), np.quantile(pos, 0.1)
    if hi > lo:
        return float(lo + NEAR * (hi - lo))
    cuts = np.unique(pos)
    hit = len(pos) - np.searchsorted(pos, cuts)
    false = len(neg) - np.searchsorted(neg, cuts)
    return float(cuts[(2 * hit / (hit + false + len(pos))).argmax()])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, score (0 to 1), predicted (1 if score >= threshold, else 0).

    Null and empty texts score as texts without any feature. Repeated rows and null identifiers are kept; other columns are
    ignored; an empty table gives an empty result. Texts of any length are scored whole, in parts of a million characters.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        m = pickle.loads(sent.value)
        for batch in batches:
            s = m.predict(large(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double, predicted int")
