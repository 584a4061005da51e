"""Language identification by word-first backoff (operator 5).

A word seen in training scores its per-language log frequency. A word not seen falls back to its character n-grams:
the longest order of which any n-gram is known scores the word, shorter orders are tried only when none is.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import codepoints, large, lean, mix64, small_batches, stored, tasks, unstore

#: Documents of a language that are fitted on, about; known words of a language; longest n-gram; smoothing.
FIT_DOCS, FIT_WORDS, ORDER, ALPHA = 2000, 30_000, 5, 0.5
#: Words are runs of letters and marks that hold a letter.
NOT_LETTERS, LETTER = r"[^\p{L}\p{M}]+", r"\p{L}"
#: Log-probabilities below the best language's by more than this count as this: no single word decides a text.
FLOOR = 6.0


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words, lower-cased; index of each word's text)."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), NOT_LETTERS)
    owner = np.asarray(pc.list_parent_indices(lists)).astype(np.int64)
    flat = pc.list_flatten(lists)
    coded = flat.dictionary_encode()
    # marks alone make no word
    keep = np.asarray(pc.match_substring_regex(coded.dictionary, LETTER))[np.asarray(coded.indices)] if len(flat) else np.zeros(0, bool)
    return flat.filter(pa.array(keep)), owner[keep]


def ngrams(words: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each n-gram of the words, each word between two marks; index of its word)."""
    points, start = codepoints(words)
    # every text is followed by one zero: with the zero before it, a word lies between two marks
    p = np.concatenate([[np.uint64(0)], points.astype(np.uint64)])
    if len(p) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(len(p) - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + p[k : len(p) - n + 1 + k] + np.uint64(1)
    h = mix64(h + np.uint64(n))
    # word w spans p[start[w] .. start[w + 1]] including both marks
    size = np.diff(start) + 1
    count = np.maximum(0, size - n + 1)
    owner = np.repeat(np.arange(len(words)), count)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return h[start[owner] + inner], owner


class Model:
    """Languages, known words with their log frequencies, and sorted n-gram hashes with theirs for every order."""

    def __init__(self, counts: list[tuple[str, str, int]], totals: dict[str, int]):
        """``counts``: (language, word, times) of the known words; ``totals``: all words of each language."""
        self.langs = sorted(totals)
        at = {x: i for i, x in enumerate(self.langs)}
        self.words = sorted({w for _, w, _ in counts})
        place = {w: i for i, w in enumerate(self.words)}
        table = np.zeros((len(self.words), len(self.langs)))
        for lang, word, n in counts:
            table[place[word], at[lang]] += n
        size = np.array([totals[x] for x in self.langs], float)
        self.word_scores = self._logs(table, size)
        self.grams = []
        arr = pa.array(self.words, pa.large_string())
        for n in range(1, ORDER + 1):
            h, owner = ngrams(arr, n) if len(self.words) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keys, inv = np.unique(h, return_inverse=True)
            t = np.zeros((len(keys), len(self.langs)))
            for j in range(len(self.langs)):
                t[:, j] = np.bincount(inv, weights=np.log1p(table[owner, j]), minlength=len(keys)) if len(keys) else 0
            often = t.sum(axis=1) >= (2.0 if n > 2 else 0.5)
            self.grams.append((keys[often], self._logs(t[often], t.sum(axis=0))))

    def _logs(self, table: np.ndarray, size: np.ndarray) -> np.ndarray:
        logs = np.log((table + ALPHA) / (size + ALPHA * max(1, len(table))))
        return np.maximum(logs, logs.max(axis=1, keepdims=True, initial=-1e9) - FLOOR).astype(np.float32) if len(logs) else logs.astype(np.float32)

    def score_words(self, words: pa.Array) -> np.ndarray:
        """Per word its log frequency in each language; zeros where nothing of a word is known."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        if not len(words) or not self.words:
            return out
        if not hasattr(self, "_words"):
            self._words = pa.array(self.words, pa.large_string())
        found = np.asarray(pc.fill_null(pc.index_in(words, self._words), -1))
        known = found >= 0
        out[known] = self.word_scores[found[known]]
        left = np.flatnonzero(~known)
        for n in range(ORDER, 0, -1):
            keys, scores = self.grams[n - 1]
            if not len(left) or not len(keys):
                continue
            h, owner = ngrams(words.take(pa.array(left)), n)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            at, owner = at[hit], owner[hit]
            number = np.bincount(owner, minlength=len(left))
            some = number > 0
            for j in range(len(self.langs)):
                mean = np.bincount(owner, weights=scores[at, j], minlength=len(left))[some] / number[some]
                out[left[some], j] = mean
            left = left[~some]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, mean of its words' posteriors) of each text; ``und`` and 0 without letters."""
        n = len(texts)
        flat, owner = words_of(texts)
        if not len(flat) or not self.langs:
            return ["und"] * n, np.zeros(n)
        coded = flat.dictionary_encode()
        logs = self.score_words(coded.dictionary).astype(np.float64)
        post = np.exp(logs - logs.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        code = np.asarray(coded.indices)
        count = np.bincount(owner, minlength=n)
        total = np.stack([np.bincount(owner, weights=logs[code, j], minlength=n) for j in range(len(self.langs))], axis=1)
        best = total.argmax(axis=1)
        share = np.bincount(owner, weights=post[code, best[owner]], minlength=n) / np.maximum(1, count)
        # letters that make no word after lower-casing don't exist; no words: no letter
        return [self.langs[b] if c else "und" for b, c in zip(best, count, strict=True)], np.where(count > 0, np.clip(share, 0, 1), 0.0)


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", most_docs: int = FIT_DOCS, most_words: int = FIT_WORDS) -> Model:
    """The model of the rows whose language isn't null, from about ``most_docs`` different texts of each.

    The sample is by a hash of the text, at the rate that each language's count of different texts gives, so it depends on neither
    partitions nor copies: a text that many rows of a language hold counts once. Of a language's words the ``most_words`` most
    frequent are known: both bound the model.
    """
    rows = train.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text", F.lit(5)))
    sizes = {r["lang"]: r["count"] for r in rows.select("lang", "h").distinct().groupBy("lang").count().collect()}
    if not sizes:
        return Model([], {})
    rate = F.create_map(*[x for k, v in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, most_docs / v)))])
    picked = rows.filter(F.pmod("h", F.lit(1_000_000)) / 1_000_000 < rate[F.col("lang")])
    # copies meet in their tasks first
    picked = picked.groupBy("lang", "h").agg(F.min("text").alias("text")).repartition(tasks(train.sparkSession))
    words = picked.select("lang", F.explode(F.split(F.lower("text"), NOT_LETTERS)).alias("word")).filter(F.col("word").rlike(LETTER))
    counted = stored(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "words")
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counted.filter("n > 1").withColumn("place", place).filter(F.col("place") <= most_words).orderBy("lang", "place").collect()
    unstore(counted)
    return Model([(r["lang"], r["word"], r["n"]) for r in top], totals)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """lang_pred and score of every row: after doc_id, or, in a struct column named ``keep``, after all columns of ``docs``.

    lang_pred is a learned language or ``und`` (null and empty texts, texts without a letter, no training rows);
    score is the mean posterior of the language over the text's words, 0 for ``und``. Equal totals go to
    the language first in order. Repeated rows and null identifiers are kept; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(pickle.dumps(model))

    def classify(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = pickle.loads(sent.value)  # a task's own, gone when it ends
        for part in texts:
            langs, score = model.predict(large(part))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

    # texts stay in Arrow's buffers: no pandas in the workers, no Python string for each text
    told = F.arrow_udf(lean(classify), "struct<lang_pred:string,score:double>")
    if keep:
        return docs.withColumn(keep, told(F.col(text_col).cast("string")))
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), told(F.col(text_col).cast("string")).alias("r"))
    return out.select("doc_id", "r.lang_pred", "r.score")
