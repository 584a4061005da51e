"""Token counts by batch encoding in Arrow functions that return lengths only (operator 9).

Texts are gathered into batches of about the same number of bytes. Where a tokenizer drops white space, no token spans
it: there every text, long ones too, is split at white space, each distinct part of a batch is encoded once,
and a text's count is the sum of its parts'. Byte-level tokenizers that split words as usual take long texts in parts, cut where a
space stands between two letters: a word of theirs always begins there. Others encode whole texts.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import large, small_batches

#: Bytes of text of a batch; words whose lengths a worker remembers.
BATCH_BYTES, REMEMBERED = 4 << 20, 1_000_000
#: Characters of a part of a long text, about; where it may end.
PART, SAFE = 1 << 18, regex.compile(r"(?<=\p{L}) (?=\p{L})")
_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer of ``path``, loaded once a worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_padding()
            t.no_truncation()
            _loaded[path] = t
    return _loaded[path]


def lengths(tok, texts: list[str]) -> list[int]:
    if hasattr(tok, "encode_batch_fast"):
        return [len(x) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
    return [len(x) for x in tok.encode(texts, num_threads=1)]


def drops_space(path: str) -> bool:
    """Whether a .json file's tokens never hold white space: its splitter keeps only matches of a pattern without any, its
    normalizers look at most at white space itself and single characters, and its special strings hold none."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    norms = norm.get("normalizers", [norm]) if norm else []
    pres = pre.get("pretokenizers", [pre]) if pre else []
    plain = all(n["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or n["type"] == "Replace" and n["pattern"].get("Regex") == r"\s+" for n in norms)
    first = pres[0] if pres else {}
    split = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s" in first["pattern"].get("Regex", "") and not any(p.get("add_prefix_space") for p in pres)
    special = all(not any(c.isspace() for c in t["content"]) and not (t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"])
    return bool(plain and split and special)


def cuts_at_spaces(path: str) -> bool:
    """Whether a .json file's words always begin at a space between two letters: no normalizer, the usual byte-level splitter, no
    special strings with white space or that take in what is beside them."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
    return bool(plain) and not any(any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])


def in_parts(text: str) -> list[str]:
    """``text`` in parts of PART characters or more, cut before a space between two letters."""
    out, lo = [], 0
    while len(text) - lo > PART and (cut := SAFE.search(text, lo + PART)):
        out.append(text[lo : cut.start()])
        lo = cut.start()
    return [*out, text[lo:]]


class Counter:
    """Token counts of arrays of texts."""

    def __init__(self, path: str):
        self.tok, self.parts, self.cuts, self.known = tokenizer(path), drops_space(path), cuts_at_spaces(path), {}

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if self.cuts:
            parts = [in_parts(t) for t in texts.to_pylist()]
            each = np.array(lengths(self.tok, [p for x in parts for p in x]), np.int64)
            return np.bincount(np.repeat(np.arange(len(parts)), [len(x) for x in parts]), weights=each, minlength=len(parts)).astype(np.int64)
        if not self.parts:
            return np.array(lengths(self.tok, texts.to_pylist()), np.int64)
        lists = pc.ascii_split_whitespace(texts)
        owner, coded = np.asarray(pc.list_parent_indices(lists)), pc.list_flatten(lists).dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = self.known
        new = [w for w in words if w not in known]
        told = dict(zip(new, lengths(self.tok, new), strict=True))
        each = np.fromiter((known[w] if w in known else told[w] for w in words), np.int64, len(words))
        if len(known) < REMEMBERED:  # the first words met are the frequent ones
            known.update(told)
        return np.bincount(owner, weights=each[np.asarray(coded.indices)] if len(words) else None, minlength=len(texts)).astype(np.int64)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``path`` names a .json file of the tokenizers library or a .model file of sentencepiece, found on every
    executor; no tokens are added, special strings in texts are what the library takes them for. Null and empty
    texts have 0 bytes and 0 tokens; null identifiers and repeated rows are kept; other columns, whatever their names, are
    ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        count = Counter(path)
        for batch in batches:
            texts = large(batch.column(1))
            sizes = np.asarray(pc.binary_length(texts)).astype(np.int64)
            upto, found, lo = np.cumsum(sizes), [], 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BATCH_BYTES, side="right")))
                found.append(count(texts.slice(lo, hi - lo)))
                lo = hi
            tokens = np.concatenate([*found, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
