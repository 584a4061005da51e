"""A corpus pipeline over ``documents``: language ID, exact deduplication, near-duplicate removal, mixing, packing.

Stages keep further columns of any name, rows that repeat a doc_id (unless they are copies) and null doc_ids and sources; an empty
table gives an empty result of the same columns; texts of any length are read whole; ties are broken as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.functions.ship import ship
from kithgraph.llm.common import free_name, stored, unstore
from kithgraph.llm.dedup_exact import deduplicated
from kithgraph.llm.jaccard import distinct_documents
from kithgraph.llm.language import fit, predict
from kithgraph.llm.mixing import mixed
from kithgraph.llm.packing import pack
from kithgraph.llm.queries import fold, vocabulary

#: A text stays if its language is known and its words' mean posterior of it is at least this.
LEAST_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents of a language learned from ``docs`` itself; those without letters (null and empty texts too), or whose words fit no
    language, go. Without any learned language all go, as none has a language."""
    ship(spark)
    told = free_name(docs, "kg_language")
    out = predict(docs, fit(docs.filter(fold(4) != 2)), keep=told)
    return out.filter((F.col(told)["lang_pred"] != "und") & (F.col(told)["score"] >= LEAST_SCORE)).drop(told)


def no_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the smallest doc_id (nulls last), then the first row."""
    return deduplicated(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document, of the smallest doc_id (nulls last), of each group linked by a similarity of 0.8 on five-word shingles;
    documents without words stay."""
    ship(spark)
    return distinct_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The sources' mix: documents repeated or left out as its targets say."""
    return mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents as pieces of packed sequences."""
    ship(spark)
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("language", known_language), ("exact dedup", no_copies), ("near dedup", no_near_copies), ("mixing", mixture), ("packing", packed)]
#: Language ID, mixing and tokenization can't be said in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """Applies all stages to ``documents``; each stage's result is written to the shared folder and read again."""
    docs, last = spark.read.parquet(f"{folder}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name.replace(" ", "-"))
        if last is not None:
            unstore(last)
        last = docs
    return STAGES[-1][1](spark, docs, folder)
