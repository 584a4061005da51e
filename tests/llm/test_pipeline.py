"""Every stage against a plain version, each on its own input."""

from collections import Counter

import pytest
import text_brute as brute
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    noise = spark.createDataFrame([(900001, "12 34 !!", "en", "src1", 8), (900002, None, None, None, None), (900003, "", "de", "src2", 0)], docs.schema)
    docs = docs.unionByName(noise)
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp('stage')}/out"
        stage(spark, docs, data).write.parquet(path)
        new = spark.read.parquet(path)
        out.append((name, docs, new))
        docs = new
    return out


def test_stage_columns(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_language_keeps_all_but_noise(stages):
    _, before, after = stages[0]
    gone = {r["doc_id"] for r in before.select("doc_id").exceptAll(after.select("doc_id")).collect()}
    assert gone == {900001, 900002, 900003}


def test_exact_copies_go(stages):
    _, before, after = stages[1]
    by = {}
    for r in before.collect():
        by.setdefault(brute.SPACE.sub("", r["text"] or ""), []).append((-len(r["text"] or ""), r["doc_id"]))
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(min(g)[1] for g in by.values())


def test_near_copies_go(stages):
    _, before, after = stages[2]
    low = brute.jaccard_components([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, (_, c) in low.items() if i == c)


def test_mix_takes_whole_documents(stages):
    from kithgraph.llm.mixing import mix_plan

    _, before, after = stages[3]
    plan = {r["doc_id"]: r["copies"] for r in mix_plan(before).collect()}
    assert Counter(r["doc_id"] for r in after.collect()) == Counter({k: c for k, c in plan.items() if c})
    assert after.distinct().exceptAll(before.distinct()).isEmpty()


def test_packing_holds_every_document(stages):
    _, before, after = stages[4]
    assert after.filter("piece = 0").count() == before.count()
    ends = after.groupBy("sequence_id").agg(F.sum("length").alias("all"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert ends.filter("all <> end or all > 1024").isEmpty()


def test_run(spark, data):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, data)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 100


def test_stages_on_edges(spark, data, edge_docs, no_docs, tmp_path):
    """Nulls, repeated rows, long texts and clashing names pass every stage; an empty table gives an empty result."""
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, edge_docs, data)
        assert stage(spark, no_docs, data).count() == 0
        if name != "packing":
            assert out.columns == edge_docs.columns
        ids = Counter(r["doc_id"] for r in out.collect())
        if name == "exact dedup":
            assert ids == Counter([2, 5, 6, 8, 9, 10, None, 11])  # the longest of equal texts
        if name == "near dedup":
            assert ids == Counter([1, 3, 4, 5, 6, 8, 9, 10, None, 11])
    language = corpus_pipeline.known_language
    assert {r["doc_id"] for r in language(spark, edge_docs, data).collect()} <= {1, 2, 6, 7, 8, 9, None, 11}
    assert language(spark, no_docs, data).count() == 0 and language(spark, edge_docs, data).columns == edge_docs.columns
