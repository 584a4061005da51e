import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

#: Extra columns whose names the operators use inside.
CLASHES = "digest key n n_points token node row text_sha256 lang_pred score size source_size blocks block h kg_id kg_hash kg_digest kg_gone kg_mark kg_plan_id kg_plan_source kg_plan_h kg_plan_shard kg_language kg_shard gone_id first best group component label".split()


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls everywhere, empty and long texts, repeated rows, equal texts, extra columns."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "b"),
        (2, "The quick  brown fox\tjumps over the lazy dog again and again.", "en", "a"),
        (3, None, None, None),
        (4, "", "en", "a"),
        (5, " \n\t ", None, "a"),
        (6, long, "en", "b"),
        (7, long, "en", None),
        (8, "Ärger über Öl – naïve café 日本語 \U0001f600", "de", "é"),
        (8, "Ärger über Öl – naïve café 日本語 \U0001f600", "de", "é"),
        (9, "x" * 300_000, None, "a"),
        (10, "12345 !!! ???", "en", "b"),
        (None, "no identifier here at all my friend", "en", "b"),
        (11, "one two", "en", "b"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return frame.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.filter("false")
