"""Exact deduplication as a stateful stream (operator 10, DataFrame functions only).

A slim feed of every row (digest, length, identifier, content locator) is appended to the state's folder and read as a stream. A
RocksDB-backed streaming aggregation without watermark or expiry keeps, for each digest ever seen, the group's count and its
best row: length, identifier and locator (file and position of the row in it). Only texts of digests that are held more than
once are read again, and compared by their full bytes; digests whose texts differ are grouped by the texts themselves.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget_path, free_name, fresh_path, slim_join, stored

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FEED = "doc_id long, n_points int, digest string, file string, position long, run string"
BEST = "struct<less:int,no_id:boolean,doc_id:long,file:string,position:long>"


def normalised(text: Column) -> Column:
    """``text`` without space, tab, line feed, vertical tab, form feed and carriage return; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for gone in " \t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(gone), F.lit(""))
    return out


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def plain_scan(df: DataFrame) -> bool:
    """Whether ``df`` reads files and only selects and filters, so that each row has a file and position of its own (which only some
    formats tell)."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    if node.nodeName() != "LogicalRelation" or "_metadata" in (c.lower() for c in df.columns):
        return False
    try:
        df.select(*places())
    except AnalysisException:
        return False
    return True


def located(docs: DataFrame, folder: str | None) -> DataFrame:
    """``docs`` whose rows have a place in a file: itself if it is read from files, else its rows written to ``folder``."""
    if plain_scan(docs) and folder is None:
        return docs
    if folder is None:
        return stored(docs, "content")
    path = f"{folder}/content/{uuid.uuid4().hex}"
    docs.write.parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)


def places() -> tuple[Column, Column]:
    return F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("position")


def best_row() -> Column:
    """The row that stays: most code points, smallest identifier (nulls last), first place."""
    return F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "position"))


def stream_best(spark: SparkSession, folder: str, files_per_trigger: int) -> DataFrame:
    """Runs the stream over what is new in the folder's feed; one row per digest ever seen: digest, group_size, best."""
    rocks = "spark.sql.streaming.stateStore.rocksdb."
    # an executor's stores share one bounded memory, whatever the number of partitions; what exceeds it is on disk
    bounds = {"boundedMemoryUsage": "true", "maxMemoryUsageMB": "128", "writeBufferSizeMB": "4", "changelogCheckpointing.enabled": "true", "allowFAllocate": "false"}
    # a store is closed when its task has committed, so an executor holds as many as it runs tasks, not one for each partition it has had
    conf = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE, "spark.sql.streaming.stateStore.unloadOnCommit": "true"} | {rocks + k: v for k, v in bounds.items()}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        seen = spark.readStream.schema(FEED).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/feed")
        best = seen.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best_row().alias("best"))

        def upsert(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/updates/{batch_id:09d}")

        query = best.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    fields = f"digest string, group_size long, best {BEST}"
    try:
        updates = spark.read.schema(fields).option("recursiveFileLookup", "true").parquet(f"{folder}/updates")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        updates = spark.createDataFrame([], fields)  # an empty feed makes no batch
    # a digest updated in several batches: its last row holds all, and rows only get better and more
    return updates.groupBy("digest").agg(F.max("group_size").alias("group_size"), F.min("best").alias("best"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, files_per_trigger: int = 1024, state: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, locator (file, position).

    Texts are equal when identical without ASCII white space. The row with the most code points in its
    original text stays, then the smallest identifier (nulls last), then the first by file and position: so
    of rows that repeat one identifier and text, exactly one has ``kept``, the same one in each run over the same files. Null and
    empty texts are equal to each other. An empty table gives an empty result. Other columns are ignored, whatever their names.
    With ``state``, a folder that all executors share, rows are held against all that earlier calls with this folder have seen
    (and told groups as they stand now; ``held_groups`` tells all rows' groups); identifiers and texts are kept there, as hits
    are compared by bytes. Without it, the state ends with the call.
    ``digest`` makes a string of a normalised text (weak ones serve tests of the full comparison).
    """
    spark = docs.sparkSession
    rows = located(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), state)
    folder, run = state or fresh_path(spark, "dedup"), uuid.uuid4().hex
    if state is None:
        atexit.register(forget_path, spark, folder)
    norm = normalised(F.col("text"))
    texts = rows.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("int").alias("n_points"), digest(norm).alias("digest"), norm.alias("norm"), *places())
    texts.drop("norm").withColumn("run", F.lit(run)).write.mode("append").parquet(f"{folder}/feed")
    best = stored(stream_best(spark, folder, files_per_trigger), "best", 4)
    if state is None:
        forget_path(spark, f"{folder}/state")
    feed = spark.read.schema(FEED).parquet(f"{folder}/feed")
    return _told(feed.filter(F.col("run") == run), best, texts, digest, state)


def held_groups(spark: SparkSession, state: str, digest=sha256) -> DataFrame:
    """The groups, as in ``exact_groups``, of all rows that calls with the folder ``state`` have seen."""
    feed = spark.read.schema(FEED).parquet(f"{state}/feed")
    updates = spark.read.schema(f"digest string, group_size long, best {BEST}").option("recursiveFileLookup", "true").parquet(f"{state}/updates")
    best = stored(updates.groupBy("digest").agg(F.max("group_size").alias("group_size"), F.min("best").alias("best")), "best")
    return _told(feed, best, _content(spark, state, digest), digest, state)


def _content(spark: SparkSession, state: str, digest) -> DataFrame:
    """All texts that the folder holds, as ``exact_groups`` sees them."""
    rows = spark.read.schema("doc_id long, text string").option("recursiveFileLookup", "true").parquet(f"{state}/content")
    norm = normalised(F.col("text"))
    return rows.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("int").alias("n_points"), digest(norm).alias("digest"), norm.alias("norm"), *places())


def _told(feed: DataFrame, best: DataFrame, texts: DataFrame, digest, state: str | None) -> DataFrame:
    """The result for the rows of ``feed``; ``texts`` are theirs."""
    spark = feed.sparkSession
    hits = best.filter("group_size > 1").select(F.col("digest").alias("hit"))
    if state is not None:  # of earlier rows only what this call has met again
        hits = hits.join(feed.select(F.col("digest").alias("own")).distinct(), F.col("hit") == F.col("own"), "left_semi")
        texts = _content(spark, state, digest)
    hits = stored(hits, "hits", 16)
    # bytes of the texts of held digests; min and max are pre-aggregated, so a hot group sends a row per task
    again = slim_join(texts.select("digest", "norm"), hits, F.col("digest") == F.col("hit"), "left_semi")
    clash = stored(again.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).filter("lo <> hi").select(F.col("digest").alias("clash")), "clash", 16)
    told = feed.join(best, "digest").select("doc_id", "group_size", "best", "digest", "file", "position")
    if not clash.isEmpty():
        some = texts.join(clash, F.col("digest") == F.col("clash"), "left_semi")
        groups = some.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("group_size"), best_row().alias("best"))
        own = some.join(groups.withColumnsRenamed({"digest": "d", "norm": "t"}), (F.col("digest") == F.col("d")) & (F.col("norm") == F.col("t")))
        own = own.join(feed.select(F.col("file").alias("f"), F.col("position").alias("p")), (F.col("file") == F.col("f")) & (F.col("position") == F.col("p")), "left_semi")
        told = told.join(clash, F.col("digest") == F.col("clash"), "left_anti").unionAll(own.select(*told.columns))
    return told.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        ((F.col("file") == F.col("best.file")) & (F.col("position") == F.col("best.position"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
        F.struct("file", "position").alias("locator"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see ``exact_groups``. Rows are found again by their locator."""
    rows = located(docs, None)
    gone = exact_groups(rows, id_col, text_col).filter("not kept").select(F.col("locator.file").alias("gone_file"), F.col("locator.position").alias("gone_at"))
    gone = stored(gone, "gone", 16)
    f, p = free_name(docs, "kg_file"), free_name(docs, "kg_position")
    file, position = places()
    keyed = rows.withColumns({f: file, p: position})
    return slim_join(keyed, gone, (keyed[f] == gone.gone_file) & (keyed[p] == gone.gone_at), "left_anti").drop(f, p)
