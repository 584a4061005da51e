"""Multi-party perspective rotation of dialogues (operator 3, DataFrame functions only).

For every participant of a conversation the dialogue is rendered with that participant as the assistant and all others as
named users. The result has one row per conversation, perspective and turn, so that no conversation, however long, is
gathered into one row or task: a row holds its turn's rendered text, where that starts in the whole rendering, and
which span of it is trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tasks

#: Header and end of a turn.
HEAD, BETWEEN, END = "<|", "|>\n", "<|end|>\n"
#: Speakers that set a conversation up: rendered under their own name for everyone, never a perspective.
SETTERS = ("system",)


def label(speaker: Column, perspective: Column, setters) -> Column:
    """What a turn's header says: assistant, user:<name>, or a setter's own name."""
    return F.when(speaker.isin(*setters), speaker).when(speaker == perspective, F.lit("assistant")).otherwise(F.concat(F.lit("user:"), speaker))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", setters=SETTERS) -> DataFrame:
    """conv_id, perspective, position, turn, speaker, label, rendered, start, end, mask_start, mask_end, target.

    ``start`` and ``end`` are the code points that the turn takes in its perspective's rendering: the rendered texts of a
    perspective in order of ``position`` make it whole. ``target`` tells that the perspective's participant speaks;
    then [mask_start, mask_end) is its text with the end mark, which is trained on; else both are -1.

    Turns are in order of ``turn`` (null last), then speaker, then text; rows that repeat all of these are turns of their
    own. A null speaker is named ``unknown``, a null text is empty; a null conversation is one conversation. A
    conversation of which only setters speak has no perspective and so no row. Other columns are ignored; an empty
    table gives an empty result. Positions and starts are sums over blocks, so a conversation that holds a third of all
    rows is spread over all tasks.
    """
    spark = turns.sparkSession
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("tie"),
    )
    # in order over all partitions; a partition's part of a conversation is a block of it
    order = ["turn_null", "turn", "speaker", "text", "tie"]
    rows = rows.withColumn("turn_null", F.col("turn").isNull())
    placed = rows.repartitionByRange(tasks(spark), F.col("conv_id").asc_nulls_last(), *[F.col(c) for c in order])
    placed = stored(placed.withColumn("block", F.spark_partition_id()), "turns")

    speakers = placed.filter(~F.col("speaker").isin(*setters)).groupBy("conv_id", F.col("speaker").alias("perspective")).agg(F.count(F.lit(1)).alias("spoken"))
    speakers = speakers.select(F.col("conv_id").alias("c"), "perspective")
    seen = placed.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    seen = seen.withColumn("label", label(F.col("speaker"), F.col("perspective"), setters))
    # the index is counted per block, as are the lengths, and what came before a block is added to it
    length = F.lit(len(HEAD) + len(BETWEEN) + len(END)) + F.length("label") + F.length("text")
    seen = seen.withColumn("length", length.cast("long"))
    inner = Window.partitionBy("conv_id", "perspective", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = seen.withColumn("upto", F.sum("length").over(inner)).withColumn("nth", F.count(F.lit(1)).over(inner))
    sums = placed.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c").withColumn("label", label(F.col("speaker"), F.col("perspective"), setters))
    sums = sums.groupBy("conv_id", "perspective", "block").agg(F.sum(length.cast("long")).alias("all"), F.count(F.lit(1)).alias("turns"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("all").over(before), F.lit(0)).alias("ahead"), F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("earlier")
    )
    out = seen.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    end = F.col("ahead") + F.col("upto")
    target = F.col("speaker") == F.col("perspective")
    mask = end - F.length("text") - len(END)
    return out.select(
        "conv_id",
        "perspective",
        (F.col("earlier") + F.col("nth") - 1).alias("position"),
        "turn",
        "speaker",
        "label",
        F.concat(F.lit(HEAD), F.col("label"), F.lit(BETWEEN), F.col("text"), F.lit(END)).alias("rendered"),
        (end - F.col("length")).alias("start"),
        end.alias("end"),
        F.when(target, mask).otherwise(-1).alias("mask_start"),
        F.when(target, end).otherwise(-1).alias("mask_end"),
        target.alias("target"),
    )
