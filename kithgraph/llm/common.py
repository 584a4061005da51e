"""Helpers shared by the text operators: Arrow batches and texts as numpy arrays."""

from __future__ import annotations

import ctypes
import functools
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import components, delete_path, forget_path, fresh_path, shared_dir, stored, unstore  # noqa: F401

#: Python's bytes class for the six ASCII white-space characters.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same as a Java/RE2 character class.
NOT_SPACE = r"[^\x20\x09-\x0D]+"


#: Rows of a slim table up to which it is broadcast, counted first (at most some 30 MB); beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches of at most ``rows`` rows from now on, for results that run when their caller asks for them: a batch of long texts
    then stays small in a worker. Steps that run at once take ``batches_of`` instead, which sets back what was set."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """``key`` set to ``value`` for the jobs that run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows in the jobs that run inside."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shuffles_dropped(spark: SparkSession):
    """Each job that runs inside deletes its shuffle files when it ends, not when the driver happens to collect its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def give_back() -> None:
    """Returns freed memory of this process to the system: Spark keeps Python workers, and their allocators keep what tasks have freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def lean(run):
    """``run``, a function of an iterator's batches, which gives memory back when a task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slim_join(df: DataFrame, slim: DataFrame, on, how: str) -> DataFrame:
    """``df`` joined with a stored slim table, which is broadcast if its count says that it is small."""
    return df.join(F.broadcast(slim) if slim.count() <= BROADCAST_ROWS else slim, on, how)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


# ---------------------------------------------------------------- numpy over Arrow string columns


def large(column: pa.Array) -> pa.Array:
    """``column`` as one large_string array with nulls as empty strings."""
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array without copies."""
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def codepoints(column: pa.Array, gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(code points, start of each text) of all texts with ``gap`` zero characters after each."""
    joined = ("\0" * gap).join([*column.to_pylist(), ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    import pyarrow.compute as pc

    sizes = np.asarray(pc.utf8_length(column)).astype(np.int64) + gap
    return points, np.concatenate([[0], np.cumsum(sizes)])


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
