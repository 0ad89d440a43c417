"""Helpers shared by the corpus operators: folders that survive lost executors, Arrow text access."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAST_ID = 2**63 - 1


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, a local master gets a temporary one, a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="coppice-")
        spark.sparkContext.setCheckpointDir(root)
    return root


#: Folders written by ``stored`` and not yet deleted.
_written: set[str] = set()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again, so that no later loss recomputes it."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/coppice-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written.add(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of stored tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._stored_at)
        _written.discard(df._stored_at)


def clean_up(spark: SparkSession) -> None:
    """Deletes every folder that this process's operators have stored so far; results that still read one end there, so write them first."""
    for path in _written:
        _delete(spark, path)
    _written.clear()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(df: DataFrame) -> int:
    """Number of shuffle partitions that follows the input: at least the session's own setting.

    For tables as they are read or stored: on a plan with shuffles the count itself would run them.
    """
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def picked(df: DataFrame, **columns: tuple[str, T.DataType]) -> DataFrame:
    """Only the named columns, cast; other columns of whatever name never reach an operator."""
    return df.select(*(df[source].cast(kind).alias(name) for name, (source, kind) in columns.items()))


def search_sorted(value: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` (ascending) that are <= ``value``: a binary search inside the JVM."""
    if not bounds:
        return F.lit(0)
    step, steps = 1, []
    while step <= len(bounds):
        steps.append(step)
        step *= 2
    table = F.lit(bounds)

    def advance(at: Column, by: Column) -> Column:
        further = at + by
        inside = (further <= F.lit(len(bounds))) & (F.get(table, further - 1) <= value)
        return F.when(inside, further).otherwise(at)

    return F.aggregate(F.lit(steps[::-1]), F.lit(0), advance)


#: A key with this share of all rows or more is joined by broadcast; there can be no more such keys than its inverse.
HOT_SHARE = 1000


def join_with_hot_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of ``left`` with stored ``right`` (one row a key; ``_n``: rows of ``left`` with it), whatever the skew.

    At most ``HOT_SHARE`` keys have so large a share of the rows that they are hot: their rows meet a broadcast. The rest
    is shuffled by key.
    """
    total = right.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("t")).first()["t"]
    is_hot = F.col("_n") * HOT_SHARE >= F.lit(total)
    hot, cold = (right.where(c).drop("_n") for c in (is_hot, ~is_hot))
    met = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return met.unionByName(rest)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; nulls have length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def text_chunks(column: pa.Array, limit: int = 1 << 20):
    """Slices (first row, end row, bytes, offsets) of about ``limit`` bytes; a longer text is a slice of its own."""
    raw, at = text_buffers(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated integer ranges start..start+length."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


#: Called to empty what an operator keeps in a worker for its own next task.
caches: list[Callable[[], None]] = []


def release(keep: bool = False) -> None:
    """Gives freed memory back to the system: workers live on between tasks, beside the executor's own. Unless ``keep``, the caches go first."""
    if not keep:
        for empty in caches:
            empty()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """Invertible 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(32))
