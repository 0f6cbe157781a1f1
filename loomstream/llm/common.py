"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on at most (a longer single text is one step of its own).
SLICE_BYTES = 1 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared folder; a local one is set only where none is configured (tests, laptops)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through files that all executors share, so a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same for wide use: a Parquet table in the shared folder, several times smaller than a checkpoint's rows."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """name, or what is behind underscores in front of it, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def select_as(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under fixed names: extra or clashing columns of the input never reach an operator."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


#: Rows up to this many of a few numbers each are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def joinable(df: DataFrame) -> DataFrame:
    """A side of a join that is cut off from its plan and broadcast if it is short.  A longer one is shuffled; as it is
    no longer the aggregate itself, adaptive execution can split a hot key of the other side."""
    df = checkpoint(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def without(docs: DataFrame, dropped: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """docs' rows but those whose keys (by name in dropped) are among dropped; null equals null.  Only a short list of
    dropped rows is broadcast, after it is counted; else both sides are shuffled with the list as the hashed side."""
    dropped = dropped.select(*(F.col(k).alias(f"_drop_{k}") for k in keys))
    dropped = F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped.hint("shuffle_hash")
    match = [c.eqNullSafe(dropped[f"_drop_{k}"]) for k, c in keys.items()]
    test = match[0]
    for m in match[1:]:
        test = test & m
    return docs.join(dropped, test, "left_anti")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def large_binary(column: pa.ChunkedArray | pa.Array) -> pa.LargeBinaryArray:
    """A string or binary Arrow array with 64-bit offsets, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    return column.cast(pa.large_string()).view(pa.large_binary()) if not pa.types.is_binary(column.type) else column.cast(pa.large_binary())


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of all values of the array, offsets from 0."""
    arr = large_binary(column)
    n = len(arr)
    offsets = np.frombuffer(arr.buffers()[1], np.int64, n + 1, arr.offset * 8) if n else np.zeros(1, np.int64)
    data = arr.buffers()[2]
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, hi - lo, lo) if data is not None and hi > lo else np.zeros(0, np.uint8)
    return offsets - lo, raw


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of values that hold at most so many bytes together, one value at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def ascii_lower(raw: np.ndarray) -> np.ndarray:
    return LOWER[raw]


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, sorted (np.unique's table of hashes takes several times as long)."""
    x = np.sort(x)
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


#: What forgets the tables that operators keep in a worker from task to task.
ROOM: list[Callable[[], None]] = []


def make_room() -> None:
    """At the begin of a task that needs no other operator's tables: a worker serves all stages of a pipeline."""
    for forget in ROOM:
        forget()
    release()


def release() -> None:
    """Give freed memory back to the system: a worker process is used again by the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)
