"""Small pieces that several operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir.

    Where it is unset and all runs in this process, as in tests, a temporary
    folder of this machine is made and used for the rest of the session; on a
    cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors see")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="objsql-"))
        folder = _own_folder[0]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The same rows read back from a reliable checkpoint, so that lost executors don't cost a recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, kept: list[str] | None = None) -> DataFrame:
    """The same rows read back from Parquet in the shared folder; the path is added to ``kept``, for ``discard``."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    if kept is not None:
        kept.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables written for steps that are over, and empties the list."""
    for path in paths:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    paths.clear()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes that may be broadcast, and what a row counts for beside its strings, arrays and maps.
BROADCAST_BYTES, ROW_BYTES = 8 << 20, 48


def _held(column: Column, kind: DataType) -> Column | None:
    """Bytes of a value beyond a fixed width; None for numbers and the like."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(kind, ArrayType):
        inner = _held(F.lit(None).cast(kind.elementType), kind.elementType)
        each = F.lit(0) if inner is None else F.coalesce(F.aggregate(column, F.lit(0).cast("long"), lambda n, v: n + F.coalesce(_held(v, kind.elementType), F.lit(0))), F.lit(0))
        return F.coalesce(F.size(column), F.lit(0)) * 16 + each
    if isinstance(kind, MapType):
        return _held(F.map_keys(column), ArrayType(kind.keyType)) + _held(F.map_values(column), ArrayType(kind.valueType))
    if isinstance(kind, StructType):
        parts = [h for f in kind.fields if (h := _held(column[f.name], f.dataType)) is not None]
        return sum(parts[1:], parts[0]) if parts else None
    return None


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most that many bytes, else as it is, to be joined by a shuffle.

    ``df`` is read to be measured, so it should be cheap to read, as after ``settled``.
    """
    width = sum((h for f in df.schema.fields if (h := _held(df[f.name], f.dataType)) is not None), F.lit(ROW_BYTES))
    return F.broadcast(df) if (df.agg(F.sum(width).alias("n")).first().n or 0) <= most else df


Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """What this process has freed goes back to the system, so that an idle Python worker doesn't keep it beside the next one's tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass  # not glibc


#: Bytes of text that an operator gets at a time of a batch, which has as many rows as the session says.
SLICE_BYTES = 4 << 20


def lean(work: Callable[[Batches], Batches], text: int | None = None) -> Callable[[Batches], Batches]:
    """``work`` for mapInArrow, with freed memory given back when a task is over; with ``text``, a string column, it gets batches in ``slices``, as it makes copies of what it gets."""

    def run(batches: Batches) -> Batches:
        yield from work(batches if text is None else (part for batch in batches for part in slices(batch, text, SLICE_BYTES)))
        give_back()

    return run


def slices(batch: pa.RecordBatch, column: int, most: int) -> Batches:
    """A batch in order, in parts of about ``most`` bytes of a string column; a longer string is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = before = 0
    while start < len(batch):
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start, before = stop, int(ends[stop - 1])
