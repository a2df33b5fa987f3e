"""What the operators of this subpackage share: tables in the cluster's shared folder, Arrow slices.

Rows that a later step reads again are written as Parquet below ``spark.checkpoint.dir`` and read
back, which cuts lineage without a copy on any single machine: a lost executor costs a re-read.
A session's tables lie in one folder, which goes when the driver ends; scope() removes those that
a finished step no longer needs.
"""

from __future__ import annotations

import atexit
import contextlib
import itertools
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType

#: Text that one slice of a batch holds at most, unless a single document is larger.
SLICE_BYTES = 1 << 20

_serial = itertools.count()


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local one on a local master, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "tidemark-shared")
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path for a table that stays."""
    return f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex[:12]}-{next(_serial)}"


def passing_path(spark: SparkSession, label: str) -> str:
    """A path for a table that goes with the session."""
    return f"{_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


_folders: dict[int, str] = {}
_open: list[list[DataFrame]] = []


def _folder(spark: SparkSession) -> str:
    """The session's folder for tables of steps in between."""
    key = id(spark.sparkContext)
    if key not in _folders:
        _folders[key] = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex[:12]}"
        atexit.register(_swept, spark, _folders[key])
    return _folders[key]


def _swept(spark: SparkSession, path: str) -> None:
    """At the end of the driver; a session that has been stopped can't remove anything."""
    with contextlib.suppress(Exception):
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def store(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read back with its own schema."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{label}-{next(_serial)}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    for made in _open:
        made.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Removes a table that store() made."""
    if path := getattr(df, "stored_at", None):
        _remove(df.sparkSession, path)


@contextlib.contextmanager
def scope(*kept: DataFrame) -> Iterator[list[DataFrame]]:
    """Removes the tables that are stored within, but for those appended to the list that it gives."""
    made: list[DataFrame] = []
    stay: list[DataFrame] = list(kept)
    _open.append(made)
    try:
        yield stay
    finally:
        _open.remove(made)
        paths = {x.stored_at for x in stay if hasattr(x, "stored_at")}
        for x in made:
            if x.stored_at not in paths:
                discard(x)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column, nulls as empty, offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8) if off else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``limit`` bytes of text; a longer document is a piece of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        offsets, _ = utf8(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(n, max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to


def list_array(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def strings(offsets: np.ndarray, data: bytes | np.ndarray) -> pa.Array:
    """A string column from UTF-8 bytes and offsets."""
    data = data if isinstance(data, bytes) else data.tobytes()
    small = offsets.astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(small.tobytes()), pa.py_buffer(data))


_made: dict = {}


def once(token: str, make):
    """The worker's object for a token; the latest one is kept, so that tasks of one job share it."""
    if token not in _made:
        _made.clear()
        _made[token] = make()
    return _made[token]


def token() -> str:
    return uuid.uuid4().hex


# --- slices: rows that travel together, ask for what they need, and meet the answers -------------

#: The column that names a row's slice.
SLICE = "_tidemark_slice"


def sliced(rows: DataFrame, text: str, limit: int, label: str) -> DataFrame:
    """The rows, stored, with the number of their slice: runs of about ``limit`` bytes of text (a longer text is one alone).

    Numbers are given while the table is written, so every later step sees the same slices.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, held = TaskContext.get().partitionId(), -1, limit
        for b in batches:
            at = b.schema.get_field_index(text)
            size = np.diff(utf8(b.column(at))[0]) + 64
            number = np.empty(len(size), np.int64)
            for i, n in enumerate(size.tolist()):
                if held + n > limit:
                    k, held = k + 1, 0
                held += n
                number[i] = k
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number + (task << 32))], [*names, SLICE])

    return store(rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(SLICE, LongType())])), label)


def dealt(keys: np.ndarray, bucket: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, places of its keys) for the buckets that have any."""
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(k, order[cut[k] : cut[k + 1]]) for k in np.flatnonzero(np.diff(cut)).tolist()]


def joined(cells: Iterable[bytes], kind) -> np.ndarray:
    """The numbers in binary cells, one after the other."""
    return np.frombuffer(b"".join(cells), kind)


def planes(numbers: np.ndarray) -> bytes:
    """Numbers as a cell, all first bytes, then all second bytes and so on, which the shuffle's codec makes smaller."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), -1).T.tobytes() if len(numbers) else b""


def numbers(cell: bytes, kind) -> np.ndarray:
    """What planes() made a cell of."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(cell, np.uint8).reshape(size, -1).T).view(kind).ravel()


def all_numbers(cells: Iterable[bytes], kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[numbers(c, kind) for c in cells]])
