"""Vectorised helpers over Arrow text batches, shared by the operators of this subpackage.

Every helper works on a bounded slice of a batch: `slices` cuts a batch so that each slice holds
at most `limit` bytes of text (or one single longer text), which bounds the memory of a task.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 20
BROADCAST_BYTES = 32 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep the Arrow batches that go to Python small: rows, and bytes where Spark knows that setting."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    except Exception:  # an older Spark without this setting
        return


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; one of our own only where that is unset and all tasks run in this process."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="checkpoints-")


_written: list[list[DataFrame]] = []


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written once to the shared checkpoint folder and read again, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    if _written:
        _written[-1].append(out)
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of `checkpointed` that only tables written since were made from."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def spent_tables() -> Iterator[list[DataFrame]]:
    """Lists the tables that `checkpointed` writes inside, and deletes at the end those that are still listed."""
    _written.append([])
    try:
        yield _written[-1]
    finally:
        release(*_written.pop())


def kept_only(made: list[DataFrame], df: DataFrame) -> DataFrame:
    """`df` written, and taken off the list of tables that `spent_tables` deletes."""
    out = checkpointed(df)
    made.remove(out)
    return out


def unused(name: str, columns: list[str]) -> str:
    """`name`, with as many marks behind it as it takes to differ from all `columns`, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_size_check(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` marked for broadcast if its counted rows fit in `limit` bytes; else left to a shuffled join."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if rows * row_bytes <= limit else df.hint("merge")


class Recent(dict):
    """A memo of `make`: when it is full, only what was asked for since the last time it was full stays."""

    made: list[Recent] = []

    def __init__(self, make, most: int):
        self.make, self.most, self.older = make, most, {}
        Recent.made.append(self)

    def __missing__(self, key):
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = out
        return out


@functools.cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def tidy(task):
    """A task over batches that leaves its worker, which later tasks use too, without memos and freed memory."""

    @functools.wraps(task)
    def run(*args, **named):
        try:
            yield from task(*args, **named)
        finally:
            for memo in Recent.made:
                memo.clear()
                memo.older = {}
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return run


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """The column as large strings in one chunk, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def view(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and n + 1 offsets into them."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """(slice of the batch, its texts) with at most `limit` bytes of text in each, or one longer text."""
    texts = texts_of(batch.column(column))
    _, at = view(texts)
    start, n = 0, len(texts)
    while start < n:
        end = int(np.searchsorted(at, at[start] + limit, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start), texts.slice(start, end - start)
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers = np.ones(1, _U)
_inverses = np.ones(1, _U)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            step = np.full(size, _BASE, _U)
            step[0] = 1
            _powers = np.cumprod(step)
            step = np.full(size, _INVERSE, _U)
            step[0] = 1
            _inverses = np.cumprod(step)
    return _powers, _inverses


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without bytes 9-13 and 32, and for each text its first word (n + 1 offsets)."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    first = ~space
    last = first.copy()
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    keep_first, keep_last = first[edge].copy(), last[edge - 1].copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    first[edge] = keep_first
    last[edge - 1] = keep_last
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes wherever they stand."""
    power, inverse = _tables(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, _U)
        total[0] = 0
        np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive word hashes: len(words) - k + 1 of them, across text borders too."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        total = words[:n].copy()
        for j in range(1, k):
            total *= _BASE
            total += words[j : j + n]
        return mix(total)
