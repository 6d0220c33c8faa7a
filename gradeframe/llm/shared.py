"""Small helpers of the text operators: batches of bounded size, files in the shared folder, held-out rows."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes of text that a task turns into Python objects at once. A single longer text is a slice alone.
SLICE_BYTES = 4 << 20


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so that no other column can clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def numbered(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """A table whose columns have names that no operator uses, and the new names of some of them.

    An operator that adds columns of its own to whole documents works on this form and gives the
    columns back under their own names, so that none can clash.
    """
    new = [f"column_{n}" for n in range(len(docs.columns))]
    return docs.toDF(*new), [new[docs.columns.index(name)] for name in names]


_HELD: list[Any] = []  # tables of the operators whose modules this Python worker has loaded


def worker_table(maxsize: int) -> Callable[[Callable], Any]:
    """``functools.lru_cache`` of tables that a Python worker keeps, until a task that does not name them begins."""

    def cached(make: Callable) -> Any:
        _HELD.append(functools.lru_cache(maxsize)(make))
        return _HELD[-1]

    return cached


def drop_tables(keep: tuple[Any, ...]) -> None:
    for table in _HELD:
        if all(table is not k for k in keep):
            table.cache_clear()


def give_back() -> None:
    """Return freed memory of this process to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], *keep: Any) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for tasks that keep only these worker tables and give back what they have freed.

    Spark uses a Python worker again for other operators and lets it idle between their tasks, so what
    one operator leaves in it would count beside all that the next ones need.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables(keep)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def text_slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        ends = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a slice; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def record_batch(schema: pa.Schema, **columns: Any) -> pa.RecordBatch:
    """A batch from arrays or lists in the order of the schema."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema
    )


def held_out(id_column: Column, remainder: int = 2) -> Column:
    """Rows never used for learning: crc32 of the id as text modulo 4 is 2. A null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 == remainder, F.lit(False))


def create_file(folder: str, suffix: str) -> tuple[Any, str]:
    """A new file below a folder that all executors share, and its address.

    The name is unique to the attempt, so a repeated task never meets a half-written file of a
    lost one. Readers only open the files that a finished task has listed.
    """
    uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(path), uri


def open_file(uri: str) -> Any:
    """A file in the shared folder, opened for reading."""
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_stream(path)
