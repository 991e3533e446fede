"""Plumbing for operators that run over Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text that is worked on at once in a Python worker; a longer single text makes a chunk of its own.
CHUNK_BYTES = 1_000_000


def chunks(ids: pa.Array, texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[str]]]:
    """Yields ids and texts (null: empty) of consecutive rows, about ``limit`` bytes at a time."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield ids[start:i].to_pylist(), [t or "" for t in texts[start:i].to_pylist()]
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield ids[start:].to_pylist(), [t or "" for t in texts[start:].to_pylist()]


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which gives the memory that a task leaves behind back to the system: workers are used again and again."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return task


def slices(batch: pa.RecordBatch, weight: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch whose weights come to about ``limit``; a heavier row stands alone."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(weight, 0).to_pylist()):
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_rows(df: DataFrame, text_col: str, make: Callable[[], Callable[[pa.RecordBatch, pa.Array], pa.RecordBatch]]) -> DataFrame:
    """Whole rows, a chunk at a time: ``make()`` gives a function from rows and their texts to rows of the same columns."""
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or make()
            for part in slices(batch, pc.binary_length(batch.column(place))):
                yield work(part, part.column(place))

    return df.mapInArrow(released(run), df.schema)


def map_texts(df: DataFrame, id_col: str, text_col: str, schema: str, make: Callable[[], Callable[[list, list[str]], dict]], limit: int = CHUNK_BYTES) -> DataFrame:
    """One pass over (id, text): ``make()`` runs once in each task and gives a function from ids and texts to columns.

    Only the two named columns are read, so further columns, whatever their names, are neither scanned nor carried.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or make()
            for ids, texts in chunks(batch.column(0), batch.column(1), limit):
                out = work(ids, texts)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return rows.mapInArrow(released(run), schema)


def to_arrow(schema: str) -> pa.Schema:
    """An Arrow schema for a flat DDL schema."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}

    def kind(x: str) -> pa.DataType:
        return pa.list_(kind(x[6:-1])) if x.startswith("array<") else kinds[x]

    return pa.schema([(name, kind(k)) for name, k in (c.strip().split(" ", 1) for c in schema.split(","))])
