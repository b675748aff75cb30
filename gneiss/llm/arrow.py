"""Running a per-text function over a table in Arrow batches, a few hundred texts at a time."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

#: Rows handed to Python objects at once; bounds a worker's memory whatever the batch size.
ROWS = 256

ARROW = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.DoubleType(): pa.float64(), T.ArrayType(T.IntegerType()): pa.list_(pa.int32())}


def give_back() -> None:
    """Returns freed memory to the system, so that a worker does not hold the peak of an earlier task through later ones."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(df: DataFrame, text: str, keep: list[str], fields: list[tuple[str, T.DataType]], factory: Callable[[], Callable[[list[str]], list[list]]]) -> DataFrame:
    """The kept columns and new fields for every row; nulls in text become empty strings.

    factory() runs once in each task and returns a function from a list of texts
    to one list of values per new field.
    """
    kept = [df.schema[c] for c in keep]
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from worked(batches)
        finally:
            give_back()

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = factory()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                values = work([x or "" for x in part.column(len(keep)).to_pylist()])
                new = [v if isinstance(v, pa.Array) else pa.array(v, ARROW[t]) for v, (_, t) in zip(values, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *new], names=schema.names)

    return df.select(*[df[c] for c in keep], df[text].cast("string").alias("__text")).mapInArrow(run, schema)


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ..., so no name a caller chose meets one used inside."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])
