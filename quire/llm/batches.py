"""Small helpers of the operators that run Python over Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Rows that Python holds as objects at a time; a batch may have thousands.
ROWS = 256

#: Stands for a null id inside an operator, so that joins and orders have one rule for it.
NO_ID = -(2**63)


def known(column: str) -> Column:
    """The id, or the smallest long for a null one."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def shown(column: str) -> Column:
    """The inverse of ``known``."""
    return F.when(F.col(column) != NO_ID, F.col(column))


def unused(name: str, columns: list[str]) -> str:
    """A name that no column has, in whatever case."""
    taken = {column.lower() for column in columns}
    while name in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [text or "" for text in batch.column(column).to_pylist()]


def with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns replaced or added."""
    kept = {name: batch.column(at) for at, name in enumerate(batch.schema.names)} | columns
    return pa.RecordBatch.from_arrays(list(kept.values()), names=list(kept))


def widened(schema: T.StructType, **kinds: T.DataType) -> T.StructType:
    """The schema with columns replaced or added, all of them nullable."""
    old = {field.name: field.dataType for field in schema.fields} | kinds
    return T.StructType([T.StructField(name, kind) for name, kind in old.items()])


def release() -> None:
    """Gives back memory that a task no longer uses; its worker goes on to other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def mapped(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType | str,
    rows: int = ROWS,
) -> DataFrame:
    """``function`` over slices of at most ``rows`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            yield function(batch)
        release()

    return df.mapInArrow(run, schema)


def shared(spark: SparkSession, value: Any) -> Any:
    """A broadcast of something whose size has a stated bound."""
    return spark.sparkContext.broadcast(value)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")
