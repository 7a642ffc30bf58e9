"""What the operators of this subpackage share: table access, scratch tables, Arrow helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructType

from siltbed.scratch import cleared, delete_stored, shared_dir, stored


__all__ = ["as_bytes", "cleared", "delete_stored", "fresh", "schema_plus", "shared_dir", "stored", "table", "trimmed"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, wanted: str) -> str:
    """wanted, or a variant of it that no column of df has (compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name = "_" + name
    return name


def schema_plus(df: DataFrame, new: dict[str, str], without: tuple[str, ...] = ()) -> StructType:
    """df's schema without some columns and with new ones (name to type) at its end; df.schema itself is kept by Spark."""
    out = StructType([f for f in df.schema.fields if f.name not in without])
    for name, kind in new.items():
        out = out.add(name, DataType.fromDDL(kind))
    return out


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with memory that is free given back to the system before and after: workers live on between tasks, and
    keep else the most that one of their tasks took."""

    @wraps(run)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return out


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)
