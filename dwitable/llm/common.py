"""Small helpers of the text operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str) -> str:
    """A column name that no input column has."""
    return f"_{name}_{uuid.uuid4().hex[:12]}"


def raw(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


#: Rows of a batch whose texts are Python objects at once.
SLICE = 256

#: What this worker keeps between tasks for the operator that it has worked for last, by the operator and a key.
_KEPT: dict[tuple[str, Hashable], object] = {}


def give_back() -> None:
    """Return freed memory to the system; a worker that lives on for other stages would otherwise keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def kept[T](owner: str, key: Hashable, make: Callable[[], T]) -> T:
    """What ``make`` returns, made when a worker first asks for it and then shared by its tasks.

    A worker works for one operator after the other. It keeps one thing at a time, so that the index, vectors or tokenizer of a
    former operator do not lie beside those of the present one.
    """
    if (owner, key) not in _KEPT:
        _KEPT.clear()
        give_back()
        _KEPT[owner, key] = make()
    return _KEPT[owner, key]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut into few rows, so that a batch of long texts is never copied into Python as a whole.

    At the end of a task the worker, which lives on for other stages, gives back the memory of its batches.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    give_back()


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of a number as decimal text, modulo ``modulus``; NULL stays NULL."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)
