"""Column helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_text(column: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(id_column: str, text_column: str) -> Column:
    """Tells rows apart that share an id but not a text; equal rows share it."""
    return F.xxhash64(F.col(id_column), whole_text(text_column), F.octet_length(whole_text(text_column)))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column has that name (case aside)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def small_batches(spark: SparkSession) -> None:
    """Bounds what Spark hands to a Python task at once by bytes: ten thousand long texts would be gigabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that hands freed memory back to the system when it is done.

    Workers are used again by later stages, and what Arrow's pool and the C library keep would add to theirs.
    """

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return wrapped
