"""Rows told from others by a bitmap of ids, so that rows without a partner are never moved to find that out.

A bitmap is a table with one row per 2 ** 15 ids, held as 512 words of 64 bits. It is broadcast, so its size has a bound:
of whole numbers that lie close together each has its own bit, and of other keys a hash of fixed width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of a row of the bitmap, as a power of two, and bits of a hash: 4,096 rows (16 MB) at most.
ROW_BITS, HASH_BITS = 15, 27


def bitmap(ids: DataFrame, at: Column) -> DataFrame:
    """``_row`` and ``_words``: the numbers ``at`` (from 0 on) that any row of ``ids`` has."""
    rows = ids.select(at.alias("_at")).filter("_at IS NOT NULL").groupBy(F.shiftright("_at", ROW_BITS).alias("_row")).agg(
        F.bitmap_construct_agg(F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))).alias("_bits"))
    half = lambda i, low: F.conv(F.hex(F.substring("_bits", i * 8 + low, F.lit(4))), 16, 10).cast("long")
    words = F.transform(
        F.sequence(F.lit(0), F.lit((1 << ROW_BITS - 6) - 1)), lambda i: F.shiftleft(half(i, F.lit(1)), 32).bitwiseOR(half(i, F.lit(5))))
    return rows.select("_row", words.alias("_words"))


def is_in(at: Column) -> Column:
    """Whether ``at`` is in a :func:`bitmap`, as the condition of a join with it."""
    word = F.shiftright(at, 6).bitwiseAND(F.lit((1 << ROW_BITS - 6) - 1)).cast("int")
    # the bytes of a word ascend and the bits of a byte descend
    bit = at.bitwiseAND(F.lit(63)).bitwiseXOR(F.lit(56)).cast("int")
    return (F.shiftright(at, ROW_BITS) == F.col("_row")) & (F.getbit(F.get("_words", word), bit) == 1)


def hash_place(columns: Sequence[str]) -> Column:
    """A number below 2 ** HASH_BITS that equal keys share."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << HASH_BITS) - 1))


def split_by_keys(df: DataFrame, keys: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` that may have a key of ``keys``, and the others, which have none.

    The key columns must have the same types in both tables.
    """
    kinds = [[dict(t.dtypes)[c] for c in columns] for t in (df, keys)]
    if kinds[0] != kinds[1]:
        raise TypeError(f"keys of different types: {kinds[0]} and {kinds[1]}")
    held = F.broadcast(bitmap(keys, hash_place(columns)))
    inside = is_in(hash_place(columns))
    return df.join(held, inside, "left_semi"), df.join(held, inside, "left_anti")
