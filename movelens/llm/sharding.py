"""Sharding by jump consistent hashing.

A stable key and the number of shards decide the shard; there is no table of
ring positions. With one more shard a row either stays or goes to the new one,
which takes about 1 / (shards + 1) of the rows.

Defined results: keys that are not whole numbers are hashed first; a null key hashes as one fixed key; a null text has no bytes;
rows with equal keys share a shard; an empty table gives an empty result;
columns of the input that clash with added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movelens.llm.text_ids import whole_text
from movelens.sources.staging import stage

# Multiplier of the published generator, and the key that stands for null.
STEP = np.uint64(2862933555777941757)
NULL_KEY = 0x9E3779B97F4A7C15


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key: jumps forward until the next one would leave the range."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    state = keys.astype(np.uint64, copy=True)
    landed = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        landed[moving] = ahead[moving]
        state[moving] = state[moving] * STEP + np.uint64(1)
        spread = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[moving] = ((landed[moving] + 1) * (2147483648.0 / spread)).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return landed


def stable_key(df: DataFrame, key: str) -> Column:
    """The key as a whole number: itself, or the hash of a key of another type."""
    kind = df.select(F.col(key)).schema.fields[0].dataType
    if isinstance(kind, T.IntegralType):
        return F.col(key).cast("long")
    return F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key)))


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a whole-number key as a column; see :func:`stable_key` for others."""

    @F.pandas_udf("int")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            bits = keys.to_numpy(np.int64).view(np.uint64)
            yield pd.Series(jump(bits, shards).astype(np.int32))

    signed = NULL_KEY - (1 << 64)
    return place(F.coalesce(key.cast("long"), F.lit(signed).cast("long")))


def assign_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """``shard`` for the given count and ``grown_shard`` for one more shard."""
    number = stable_key(df, key)
    return df.withColumns({"shard": shard_of(number, shards), "grown_shard": shard_of(number, shards + 1)})


def number_slots(rows: DataFrame, shards: int, block_rows: int = 50_000) -> DataFrame:
    """Adds ``slot``: 0, 1, 2, ... within each ``shard``, without sending a shard to one task.

    The rows are written once with a row number of their own, which fixes them
    for every retry. Blocks of about ``block_rows`` rows are numbered each on
    its own and start where the blocks before them end.
    """
    fixed = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "shard-rows")
    blocks = max(1, -(-fixed.count() // (block_rows * shards)))
    fixed = fixed.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)))
    sizes = fixed.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("shard", "_block").orderBy("_row")
    numbered = fixed.withColumn("_place", F.row_number().over(inside) - 1).join(starts, ["shard", "_block"])
    return numbered.withColumn("slot", (F.col("_start") + F.col("_place")).cast("long")).drop("_row", "_block", "_start", "_place")


def shard_manifest(df: DataFrame, key: str, text: str, shards: int) -> DataFrame:
    """One small row per document: key, size, checksum, shard, slot and the shard after growth."""
    small = df.select(
        F.col(key),
        (F.octet_length(whole_text(text)) + 1).cast("long").alias("size"),
        F.crc32(whole_text(text).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return number_slots(assign_shards(small, key, shards), shards).select(
        key, "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def write_shards(df: DataFrame, key: str, shards: int, path: str, tasks_per_shard: int = 16) -> None:
    """Writes the rows as Parquet folders ``shard=<n>``; several tasks share a shard."""
    placed = df.withColumn("shard", shard_of(stable_key(df, key), shards))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c != "shard"]), F.lit(tasks_per_shard))
    placed.repartition(shards * tasks_per_shard, "shard", spread).write.partitionBy("shard").parquet(path)
