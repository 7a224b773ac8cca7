"""Joins of a large table with a table of few keys, without hashing the large one by them.

Facts by position, segment or region have four or five keys, so a shuffle on
them feeds four or five tasks. The small side is counted first. Up to a stated
number of rows it is held by the driver and broadcast. A larger one is written
once and joined by a shuffle on its key and a salt: the large side is spread
over the salts by its content, the small one repeated for each.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movelens.sources.staging import stage

#: Rows of a small side that are held and broadcast at most; salts of a larger one.
LIMIT_ROWS, SALTS = 10_000, 64


def held(small: DataFrame, limit: int | None = None) -> DataFrame | None:
    """The table as rows of the plan if it has at most ``limit`` rows, else None."""
    limit = LIMIT_ROWS if limit is None else limit
    table = small.limit(limit + 1).toArrow()
    if table.num_rows > limit:
        return None
    return small.sparkSession.createDataFrame(table, small.schema)


def settled(small: DataFrame, limit: int | None = None) -> DataFrame:
    """The table computed once: held if it is small, else written to the shared folder."""
    kept = held(small, limit)
    return stage(small, "small-side") if kept is None else kept


def _spread(df: DataFrame, salt: str) -> DataFrame:
    plain = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return df.withColumn(salt, F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int"))


def small_join(
    df: DataFrame, small: DataFrame, on: Sequence[tuple[str, str]], how: str = "left", limit: int | None = None,
) -> DataFrame:
    """``df`` joined with ``small`` where every pair (column of df, column of small) is equal.

    All columns of both sides are kept. The columns' names have to differ.
    """
    def same() -> Column:
        return reduce(lambda a, b: a & b, [F.col(x) == F.col(y) for x, y in on])

    kept = held(small, limit)
    if kept is not None:
        return df.join(F.broadcast(kept), same(), how)
    copies = stage(small, "small-side").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return _spread(df, "_salt").join(copies, same() & (F.col("_salt") == F.col("_copy")), how).drop("_salt", "_copy")
