"""Ordered scans along a key that stay parallel when one key is huge.

``lead``, running sums and "last value seen" are window functions over
``partitionBy(key).orderBy(time)``, and a window sends each key to one task.
When a key holds a large share of all rows that task never finishes. Here such
*hot* keys are cut into consecutive segments of their order, the window runs
per ``(key, segment)``, and what a segment needs from its neighbours (the last
value before it, the sum before it, the first row after it) comes from a
summary with one row per segment.

The segment of a row depends only on its key, its order value and the stored
bounds, never on where the row happens to be processed, so a recomputed task
always agrees with the original one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movelens.sources.staging import stage


@dataclass(frozen=True)
class Skew:
    """How a scan guards against hot keys.

    hot_rows      a key with more rows than this is cut into segments
    pieces        segments per hot key at least; more where the largest key has
                  more than ``pieces`` times ``hot_rows`` rows
    rows_at_most  known upper bound on the input's rows; at or below
                  ``hot_rows`` no key can be hot, and the counting pass is saved
    max_broadcast hot keys whose boundaries may be broadcast; beyond it the
                  boundaries are joined by a shuffle
    """

    hot_rows: int = 1_000_000
    pieces: int = 512
    rows_at_most: int | None = None
    max_broadcast: int = 1_000

    def bounded(self, rows: int | None) -> "Skew":
        return replace(self, rows_at_most=rows)

    def times(self, factor: int) -> "Skew":
        """The guard for a scan over ``factor`` times the rows."""
        return self if self.rows_at_most is None else self.bounded(self.rows_at_most * factor)


DEFAULT_SKEW = Skew()


def order_number(df: DataFrame, name: str) -> Column:
    """``name`` as a number that never decreases when ``name`` increases."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.DateType):
        return F.unix_date(name).cast("double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if isinstance(dtype, T.NumericType):
        return F.col(name).cast("double")
    raise TypeError(f"cannot order by {name}: {dtype.simpleString()}")


def bucket_of(bounds: Column, value: Column, size: int) -> Column:
    """How many of the ascending ``bounds`` (at most ``size``) lie below ``value``."""
    steps = [1 << i for i in reversed(range(max(size, 1).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda pos, step: F.when(
            (pos + step <= F.size(bounds)) & (F.get(bounds, pos + step - 1) < value), pos + step
        ).otherwise(pos),
    )


def _boundaries(ord_col: str, pieces: int) -> Column:
    # one parsed literal instead of a call into the JVM per entry
    probs = F.expr("array(" + ", ".join(f"{i / pieces!r}D" for i in range(1, pieces)) + ")")
    return F.array_sort(F.array_distinct(F.percentile_approx(ord_col, probs, F.lit(pieces * 20))))


def _same_keys(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)])


def _pieces(rows: int, skew: Skew) -> int:
    """Segments for a key of so many rows: none has far more than ``hot_rows``."""
    return max(skew.pieces, min(10_000, -(-rows // max(1, skew.hot_rows))))


def _with_segments(df: DataFrame, by: list[str], skew: Skew) -> DataFrame | None:
    """Add ``_bounds`` (null for ordinary keys) and ``_seg``; None if no key is hot.

    With a hot key the rows are written once: bounds, summary and rows all read
    that table, so that chained scans do not multiply their plans. The bounds are
    written too: approximate quantiles follow the order in which partial results
    are fetched, so rows and summary agree on segments only if both read one copy.
    """
    if skew.rows_at_most is not None and skew.rows_at_most <= skew.hot_rows:
        return None
    pieces = skew.pieces
    if not by:
        df = stage(df, "scan")
        pieces = _pieces(df.count(), skew)
        bounds = stage(df.agg(_boundaries("_ord", pieces).alias("b")), "scan-bounds")
        out = df.withColumn("_bounds", bounds.scalar())
    else:
        counts = df.groupBy(*by).count().filter(F.col("count") > skew.hot_rows)
        found = counts.agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("rows")).first()
        if found.n == 0:
            return None
        df = stage(df, "scan")
        pieces = _pieces(found.rows, skew)
        few = found.n <= skew.max_broadcast
        names = [f"_hot_key{i}" for i in range(len(by))]
        hot = df.groupBy(*by).count().filter(F.col("count") > skew.hot_rows).drop("count").toDF(*names)
        bounds = (
            df.select(*by, "_ord")
            .join(F.broadcast(hot) if few else hot, _same_keys(by, names), "left_semi")
            .groupBy(*by)
            .agg(_boundaries("_ord", pieces).alias("_bounds"))
            .toDF(*names, "_bounds")
        )
        bounds = stage(bounds, "scan-bounds")
        out = df.join(F.broadcast(bounds) if few else bounds, _same_keys(by, names), "left").drop(*names)
    return out.withColumn(
        "_seg",
        F.when(F.col("_bounds").isNull(), F.lit(0)).otherwise(
            bucket_of(F.col("_bounds"), F.col("_ord"), pieces)
        ),
    )


def ordered_scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    *,
    last: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    lead: Mapping[str, Column] | None = None,
    lag: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """Add columns computed along each key's rows in ascending ``order``.

    last       latest non-null value at or before the row
    following  earliest non-null value at or after the row
    lead       value on the next row (null on the last one)
    lag        value on the row before (null on the first one)
    sums       running sum up to and including the row
    totals     sum over all rows of the key

    ``order`` has to make a key's rows distinct for the result to be
    deterministic; its first column is numeric, a date or a timestamp.
    """
    by, order = list(by), list(order)
    last, following, lead = dict(last or {}), dict(following or {}), dict(lead or {})
    lag, sums, totals = dict(lag or {}), dict(sums or {}), dict(totals or {})
    kinds = (("l", last), ("f", following), ("n", lead), ("p", lag), ("s", sums), ("t", totals))
    columns = df.columns
    df = df.withColumn("_ord", order_number(df, order[0]))
    inputs = {f"_{k}_{out}": expr for k, group in kinds for out, expr in group.items()}
    if inputs:
        df = df.withColumns(inputs)
    segmented = _with_segments(df, by, skew)
    keys = by if segmented is None else by + ["_seg"]
    rows = df if segmented is None else segmented

    forward = Window.partitionBy(*keys).orderBy(*order)
    upto = forward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A frame that runs to the end of the partition is recomputed for every
    # row, so "following" is a "last" along the reversed order instead.
    backward = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    back_upto = backward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)

    local: dict[str, Column] = {}
    for out in last:
        local[f"_in_l_{out}"] = F.last(f"_l_{out}", ignorenulls=True).over(upto)
    for out in following:
        local[f"_in_f_{out}"] = F.last(f"_f_{out}", ignorenulls=True).over(back_upto)
    for out in lead:
        local[f"_in_n_{out}"] = F.lead(F.struct(F.col(f"_n_{out}").alias("v"))).over(forward)
    for out in lag:
        local[f"_in_p_{out}"] = F.lag(F.struct(F.col(f"_p_{out}").alias("v"))).over(forward)
    for out in sums:
        local[f"_in_s_{out}"] = F.sum(f"_s_{out}").over(upto)
    for out in totals:
        local[f"_in_t_{out}"] = F.sum(f"_t_{out}").over(whole)
    scanned = rows.withColumns(local)

    if segmented is None:
        final = {out: F.col(f"_in_{k}_{out}") for k, g in kinds if k not in "np" for out in g}
        final.update({out: F.col(f"_in_{k}_{out}.v") for k, g in kinds if k in "np" for out in g})
        return scanned.select(*columns, *[c.alias(o) for o, c in final.items()])

    place = [F.col(c) for c in order]
    heads: list[Column] = []
    for out in last:
        heads.append(
            F.max(F.when(F.col(f"_l_{out}").isNotNull(), F.struct(*place, F.col(f"_l_{out}").alias("v")))).alias(f"_sl_{out}")
        )
    for out in following:
        heads.append(
            F.min(F.when(F.col(f"_f_{out}").isNotNull(), F.struct(*place, F.col(f"_f_{out}").alias("v")))).alias(f"_sf_{out}")
        )
    for out in lead:
        heads.append(F.min(F.struct(*place, F.col(f"_n_{out}").alias("v"))).alias(f"_sn_{out}"))
    for out in lag:
        heads.append(F.max(F.struct(*place, F.col(f"_p_{out}").alias("v"))).alias(f"_sp_{out}"))
    for out in sums:
        heads.append(F.sum(f"_s_{out}").alias(f"_ss_{out}"))
    for out in totals:
        heads.append(F.sum(f"_t_{out}").alias(f"_st_{out}"))
    summary = rows.filter(F.col("_bounds").isNotNull()).groupBy(*by, "_seg").agg(*heads)

    # One row per segment of a hot key: at most ``pieces`` rows in a window.
    across = Window.partitionBy(*by).orderBy("_seg")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*by).orderBy(F.col("_seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried: list[Column] = []
    for out in last:
        carried.append(F.last(f"_sl_{out}.v", ignorenulls=True).over(before).alias(f"_c_l_{out}"))
    for out in following:
        carried.append(F.last(f"_sf_{out}.v", ignorenulls=True).over(back).alias(f"_c_f_{out}"))
    for out in lead:
        carried.append(F.lead(F.struct(F.col(f"_sn_{out}.v").alias("v"))).over(across).alias(f"_c_n_{out}"))
    for out in lag:
        carried.append(F.lag(F.struct(F.col(f"_sp_{out}.v").alias("v"))).over(across).alias(f"_c_p_{out}"))
    for out in sums:
        carried.append(F.sum(f"_ss_{out}").over(before).alias(f"_c_s_{out}"))
    for out in totals:
        carried.append(F.sum(f"_st_{out}").over(Window.partitionBy(*by)).alias(f"_c_t_{out}"))
    names = [f"_carry_key{i}" for i in range(len(by))]
    carry = summary.select(*[F.col(b).alias(n) for b, n in zip(by, names)], F.col("_seg").alias("_cseg"), *carried)
    joined = scanned.join(carry, _same_keys(by + ["_seg"], names + ["_cseg"]), "left")

    final = {}
    for out in last:
        final[out] = F.coalesce(f"_in_l_{out}", f"_c_l_{out}")
    for out in following:
        final[out] = F.coalesce(f"_in_f_{out}", f"_c_f_{out}")
    for out in lead:
        final[out] = F.coalesce(F.col(f"_in_n_{out}"), F.col(f"_c_n_{out}"))["v"]
    for out in lag:
        final[out] = F.coalesce(F.col(f"_in_p_{out}"), F.col(f"_c_p_{out}"))["v"]
    for out in sums:
        here, prior = F.col(f"_in_s_{out}"), F.col(f"_c_s_{out}")
        final[out] = F.when(here.isNull(), prior).otherwise(here + F.coalesce(prior, F.lit(0)))
    for out in totals:
        final[out] = F.coalesce(f"_c_t_{out}", f"_in_t_{out}")
    return joined.select(*columns, *[c.alias(o) for o, c in final.items()])
