"""Exact percentile ranks and quantiles over distributions of any size.

Both start from the distinct values of a column with their counts. Equal
values collapse in the map-side combine, so one value that holds a third of
all rows costs one row; the running count along the values is an ordered scan,
which segments large groups. Nothing is approximated: sampled boundaries only
decide how the work is spread.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movelens.operators.scan import DEFAULT_SKEW, Skew, _same_keys, ordered_scan
from movelens.sources.staging import stage


def value_counts(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    aggs: Mapping[str, Column] | None = None,
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """Distinct values of ``value`` per group, in order.

    Columns: ``by``, ``value``, ``cnt`` (rows with it), ``before`` (rows of the
    group with a smaller one), ``n`` (non-null rows of the group) and ``aggs``.
    """
    by = list(by)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("cnt"), *[c.alias(o) for o, c in (aggs or {}).items()])
    )
    if skew.rows_at_most is not None and skew.rows_at_most > skew.hot_rows:
        # counted from the file, so that rows that repeat few values need no guard and are grouped once
        counts = stage(counts, "value-counts")
        skew = skew.bounded(counts.count())
    scanned = ordered_scan(
        counts, by, [value], sums={"_upto": F.col("cnt")}, totals={"n": F.col("cnt")}, skew=skew
    )
    return scanned.withColumn("before", F.col("_upto") - F.col("cnt")).drop("_upto")


def rank_share() -> Column:
    """Average-tie rank over non-null count, times 100: from 100/n up to 100."""
    return (F.col("before") + (F.col("cnt") + 1) / F.lit(2.0)) / F.col("n") * 100


def pct_rank(
    df: DataFrame,
    value: str,
    out: str,
    by: Sequence[str] = (),
    where: Column | None = None,
    other: Column | None = None,
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """Percentile rank of ``value`` within ``by`` (over everything if empty).

    ``where`` restricts the ranked population; rows outside it get ``other``
    (null by default). Null values are not ranked.
    """
    by = list(by)
    ranked_value = F.col(value) if where is None else F.when(where, F.col(value))
    df = df.withColumn("_rv", ranked_value)
    names = [f"_g{i}" for i in range(len(by))]
    ranks = value_counts(df.select(*by, "_rv"), "_rv", by, skew=skew).select(
        *[F.col(b).alias(n) for b, n in zip(by, names)], F.col("_rv").alias("_v"), rank_share().alias(out)
    )
    # rows that are not ranked match nothing; spread by their content they do not meet in one task
    spread = F.when(F.col("_rv").isNull(), F.xxhash64(*[F.col(c) for c in df.columns])).otherwise(F.lit(0))
    df, ranks = df.withColumn("_rs", spread), ranks.withColumn("_s", F.lit(0).cast("long"))
    on = (F.col("_rv") == F.col("_v")) & (F.col("_rs") == F.col("_s"))
    if by:
        on = on & _same_keys(by, names)
    ranked = df.join(ranks, on, "left").drop("_rv", "_v", "_rs", "_s", *names)
    if other is not None:
        ranked = ranked.withColumn(out, F.when(where, F.col(out)).otherwise(other))
    return ranked


@dataclass(frozen=True)
class RankSpec:
    """One rank of :func:`pct_ranks`: ``by`` are group columns, ``where`` the population."""

    out: str
    value: Column
    by: tuple[str, ...] = ()
    where: Column | None = None


def pct_ranks(df: DataFrame, key: Sequence[str], specs: Sequence[RankSpec], skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Several percentile ranks in one pass.

    The values are stacked as ``(metric, group, value)`` and ranked together,
    so the number of shuffles does not grow with the number of ranks. ``key``
    identifies a row of ``df``. A row with a null group has no rank.
    """
    key = list(key)

    def value(spec: RankSpec) -> Column:
        return (spec.value if spec.where is None else F.when(spec.where, spec.value)).cast("double")

    def group(spec: RankSpec) -> Column:
        if len(spec.by) > 1:
            return F.to_json(F.struct(*spec.by))
        return F.col(spec.by[0]).cast("string") if spec.by else F.lit("")

    if len(specs) == 1:
        # one rank joins the rows by its value; stacked, they would be moved by value, by key and by key again
        grouped = df.withColumn("_g", group(specs[0]))
        ranked = grouped.withColumn("_v1", F.when(F.col("_g").isNotNull(), value(specs[0])))
        return pct_rank(ranked, "_v1", specs[0].out, ["_g"], skew=skew).drop("_v1", "_g")
    entries = [F.struct(F.lit(i).alias("_m"), group(s).alias("_g"), value(s).alias("_v")) for i, s in enumerate(specs)]
    stacked = (
        df.select(*key, F.explode(F.array(*entries)).alias("_e"))
        .select(*key, "_e._m", "_e._g", "_e._v")
        .filter(F.col("_v").isNotNull() & F.col("_g").isNotNull())
    )
    ranks = value_counts(stacked, "_v", ["_m", "_g"], skew=skew).select("_m", "_g", "_v", rank_share().alias("_p"))
    wide = (
        stacked.join(ranks, ["_m", "_g", "_v"])
        .groupBy(*key)
        .agg(*[F.max(F.when(F.col("_m") == i, F.col("_p"))).alias(s.out) for i, s in enumerate(specs)])
    )
    return df.join(wide, key, "left")


def quantile_positions(k: int) -> Column:
    """Indices ``i`` of the quantiles ``i/k`` touching a row of :func:`value_counts`."""
    gaps = F.greatest(F.col("n") - 1, F.lit(1))
    lo = F.greatest(F.lit(0), F.floor((F.col("before") - 1) * k / gaps).cast("int"))
    hi = F.least(F.lit(k), F.ceil((F.col("before") + F.col("cnt")) * k / gaps).cast("int"))
    hi = F.when(F.col("n") == 1, F.lit(k)).otherwise(hi)
    return F.sequence(F.least(lo, hi), hi)


def quantiles(counts: DataFrame, value: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles ``0/k .. k/k`` with linear interpolation.

    ``counts`` comes from :func:`value_counts`. One row per group: ``by``, the
    group's ``n`` and ``q``, an array of ``k + 1`` values.
    """
    by = list(by)
    place = (F.col("n") - 1) * (F.col("i") / F.lit(float(k)))
    first, last = F.col("before"), F.col("before") + F.col("cnt") - 1
    picked = (
        counts.select(*by, value, "cnt", "before", "n", F.explode(quantile_positions(k)).alias("i"))
        .withColumn("_place", place)
        .withColumn("_lo", F.floor("_place"))
        .withColumn("_hi", F.ceil("_place"))
        .filter(F.col("_lo").between(first, last) | F.col("_hi").between(first, last))
        .groupBy(*by, "i")
        .agg(
            F.max("n").alias("n"),
            F.max("_place").alias("_place"),
            F.max(F.when(F.col("_lo").between(first, last), F.col(value))).alias("_a"),
            F.max(F.when(F.col("_hi").between(first, last), F.col(value))).alias("_b"),
        )
        .withColumn("_q", F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_place") - F.floor("_place")))
    )
    # k + 1 values per group
    return picked.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("_q").alias("q")))), lambda x: x["q"]).alias("q"),
    )


def exact_quantiles(
    df: DataFrame, value: str, k: int, by: Sequence[str] = (), skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """:func:`quantiles` straight from rows."""
    return quantiles(value_counts(df, value, by, skew=skew), value, k, by)


def stacked_quantiles(
    df: DataFrame, values: Mapping[str, Column], k: int, by: Sequence[str] = (), skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """Exact quantiles of several expressions in one pass: ``stat``, ``by``, ``n``, ``q``."""
    by = list(by)
    entries = F.array(*[F.struct(F.lit(s).alias("stat"), c.cast("double").alias("_v")) for s, c in values.items()])
    stacked = df.select(*by, F.explode(entries).alias("_e")).select(*by, "_e.stat", "_e._v")
    return exact_quantiles(stacked, "_v", k, ["stat", *by], skew=skew)
