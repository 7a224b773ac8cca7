"""Group baselines with a minimum sample and a fallback chain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movelens.operators.small_side import settled, small_join

# Smallest samples a cell baseline is trusted with.
MIN_CELL_MINUTES = 5000
MIN_CELL_ROWS = 15
DEFAULT_REGION = "_default"


def rate_baselines(
    facts: DataFrame,
    *,
    region: str,
    group: str,
    num: Column,
    den: Column,
    scale: float = 90.0,
    min_den: float = MIN_CELL_MINUTES,
    out: str = "baseline",
) -> DataFrame:
    """Rate of sums per (region, group), and per group under region ``_default``.

    Cells below ``min_den`` are left out; the group totals keep every fact.
    Totals are added up from the cells, so the facts are read once.
    """
    cells = facts.groupBy(region, group).agg(F.sum(num).alias("_num"), F.sum(den).alias("_den"))
    rate = (F.col("_num") / F.greatest(F.col("_den"), F.lit(1)) * scale).alias(out)
    both = _cells_and_totals(cells, region, group)
    fine = (F.col("_den") >= min_den) & F.col(region).isNotNull()
    return both.filter(F.col(group).isNotNull() & (~F.col("_fine") | fine)).select(region, group, rate)


def _cells_and_totals(cells: DataFrame, region: str, group: str) -> DataFrame:
    """Cells (``_fine``) and, under region ``_default``, the sums of each group's cells.

    Every cell counts for itself and for its group, so that one pass over the
    facts serves both; a union of cells and totals would read the facts twice.
    """
    parts = [c for c in cells.columns if c not in (region, group)]
    for_itself = F.struct(F.col(region).alias("r"), F.lit(True).alias("f"))
    for_group = F.struct(F.lit(DEFAULT_REGION).alias("r"), F.lit(False).alias("f"))
    return (
        cells.select(group, *parts, F.explode(F.array(for_itself, for_group)).alias("_at"))
        .groupBy(F.col("_at.r").alias(region), group, F.col("_at.f").alias("_fine"))
        .agg(*[F.sum(c).alias(c) for c in parts])
    )


def weighted_baselines(
    df: DataFrame,
    stats: Sequence[str],
    *,
    region: str,
    group: str,
    weight: str,
    min_rows: int = MIN_CELL_ROWS,
) -> DataFrame:
    """Weighted mean of every stat per cell and, as ``_default`` rows, per group.

    A stat of a cell with fewer than ``min_rows`` usable rows is null there.
    """
    w = F.col(weight)
    parts = []
    for s in stats:
        ok = F.col(s).isNotNull() & w.isNotNull()
        parts += [
            F.sum(F.when(ok, F.col(s) * w)).alias(f"_x_{s}"),
            F.sum(F.when(ok, w)).alias(f"_w_{s}"),
            F.count(F.when(ok, F.lit(1))).alias(f"_n_{s}"),
        ]
    cells = df.groupBy(region, group).agg(*parts)
    both = _cells_and_totals(cells, region, group)
    fine = F.col("_fine")

    def mean(s: str) -> Column:
        value = F.col(f"_x_{s}") / F.greatest(F.col(f"_w_{s}"), F.lit(1))
        return F.when(F.col(f"_n_{s}") >= F.when(fine, min_rows).otherwise(1), value).alias(s)

    kept = both.filter(F.col(group).isNotNull() & (~fine | F.col(region).isNotNull()))
    return kept.select(region, group, *[mean(s) for s in stats])


def lookup_baseline(
    df: DataFrame,
    baselines: DataFrame,
    *,
    region: str,
    group: str,
    take: Mapping[str, str],
    base_region: str | None = None,
    base_group: str | None = None,
    last_resort: float | None = None,
) -> DataFrame:
    """Baseline of (region, group), else of the group, else the mean over groups.

    ``take`` maps output names to baseline columns. With ``last_resort`` set,
    that constant replaces the mean. A null region goes straight to the group.
    """
    base_region, base_group = base_region or region, base_group or group
    b = baselines.select(
        F.col(base_region).alias("_r"), F.col(base_group).alias("_g"), *[F.col(c).alias(f"_c_{o}") for o, c in take.items()]
    )
    b = settled(b)  # read for cells, groups and their mean
    fallback = b.filter(F.col("_r") == DEFAULT_REGION)
    means = fallback.agg(F.struct(*[F.avg(f"_c_{o}").alias(o) for o in take]).alias("m"))
    fine = b.filter(F.col("_r") != DEFAULT_REGION)
    coarse = fallback.select(F.col("_g").alias("_g2"), *[F.col(f"_c_{o}").alias(f"_d_{o}") for o in take])
    joined = small_join(small_join(df, fine, [(region, "_r"), (group, "_g")]), coarse, [(group, "_g2")])
    if last_resort is None:
        joined = joined.withColumn("_m", means.scalar())
        last = {o: F.col(f"_m.{o}") for o in take}
    else:
        last = {o: F.lit(last_resort) for o in take}
    values = {o: F.coalesce(f"_c_{o}", f"_d_{o}", last[o]) for o in take}
    return joined.withColumns(values).select(*df.columns, *[o for o in take if o not in df.columns])


def category_baselines(df: DataFrame, columns: Sequence[str], value: str, min_n: int = MIN_CELL_ROWS) -> DataFrame:
    """Mean outcome of every category of several columns: ``feature``, ``level``, ``n``, ``mean``."""
    sets = df.groupingSets([[c] for c in columns], *columns).agg(
        F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")
    )
    # grouping_id has a 0 bit for the one column that is kept
    full = (1 << len(columns)) - 1
    feature = F.coalesce(
        *[F.when(F.col("_gid") == full - (1 << (len(columns) - 1 - i)), F.lit(c)) for i, c in enumerate(columns)]
    )
    level = F.coalesce(*[F.when(feature == c, F.col(c).cast("string")) for c in columns])
    return sets.select(feature.alias("feature"), level.alias("level"), "n", F.bround("mean", 1).alias("mean")).filter(
        (F.col("n") >= min_n) & F.col("level").isNotNull()
    )


def group_means(df: DataFrame, value: str, by: str, out: str = "mean") -> DataFrame:
    """Mean per group, with the overall mean under group ``_default``."""
    sums = df.groupBy(by).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    overall = sums.agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n")).withColumn(by, F.lit(DEFAULT_REGION))
    return sums.filter(F.col(by).isNotNull()).unionByName(overall).select(by, (F.col("_s") / F.col("_n")).alias(out))


def regress(df: DataFrame, y: Column, x: Column, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` per group: ``slope``, ``intercept``."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def center_by(df: DataFrame, value: str, by: str, fitted: DataFrame, out: str, mean: str = "mean") -> DataFrame:
    """``value`` minus the fitted mean of its group, or the overall mean for a new group."""
    fitted = settled(fitted)
    default = fitted.filter(F.col(by) == DEFAULT_REGION).select(mean)
    table = fitted.filter(F.col(by) != DEFAULT_REGION).select(F.col(by).alias("_cg"), F.col(mean).alias("_cm"))
    centered = F.col(value) - F.coalesce(F.col("_cm"), default.scalar())
    return small_join(df, table, [(by, "_cg")]).withColumn(out, centered).drop("_cg", "_cm")
