"""Careers: timelines over both populations, their shape, and neighbours."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movelens.operators.knn import nearest
from movelens.operators.scan import DEFAULT_SKEW, Skew, ordered_scan

SHAPE_FEATURES = ("n_stops", "first_score", "last_score", "avg_score", "score_range", "score_trend", "span_years")


def union_populations(tagged: Mapping[str, DataFrame], tag: str = "type") -> DataFrame:
    """All rows of several populations with the name of theirs; missing columns are null."""
    out = None
    for name, df in tagged.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def timeline(permanent: DataFrame, loans: DataFrame, columns: Sequence[str], players: DataFrame | None = None,
             subject: str = "player_id", header: Sequence[str] = ("position", "current_club_name")) -> DataFrame:
    """Every scored stop of every subject with one shared ``score`` column.

    ``columns`` exist in both tables. ``players`` adds optional header values.
    """
    both = union_populations(
        {
            "permanent": permanent.select(*columns, F.col("success_score").alias("score")),
            "loan": loans.select(*columns, F.col("loan_success_score").alias("score")),
        }
    )
    if players is None:
        return both
    heads = players.select(F.col(subject).alias("_hs"), *header)
    return both.join(heads, F.col(subject) == F.col("_hs"), "left").drop("_hs")


def merge_careers(
    stops: DataFrame, pairs: DataFrame, subject: str = "player_id", ts: str = "transfer_date", tie: Sequence[str] = (),
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """Stops of two subjects in one list by date, for any number of pairs.

    ``pairs`` has ``pair``, ``a`` and ``b``. Adds ``pair``, ``side`` (a or b)
    and ``place``, the position in the merged list.
    """
    sides = pairs.select(
        "pair", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("_who")) for s in ("a", "b")])).alias("_e")
    ).select("pair", "_e.*")
    merged = stops.join(sides, F.col(subject) == F.col("_who")).drop("_who")
    return ordered_scan(merged, ["pair"], [ts, "side", *tie], sums={"place": F.lit(1)}, skew=skew)


def distinct_subjects(tables: Sequence[DataFrame], subject: str, name: str) -> DataFrame:
    """Subjects over several tables, with the name of the first table that has one."""
    out = None
    for i, df in enumerate(tables):
        part = df.select(subject, name, F.lit(i).alias("_from"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(subject).agg(F.min(F.struct("_from", name))[name].alias(name))


def peak_stop(stops: DataFrame, subject: str, ts: str, score: str, carry: Sequence[str] = ()) -> DataFrame:
    """Each subject's best stop; the earliest one on a tie."""
    best = F.min(F.struct((-F.col(score)).alias("_s"), F.col(ts).alias("_t"), F.struct(ts, score, *carry).alias("r")))
    return stops.groupBy(subject).agg(best["r"].alias("_r")).select(subject, "_r.*")


def shape_vectors(stops: DataFrame, subject: str, ts: str, score: str, tie: Sequence[str] = ()) -> DataFrame:
    """Career shape: stops, first, last, mean, range and trend of the score, years spanned."""
    place = F.struct(ts, *tie, score)
    agg = stops.groupBy(subject).agg(
        F.count(F.lit(1)).alias("n_stops"),
        F.min(place).alias("_a"), F.max(place).alias("_z"),
        F.avg(score).alias("avg_score"), F.max(score).alias("_hi"), F.min(score).alias("_lo"),
    )
    return agg.select(
        subject, "n_stops",
        F.col(f"_a.{score}").alias("first_score"), F.col(f"_z.{score}").alias("last_score"), "avg_score",
        (F.col("_hi") - F.col("_lo")).alias("score_range"),
        (F.col(f"_z.{score}") - F.col(f"_a.{score}")).alias("score_trend"),
        (F.datediff(F.col(f"_z.{ts}"), F.col(f"_a.{ts}")) / F.lit(365.25)).alias("span_years"),
    )


def scale_stats(df: DataFrame, columns: Sequence[str], sample: bool = True) -> DataFrame:
    """One row with a struct ``s`` of ``m_<c>`` and ``d_<c>``: mean and deviation (0 becomes 1)."""
    dev = F.stddev_samp if sample else F.stddev_pop
    parts = []
    for c in columns:
        d = dev(c)
        parts += [F.avg(c).alias(f"m_{c}"), F.when((d == 0) | d.isNull(), F.lit(1.0)).otherwise(d).alias(f"d_{c}")]
    return df.agg(F.struct(*parts).alias("s"))


def zscore(df: DataFrame, columns: Sequence[str], stats: DataFrame | None = None, sample: bool = True, suffix: str = "_z") -> DataFrame:
    """Columns against the population's mean and deviation, as ``<c>_z``."""
    stats = scale_stats(df, columns, sample) if stats is None else stats
    scaled = df.withColumn("_st", stats.scalar())
    return scaled.withColumns(
        {f"{c}{suffix}": (F.col(c) - F.col(f"_st.m_{c}")) / F.col(f"_st.d_{c}") for c in columns}
    ).drop("_st")


def similar_entities(
    shapes: DataFrame, subject: str, features: Sequence[str] = SHAPE_FEATURES, k: int = 5,
    queries: DataFrame | None = None, min_stops: int = 2,
) -> DataFrame:
    """Subjects whose careers went most alike, by standardised shape.

    A query subject needs ``min_stops`` stops; anyone can be found. ``queries``
    holds the subject ids asked for; by default every subject is one.
    """
    z = zscore(shapes, features)
    asked = z.filter(F.col("n_stops") >= min_stops)
    if queries is not None:
        asked = asked.join(queries.select(subject).distinct(), subject, "left_semi")
    scaled = [f"{c}_z" for c in features]
    return nearest(asked, z, scaled, query_key=subject, reference_key=subject, k=k, exclude_self=True)
