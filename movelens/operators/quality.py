"""Data-quality checks: each returns the violating rows or their counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movelens.operators.scan import DEFAULT_SKEW, Skew, order_number, ordered_scan
from movelens.operators.scoring import fold_component, lookup_weights, others_mean


def check_weights(weights: DataFrame, zero: Mapping[str, Sequence[str]] | None = None, tol: float = 1e-6) -> DataFrame:
    """Profiles that do not sum to 1, or have weight where there must be none."""
    names = [c for c in weights.columns if c not in ("level", "key")]
    total = sum((F.col(c) for c in names), F.lit(0.0))
    bad = F.abs(total - 1) > tol
    for k, columns in (zero or {}).items():
        for c in columns:
            bad = bad | ((F.col("key") == k) & (F.col(c) != 0))
    return weights.filter(bad)


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows breaking each rule: ``rule``, ``violations``. A null condition is a violation."""
    counts = df.agg(*[F.count(F.when(~F.coalesce(c, F.lit(False)), F.lit(1))).alias(r) for r, c in rules.items()])
    entries = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"`{r}`").alias("violations")) for r in rules])
    return counts.select(F.explode(entries).alias("e")).select("e.*")


def bounds(columns: Sequence[str], lo: float = 0.0, hi: float = 100.0, nullable: bool = False) -> dict[str, Column]:
    """Rules that keep columns within limits."""
    out = {}
    for c in columns:
        ok = F.col(c).between(lo, hi)
        out[f"{c}_in_bounds"] = F.col(c).isNull() | ok if nullable else ok
    return out


def flag_iff_value(flags: Mapping[str, str]) -> dict[str, Column]:
    """Rules that a flag is set exactly where its value is present."""
    return {f"{flag}_matches": F.col(flag) == F.col(value).isNotNull() for flag, value in flags.items()}


def derived_rules() -> dict[str, Column]:
    """Consistency of derived columns of scored permanent spells."""
    def close(a: Column, b: Column, tol: float = 1e-6) -> Column:
        return F.abs(a - b) <= tol

    share = F.least(F.col("post_apps") / F.greatest("team_games_in_tenure", F.lit(1)), F.lit(1.0))
    return {
        "pre_level_ratio": close(
            F.col("pre_ga_p90_vs_league"), F.col("pre_ga_p90") / F.greatest("from_league_ga_baseline", F.lit(0.05))
        ),
        "post_level_ratio": close(
            F.col("post_ga_p90_vs_league"), F.col("post_ga_p90") / F.greatest("to_league_ga_baseline", F.lit(0.05))
        ),
        "share_of_games": close(F.col("pct_team_games_played"), share),
        "peak_not_below_end": F.col("value_peak") >= F.col("value_after"),
    }


def check_recomposition(df: DataFrame, weights: DataFrame, key: Sequence[str], tol: float = 0.15) -> DataFrame:
    """Scored permanent spells whose score does not follow from their components.

    The stored attacking component is already folded, so the weights are too.
    """
    w = lookup_weights(df, weights)
    folded = fold_component(w.withColumn("_kept", F.col("attacking_pct"))).withColumn("attacking_pct", F.col("_kept"))
    vw = F.col("value_for_money_weight")
    rw = F.when(F.col("has_resale_data"), F.col("resale_weight")).otherwise(0.0)
    again = (
        others_mean() * (1 - vw - rw) + vw * F.col("value_for_money_pct")
        + F.when(F.col("has_resale_data"), rw * F.col("resale_profit_pct")).otherwise(0.0)
    )
    return folded.withColumn("_again", again).filter(
        F.abs(F.col("_again") - F.col("success_score")) > tol
    ).select(*key, "success_score", F.col("_again").alias("recomputed"))


def burst_distinct(
    df: DataFrame, key: str, value: str, ts: str, days: int = 30, n: int = 3, skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """Keys with ``n`` or more distinct values within some ``days``-day window.

    A value counts from each of its dates for ``days`` days, or until it is
    seen again if that is sooner; the number of counting values is a running
    sum of arrivals and expiries. Result: ``key``, ``peak``.
    """
    seen = df.filter(F.col(value).isNotNull() & F.col(ts).isNotNull()).select(key, value, F.to_date(ts).alias("_d")).distinct()
    nxt = ordered_scan(seen, [key, value], ["_d"], lead={"_next": F.col("_d")}, skew=skew)
    expiry = F.least(F.date_add("_d", days), F.col("_next"))
    # At one date values expire before others arrive.
    steps = nxt.select(
        key, F.explode(F.array(
            F.struct(F.col("_d").alias("_at"), F.lit(1).alias("_step")),
            F.struct(expiry.alias("_at"), F.lit(-1).alias("_step")),
        )).alias("_e"),
    ).select(key, "_e.*").groupBy(key, "_at").agg(F.sum("_step").alias("_step"))
    running = ordered_scan(steps, [key], ["_at"], sums={"_active": F.col("_step")}, skew=skew.times(2))
    return running.groupBy(key).agg(F.max("_active").alias("peak")).filter(F.col("peak") >= n)
