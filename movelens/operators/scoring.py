"""Outcome scores: components as percentile ranks, blended by role weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from movelens import fixed_values as fv
from movelens.functions.numeric import clip, decay_weight, known_mean, ratio, weighted_known_mean
from movelens.operators.baselines import lookup_baseline, regress, weighted_baselines
from movelens.operators.ranks import RankSpec, pct_ranks
from movelens.operators.scan import DEFAULT_SKEW, Skew
from movelens.operators.small_side import small_join

# Shape of the single components.
OVERPAY_FREE_RATIO = 1.3
RESALE_FEE_FLOOR = 1_000_000.0
LEVEL_FLOOR = 0.05
FORGIVEN_GAMES_PER_SEASON = 10.0
MIN_GAMES_PER_YEAR = 15.0
PROXY_COMPONENTS = ("perf_level", "attacking", "defensive", "possession", "rating")
PROVIDER_COMPONENTS = ("rating", "attacking", "defensive", "possession")


def load_weights(
    spark: SparkSession,
    components: Sequence[str] = fv.COMPONENTS,
    positions: Mapping[str, Sequence[float]] = fv.POSITION_WEIGHTS,
    sub_positions: Mapping[str, Sequence[float]] = fv.SUB_POSITION_WEIGHTS,
) -> DataFrame:
    """Weight profiles as a table: ``level``, ``key`` and one column per component.

    Keys that start with an underscore are comments and left out.
    """
    rows = [("position", k, *map(float, w)) for k, w in positions.items() if not k.startswith("_")]
    rows += [("sub_position", k, *map(float, w)) for k, w in sub_positions.items() if not k.startswith("_")]
    schema = "level string, key string, " + ", ".join(f"{c} double" for c in components)
    return spark.createDataFrame(rows, schema)


def load_loan_weights(spark: SparkSession) -> DataFrame:
    """Weight profiles of loans, which have no fee and no resale component."""
    return load_weights(spark, fv.LOAN_COMPONENTS, fv.LOAN_POSITION_WEIGHTS, fv.LOAN_SUB_POSITION_WEIGHTS)


def lookup_weights(
    df: DataFrame, weights: DataFrame, group: str = "position", sub_group: str = "sub_position", prefix: str = "w_"
) -> DataFrame:
    """Add ``w_<component>``: the sub-group's profile if there is one, else the group's.

    Rows whose group has no profile are dropped. The weights are a handful of
    literal rows, so broadcasting them is always safe.
    """
    names = [c for c in weights.columns if c not in ("level", "key")]
    broad = weights.filter(F.col("level") == "position").select(
        F.col("key").alias("_wk"), *[F.col(c).alias(f"_b_{c}") for c in names]
    )
    narrow = weights.filter(F.col("level") == "sub_position").select(
        F.col("key").alias("_wk2"), *[F.col(c).alias(f"_n_{c}") for c in names]
    )
    joined = df.join(F.broadcast(broad), F.col(group) == F.col("_wk")).join(
        F.broadcast(narrow), F.col(sub_group) == F.col("_wk2"), "left"
    )
    picked = {f"{prefix}{c}": F.coalesce(f"_n_{c}", f"_b_{c}") for c in names}
    return joined.withColumns(picked).select(*df.columns, *picked)


def growth_specs(before: str, peak: str, after: str, by: tuple[str, ...] = ()) -> list[RankSpec]:
    """The four ranks behind :func:`value_growth`."""
    b = F.col(before)
    return [
        RankSpec("_rp", ratio(F.col(peak), b), by),
        RankSpec("_re", ratio(F.col(after), b), by),
        RankSpec("_ap", F.col(peak) - b, by),
        RankSpec("_ae", F.col(after) - b, by),
    ]


def growth_blend() -> Column:
    """0.2 relative + 0.8 absolute growth, each 0.8 to the peak + 0.2 to the end."""
    relative = 0.8 * F.col("_rp") + 0.2 * F.col("_re")
    absolute = 0.8 * F.col("_ap") + 0.2 * F.col("_ae")
    return 0.2 * relative + 0.8 * absolute


def value_growth(
    df: DataFrame, key: Sequence[str], before: str, peak: str, after: str,
    out: str = "value_growth_pct", skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """Growth of the subject's value over the spell, as a blend of four ranks."""
    ranked = pct_ranks(df, key, growth_specs(before, peak, after), skew=skew)
    return ranked.withColumn(out, growth_blend()).drop("_rp", "_re", "_ap", "_ae")


def overpay_spec(fee: str, before: str, free: float = OVERPAY_FREE_RATIO, out: str = "_fee_rank") -> RankSpec:
    """Rank of the excess over a normal premium, among overpaid moves only."""
    paid = F.coalesce(F.col(fee), F.lit(0.0)) / F.greatest(F.col(before), F.lit(1.0))
    return RankSpec(out, F.greatest(paid - free, F.lit(0.0)), (), paid > free)


def fee_penalty(
    df: DataFrame, key: Sequence[str], fee: str, before: str, free: float = OVERPAY_FREE_RATIO,
    out: str = "fee_penalty_pct", skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """0 up to a normal premium; above it the rank among overpaid moves."""
    ranked = pct_ranks(df, key, [overpay_spec(fee, before, free)], skew=skew)
    return ranked.withColumn(out, F.coalesce("_fee_rank", F.lit(0.0))).drop("_fee_rank")


def resale_spec(fee: str, next_fee: str, floor: float = RESALE_FEE_FLOOR, out: str = "resale_profit_pct") -> RankSpec:
    """Rank of the resale profit relative to the fee, among resold subjects."""
    paid = F.coalesce(F.col(fee), F.lit(0.0))
    profit = (F.col(next_fee) - paid) / F.greatest(paid, F.lit(floor))
    return RankSpec(out, profit, (), F.col(next_fee) > 0)


def effective_share(apps: Column, games: Column, days: Column) -> Column:
    """Share of the organisation's games taken part in, forgiving normal rotation.

    Missed games are forgiven along a saturating curve; not at all where the
    organisation has too few games on record to trust the denominator.
    """
    years = F.greatest(days / F.lit(365.25), F.lit(1 / 365.25))
    trusted = games >= MIN_GAMES_PER_YEAR * years
    total = F.greatest(games, F.lit(1))
    missed = F.greatest(total - apps, F.lit(0))
    allowance = FORGIVEN_GAMES_PER_SEASON * years
    forgiven = F.when(trusted, allowance * (1 - F.exp(-missed / allowance))).otherwise(0.0)
    return F.least(F.least(apps + forgiven, total) / total, F.lit(1.0))


def availability_specs(apps: str, games: str, days: str) -> list[RankSpec]:
    """The two ranks behind playing time."""
    share = effective_share(F.col(apps), F.col(games), F.col(days))
    return [RankSpec("_share", share), RankSpec("_apps", F.col(apps))]


def availability_blend() -> Column:
    return 0.6 * F.col("_share") + 0.4 * F.col("_apps")


def availability(
    df: DataFrame, key: Sequence[str], apps: str, games: str, days: str,
    out: str = "playing_time_pct", skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """Playing time: 0.6 availability rank + 0.4 appearance rank."""
    ranked = pct_ranks(df, key, availability_specs(apps, games, days), skew=skew)
    return ranked.withColumn(out, availability_blend()).drop("_share", "_apps")


def expected_level(
    df: DataFrame, y: str, x: str, by: str, out: str = "expected"
) -> DataFrame:
    """Level expected from the level before, by one regression line per group."""
    lines = regress(df.select(by, y, x), F.col(y), F.col(x), [by]).withColumnRenamed(by, "_lg")
    joined = small_join(df, lines, [(by, "_lg")])
    return joined.withColumn(out, F.col("intercept") + F.col("slope") * F.col(x)).drop("_lg", "slope", "intercept")


def provider_rates(df: DataFrame) -> DataFrame:
    """Season totals of the provider as rates per 90, and conceded goals inverted."""
    nineties = clip(F.col("fotmob_total_minutes") / 90, lo=1.0)
    return df.withColumns(
        {
            "fotmob_chances_created_p90": F.col("fotmob_total_att_assist") / nineties,
            "fotmob_big_chance_created_p90": F.col("fotmob_big_chance_created") / nineties,
            "fotmob_goals_conceded_inv": -F.col("fotmob_goals_conceded"),
        }
    )


def component_pcts(
    df: DataFrame,
    key: Sequence[str],
    buckets: Mapping[str, Sequence[str]],
    *,
    region: str,
    group: str,
    weight: str,
    special: Mapping[str, tuple[Column, Sequence[str]]] | None = None,
    min_rows: int = 15,
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """``<bucket>_pct`` and ``has_<bucket>_data`` from raw statistics.

    Each statistic loses its (region, group) baseline - a difference, since
    some statistics are negative or percentages - and is ranked within
    ``group``; a bucket is the mean of its available ranks. ``special`` gives
    other statistics to the rows of a condition.
    """
    special = dict(special or {})
    stats = list(dict.fromkeys([s for b in buckets.values() for s in b] + [s for _, b in special.values() for s in b]))
    base = weighted_baselines(df, stats, region=region, group=group, weight=weight, min_rows=min_rows)
    adjusted = lookup_baseline(df, base, region=region, group=group, take={f"_base_{s}": s for s in stats})
    specs = [RankSpec(f"_p_{s}", F.col(s) - F.col(f"_base_{s}"), (group,), F.col(group).isNotNull()) for s in stats]
    ranked = pct_ranks(adjusted, key, specs, skew=skew)
    out = {}
    for b, members in buckets.items():
        value = known_mean(*[F.col(f"_p_{s}") for s in members])
        if b in special:
            when, others = special[b]
            value = F.when(when, known_mean(*[F.col(f"_p_{s}") for s in others])).otherwise(value)
        out[f"{b}_pct"] = value
    flagged = ranked.withColumns(out).withColumns({f"has_{b}_data": F.col(f"{b}_pct").isNotNull() for b in buckets})
    return flagged.drop(*[f"_base_{s}" for s in stats], *[f"_p_{s}" for s in stats])


def provider_components(
    df: DataFrame, key: Sequence[str], region: str = "to_domestic_competition_id", group: str = "position",
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """Rating, attacking, defensive and possession components of both populations.

    Pass the union of permanent and loan spells: rates per 90 mean the same in
    both, so they share one ranking.
    """
    rated = component_pcts(
        provider_rates(df),
        key,
        {
            "rating": ("fotmob_rating",),
            "attacking": fv.ATTACKING_STATS,
            "defensive": fv.DEFENSIVE_STATS,
            "possession": fv.POSSESSION_STATS,
        },
        region=region,
        group=group,
        weight="fotmob_total_minutes",
        special={"defensive": (F.col(group) == fv.KEEPER, fv.KEEPER_STATS)},
        skew=skew,
    )
    has_any = F.greatest(*[F.col(f"has_{c}_data") for c in PROVIDER_COMPONENTS])
    return rated.withColumn("has_fotmob_data", has_any).drop(
        "fotmob_chances_created_p90", "fotmob_big_chance_created_p90", "fotmob_goals_conceded_inv"
    )


def performance_proxy() -> Column:
    """On-pitch quality for value for money, weighted by the row's own profile."""
    blended = weighted_known_mean([(F.col(f"{c}_pct"), F.col(f"w_{c}")) for c in PROXY_COMPONENTS])
    return F.coalesce(blended, F.col("perf_level_pct"))


def fold_component(df: DataFrame) -> DataFrame:
    """Where attacking is known, goal output moves into it, value and weight alike."""
    has = F.col("has_attacking_data")
    return df.withColumns(
        {
            "attacking_pct": F.when(has, 0.5 * (F.col("perf_level_pct") + F.col("attacking_pct"))).otherwise(
                F.col("attacking_pct")
            ),
            "_fw_level": F.when(has, F.lit(0.0)).otherwise(F.col("w_perf_level")),
            "_fw_attacking": F.when(has, F.col("w_attacking") + F.col("w_perf_level")).otherwise(F.col("w_attacking")),
        }
    )


def others_mean() -> Column:
    """Missing-aware mean of the eight components both populations share."""
    weights = {
        "perf_level": F.col("_fw_level"), "perf_delta": F.col("w_perf_delta"),
        "value_growth": F.col("w_value_growth"), "playing_time": F.col("w_playing_time"),
        "rating": F.col("w_rating"), "attacking": F.col("_fw_attacking"),
        "defensive": F.col("w_defensive"), "possession": F.col("w_possession"),
    }
    return weighted_known_mean([(F.col(f"{c}_pct"), w) for c, w in weights.items()])


def level_columns(df: DataFrame, baselines: DataFrame, baseline: str = "ga_p90_baseline") -> DataFrame:
    """Goal output before and after the move relative to each league's going rate."""
    for side, stage in (("from", "pre"), ("to", "post")):
        df = lookup_baseline(
            df,
            baselines,
            region=f"{side}_domestic_competition_id",
            group="position",
            base_region="competition_id",
            take={f"{side}_league_ga_baseline": baseline},
        )
        df = df.withColumn(
            f"{stage}_ga_p90_vs_league",
            ratio(F.col(f"{stage}_ga_p90"), F.col(f"{side}_league_ga_baseline"), LEVEL_FLOOR),
        )
    return df


def base_components(df: DataFrame, key: Sequence[str], extra: Sequence[RankSpec] = (), skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """The components that need no provider data, ranked within ``df``."""
    df = expected_level(
        df, "post_ga_p90_vs_league", "pre_ga_p90_vs_league", "position",
        out="expected_post_ga_p90_vs_league",
    )
    residual = F.col("post_ga_p90_vs_league") - F.col("expected_post_ga_p90_vs_league")
    specs = [
        RankSpec("perf_level_pct", F.col("post_ga_p90_vs_league"), ("position",)),
        RankSpec("perf_delta_pct", residual, ("position",)),
        *growth_specs("value_before", "value_peak", "value_after"),
        *availability_specs("post_apps", "team_games_in_tenure", "tenure_days"),
        *extra,
    ]
    ranked = pct_ranks(df, key, specs, skew=skew)
    share = F.least(F.col("post_apps") / F.greatest(F.col("team_games_in_tenure"), F.lit(1)), F.lit(1.0))
    return ranked.withColumns(
        {
            "value_growth_pct": growth_blend(),
            "playing_time_pct": availability_blend(),
            "pct_team_games_played": share,
        }
    ).drop("_rp", "_re", "_ap", "_ae", "_share", "_apps")


def score_permanent(df: DataFrame, weights: DataFrame, key: Sequence[str], skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """``success_score`` of permanent spells whose components are attached.

    The eight shared components form a missing-aware mean; value for money and,
    if the subject was resold, the resale profit are blended in at weights that
    fade with the length of the spell. Value for money looks at the attacking
    component before goal output is folded into it.
    """
    df = lookup_weights(df, weights)
    df = df.withColumns(
        {
            "_worth": performance_proxy() - F.coalesce("_fee_rank", F.lit(0.0)),
            "has_resale_data": F.coalesce(F.col("next_transfer_fee") > 0, F.lit(False)),
        }
    )
    df = pct_ranks(df, key, [RankSpec("value_for_money_pct", F.col("_worth"))], skew=skew)
    years = F.col("tenure_days") / F.lit(365.25)
    df = fold_component(df).withColumns(
        {
            "_others": others_mean(),
            "value_for_money_weight": decay_weight(years, *fv.VALUE_CURVE),
            "resale_weight": decay_weight(years, *fv.RESALE_CURVE),
        }
    )
    vw, rw = F.col("value_for_money_weight"), F.col("resale_weight")
    with_resale = F.col("_others") * (1 - vw - rw) + vw * F.col("value_for_money_pct") + rw * F.col("resale_profit_pct")
    without = F.col("_others") * (1 - vw) + vw * F.col("value_for_money_pct")
    score = F.bround(F.when(F.col("has_resale_data"), with_resale).otherwise(without), 1)
    return df.withColumn("success_score", score).drop("_worth", "_others", "_fee_rank", "_fw_level", "_fw_attacking")


def score_loans(df: DataFrame, weights: DataFrame) -> DataFrame:
    """``loan_success_score``: the eight shared components with loan weights."""
    df = fold_component(lookup_weights(df, weights))
    return df.withColumn("loan_success_score", F.bround(others_mean(), 1)).drop("_fw_level", "_fw_attacking")


def breakdown_rows(df: DataFrame, key: Sequence[str], loan: bool = False, labels: Mapping[str, str] = fv.COMPONENT_LABELS) -> DataFrame:
    """One row per shown component of a scored spell: ``place``, ``component``, ``label``, ``value``.

    Attacking and goal output exclude each other, keepers have neither, and the
    resale only shows where there was one.
    """
    keeper = F.coalesce(F.col("position") == fv.KEEPER, F.lit(False))
    attacking = F.col("has_attacking_data")
    shown = {
        "value_for_money": F.lit(not loan),
        "value_growth": F.lit(True),
        "resale_profit": F.lit(False) if loan else F.col("has_resale_data"),
        "perf_level": ~keeper & ~attacking,
        "perf_delta": ~keeper,
        "attacking": ~keeper & attacking,
        "possession": F.col("has_possession_data"),
        "defensive": F.col("has_defensive_data"),
        "rating": F.col("has_rating_data"),
        "playing_time": F.lit(True),
    }
    if loan:
        shown = {c: s for c, s in shown.items() if c not in ("value_for_money", "resale_profit")}
    entries = []
    for i, (c, show) in enumerate(shown.items()):
        label = F.lit(labels[c])
        if c == "defensive":
            label = F.when(keeper, F.lit(fv.KEEPER_DEFENSIVE_LABEL)).otherwise(label)
        entries.append(
            F.struct(
                F.lit(i).alias("place"), F.lit(c).alias("component"), label.alias("label"),
                F.bround(f"{c}_pct", 1).alias("value"), show.alias("show"),
            )
        )
    rows = df.select(*key, F.explode(F.array(*entries)).alias("_e")).filter("_e.show")
    return rows.select(*key, "_e.place", "_e.component", "_e.label", "_e.value")
