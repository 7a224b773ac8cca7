"""Scenarios: validation, batch prediction, explanation, what-if, comparison.

A scenario is a row. Since the model is linear, swapping a feature for its
reference value changes the prediction by the difference of that feature's two
parts; explanations are column arithmetic and need no further predictions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from movelens import fixed_values as fv
from movelens.functions.numeric import clip
from movelens.operators.baselines import category_baselines, center_by, regress
from movelens.operators.knn import nearest
from movelens.operators.model import FittedFeatures, LinearModel, apply_percentiles, as_struct, medians
from movelens.operators.reports import top_k
from movelens.operators.scan import DEFAULT_SKEW, Skew
from movelens.operators.small_side import small_join

# Steps of the what-if analysis and gates of the notes.
COMPOSITE_STEP, COMPOSITE_CEILING, RATE_STEP = 15.0, 95.0, 1.25
TOSS_UP_GAP = 3.0
MIN_NOTE_GAP = 4.0


# ---------------------------------------------------------------- references


@dataclass(frozen=True)
class References:
    """Typical values a prediction is compared with, as small tables.

    flat         one row, struct ``v``: medians and modes over everything
    paid         one row, struct ``v``: medians of paid moves
    by_group     per position: struct ``v`` of medians, mode ``sub_position``
    profiles     per position: struct ``v`` of mean recent form
    fee_line     one row: log fee expected from log value, paid moves
    rating_lines one row: rating expected from either club's log value
    free_share   one row: share of free moves
    baselines    mean outcome per category
    """

    flat: DataFrame
    paid: DataFrame
    by_group: DataFrame
    profiles: DataFrame
    fee_line: DataFrame
    rating_lines: DataFrame
    free_share: DataFrame
    baselines: DataFrame


def modes(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Most frequent level per column (and ``by``): ``stat``, ``by``, ``mode``; ties go to the smaller."""
    entries = F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).cast("string").alias("l")) for c in columns])
    counts = (
        df.select(*by, F.explode(entries).alias("e")).select(*by, "e.stat", "e.l").filter(F.col("l").isNotNull())
        .groupBy(*by, "stat", "l").agg(F.count(F.lit(1)).alias("n"))
    )
    pick = F.min(F.struct((-F.col("n")).alias("n"), F.col("l")))["l"]
    return counts.groupBy("stat", *by).agg(pick.alias("mode"))


def reference_values(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Medians of numeric and modes of categorical columns: ``stat``, ``median``, ``mode``."""
    m = medians(df, numeric, skew=skew).withColumn("mode", F.lit(None).cast("string"))
    c = modes(df, categorical).select("stat", F.lit(None).cast("double").alias("median"), "mode")
    return m.select("stat", "median", "mode").unionByName(c)


def fit_references(df: DataFrame, skew: Skew = DEFAULT_SKEW) -> References:
    """All reference tables from training rows with model features."""
    numeric, categorical = list(fv.NUMERIC_FEATURES), list(fv.CATEGORICAL_FEATURES)
    paid = df.filter(F.col("transfer_fee") > 0)
    table = reference_values(df, numeric, categorical, skew)
    flat = table.agg(
        F.struct(
            *[F.max(F.when(F.col("stat") == c, F.col("median"))).alias(c) for c in numeric],
            *[F.max(F.when(F.col("stat") == c, F.col("mode"))).alias(c) for c in categorical],
        ).alias("v")
    )
    groups = as_struct(medians(df, fv.POSITION_CONDITIONAL, ["position"], skew), fv.POSITION_CONDITIONAL, "median", ["position"])
    roles = modes(df, ["sub_position"], ["position"]).select("position", F.col("mode").alias("sub_position"))
    known = df.filter(F.col("rating_pct").isNotNull())
    lines = known.agg(
        *[
            f(F.col("rating_pct"), F.col(f"log_{side}_club_value")).alias(f"{side}_{n}")
            for side in ("to", "from")
            for n, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept))
        ]
    )
    return References(
        flat=flat,
        paid=as_struct(medians(paid, ["log_transfer_fee", "fee_to_value_ratio"], skew=skew), ["log_transfer_fee", "fee_to_value_ratio"], "median"),
        by_group=groups.join(roles, "position", "left"),
        profiles=df.groupBy("position").agg(F.struct(*[F.avg(f).alias(f) for f in fv.RECENT_FEATURES]).alias("v")),
        fee_line=regress(paid, F.col("log_transfer_fee"), F.col("log_value_before")),
        rating_lines=lines,
        free_share=df.agg(F.bround(F.avg((F.coalesce("transfer_fee", F.lit(0.0)) == 0).cast("double")), 3).alias("free_share")),
        baselines=category_baselines(
            df, ["to_domestic_competition_id", "from_domestic_competition_id", "position", "sub_position", "foot"], "success_score"
        ),
    )


# ---------------------------------------------------------------- scenarios

# Accepted range per scenario field (None is open).
SCENARIO_RANGES: dict[str, tuple[float | None, float | None, bool]] = {
    "age_at_transfer": (15, 42, False), "height_in_cm": (150, 210, False),
    "transfer_fee": (0, None, False), "value_before": (0, None, True),
    "from_total_market_value": (0, None, False), "to_total_market_value": (0, None, False),
}


def validate_scenarios(df: DataFrame) -> DataFrame:
    """Add ``reasons``, the list of rules a scenario breaks; empty means valid."""
    checks: list[Column] = []
    for c, (lo, hi, open_low) in SCENARIO_RANGES.items():
        bad = F.col(c).isNull()
        if lo is not None:
            bad = bad | (F.col(c) <= lo if open_low else F.col(c) < lo)
        if hi is not None:
            bad = bad | (F.col(c) > hi)
        checks.append(F.when(bad, F.lit(f"{c} out of range")))
    for c in ("position", "sub_position", "foot", "from_domestic_competition_id", "to_domestic_competition_id"):
        checks.append(F.when(F.col(c).isNull(), F.lit(f"{c} missing")))
    given = sum((F.col(c).isNotNull().cast("int") for c in fv.RECENT_FEATURES), F.lit(0))
    checks.append(F.when((given > 0) & (given < len(fv.RECENT_FEATURES)), F.lit("recent form has to be complete or absent")))
    for c in fv.RECENT_FEATURES:
        checks.append(F.when(F.col(c) < 0, F.lit(f"{c} out of range")))
    return df.withColumn("reasons", F.filter(F.array(*checks), lambda r: r.isNotNull()))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid scenarios, and rejected ones with their reasons."""
    checked = validate_scenarios(df)
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def scenario_features(df: DataFrame, fitted: FittedFeatures, refs: References) -> DataFrame:
    """Model features of scenarios, and ``has_recent`` / ``has_pre_*_data``.

    Absent recent form is filled with the position's typical one, else the
    overall one - the very values explanations compare with.
    """
    has = sum((F.col(c).isNotNull().cast("int") for c in fv.RECENT_FEATURES), F.lit(0)) == len(fv.RECENT_FEATURES)
    groups = refs.by_group.select(F.col("position").alias("_rg"), F.col("v").alias("_gv"))
    joined = df.withColumn("has_recent", has)
    joined = small_join(joined, groups, [("position", "_rg")]).withColumn("_fv", refs.flat.scalar())
    filled = {
        c: F.when(F.col("has_recent"), F.col(c)).otherwise(F.coalesce(F.col(f"_gv.{c}"), F.col(f"_fv.{c}")))
        for c in fv.RECENT_FEATURES
    }
    out = joined.withColumns(filled).drop("_rg", "_gv", "_fv").withColumns(
        {
            "log_transfer_fee": F.log1p("transfer_fee"),
            "log_value_before": F.log1p("value_before"),
            "log_from_club_value": F.log1p("from_total_market_value"),
            "log_to_club_value": F.log1p("to_total_market_value"),
            "fee_to_value_ratio": F.col("transfer_fee") / F.greatest("value_before", F.lit(1.0)),
            "club_quality_ratio": F.col("to_total_market_value") / F.greatest("from_total_market_value", F.lit(1.0)),
        }
    )
    centered = center_by(out, "height_in_cm", "position", fitted.heights, "height_vs_position")
    composed = apply_percentiles(centered, fitted.percentiles).withColumn("_med", fitted.composite_medians.scalar())
    return composed.withColumns({c: F.coalesce(F.col(c), F.col(f"_med.{c}")) for c in fv.COMPOSITES}).drop("_med")


def marginalise(df: DataFrame, model: LinearModel, profiles: DataFrame, group: str = "position",
                has: str = "has_recent", base: str = "point_score", out: str = "raw_score",
                features: Sequence[str] = fv.RECENT_FEATURES) -> DataFrame:
    """Mean prediction over all real recent-form profiles of the scenario's group.

    The mean of a linear prediction over profiles is the prediction at their
    mean, so scenarios meet one row per group instead of every profile.
    ``profiles`` has ``group`` and struct ``v`` of means. Scenarios with real
    form, or of a group without profiles, keep their point prediction.
    """
    p = profiles.select(F.col(group).alias("_pg"), F.col("v").alias("_pv"))
    joined = small_join(df, p, [(group, "_pg")])
    shift = sum((model.part(f, F.col(f"_pv.{f}")) - model.part(f) for f in features), F.lit(0.0))
    raw = F.when(F.col(has) | F.col("_pg").isNull(), F.col(base)).otherwise(F.col(base) + shift)
    return joined.withColumn(out, raw).drop("_pg", "_pv")


def neighbour_range(queries: DataFrame, reference: DataFrame, stats: Mapping[str, tuple[float, float]], *,
                    query_key: str, reference_key: str, score: str, k: int = fv.NEIGHBOURS) -> DataFrame:
    """Lowest and highest outcome among the ``k`` nearest reference rows."""
    scale = {f"{c}_z": (F.col(c) - m) / d for c, (m, d) in stats.items()}
    found = nearest(
        queries.withColumns(scale), reference.withColumns(scale), list(scale),
        query_key=query_key, reference_key=reference_key, k=k,
    )
    outcome = reference.select(F.col(reference_key).alias("_nk"), F.col(score).alias("_ns"))
    joined = found.join(outcome, F.col("neighbour") == F.col("_nk"))
    return joined.groupBy(query_key).agg(
        F.bround(F.min("_ns"), 1).alias("range_low"), F.bround(F.max("_ns"), 1).alias("range_high")
    )


def predict(scenarios: DataFrame, model: LinearModel, refs: References) -> DataFrame:
    """Point prediction, marginalised prediction and the clipped headline score."""
    df = scenarios.withColumn("point_score", model.predict())
    df = marginalise(df, model, refs.profiles)
    return df.withColumn("predicted_score", F.bround(clip(F.col("raw_score"), 0.0, 100.0), 1))


# ---------------------------------------------------------------- explanation


def resolve_references(df: DataFrame, fitted: FittedFeatures, refs: References, model: LinearModel) -> DataFrame:
    """Add ``ref_<feature>``, the typical value each feature is compared with.

    In order: an imputed composite is compared with the median it was imputed
    with; a paid fee with the fee expected for the value; the role with the
    position's usual one; position-dependent features with the position's
    median; features of paid moves with the paid median; the rest overall.
    """
    groups = refs.by_group.select(F.col("position").alias("_rg"), F.col("v").alias("_gv"), F.col("sub_position").alias("_gs"))
    line = refs.fee_line.select(F.struct("slope", "intercept").alias("l"))
    df = small_join(df, groups, [("position", "_rg")]).withColumns(
        {
            "_fv": refs.flat.scalar(), "_paid": refs.paid.scalar(), "_line": line.scalar(),
            "_med": fitted.composite_medians.scalar(),
        }
    )
    is_paid = F.col("log_transfer_fee") > 0
    out: dict[str, Column] = {}
    for f in model.features:
        if f in fv.COMPOSITE_FLAGS:
            continue
        ref = F.col(f"_fv.{f}")
        if f in ("log_transfer_fee", "fee_to_value_ratio"):
            ref = F.when(is_paid, F.col(f"_paid.{f}")).otherwise(ref)
        if f in fv.POSITION_CONDITIONAL:
            ref = F.coalesce(F.col(f"_gv.{f}"), ref)
        if f == "sub_position":
            ref = F.coalesce(F.col("_gs"), ref)
        if f == "log_transfer_fee":
            expected = F.col("_line.intercept") + F.col("_line.slope") * F.col("log_value_before")
            ref = F.when(is_paid, expected).otherwise(ref)
        if f in fv.COMPOSITES:
            flag = fv.COMPOSITE_FLAGS[fv.COMPOSITES.index(f)]
            ref = F.when(F.col(flag) == 0, F.col(f"_med.{f}")).otherwise(ref)
        out[f"ref_{f}"] = ref
    df = df.withColumns(out)
    # The role usual for the reference position; unchanged if the position is.
    typical = refs.by_group.select(F.col("position").alias("_tp"), F.col("sub_position").alias("_ts"))
    df = small_join(df, typical, [("ref_position", "_tp")])
    role = F.when(F.col("ref_position") == F.col("position"), F.col("sub_position")).otherwise(F.col("_ts"))
    return df.withColumn("ref_role_of_position", role).drop("_rg", "_gv", "_gs", "_fv", "_paid", "_line", "_med", "_tp", "_ts")


def default_swaps(model: LinearModel) -> dict[str, dict[str, str]]:
    """Factor -> {feature: reference column}; dependent features are swapped together."""
    swaps: dict[str, dict[str, str]] = {
        "pre_playing_time": {f: f"ref_{f}" for f in fv.PLAYING_TIME_FEATURES},
        "position": {"position": "ref_position", "sub_position": "ref_role_of_position"},
    }
    skip = {*fv.COMPOSITE_FLAGS, *fv.PLAYING_TIME_FEATURES, "position"}
    swaps.update({f: {f: f"ref_{f}"} for f in model.features if f not in skip})
    return swaps


def explain(
    df: DataFrame, model: LinearModel, swaps: Mapping[str, Mapping[str, str]], key: Sequence[str],
    base: str = "point_score", labels: Mapping[str, str] = fv.FEATURE_LABELS, top: int | None = None,
) -> DataFrame:
    """What each factor adds to a scenario's prediction against its typical value.

    One row per scenario and factor: ``factor``, ``label``, ``contribution``
    (one decimal), ``rank`` by size, ``shown`` (within ``top``), and per
    scenario ``baseline_score``, ``other_total`` and ``other_count`` so that
    baseline + shown + other is the prediction.
    """
    entries = []
    for factor, features in swaps.items():
        effect = sum((model.part(f) - model.part(f, F.col(r)) for f, r in features.items()), F.lit(0.0))
        entries.append(
            F.struct(
                F.lit(factor).alias("factor"), F.lit(labels.get(factor, factor)).alias("label"),
                F.bround(effect, 1).alias("contribution"),
            )
        )
    # The factors of a scenario are a short array: ranking and totals stay in its row.
    place = lambda e: F.struct((-F.abs(e["contribution"])).alias("o"), e["factor"].alias("t"), e.alias("e"))
    ranked = F.transform(F.array_sort(F.transform(F.array(*entries), place)), lambda s: s["e"])
    limit = len(swaps) if top is None else top

    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0.0), lambda a, e: a + e["contribution"])

    rows = df.select(*key, F.col(base).alias("_base"), ranked.alias("_f")).withColumns(
        {"_all": total(F.col("_f")), "_shown": total(F.slice("_f", 1, limit))}
    )
    rows = rows.select(
        *key,
        F.bround(F.col("_base") - F.col("_all"), 1).alias("baseline_score"),
        F.bround(F.col("_all") - F.col("_shown"), 1).alias("other_total"),
        F.lit(len(swaps) - min(limit, len(swaps))).alias("other_count"),
        F.posexplode_outer("_f"),
    )
    return rows.select(
        *key, "col.factor", "col.label", "col.contribution", (F.col("pos") + 1).alias("rank"),
        (F.col("pos") < limit).alias("shown"), "baseline_score", "other_total", "other_count",
    )


def sensitivity(
    df: DataFrame, model: LinearModel, key: Sequence[str], real: Mapping[str, Column] | None = None,
    features: Sequence[str] = fv.SENSITIVITY_FEATURES, composites: Sequence[str] = fv.COMPOSITES, k: int = 3,
) -> DataFrame:
    """The ``k`` realistic improvements that raise the score most: ``feature``, ``actual``, ``target``, ``gain``.

    A composite gains 15 points up to 95, a rate a quarter. Imputed values and
    changes that do not help are left out.
    """
    real = real or {}
    entries = []
    for f in features:
        actual = F.col(f)
        if f in composites:
            target = F.least(actual + COMPOSITE_STEP, F.lit(COMPOSITE_CEILING))
            usable = target > actual
        else:
            target, usable = actual * RATE_STEP, actual > 0
        gain = F.bround(model.part(f, target) - model.part(f), 1)
        usable = usable & real.get(f, F.lit(True))
        entries.append(
            F.struct(
                F.when(usable & (gain > 0), -gain).alias("order"), F.lit(f).alias("feature"),
                actual.alias("actual"), target.alias("target"), gain.alias("gain"),
            )
        )
    best = F.slice(F.array_sort(F.filter(F.array(*entries), lambda e: e["order"].isNotNull())), 1, k)
    rows = df.select(*key, F.posexplode(best))
    return rows.select(*key, (F.col("pos") + 1).alias("rank"), "col.feature", "col.actual", "col.target", "col.gain")


def real_data(df_columns: Sequence[str] = ()) -> dict[str, Column]:
    """Which sensitivity features rest on real data, for scenarios with model features."""
    flags = {c: F.col(f) == 1 for c, f in zip(fv.COMPOSITES, fv.COMPOSITE_FLAGS)}
    return {**flags, "pre_goals_p90": F.col("has_recent"), "pre_ga_p90": F.col("has_recent")}


def factor_spread(explained: DataFrame, group: Sequence[str], scenario: str) -> DataFrame:
    """Per factor: spread over a group's scenarios, its rank, and the scenario it favours most."""
    best = F.min(F.struct((-F.col("contribution")).alias("c"), F.col(scenario).alias("s")))["s"]
    rows = explained.groupBy(*group, "factor").agg(
        F.bround(F.max("contribution") - F.min("contribution"), 1).alias("spread"), best.alias("winner")
    )
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("spread").desc(), "factor"))
    return rows.withColumn("rank", rank)


def verdict(df: DataFrame, group: Sequence[str], scenario: str, score: str, gap: float = TOSS_UP_GAP) -> DataFrame:
    """Best and second scenario of each group, their distance, and whether it is a toss-up.

    Takes the two best rows per group, which are found before the shuffle.
    """
    two = top_k(df.select(*group, scenario, score), group, [F.col(score).desc(), F.col(scenario)], 2)
    first, second = F.col("rank") == 1, F.col("rank") == 2
    out = two.groupBy(*group).agg(
        F.max(F.when(first, F.col(scenario))).alias("winner"), F.max(F.when(first, F.col(score))).alias("best_score"),
        F.max(F.when(second, F.col(scenario))).alias("runner_up"), F.max(F.when(second, F.col(score))).alias("second_score"),
    )
    diff = F.bround(F.col("best_score") - F.col("second_score"), 1)
    return out.withColumns({"gap": diff, "toss_up": F.coalesce(diff < gap, F.lit(False))})


def compare(scenarios: DataFrame, model: LinearModel, swaps: Mapping[str, Mapping[str, str]], group: Sequence[str],
            scenario: str, score: str = "predicted_score") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all factors, factor spread, verdict) of groups of scenarios."""
    explained = explain(scenarios, model, swaps, [*group, scenario])
    return explained, factor_spread(explained, group, scenario), verdict(scenarios, group, scenario, score)


def context_gaps(df: DataFrame, refs: References, key: Sequence[str],
                 features: Sequence[str] = ("to_domestic_competition_id", "from_domestic_competition_id", "position", "sub_position", "foot")) -> DataFrame:
    """Numbers behind an explanation: ``kind``, ``actual``, ``reference`` per factor.

    Categories give the mean outcome of the actual and the typical level, if
    both have enough moves; club values give the rating each implies, if the
    two differ by at least 4 points.
    """
    b = refs.baselines
    pairs = df.select(
        *key, F.explode(F.array(*[
            F.struct(F.lit(f).alias("kind"), F.col(f).alias("a"), F.col(f"ref_{f}").alias("r")) for f in features
        ])).alias("e"),
    ).select(*key, "e.*")
    actual = b.select(F.col("feature").alias("kind"), F.col("level").alias("a"), F.col("mean").alias("actual"))
    typical = b.select(F.col("feature").alias("kind"), F.col("level").alias("r"), F.col("mean").alias("reference"))
    categories = pairs.join(actual, ["kind", "a"]).join(typical, ["kind", "r"]).select(*key, "kind", "actual", "reference")
    lines = refs.rating_lines.select(F.struct(*refs.rating_lines.columns).alias("l"))

    def implied(side: str, value: str) -> Column:
        return clip(F.col(f"_l.{side}_slope") * F.col(value) + F.col(f"_l.{side}_intercept"), 0.0, 100.0)

    clubs = df.withColumn("_l", lines.scalar()).select(
        *key, F.explode(F.array(*[
            F.struct(
                F.lit(f"{side}_club_rating").alias("kind"), implied(side, f"log_{side}_club_value").alias("actual"),
                implied(side, f"ref_log_{side}_club_value").alias("reference"),
            ) for side in ("to", "from")
        ])).alias("e"),
    ).select(*key, "e.*").filter(F.abs(F.col("actual") - F.col("reference")) >= MIN_NOTE_GAP)
    return categories.unionByName(clubs)
