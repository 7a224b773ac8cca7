"""Training: fitted features and a weighted ridge.

Every statistic is fitted on the training rows alone and applied to others as
a table. The model itself is a handful of coefficients, so scoring is a column
expression and never leaves the JVM.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movelens import fixed_values as fv
from movelens.functions.numeric import interp, known_mean
from movelens.operators.baselines import center_by, group_means
from movelens.operators.ranks import stacked_quantiles
from movelens.operators.scan import DEFAULT_SKEW, Skew
from movelens.operators.small_side import small_join
from movelens.sources.staging import stage

POOLED = "__infrequent__"


# ---------------------------------------------------------------- features


def derive(df: DataFrame) -> DataFrame:
    """Log features (an unknown fee counts as 0) and "unknown" categories."""
    return df.withColumns(
        {
            "log_transfer_fee": F.log1p(F.coalesce("transfer_fee", F.lit(0.0))),
            "log_value_before": F.log1p("value_before"),
            "log_from_club_value": F.log1p("from_total_market_value"),
            "log_to_club_value": F.log1p("to_total_market_value"),
            "foot": F.coalesce("foot", F.lit("unknown")),
            "from_domestic_competition_id": F.coalesce("from_domestic_competition_id", F.lit("unknown")),
            "to_domestic_competition_id": F.coalesce("to_domestic_competition_id", F.lit("unknown")),
        }
    )


REQUIRED = tuple(
    f for f in fv.NUMERIC_FEATURES if f != "height_vs_position" and f not in fv.COMPOSITES and f not in fv.COMPOSITE_FLAGS
) + ("height_in_cm",)


def trainable(df: DataFrame, required: Sequence[str] = (*REQUIRED, *fv.CATEGORICAL_FEATURES, "success_score")) -> DataFrame:
    """Rows with every value that is not imputed later."""
    return df.dropna(subset=list(required))


def temporal_split(df: DataFrame, ts: str = "transfer_date", cut: str = fv.SPLIT_DATE) -> tuple[DataFrame, DataFrame]:
    """Rows before the cut, rows on or after it."""
    at = F.lit(cut).cast("date")
    return df.filter(F.col(ts) < at), df.filter(F.col(ts) >= at)


def recency_weight(df: DataFrame, ts: str, half_life: float = fv.HALF_LIFE_YEARS, reference: dt.date | None = None,
                   out: str = "recency_weight") -> DataFrame:
    """Weight 1 at the newest row, halving every ``half_life`` years.

    ``reference`` fixes the date instead of the rows' own newest one.
    """
    newest = F.lit(reference) if reference is not None else df.agg(F.max(ts).alias("m")).scalar()
    years = F.datediff(newest, ts) / F.lit(365.25)
    return df.withColumn(out, F.pow(F.lit(0.5), years / half_life))


def percentile_tables(
    df: DataFrame, stats: Sequence[str] = fv.PRE_STATS, by: str = "position",
    inverted: Sequence[str] = fv.PRE_INVERTED, min_n: int = fv.MIN_PERCENTILE_ROWS, skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """101 breakpoints per statistic and group with at least ``min_n`` values."""
    values = {s: -F.col(s) if s in inverted else F.col(s) for s in stats}
    table = stacked_quantiles(df.filter(F.col(by).isNotNull()), values, 100, [by], skew)
    return table.filter(F.col("n") >= min_n).select("stat", by, "q")


def apply_percentiles(
    df: DataFrame, tables: DataFrame, by: str = "position", buckets: Mapping[str, Sequence[str]] = fv.PRE_BUCKETS,
    keeper_bucket: Sequence[str] = fv.PRE_KEEPER_BUCKET, inverted: Sequence[str] = fv.PRE_INVERTED, position: str | None = None,
) -> DataFrame:
    """``pre_fotmob_<bucket>_pct`` and ``has_pre_<bucket>_data`` from fitted breakpoints.

    ``position`` names the position's column where the breakpoints are ``by`` another one.
    """
    stats = list(dict.fromkeys([s for b in buckets.values() for s in b] + list(keeper_bucket)))
    # at most one entry per statistic and group
    maps = tables.groupBy(F.col(by).alias("_pg")).agg(
        F.map_from_entries(F.collect_list(F.struct("stat", "q"))).alias("_tables")
    )
    joined = small_join(df, maps, [(by, "_pg")])
    pct = {
        s: interp((-F.col(s) if s in inverted else F.col(s)).cast("double"), F.try_element_at("_tables", F.lit(s)))
        for s in stats
    }
    joined = joined.withColumns({f"_p_{s}": c for s, c in pct.items()})
    out: dict[str, Column] = {}
    for b, members in buckets.items():
        value = known_mean(*[F.col(f"_p_{s}") for s in members])
        if b == "defensive":
            value = F.when(F.col(position or by) == fv.KEEPER, known_mean(*[F.col(f"_p_{s}") for s in keeper_bucket])).otherwise(value)
        out[f"pre_fotmob_{b}_pct"] = value
    flagged = joined.withColumns(out).withColumns(
        {f"has_pre_{b}_data": F.col(f"pre_fotmob_{b}_pct").isNotNull().cast("int") for b in buckets}
    )
    return flagged.drop("_pg", "_tables", *[f"_p_{s}" for s in stats])


def medians(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Exact medians as a long table: ``stat``, ``by``, ``median``."""
    table = stacked_quantiles(df, {c: F.col(c) for c in columns}, 2, by, skew)
    return table.select("stat", *by, F.get("q", F.lit(1)).alias("median"))


def as_struct(table: DataFrame, names: Sequence[str], value: str, by: Sequence[str] = ()) -> DataFrame:
    """A long ``stat`` table as one struct column ``v`` (per ``by``)."""
    parts = [F.max(F.when(F.col("stat") == n, F.col(value))).alias(n) for n in names]
    return table.groupBy(*by).agg(F.struct(*parts).alias("v")) if by else table.agg(F.struct(*parts).alias("v"))


def impute(df: DataFrame, columns: Sequence[str], fitted: DataFrame) -> DataFrame:
    """Fill nulls with fitted medians (one row with struct ``v``)."""
    filled = df.withColumn("_med", fitted.select("v").scalar())
    return filled.withColumns({c: F.coalesce(F.col(c), F.col(f"_med.{c}")) for c in columns}).drop("_med")


@dataclass(frozen=True)
class FittedFeatures:
    """Statistics that turn raw rows into model features, as tables."""

    heights: DataFrame
    percentiles: DataFrame
    composite_medians: DataFrame


def fit_features(train: DataFrame, skew: Skew = DEFAULT_SKEW) -> FittedFeatures:
    """Fit position heights, percentile tables and composite medians on ``train``.

    The tables are staged: each is small, and every later pass reads them.
    """
    heights = stage(group_means(train, "height_in_cm", "position"), "fitted-heights")
    tables = stage(percentile_tables(train, skew=skew), "fitted-percentiles")
    composed = apply_percentiles(train, tables)
    med = as_struct(medians(composed, fv.COMPOSITES, skew=skew), fv.COMPOSITES, "median")
    return FittedFeatures(heights, tables, stage(med, "fitted-medians"))


def apply_features(df: DataFrame, fitted: FittedFeatures) -> DataFrame:
    """Model features of any rows from statistics fitted elsewhere."""
    centered = center_by(df, "height_in_cm", "position", fitted.heights, "height_vs_position")
    return impute(apply_percentiles(centered, fitted.percentiles), fv.COMPOSITES, fitted.composite_medians)


# ---------------------------------------------------------------- model


@dataclass(frozen=True)
class LinearModel:
    """A linear model as data.

    numeric      feature -> (coefficient, mean, deviation) of the scaled value
    categorical  feature -> level -> coefficient; the pooled level, if fitted,
                 also serves levels never seen
    """

    intercept: float
    numeric: Mapping[str, tuple[float, float, float]]
    categorical: Mapping[str, Mapping[str, float]] = field(default_factory=dict)

    def part(self, feature: str, value: Column | None = None) -> Column:
        """What one feature's value adds to the prediction."""
        value = F.col(feature) if value is None else value
        if feature in self.numeric:
            coef, mean, dev = self.numeric[feature]
            return (value - F.lit(mean)) / F.lit(dev) * F.lit(coef)
        levels = self.categorical[feature]
        known = [(k, c) for k, c in levels.items() if k != POOLED]
        rest = F.lit(float(levels.get(POOLED, 0.0)))
        if not known:
            return rest
        table = F.create_map(*[F.lit(x) for pair in known for x in pair])
        return F.coalesce(F.try_element_at(table, value), rest)

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def predict(self, values: Mapping[str, Column] | None = None) -> Column:
        """Prediction, with some features' values replaced."""
        values = values or {}
        parts = [self.part(f, values.get(f)) for f in self.features]
        return reduce(lambda a, b: a + b, parts, F.lit(float(self.intercept)))

    def coefficients(self, spark) -> DataFrame:
        """The model as a table: ``feature``, ``level``, ``coefficient``, ``mean``, ``deviation``."""
        rows = [("(intercept)", None, float(self.intercept), None, None)]
        rows += [(f, None, float(c), float(m), float(d)) for f, (c, m, d) in self.numeric.items()]
        rows += [(f, lv, float(c), None, None) for f, t in self.categorical.items() for lv, c in t.items()]
        return spark.createDataFrame(
            rows, "feature string, level string, coefficient double, mean double, deviation double"
        )

    @staticmethod
    def from_table(table: DataFrame) -> "LinearModel":
        """Inverse of :meth:`coefficients`; the table has one row per coefficient."""
        intercept, numeric, categorical = 0.0, {}, {}
        for r in table.collect():
            if r.feature == "(intercept)":
                intercept = r.coefficient
            elif r.level is None:
                numeric[r.feature] = (r.coefficient, r.mean, r.deviation)
            else:
                categorical.setdefault(r.feature, {})[r.level] = r.coefficient
        return LinearModel(intercept, numeric, categorical)


def category_levels(df: DataFrame, columns: Sequence[str], min_n: int = fv.MIN_CATEGORY_ROWS) -> dict[str, list[str]]:
    """Levels with at least ``min_n`` rows per column, plus the pooled level where others exist.

    These are the model's own columns: the result has as many entries as the
    model has categorical coefficients.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("string").alias("l")) for c in columns])
    counts = df.select(F.explode(entries).alias("e")).groupBy("e.f", "e.l").agg(F.count(F.lit(1)).alias("n"))
    pooled = counts.withColumn("l", F.coalesce(F.when(F.col("n") >= min_n, F.col("l")), F.lit(POOLED))).select("f", "l").distinct()
    levels: dict[str, list[str]] = {c: [] for c in columns}
    for r in pooled.orderBy("f", "l").collect():
        levels[r.f].append(r.l)
    return levels


def encode(df: DataFrame, columns: Sequence[str], levels: Mapping[str, Sequence[str]], suffix: str = "_level") -> DataFrame:
    """Replace rare and unseen levels by the pooled one, as ``<column>_level``."""
    out = {}
    for c in columns:
        known = [x for x in levels[c] if x != POOLED]
        out[f"{c}{suffix}"] = F.when(F.col(c).isin(known), F.col(c)).otherwise(F.lit(POOLED))
    return df.withColumns(out)


def standard_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column has deviation 1."""
    parts = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("d", F.stddev_pop))]
    row = df.agg(*parts).first()
    return {c: (row[f"m_{c}"], row[f"d_{c}"] or 1.0) for c in columns}


def fit_ridge(
    df: DataFrame, target: str, weight: str | None, numeric: Sequence[str], categorical: Sequence[str] = (),
    alpha: float = fv.RIDGE_ALPHA, min_n: int = fv.MIN_CATEGORY_ROWS,
) -> LinearModel:
    """Weighted ridge with penalty ``alpha`` and a free intercept.

    Numeric features are standardised without weights; categories become one
    column per level with none left out. The normal equations are summed up in
    parallel; only the coefficients come back.
    """
    df = df.withColumn("_w", F.lit(1.0) if weight is None else F.col(weight))
    stats = standard_stats(df, numeric)
    levels = category_levels(df, categorical, min_n) if categorical else {}
    entries = [((F.col(c) - stats[c][0]) / stats[c][1]).cast("double") for c in numeric]
    encoded = encode(df, categorical, levels) if categorical else df
    for c in categorical:
        entries += [(F.col(f"{c}_level") == lv).cast("double") for lv in levels[c]]
    w, y = F.col("_w"), F.col(target)
    moments = df.agg(F.sum(w).alias("w"), F.sum(w * y).alias("y"), F.sum(w * y * y).alias("yy")).first()
    spread = max(moments["yy"] / moments["w"] - (moments["y"] / moments["w"]) ** 2, 0.0) ** 0.5
    # Spark divides the squared error by the sum of weights and scales the
    # label, so the penalty is stated relative to both.
    estimator = LinearRegression(
        featuresCol="_x", labelCol=target, weightCol="_w", solver="normal", elasticNetParam=0.0,
        standardization=False, fitIntercept=True, regParam=alpha * spread / moments["w"],
    )
    design = encoded.select(array_to_vector(F.array(*entries)).alias("_x"), F.col(target).cast("double").alias(target), "_w")
    fitted = estimator.fit(design)
    values = list(fitted.coefficients)
    num = {c: (float(values[i]), *stats[c]) for i, c in enumerate(numeric)}
    at, cat = len(numeric), {}
    for c in categorical:
        cat[c] = {lv: float(values[at + i]) for i, lv in enumerate(levels[c])}
        at += len(levels[c])
    return LinearModel(float(fitted.intercept), num, cat)


def evaluate(df: DataFrame, actual: str, predicted: str, typical: float | Column | None = None) -> DataFrame:
    """MAE, R², and the MAE of always predicting ``typical`` (the mean by default)."""
    y, p = F.col(actual), F.col(predicted)
    if typical is None:
        typical = df.agg(F.avg(actual).alias("m")).scalar()
    typical = typical if isinstance(typical, Column) else F.lit(typical)
    res = F.sum((y - p) * (y - p))
    total = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)
    return df.withColumn("_t", typical).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(y - p)).alias("mae"),
        (1 - res / total).alias("r2"),
        F.avg(F.abs(y - F.col("_t"))).alias("baseline_mae"),
    )


def fold_of(key: Sequence[str], k: int = fv.FOLDS) -> Column:
    """Fold of a row, a hash of its natural key: stable under any partitioning."""
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % k).cast("int")


def train(df: DataFrame, reference: dt.date | None = None, skew: Skew = DEFAULT_SKEW) -> tuple[FittedFeatures, LinearModel]:
    """Fit features and model on the given rows."""
    fitted = fit_features(df, skew)
    ready = recency_weight(apply_features(df, fitted), "transfer_date", reference=reference)
    # scaling, category counts and the normal equations each pass over the rows
    needed = ["success_score", "recency_weight", *fv.NUMERIC_FEATURES, *fv.CATEGORICAL_FEATURES]
    ready = stage(ready.select(*needed), "fit-rows")
    model = fit_ridge(ready, "success_score", "recency_weight", fv.NUMERIC_FEATURES, fv.CATEGORICAL_FEATURES)
    return fitted, model


def holdout_and_refit(df: DataFrame, cut: str = fv.SPLIT_DATE, skew: Skew = DEFAULT_SKEW):
    """(holdout metrics, fitted features, model): judged on newer rows, then fitted on all."""
    past, future = temporal_split(df, cut=cut)
    fitted, model = train(past, skew=skew)
    scored = apply_features(future, fitted).withColumn("predicted_score", model.predict())
    metrics = evaluate(scored, "success_score", "predicted_score", past.agg(F.avg("success_score").alias("m")).scalar())
    return (metrics, *train(df, skew=skew))


def surprise(df: DataFrame, actual: str = "success_score", predicted: str = "predicted_score") -> DataFrame:
    """Signed and absolute difference between outcome and prediction."""
    delta = F.bround(F.col(actual) - F.col(predicted), 1)
    return df.withColumns({"surprise_delta": delta, "abs_surprise_delta": F.abs(delta)})


def feature_importance(model: LinearModel, spark, labels: Mapping[str, str] = fv.FEATURE_LABELS) -> DataFrame:
    """Numeric coefficients by size, without data flags: ``feature``, ``label``, ``coefficient``."""
    shown = [(f, labels.get(f, f), round(c, 3)) for f, (c, _, _) in model.numeric.items() if f not in fv.COMPOSITE_FLAGS]
    shown.sort(key=lambda r: (-abs(r[2]), r[0]))
    return spark.createDataFrame(shown, "feature string, label string, coefficient double")
