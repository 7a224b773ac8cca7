"""Training and prediction jobs around stored tables."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movelens import fixed_values as fv
from movelens.operators import model as md
from movelens.operators import predict as pr
from movelens.operators.folds import oof_predict
from movelens.operators.scan import DEFAULT_SKEW, Skew
from movelens.sources.sinks import load_fitted, save_fitted
from movelens.sources.staging import stage

NEIGHBOUR_FEATURES = fv.NUMERIC_FEATURES


@dataclass(frozen=True)
class Trained:
    """Everything prediction needs, as tables, plus the coefficients."""

    model: md.LinearModel
    features: md.FittedFeatures
    references: pr.References
    comparables: DataFrame
    metrics: DataFrame


def train_job(scored: DataFrame, path: str, folds: int = fv.FOLDS, skew: Skew = DEFAULT_SKEW) -> None:
    """Fit on scored moves and store model, statistics, comparables and surprises under ``path``."""
    spark = scored.sparkSession
    rows = stage(md.trainable(md.derive(scored)), "train-rows")
    if skew.rows_at_most is None:
        skew = skew.bounded(rows.count())
    metrics, fitted, model = md.holdout_and_refit(rows, skew=skew)
    ready = stage(md.apply_features(rows, fitted), "train-features")
    refs = pr.fit_references(ready, skew)
    comparables = ready.select(
        F.xxhash64("player_id", "transfer_date").alias("move_id"), "player_id", "name", "transfer_date", "from_club_name",
        "to_club_name", "success_score", *NEIGHBOUR_FEATURES,
    )
    tables = {f"features_{f.name}": getattr(fitted, f.name) for f in dataclasses.fields(fitted)}
    tables |= {f"references_{f.name}": getattr(refs, f.name) for f in dataclasses.fields(refs)}
    tables |= {
        "coefficients": model.coefficients(spark), "comparables": comparables, "metrics": metrics,
        "surprises": oof_predict(rows, k=folds, skew=skew),
    }
    save_fitted(tables, path)


def load_trained(spark: SparkSession, path: str) -> Trained:
    """What :func:`train_job` stored."""
    def group(cls, prefix: str):
        names = [f.name for f in dataclasses.fields(cls)]
        tables = load_fitted(spark, path, [f"{prefix}_{n}" for n in names])
        return cls(*[tables[f"{prefix}_{n}"] for n in names])

    rest = load_fitted(spark, path, ["coefficients", "comparables", "metrics"])
    return Trained(
        md.LinearModel.from_table(rest["coefficients"]), group(md.FittedFeatures, "features"),
        group(pr.References, "references"), rest["comparables"], rest["metrics"],
    )


@dataclass(frozen=True)
class Predictions:
    """Result of :func:`predict_job`; all tables carry ``scenario_id``."""

    scores: DataFrame
    factors: DataFrame
    sensitivity: DataFrame
    rejected: DataFrame


def predict_job(scenarios: DataFrame, trained: Trained, top: int = 5) -> Predictions:
    """Score a batch of scenarios (``scenario_id`` is an integer key).

    The range comes from the nearest past moves. Explanations stay on the point
    prediction also where the headline is averaged over profiles.
    """
    valid, rejected = pr.split_valid(scenarios)
    df = pr.scenario_features(valid, trained.features, trained.references)
    df = stage(pr.predict(df, trained.model, trained.references), "scored-scenarios")
    stats = {f: (m, d) for f, (_, m, d) in trained.model.numeric.items()}
    ranges = pr.neighbour_range(
        df, trained.comparables, stats, query_key="scenario_id", reference_key="move_id", score="success_score"
    )
    explained = pr.explain(
        pr.resolve_references(df, trained.features, trained.references, trained.model), trained.model,
        pr.default_swaps(trained.model), ["scenario_id"], top=top,
    )
    gains = pr.sensitivity(df, trained.model, ["scenario_id"], pr.real_data())
    scores = df.select("scenario_id", "predicted_score", "point_score", "has_recent").join(ranges, "scenario_id", "left")
    return Predictions(scores, explained, gains, rejected)
