"""Training against closed forms; explanation and prediction identities."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from movelens import fixed_values as fv
from movelens.operators import model as md
from movelens.operators import predict as pr
from movelens.operators.careers import shape_vectors, similar_entities
from movelens.operators.folds import fit_folds, oof_predict, predicted
from movelens.operators.knn import nearest
from movelens.sources.staging import stage


def make_rows(n=400, seed=2):
    rng = np.random.default_rng(seed)
    pos = rng.choice(["Attack", "Midfield", "Defender", "Goalkeeper"], n, p=[0.35, 0.3, 0.2, 0.15])
    d = pd.DataFrame({
        "player_id": range(n), "transfer_date": [dt.date(2015, 1, 1) + dt.timedelta(days=int(x)) for x in rng.integers(0, 3400, n)],
        "position": pos, "sub_position": [f"{p}-{i}" for p, i in zip(pos, rng.integers(0, 2, n))],
        "foot": rng.choice(["left", "right", None], n, p=[0.3, 0.6, 0.1]),
        "from_domestic_competition_id": rng.choice(["GB1", "ES1", "XX", None], n, p=[0.45, 0.4, 0.05, 0.1]),
        "to_domestic_competition_id": rng.choice(["GB1", "ES1", "L1"], n),
        "height_in_cm": rng.integers(165, 200, n).astype(float), "age_at_transfer": rng.uniform(17, 35, n),
        "pre_apps": rng.integers(10, 50, n).astype(float), "pre_minutes": rng.integers(500, 4000, n).astype(float),
        "pre_goals_p90": rng.uniform(0, 1, n), "pre_ga_p90": rng.uniform(0, 1.5, n), "pre_mins_per_app": rng.uniform(20, 90, n),
        "transfer_fee": np.where(rng.random(n) < 0.4, 0.0, rng.integers(1, 500, n) * 1e5), "value_before": rng.integers(1, 600, n) * 1e5,
        "from_total_market_value": rng.integers(10, 900, n) * 1e6, "to_total_market_value": rng.integers(10, 900, n) * 1e6,
        "rating_pct": rng.uniform(0, 100, n),
    })
    d["fee_to_value_ratio"] = d.transfer_fee / d.value_before
    d["club_quality_ratio"] = d.to_total_market_value / d.from_total_market_value
    for s in fv.PRE_STATS:
        v = rng.uniform(0, 8, n).round(2)
        keep = (d.position == "Goalkeeper") if s in fv.PRE_KEEPER_BUCKET else (rng.random(n) < 0.7)
        d[s] = np.where(keep, v, np.nan)
    d["success_score"] = (40 + 8 * d.pre_ga_p90 + 0.3 * (d.age_at_transfer - 25) + rng.normal(0, 5, n)).clip(0, 100).round(1)
    return d


@pytest.fixture(scope="module")
def frame():
    return make_rows()


@pytest.fixture(scope="module")
def rows(spark, frame):
    recs = [{k: (None if v is None or (not isinstance(v, (str, dt.date)) and pd.isna(v)) else (v.item() if hasattr(v, "item") else v)) for k, v in r.items()} for r in frame.to_dict("records")]
    kinds = {c: "string" for c in ("position", "sub_position", "foot", "from_domestic_competition_id", "to_domestic_competition_id")}
    kinds |= {"player_id": "long", "transfer_date": "date"}
    schema = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in frame.columns)
    return stage(md.derive(spark.createDataFrame([tuple(r[c] for c in frame.columns) for r in recs], schema)), "test-rows")


@pytest.fixture(scope="module")
def fitted(rows):
    return md.train(md.trainable(rows))


def design(d, train):
    """Plain design matrix of the same features, fitted on ``train``."""
    def features(x):
        x = x.copy()
        x["log_transfer_fee"] = np.log1p(x.transfer_fee)
        for a, b in (("log_value_before", "value_before"), ("log_from_club_value", "from_total_market_value"), ("log_to_club_value", "to_total_market_value")):
            x[a] = np.log1p(x[b])
        for c in ("foot", "from_domestic_competition_id", "to_domestic_competition_id"):
            x[c] = x[c].where(x[c].notna(), "unknown")
        mean = train.groupby("position").height_in_cm.mean()
        x["height_vs_position"] = x.height_in_cm - x.position.map(mean)
        pct = {}
        for s in fv.PRE_STATS:
            sign = -1 if s in fv.PRE_INVERTED else 1
            col = pd.Series(np.nan, index=x.index)
            for p, g in train.groupby("position"):
                v = (sign * g[s]).dropna()
                if len(v) >= 20:
                    m = (x.position == p) & x[s].notna()
                    col[m] = np.interp(sign * x[s][m], v.quantile([i / 100 for i in range(101)]), range(101))
            pct[s] = col
        for b, members in fv.PRE_BUCKETS.items():
            x[f"pre_fotmob_{b}_pct"] = pd.concat([pct[s] for s in members], axis=1).mean(axis=1)
        gk = x.position == "Goalkeeper"
        x.loc[gk, "pre_fotmob_defensive_pct"] = pd.concat([pct[s] for s in fv.PRE_KEEPER_BUCKET], axis=1).mean(axis=1)[gk]
        for b in fv.PRE_BUCKETS:
            x[f"has_pre_{b}_data"] = x[f"pre_fotmob_{b}_pct"].notna().astype(int)
        return x
    base = features(train)
    out = features(d)
    for c in fv.COMPOSITES:
        out[c] = out[c].fillna(base[c].median())
        base[c] = base[c].fillna(base[c].median())
    cols = []
    for f in fv.NUMERIC_FEATURES:
        sd = base[f].std(ddof=0) or 1.0
        cols.append((out[f] - base[f].mean()) / sd)
    for f in fv.CATEGORICAL_FEATURES:
        n = base[f].value_counts()
        big = sorted(n[n >= 30].index)
        pooled = (n < 30).any()
        for lv in big:
            cols.append((out[f] == lv).astype(float))
        if pooled:
            cols.append((~out[f].isin(big)).astype(float))
    return np.column_stack(cols), out


def closed_form(x, y, w, alpha=1.0):
    mx, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    xc, yc = x - mx, y - my
    beta = np.linalg.solve((xc * w[:, None]).T @ xc + alpha * np.eye(x.shape[1]), (xc * w[:, None]).T @ yc)
    return beta, my - mx @ beta


def weights_of(d, newest):
    return np.array([0.5 ** ((newest - t).days / 365.25 / 3.0) for t in d.transfer_date])


def test_ridge_and_features_match_closed_form(rows, fitted, frame):
    stats, model = fitted
    x, _ = design(frame, frame)
    beta, icpt = closed_form(x, frame.success_score.to_numpy(), weights_of(frame, frame.transfer_date.max()))
    got = [c for c, _, _ in model.numeric.values()] + [c for t in model.categorical.values() for c in t.values()]
    # levels are sorted with the pooled one first or last; compare through predictions and the numeric part
    assert np.allclose(got[: len(fv.NUMERIC_FEATURES)], beta[: len(fv.NUMERIC_FEATURES)], atol=1e-5)
    scored = md.apply_features(rows, stats).withColumn("p", model.predict()).select("player_id", "p").toPandas().set_index("player_id").p.sort_index()
    assert np.allclose(scored, x @ beta + icpt, atol=1e-5)
    assert md.POOLED in model.categorical["from_domestic_competition_id"] and md.POOLED not in model.categorical["position"]


def test_out_of_fold_never_sees_itself(rows, frame):
    got = oof_predict(rows, k=3).toPandas().set_index("player_id").sort_index()
    assert len(got) == len(frame)
    folds = rows.select("player_id", md.fold_of(["player_id", "transfer_date"], 3).alias("f")).toPandas().set_index("player_id").f.sort_index()
    assert set(folds) == set(range(3))
    f0 = folds == 0
    train, test = frame[~f0.values], frame[f0.values]
    xt, _ = design(train, train)
    xs, _ = design(test, train)
    beta, icpt = closed_form(xt, train.success_score.to_numpy(), weights_of(train, frame.transfer_date.max()))
    assert np.abs(got.predicted_score[f0.values] - (xs @ beta + icpt).clip(0, 100)).max() <= 0.0501
    assert np.allclose(got.surprise_delta, (frame.success_score.values - got.predicted_score).round(1))


def test_every_fold_from_one_pass_equals_its_own_fit(spark):
    """Levels that are rare in some training sets only, a constant column and a fold without rows of a level."""
    rng = np.random.default_rng(7)
    levels = ["a"] * 200 + ["b"] * 60 + ["c"] * 12 + ["d"] * 9
    data = [(i, 0 if lv == "c" and i % 3 else i % 4, float(rng.normal(2000, 3)), 5.0, float(rng.uniform(0, 1)), lv, None if i % 17 == 0 else "x" if i % 2 else "y", float(rng.normal(50, 9)), float(rng.uniform(0.1, 1)))
            for i, lv in enumerate(rng.permutation(levels).tolist())]
    df = spark.createDataFrame(data, "id long, fold int, year double, flat double, share double, lv string, side string, y double, w double").repartition(3)
    numeric, categorical = ["year", "flat", "share"], ["lv", "side"]
    models = fit_folds(df, "y", "w", numeric, categorical, fold="fold", min_n=10)
    assert set(models) == {0, 1, 2, 3}
    got = {r.id: r.p for r in df.withColumn("p", predicted(models, "fold")).collect()}
    for f in range(4):
        own = md.fit_ridge(df.filter(F.col("fold") != f), "y", "w", numeric, categorical, min_n=10)
        for r in df.filter(F.col("fold") == f).withColumn("p", own.predict()).collect():
            assert abs(got[r.id] - r.p) < 1e-5
        assert {c: set(t) for c, t in models[f].categorical.items()} == {c: set(t) for c, t in own.categorical.items()}
    assert not any("d" in m.categorical["lv"] for m in models.values())
    assert "c" not in models[0].categorical["lv"] and any("c" in m.categorical["lv"] for m in models.values())


def test_out_of_fold_jobs_do_not_grow_with_the_folds(spark, rows):
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for k in (2, 5):
        spark.sparkContext.setJobGroup(f"oof-{k}", "")
        assert oof_predict(rows, k=k).count() == rows.count()
        jobs.append(len(tracker.getJobIdsForGroup(f"oof-{k}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(jobs[0] - jobs[1]) <= 6


def test_holdout(rows):
    metrics, _, model = md.holdout_and_refit(rows, "2021-01-01")
    m = metrics.first()
    assert 0 < m.mae < m.baseline_mae + 3 and m.r2 <= 1
    back = md.LinearModel.from_table(model.coefficients(rows.sparkSession))
    assert back == model


@pytest.fixture(scope="module")
def prediction(rows, fitted):
    stats, model = fitted
    ready = stage(md.apply_features(rows, stats), "ready")
    refs = pr.fit_references(ready)
    scen = rows.limit(60)
    gone = F.col("player_id") % 4 == 0
    scen = scen.withColumns({c: F.when(~gone, F.col(c)) for c in fv.RECENT_FEATURES})
    valid, bad = pr.split_valid(scen.withColumn("foot", F.coalesce("foot", F.lit("unknown"))))
    assert bad.count() == 0
    feat = stage(pr.predict(pr.scenario_features(valid, stats, refs), model, refs), "scenarios")
    return stats, model, refs, ready, feat


def test_explanations_reconcile(prediction):
    stats, model, refs, _, feat = prediction
    ref = pr.resolve_references(feat, stats, refs, model)
    swaps = pr.default_swaps(model)
    assert len(swaps) == 20
    e = pr.explain(ref, model, swaps, ["player_id"], top=5).toPandas()
    point = feat.select("player_id", "point_score", "has_recent", "position", "sub_position").toPandas().set_index("player_id")
    for pid, g in e.groupby("player_id"):
        total = g.baseline_score.iloc[0] + g[g.shown].contribution.sum() + g.other_total.iloc[0]
        assert total == pytest.approx(point.point_score[pid], abs=0.11)
        if not point.has_recent[pid]:
            # imputed values are compared with themselves
            assert g.set_index("factor").contribution[["pre_playing_time", "pre_goals_p90", "pre_ga_p90"]].abs().max() == 0
    # a full re-prediction with the swapped values gives the same numbers
    again = ref.withColumn("p", model.predict({f: F.col(r) for f, r in swaps["pre_playing_time"].items()}))
    again = again.select("player_id", F.bround(F.col("point_score") - F.col("p"), 1).alias("c")).toPandas().set_index("player_id").c
    assert np.allclose(e[e.factor == "pre_playing_time"].set_index("player_id").contribution, again.loc[e[e.factor == "pre_playing_time"].player_id], atol=0.1001)


def test_marginal_prediction_is_the_mean_over_profiles(prediction):
    stats, model, refs, ready, feat = prediction
    row = feat.filter("not has_recent").first()
    profiles = ready.filter(F.col("position") == row.position).select(*fv.RECENT_FEATURES).toPandas()
    shift = 0.0
    for f in fv.RECENT_FEATURES:
        c, m, d = model.numeric[f]
        shift += ((profiles[f] - m) / d * c).mean() - (row[f] - m) / d * c
    assert row.raw_score == pytest.approx(row.point_score + shift)
    kept = feat.filter("has_recent").first()
    assert kept.raw_score == kept.point_score


def test_sensitivity_only_gains(prediction):
    _, model, _, _, feat = prediction
    s = pr.sensitivity(feat, model, ["player_id"], pr.real_data()).toPandas()
    assert (s.gain > 0).all() and s["rank"].max() <= 3
    gone = set(feat.filter("not has_recent").toPandas().player_id)
    assert not set(s[s.feature.isin(["pre_goals_p90", "pre_ga_p90"])].player_id) & gone
    assert (s[s.feature.isin(fv.COMPOSITES)].target <= 95).all()


def test_compare_and_context(prediction):
    stats, model, refs, _, feat = prediction
    ref = pr.resolve_references(feat, stats, refs, model).withColumn("grp", F.col("player_id") % 7)
    explained, spread, verdict = pr.compare(ref, model, pr.default_swaps(model), ["grp"], "player_id")
    e = explained.toPandas()
    want = e.groupby(["grp", "factor"]).contribution.agg(lambda c: round(c.max() - c.min(), 1))
    got = spread.toPandas().set_index(["grp", "factor"]).spread
    assert np.allclose(got.sort_index(), want.sort_index())
    v = verdict.toPandas()
    assert (v.gap >= 0).all() and ((v.gap < 3) == v.toss_up).all()
    assert pr.context_gaps(ref, refs, ["player_id"]).filter("abs(actual - reference) < 4 and kind like '%club%'").count() == 0


def test_neighbours_equal_brute_force(spark, prediction):
    _, _, _, ready, feat = prediction
    cols = ["age_at_transfer", "pre_apps"]
    q = feat.filter("has_recent").select("player_id", *cols)
    for cell_rows in (2000, 40):
        got = nearest(q, ready, cols, query_key="player_id", reference_key="player_id", k=5, cell_rows=cell_rows).toPandas()
        a, b = q.toPandas().set_index("player_id"), ready.select("player_id", *cols).toPandas().set_index("player_id")
        for pid, g in got.groupby("player_id"):
            d = np.sqrt(((b - a.loc[pid]) ** 2).sum(axis=1)).reset_index(name="d").sort_values(["d", "player_id"]).head(5)
            assert g.sort_values("rank").neighbour.tolist() == d.player_id.tolist()


def test_similar_careers_skip_self_and_single_stops(spark):
    stops = [(i, dt.date(2015 + j, 1, 1), float((i * 7 + j * 13) % 100)) for i in range(30) for j in range(i % 4 + 1)]
    s = shape_vectors(spark.createDataFrame(stops, "p long, d date, score double"), "p", "d", "score")
    got = similar_entities(s, "p", k=5).toPandas()
    assert (got.p != got.neighbour).all()
    assert set(got.p) == {i for i in range(30) if i % 4 >= 1}
    assert (got.groupby("p").size() == 5).all()


def test_stored_training_job(spark, rows, tmp_path):
    from movelens.plans.training import load_trained, predict_job, train_job

    named = rows.withColumns({"name": F.lit("n"), "from_club_name": F.lit("a"), "to_club_name": F.lit("b")})
    train_job(named, str(tmp_path / "m"), folds=2)
    trained = load_trained(spark, str(tmp_path / "m"))
    scen = rows.limit(12).withColumns({"scenario_id": F.col("player_id"), "foot": F.coalesce("foot", F.lit("unknown"))})
    scen = scen.withColumn("age_at_transfer", F.when(F.col("player_id") % 5 == 0, 60.0).otherwise(F.col("age_at_transfer")))
    out = predict_job(scen, trained)
    scores = out.scores.toPandas()
    bad = scen.filter("player_id % 5 = 0").count()
    assert len(scores) == 12 - bad and out.rejected.count() == bad
    assert scores.predicted_score.between(0, 100).all() and (scores.range_low <= scores.range_high).all()
    assert out.factors.count() == 20 * len(scores)


def test_validation_reasons(prediction):
    _, _, _, _, feat = prediction
    bad = feat.limit(4).withColumns({"age_at_transfer": F.lit(50.0), "pre_apps": F.lit(None).cast("double"), "pre_minutes": F.lit(1.0), "foot": F.lit(None).cast("string")})
    reasons = pr.validate_scenarios(bad).first().reasons
    assert len(reasons) == 3
