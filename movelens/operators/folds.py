"""Ridge models for all folds from one pass over the rows.

The normal equations are sums over rows, so each fold's training set is the
total less the fold. One grouped aggregation gives, per fold, the weighted
products of all columns with each other and the plain sums that scaling and
pooling need; every fold is then solved on the driver from matrices whose size
is that of the model. The levels of a category are disjoint columns, so pooling
the rare ones of a training set adds up their entries.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movelens import fixed_values as fv
from movelens.functions.numeric import clip
from movelens.operators.model import (
    POOLED, LinearModel, apply_percentiles, as_struct, category_levels, fold_of, medians, percentile_tables, recency_weight, standard_stats, surprise,
)
from movelens.operators.scan import DEFAULT_SKEW, Skew
from movelens.operators.small_side import settled, small_join
from movelens.sources.staging import stage

#: A deviation below this share of the whole's is that of a constant.
CONSTANT = 1e-9


@dataclass
class Moments:
    """Sums over rows of the columns 1, numeric, levels, target: weighted products, plain sums and plain sums of squares."""

    products: np.ndarray
    sums: np.ndarray
    squares: np.ndarray

    def __add__(self, other: "Moments") -> "Moments":
        return Moments(self.products + other.products, self.sums + other.sums, self.squares + other.squares)

    def __sub__(self, other: "Moments") -> "Moments":
        return Moments(self.products - other.products, self.sums - other.sums, self.squares - other.squares)


@dataclass
class Design:
    """Columns of the moments: numeric ones in units of the whole table, and the levels of each category with the rest pooled."""

    numeric: Sequence[str]
    stats: Mapping[str, tuple[float, float]]
    levels: Mapping[str, Sequence[str]]

    @property
    def size(self) -> int:
        return 2 + len(self.numeric) + sum(map(len, self.levels.values()))


def moments(df: DataFrame, target: str, weight: Column, design: Design, by: str) -> dict[int, Moments]:
    """Moments of each group ``by``; rows with a null or NaN among the numbers take no part."""
    q, p = design.size, len(design.numeric)
    numbers = {"_y": F.col(target).cast("double"), "_w": weight.cast("double")} | {f"_x{i}": F.col(c).cast("double") for i, c in enumerate(design.numeric)}
    rows = df.select(F.col(by).cast("int").alias("_f"), *[c.alias(n) for n, c in numbers.items()], *[F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(design.levels)])
    for n in numbers:
        rows = rows.filter(F.col(n).isNotNull() & ~F.isnan(n))
    scale = np.array([design.stats[c] for c in design.numeric], float).reshape(-1, 2)
    levels = [list(v) for v in design.levels.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.zeros((b.num_rows, q))
            x[:, 0], x[:, -1] = 1.0, b.column(1).to_numpy()
            for i in range(p):
                x[:, 1 + i] = (b.column(3 + i).to_numpy() - scale[i, 0]) / scale[i, 1]
            at = 1 + p
            for i, known in enumerate(levels):
                place = pc.index_in(b.column(3 + p + i), value_set=pa.array(known, pa.string()))
                rest = known.index(POOLED) if POOLED in known else -1
                place = pc.fill_null(place, rest).to_numpy()
                hit = np.flatnonzero(place >= 0)
                x[hit, at + place[hit]] = 1.0
                at += len(known)
            fold, w = b.column(0).to_numpy(), b.column(2).to_numpy()
            for f in np.unique(fold):
                mine = x[fold == f]
                part = [(mine * w[fold == f][:, None]).T @ mine, mine.sum(axis=0), (mine * mine).sum(axis=0)]
                total[int(f)] = [a + b for a, b in zip(total[int(f)], part)] if int(f) in total else part
        for f, (m, s, ss) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([np.concatenate([m.ravel(), s, ss])], pa.list_(pa.float64()))], names=["f", "v"])

    parts = rows.mapInArrow(run, "f int, v array<double>").select("f", F.posexplode("v").alias("i", "v"))
    out: dict[int, np.ndarray] = {}
    # folds times the square of the model's columns
    for r in parts.groupBy("f", "i").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r.f, np.zeros(q * q + 2 * q))[r.i] = r.v
    return {f: Moments(v[:q * q].reshape(q, q), v[q * q:q * q + q], v[q * q + q:]) for f, v in sorted(out.items())}


def solve(train: Moments, design: Design, alpha: float, min_n: int) -> LinearModel:
    """The ridge of one training set: numeric columns scaled by its own mean and deviation, levels under ``min_n`` rows pooled."""
    q, p = design.size, len(design.numeric)
    n = train.sums[0]
    mean = train.sums[1:1 + p] / n
    dev = np.sqrt(np.maximum(train.squares[1:1 + p] / n - mean * mean, 0.0))
    dev[dev < CONSTANT] = 1.0
    turn = [np.eye(q)[0]]
    for i in range(p):
        column = np.zeros(q)
        column[1 + i], column[0] = 1 / dev[i], -mean[i] / dev[i]
        turn.append(column)
    names: list[tuple[str, str]] = []
    at = 1 + p
    for c, known in design.levels.items():
        count = train.sums[at:at + len(known)]
        kept = {lv: count[j] >= min_n and lv != POOLED for j, lv in enumerate(known)}
        groups = [(lv, [j]) for j, lv in enumerate(known) if kept[lv]]
        rest = [j for j, lv in enumerate(known) if not kept[lv]]
        if count[rest].sum() > 0.5:
            groups.append((POOLED, rest))
        for lv, js in sorted(groups):
            column = np.zeros(q)
            column[[at + j for j in js]] = 1.0
            turn.append(column)
            names.append((c, lv))
        at += len(known)
    turn.append(np.eye(q)[-1])
    t = np.array(turn)
    m = t @ train.products @ t.T
    centre = m[0] / m[0, 0]
    cov = m - m[0, 0] * np.outer(centre, centre)
    inner = slice(1, len(turn) - 1)
    beta = np.linalg.solve(cov[inner, inner] + alpha * np.eye(len(turn) - 2), cov[inner, -1])
    intercept = float(centre[-1] - centre[inner] @ beta)
    numeric = {}
    for i, c in enumerate(design.numeric):
        m0, d0 = design.stats[c]
        numeric[c] = (float(beta[i]), float(m0 + d0 * mean[i]), float(d0 * dev[i]))
    categorical: dict[str, dict[str, float]] = {c: {} for c in design.levels}
    for (c, lv), b in zip(names, beta[p:]):
        categorical[c][lv] = float(b)
    return LinearModel(intercept, numeric, categorical)


def fit_folds(
    df: DataFrame, target: str, weight: str | None, numeric: Sequence[str], categorical: Sequence[str] = (), *, fold: str,
    others: bool = True, alpha: float = fv.RIDGE_ALPHA, min_n: int = fv.MIN_CATEGORY_ROWS,
) -> dict[int, LinearModel]:
    """One weighted ridge per value of ``fold``: on the rows of all other folds, or (``others=False``) on its own rows.

    Same model as :func:`movelens.operators.model.fit_ridge` on each training set.
    """
    stats = {c: (m or 0.0, d) for c, (m, d) in standard_stats(df, numeric).items()} if numeric else {}
    # with training sets that overlap, a level may be frequent in the union only; it is pooled where it is rare
    levels = {c: sorted({*v, POOLED}) for c, v in category_levels(df, categorical, min_n).items()} if categorical else {}
    design = Design(list(numeric), stats, levels)
    found = moments(df, target, F.lit(1.0) if weight is None else F.col(weight), design, fold)
    if not others:
        return {f: solve(m, design, alpha, min_n) for f, m in found.items()}
    if len(found) < 2:
        return {}
    whole = sum(list(found.values())[1:], next(iter(found.values())))
    return {f: solve(whole - m, design, alpha, min_n) for f, m in found.items()}


def predicted(models: Mapping[int, LinearModel], fold: str) -> Column:
    """Each row's prediction by its fold's model, in one expression; null for a fold without one."""
    out = F.lit(None).cast("double")
    for f, model in models.items():
        out = F.when(F.col(fold) == f, model.predict()).otherwise(out)
    return out


def _set_features(every: DataFrame, learn: Column, skew: Skew) -> DataFrame:
    """Model features of every row under each training set ``_train``, all statistics fitted on that set's rows (``learn``)."""
    cell = F.when(F.col("position").isNotNull(), F.concat_ws("|", F.col("_train").cast("string"), "position"))
    every = every.withColumn("_cell", cell)
    rows = every.filter(learn)
    sums = settled(rows.groupBy("_train", "_cell").agg(F.sum("height_in_cm").alias("s"), F.count("height_in_cm").alias("n")))
    own = sums.filter("_cell IS NOT NULL").select(F.col("_cell").alias("_hc"), (F.col("s") / F.col("n")).alias("_hm"))
    whole = sums.groupBy(F.col("_train").alias("_ht")).agg((F.sum("s") / F.sum("n")).alias("_hw"))
    every = small_join(small_join(every, own, [("_cell", "_hc")]), whole, [("_train", "_ht")])
    every = every.withColumn("height_vs_position", F.col("height_in_cm") - F.coalesce("_hm", "_hw")).drop("_hc", "_hm", "_ht", "_hw")
    tables = settled(percentile_tables(rows, by="_cell", skew=skew))
    composed = apply_percentiles(every, tables, by="_cell", position="position")
    typical = as_struct(medians(composed.filter(learn), fv.COMPOSITES, ["_train"], skew), fv.COMPOSITES, "median", ["_train"])
    typical = typical.select(F.col("_train").alias("_mt"), F.col("v").alias("_med"))
    filled = small_join(composed, typical, [("_train", "_mt")])
    return filled.withColumns({c: F.coalesce(F.col(c), F.col(f"_med.{c}")) for c in fv.COMPOSITES}).drop("_mt", "_med", "_cell")


def oof_predict(df: DataFrame, key: Sequence[str] = ("player_id", "transfer_date"), k: int = fv.FOLDS, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Predictions for every row by a model that never saw it, and the surprise.

    All statistics are refitted for each of the ``k`` training sets, in the same
    jobs whatever ``k`` is: a row goes through once for every set, learned from
    in all but one, where it is judged. Recency counts from one date for all.
    """
    folded = recency_weight(df, "transfer_date").withColumn("_fold", fold_of(key, k))
    every = folded.withColumn("_train", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    needed = ["success_score", "recency_weight", *fv.NUMERIC_FEATURES, *fv.CATEGORICAL_FEATURES]
    learn = F.col("_fold") != F.col("_train")
    ready = _set_features(every, learn, skew.times(k))
    ready = stage(ready.select(*dict.fromkeys([*key, "_fold", "_train", *needed])), "fold-rows")
    models = fit_folds(ready.filter(learn), "success_score", "recency_weight", fv.NUMERIC_FEATURES, fv.CATEGORICAL_FEATURES, fold="_train", others=False)
    held = ready.filter(F.col("_fold") == F.col("_train"))
    score = F.bround(clip(predicted(models, "_train"), 0.0, 100.0), 1)
    return surprise(held.select(*key, "success_score", score.alias("predicted_score")))
