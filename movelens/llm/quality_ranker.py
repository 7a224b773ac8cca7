"""Quality scores by Bradley-Terry ranking.

A document's utility is a weighted sum of features of its text. Every labelled
document is paired with documents of the other label, and the weights minimise
the logistic loss of the pairs' feature differences (Newton steps, small ridge);
tasks add up the moments, gradients and curvature of their rows. The threshold
is the quantile of all labelled utilities at the share of rejected labels; the score is the logistic function of the distance from it, placed so
that the threshold scores 0.3.

Features: how often one class of characters follows another, and shape of words
and lines; no language, source, id or label goes in.

Defined results: a null text is an empty one and is scored; a document with
several labels counts as good if at least half of them are; labels of unknown
documents are ignored; without labels of both kinds every score is 0.5; equal
texts score alike.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movelens.llm.text_ids import small_batches, whole_text
from movelens.sources.staging import stage, unstage

#: Pairs of :func:`fit_pairs`; labelled documents that are paired with each other, about; cells of a count of utilities.
PAIRS, BUCKET_ROWS, CELLS = 40_000, 2_048, 4_096
#: Rows of the rarer label that a bucket has at least, about.
RARE_ROWS = 32
CUT = 0.3

CLASSES = 13
_CLASS = np.full(256, 11, np.uint8)  # control and all else
for _i, _chars in enumerate((
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t", ".,;:", "!?", "'\"-_", "|/\\", "#$%&*@^~+=<>",
    "()[]{}`",
)):
    for _c in _chars:
        _CLASS[ord(_c)] = _i
_CLASS[128:] = 12
WIDTH = CLASSES * CLASSES + CLASSES + 14


def features(text: str | None) -> np.ndarray:
    """Fixed-width description of a whole text."""
    out = np.zeros(WIDTH)
    text = text or ""
    data = text.encode("utf-8", "replace")
    if data:
        kinds = _CLASS[np.frombuffer(data, np.uint8)]
        pairs = np.bincount(kinds[:-1].astype(np.int32) * CLASSES + kinds[1:], minlength=CLASSES * CLASSES)
        out[:CLASSES * CLASSES] = np.sqrt(pairs / len(data))
        out[CLASSES * CLASSES:CLASSES * CLASSES + CLASSES] = np.bincount(kinds, minlength=CLASSES) / len(data)
    words, lines = text.split(), text.split("\n")
    n, m = len(words), len(lines)
    shape = out[CLASSES * CLASSES + CLASSES:]
    shape[0], shape[1], shape[2] = np.log1p(len(data)), np.log1p(n), np.log1p(m)
    shape[3] = n == 0
    if n:
        distinct = len(set(words))
        again = sum(map(operator.eq, words, words[1:]))
        shape[4] = distinct / n
        shape[5] = np.log(distinct) / np.log(n) if n > 1 else 1.0
        shape[6] = np.sqrt(again / n)
        shape[7] = np.log1p(again)
        lengths = np.fromiter(map(len, words), np.int32, n)
        shape[8], shape[9] = lengths.mean(), lengths.std()
        shape[10] = np.log1p(lengths.max())
    shape[11] = len(set(lines)) / m
    shape[12] = np.log1p(len(text) / m)
    shape[13] = shape[12] * shape[4]
    return out


@dataclass
class Ranker:
    """Weights of scaled features, the utility that scores CUT, and whether anything was learned."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    learned: bool = True

    def utility(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.learned:
            return np.full(len(x), 0.5)
        away = self.utility(x) - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(away, -500, 500)))


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def _pairs(z: np.ndarray, label: np.ndarray, pairs: int, seed: int = 11) -> np.ndarray:
    """Differences of preferred and rejected rows; every row of a label takes part about equally often."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    rng = np.random.default_rng(seed)
    winners = good[np.resize(rng.permutation(len(good)), pairs)]
    losers = bad[np.resize(rng.permutation(len(bad)), pairs)][rng.permutation(pairs)]
    return z[winners] - z[losers]


def _slopes(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature that some pairs add to the loss at weights ``w``."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance that the pair is still the wrong way round
    return d.T @ p, (d * (p * (1 - p))[:, None]).T @ d


def _newton(slopes: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, ridge: float, steps: int) -> np.ndarray:
    """Weights that minimise the loss whose gradient and curvature ``slopes`` adds up over all pairs."""
    w = np.zeros(width)
    for _ in range(steps):
        gradient, curve = slopes(w)
        step = np.linalg.solve(curve + ridge * np.eye(width), gradient - ridge * w)
        w = w + step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _unlearned(width: int = WIDTH) -> Ranker:
    return Ranker(np.zeros(width), np.ones(width), np.zeros(width), 0.0, False)


def fit_pairs(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, ridge: float = 1.0, steps: int = 25) -> Ranker:
    """Bradley-Terry weights from preferred (label 1) against rejected (label 0) documents of one array."""
    width = x.shape[1] if x.ndim == 2 else WIDTH
    if not (label == 1).any() or not (label == 0).any():
        return _unlearned(width)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = _scaled(x, mean, scale)
    d = _pairs(z, label, pairs)
    w = _newton(lambda w: _slopes(d, w), width, ridge, steps)
    return Ranker(mean, scale, w, float(np.quantile(z @ w, (label == 0).mean())))


def feature_column(text: Column) -> Column:
    @F.pandas_udf("array<float>")
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t).astype(np.float32) for t in texts])

    return describe(text)


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(np.float64) if len(values) else np.zeros((0, WIDTH))


def _added(df: DataFrame, column: str, parts: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum of ``parts`` of the rows' vectors: each task adds up its rows, the driver one vector a task."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += parts(_matrix(batch[column]))
        yield pd.DataFrame({"v": [total.tobytes()]})

    return sum((np.frombuffer(row.v) for row in df.select(column).mapInPandas(add, "v binary").collect()), np.zeros(size))


def quantile(df: DataFrame, column: str, share: float) -> float:
    """Quantile of a column over all rows, between neighbours linear: counts in cells that get finer around it."""
    n, lo, hi = df.agg(F.count(column), F.min(column), F.max(column)).first()

    def ranked(k: int) -> float:
        """The value with ``k`` smaller ones."""
        low, high = lo, hi
        while high > low:
            width = (high - low) / CELLS
            if low + width == low:
                break
            inside = df.filter(F.col(column).between(low, high))
            cell = F.least(F.floor((F.col(column) - low) / width), F.lit(CELLS - 1))
            found = inside.groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).orderBy("c").collect()
            seen = df.filter(F.col(column) < low).count()
            for r in found:
                if seen + r.n > k:
                    low, high = r.a, r.b
                    break
                seen += r.n
        return low

    place = (n - 1) * share
    a = ranked(int(np.floor(place)))
    return a if place == np.floor(place) else a + (ranked(int(np.ceil(place))) - a) * (place - np.floor(place))


def learn(docs: DataFrame, key: str, text: str, labels: DataFrame, label: str, ridge: float = 1.0, steps: int = 25) -> Ranker:
    """Weights from all labelled documents; ``labels`` has ``key`` and the 0/1 ``label``.

    Documents are paired within buckets of their ids' hash, each at least once. Vectors stay with the tasks; the driver
    gets sums, one curvature matrix of features a task and step, and counts of utilities.
    """
    votes = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
    # The ids grow with the labels, so they are never broadcast: the plan is the same at every size.
    chosen = docs.select(F.col(key), whole_text(text).alias("_text")).join(votes.hint("merge"), key)
    seen = chosen.select(F.col(key), "_label", F.xxhash64("_text").alias("_h"), feature_column(F.col("_text")).alias("x"))
    # one text for each id, also where rows repeat it
    rows = stage(seen.groupBy(key, "_label").agg(F.min_by("x", "_h").alias("x")), "labelled-features")
    n, good = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("_label"), F.lit(0))).first()
    if good == 0 or good == n:
        unstage(rows)
        return _unlearned()
    mean = _added(rows, "x", lambda x: x.sum(0), WIDTH) / n
    scale = np.sqrt(_added(rows, "x", lambda x: ((x - mean) ** 2).sum(0), WIDTH) / n)
    scale[scale < 1e-9] = 1.0

    # Buckets have bounded rows; a rare label's rows go to several, so that each bucket has about RARE_ROWS of them.
    buckets, rare = -(-n // BUCKET_ROWS), min(good, n - good)
    copies = min(buckets, max(1, -(-RARE_ROWS * buckets // rare)))
    places = F.when(F.col("_label") == (1 if rare == good else 0), copies).otherwise(1)

    def paired(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        got = group["_label"].to_numpy()
        most = int(max((got == 1).sum(), (got == 0).sum()))
        if most == len(got):
            return pd.DataFrame({"d": []})
        d = _pairs(_scaled(_matrix(group["x"]), mean, scale), got, most)
        return pd.DataFrame({"d": list(d.astype(np.float32))})

    spread = rows.select(F.col(key).cast("string").alias("k"), "_label", "x", F.explode(F.sequence(F.lit(0), places - 1)).alias("_i"))
    bucket = F.pmod(F.xxhash64("k") % buckets + F.col("_i"), F.lit(buckets)).alias("b")
    pairs = stage(spread.select("k", "_label", "x", bucket).groupBy("b").applyInPandas(paired, "d array<float>"), "label-pairs")

    def slopes(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = _added(pairs, "d", lambda d: np.concatenate([part.ravel() for part in _slopes(d, w)]), WIDTH + WIDTH * WIDTH)
        return total[:WIDTH], total[WIDTH:].reshape(WIDTH, WIDTH)

    ranker = Ranker(mean, scale, _newton(slopes, WIDTH, ridge, steps), 0.0)

    @F.pandas_udf("double")
    def utility(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(ranker.utility(_matrix(x)))

    utilities = stage(rows.select(utility("x").alias("u")), "label-utilities")
    threshold = quantile(utilities, "u", (n - good) / n)
    unstage(rows, pairs, utilities)
    return Ranker(mean, scale, ranker.weights, threshold)


def score_column(text: Column, ranker: Ranker) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(ranker.score(np.array([features(t).astype(np.float32) for t in texts], dtype=np.float64).reshape(-1, WIDTH)))

    return score(text)


def scored(docs: DataFrame, key: str, text: str, labels: DataFrame, label: str, learn_from: Column | None = None) -> DataFrame:
    """``docs`` with ``score``; ``learn_from`` picks the rows of ``labels`` to learn from."""
    small_batches(docs.sparkSession)
    ranker = learn(docs, key, text, labels if learn_from is None else labels.filter(learn_from), label)
    return docs.withColumn("score", score_column(whole_text(text), ranker))


def in_fold(key: Column, folds: int, fold: int) -> Column:
    """Whether the checksum of the id as text falls into a fold."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))
