import random

import numpy as np
from pyspark.sql import functions as F

from movelens.llm import quality_ranker as qr
from movelens.llm.queries import REGISTRY


def sample(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        words = [word() for _ in range(rng.randrange(3, 80))]
        text = " ".join(w.upper() + "!!" for w in words) if bad else (" ".join(words) + ".").capitalize()
        rows.append((i, text, 0 if bad else 1))
    return rows


def test_learns_and_thresholds_by_quantile(spark):
    rows = sample(400)
    docs = spark.createDataFrame([(i, t, 9.0) for i, t, _ in rows] + [(1000, None, 0.0), (1001, "", 0.0), (5, rows[5][1], 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(7, 1), (99999, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = qr.scored(docs, "doc_id", "text", labels, "quality", F.col("doc_id") % 5 != 0).collect()
    assert len(got) == 403 and got[0].asDict().keys() == {"doc_id", "text", "score"}
    by = {r.doc_id: r.score for r in got}
    assert all(0 <= s <= 1 for s in by.values()) and by[1000] == by[1001]
    assert np.mean([(by[i] >= 0.3) == (q == 1) for i, _, q in rows if i % 5 == 0]) > 0.97
    assert qr.scored(docs, "doc_id", "text", labels.limit(0), "quality").filter("score = 0.5").count() == 403
    assert qr.scored(docs.limit(0), "doc_id", "text", labels, "quality").count() == 0


def test_pairwise_fit_orders_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6))
    label = (x @ np.array([1, -2, 0, 0.5, 0, 0]) + rng.normal(size=500) > -1).astype(int)
    r = qr.fit_pairs(x, label)
    u = r.utility(x)
    good, bad = u[label == 1], u[label == 0]
    assert (good[:, None] > bad[None, :]).mean() > 0.9
    assert abs((u < r.threshold).mean() - (label == 0).mean()) < 0.01
    assert np.array_equal(r.score(x) < 0.3, u < r.threshold)


def test_held_out_accuracy_on_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    got = REGISTRY["op1_bradley_terry"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    s, q = np.array([r.score for r in got]), np.array([r.quality for r in got])
    assert (s[q == 1][:, None] > s[q == 0][None, :]).mean() > 0.97
    assert np.mean([(r.predicted == 1) == (r.quality == 1) for r in got]) > 0.93


def test_long_and_odd_texts():
    for t in (None, "", " ", "\n" * 10, "x" * 2_000_000, "\x00\ud800"):
        assert np.isfinite(qr.features(t)).all()
