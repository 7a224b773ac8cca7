import numpy as np

from movelens.llm import quality_ranker as qr
from tests.llm.test_quality_ranker import sample


def test_every_labelled_document_is_learned_from(spark, monkeypatch):
    """Means of the features are those of all labelled rows, also above any former limit."""
    monkeypatch.setattr(qr, "BUCKET_ROWS", 100)
    rows = sample(600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = qr.learn(docs, "doc_id", "text", labels, "quality")
    x = np.array([qr.features(t).astype(np.float32) for _, t, _ in rows], dtype=np.float64)
    label = np.array([q for _, _, q in rows])
    assert np.allclose(got.mean, x.mean(0)) and np.allclose(got.scale, np.where(x.std(0) < 1e-9, 1.0, x.std(0)))
    u = got.utility(x)
    assert abs(got.threshold - np.quantile(u, (label == 0).mean())) < 1e-9
    assert np.mean((u >= got.threshold) == (label == 1)) > 0.97


def test_quantile_is_exact(spark):
    values = np.concatenate([np.random.default_rng(2).normal(size=3000) ** 3, [1e9, -1e9], np.repeat(0.25, 500)])
    df = spark.createDataFrame([(float(v),) for v in values], "u double").repartition(4)
    for share in (0.0, 0.123, 0.5, 0.77, 1.0):
        assert abs(qr.quantile(df, "u", share) - np.quantile(values, share)) < 1e-9 * max(1, abs(np.quantile(values, share)))


def test_a_rare_label_reaches_all_buckets(spark, monkeypatch):
    monkeypatch.setattr(qr, "BUCKET_ROWS", 20)
    rows = [r for r in sample(300) if r[2] == 1 or r[0] < 12]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = qr.learn(docs, "doc_id", "text", labels, "quality")
    u = got.utility(np.array([qr.features(t).astype(np.float32) for _, t, _ in rows], dtype=np.float64))
    label = np.array([q for _, _, q in rows])
    assert got.learned and u[label == 1].min() > u[label == 0].max()
