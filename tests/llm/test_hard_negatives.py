import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from movelens.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, id string, uid string, shard string"


def brute(rows, anchors, positives=5, negatives=10):
    """Rows of the result, as a sorted list; ``anchors`` picks the ids that are mined for."""
    ok = []
    for no, (k, e, label) in enumerate(rows):
        if k is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        ok.append((k, [math.floor(256 * float(np.float32(x))) for x in e], label, no))
    out = []
    for k, q, label, no in ok:
        if not anchors(k):
            continue
        all_scores = [(-sum(a * b for a, b in zip(q, v)), i, n, lab) for i, v, lab, n in ok if n != no]
        for s, pid, _, _ in sorted(x for x in all_scores if x[3] == label)[:positives]:
            fit = sorted(x for x in all_scores if x[3] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)[:negatives]
            out += [(k, pid, r, i, -s, -t) for r, (t, i, _, _) in enumerate(fit, 1)]
    return sorted(out)


def clustered(n, dims=8, seed=5, groups=12):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dims))
    x = middles[rng.integers(0, groups, n)] + 0.2 * rng.normal(size=(n, dims))
    return [(i, [float(a) for a in x[i]], int(rng.integers(0, 4))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(4)


def mined(df, every=10, **more):
    got = hn.mine(df, "vec_id", "embedding", F.col("label"), F.col("vec_id") % every == 0, **more)
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("shard_rows", [8192, 60])
def test_equals_brute_force(spark, shard_rows):
    rows = clustered(700)
    rows += [(2000 + i, rows[20][1], 1 + i % 2) for i in range(150)]  # one vector many times
    rows += [(None, rows[1][1], 1), (3000, None, 1), (3001, [1.0, None], 1), (3002, [float("nan")] * 8, 2), (3003, [float("inf")] * 8, 2)]
    rows += [(3010, [], 1), (3020, [1.5, 2.5], 1), (3030, rows[2][1], None), (30, rows[3][1], 2), (30, rows[3][1], 2)]
    got = mined(frame(spark, rows), shard_rows=shard_rows, cell_rows=12)
    assert got == brute(rows, lambda k: k % 10 == 0) and len(got) > 2000


def test_numbers_beyond_doubles(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) * 3e6 for _ in range(5)], i % 2) for i in range(60)]
    rows = [(k, [float(np.float32(x)) for x in e], lab) for k, e, lab in rows]
    assert mined(frame(spark, rows), every=5) == brute(rows, lambda k: k % 5 == 0)


def test_empty_table(spark):
    assert mined(frame(spark, [(1, [1.0], 1)]).limit(0)) == []
    assert mined(frame(spark, [(10, [1.0], 1), (20, [2.0], 1)])) == []


def shard_of(rows):
    """The rows as one shard, and codebooks fitted on them."""
    x = np.floor(256 * np.array([r[1] for r in rows]))
    cut = x.shape[1] // 2
    books = hn.Codebooks(cut, (hn._kmeans(x[:, :cut], 12), hn._kmeans(x[:, cut:], 12)))
    (c1, d1), (c2, d2) = (hn._nearest(h, c) for h, c in zip(books.halves(x), books.centres))
    books.radii = tuple(np.array([d[c == k].max(initial=0) for k in range(12)]) for c, d in ((c1, d1), (c2, d2)))
    order = np.lexsort((c2, c1))
    whole = lambda a, t: np.ascontiguousarray(a, t).tobytes()
    packed = {"kind": "<f8", "ids": whole(order, np.int64), "uids": whole(order, np.int64), "labels": whole(np.array([r[2] for r in rows])[order], np.int64),
              "codes": whole(np.stack([c1, c2], 1)[order], np.int32), "anchor": whole(order >= 0, bool), "vectors": whole(x[order], np.float64)}
    return hn.Shard(packed, x.shape[1]), books, x


def test_bounds_hold_and_the_heap_stops_early(monkeypatch):
    shard, books, x = shard_of(clustered(3000, groups=30))
    monkeypatch.setattr(hn, "STEP_ROWS", 1)
    scored = []
    products = hn._products
    monkeypatch.setattr(hn, "_products", lambda rows, q: scored.append(len(rows)) or products(rows, q))
    for i in range(0, 3000, 150):
        q = shard.vectors[i]
        (low1, up1), (low2, up2) = books.bounds(q)
        for (a, b), (start, end) in shard.cells.items():
            s = shard.vectors[start:end] @ q
            assert (s <= up1[a] + up2[b]).all() and (s >= low1[a] + low2[b]).all()
        w = hn.Wanted(0, True, 5)
        shard.search(q, int(shard.uids[i]), int(shard.labels[i]), [w], books)
        same = (shard.labels == shard.labels[i]) & (np.arange(3000) != i)
        assert w.scores.tolist() == sorted((shard.vectors[same] @ q).tolist(), reverse=True)[:5]
    assert sum(scored) < 0.5 * 20 * 3000


def above(plan, found):
    """The lines of a plan above the first one with ``found``."""
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if found in x)
    depth, out = len(lines[at]) - len(lines[at].lstrip(" :+-*")), []
    for x in reversed(lines[:at]):
        if (d := len(x) - len(x.lstrip(" :+-*"))) < depth:
            depth, out = d, [*out, x]
    return out


def test_anchors_of_all_visits_are_not_broadcast(spark):
    df = frame(spark, clustered(700)).select("vec_id", "embedding", "label")
    got = hn.mine(df, "vec_id", "embedding", F.col("label"), F.col("vec_id") % 10 == 0, shard_rows=60, cell_rows=12)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in next(x for x in above(plan, "explode(visits") if "Join" in x)


@pytest.mark.parametrize("n", [30, 90, 3000])
def test_sample_is_that_of_the_smallest_hashes(spark, monkeypatch, n):
    monkeypatch.setattr(hn, "SAMPLE_ROWS", 40)
    rows = hn._scaled_rows(frame(spark, clustered(n)), "vec_id", "embedding", F.col("label"), F.lit(True), 256).localCheckpoint()
    want = rows.select("uid", F.xxhash64("id", "uid").alias("h")).collect()
    got = hn._sample(rows, n)
    assert [(r.h, r.uid) for r in got] == sorted((r.h, r.uid) for r in want)[:40]


def test_tasks_send_few_rows_of_the_sample(spark, monkeypatch):
    """With one task for each row no more than the sample is needed; with few, each sent as many rows as the whole sample has."""
    asked = []
    monkeypatch.setattr(hn, "SAMPLE_ROWS", 40)
    rows = hn._scaled_rows(frame(spark, clustered(3000)), "vec_id", "embedding", F.col("label"), F.lit(True), 256)
    limit = type(rows).limit
    monkeypatch.setattr(type(rows), "limit", lambda self, k: asked.append(self.count()) or limit(self, k))
    hn._sample(rows, 3000)
    assert 40 <= asked[0] < 160
