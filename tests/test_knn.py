import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from movelens.operators import knn


def brute(queries, refs, k, exclude):
    out = []
    for qk, *q in queries:
        if any(x is None or x != x for x in q):
            continue
        near = sorted((sum((a - b) ** 2 for a, b in zip(r, q)), rk) for rk, *r in refs if not (exclude and rk == qk) and all(x is not None and x == x for x in r))
        out += [(qk, i, rk, round(d ** 0.5, 9)) for i, (d, rk) in enumerate(near[:k], 1)]
    return sorted(out)


def points(n, seed, spread=1.0):
    rng = random.Random(seed)
    middles = [(rng.uniform(-50, 50), rng.uniform(-50, 50), rng.uniform(-5, 5)) for _ in range(9)]
    return [(i, *[round(c + rng.gauss(0, spread), 2) for c in rng.choice(middles)]) for i in range(n)]


def frame(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, x double, y double, z double").repartition(3)


def got(df):
    return sorted((r[0], r["rank"], r["neighbour"], round(r["distance"], 9)) for r in df.collect())


@pytest.mark.parametrize("exclude", [False, True])
@pytest.mark.parametrize(("cell_rows", "part", "block"), [(2000, 8192, 2048), (30, 8192, 2048), (25, 9, 4)])
def test_equals_brute_force(spark, monkeypatch, cell_rows, part, block, exclude):
    monkeypatch.setattr(knn, "PART_ROWS", part)
    monkeypatch.setattr(knn, "QUERY_ROWS", block)
    refs = points(500, 1)
    refs += [(1000 + i, *refs[3][1:]) for i in range(40)] + [(2000, None, 1.0, 1.0), (2001, float("nan"), 1.0, 1.0), (2002, 0.0, -0.0, 0.0), (2003, -0.0, 0.0, 0.0)]
    queries = refs[::6] + [(5000 + i, *p[1:]) for i, p in enumerate(points(40, 7, spread=20.0))] + [(6000, None, 0.0, 0.0), (6001, 900.0, 900.0, 900.0)]
    found = knn.nearest(frame(spark, queries, "k"), frame(spark, refs, "id"), ["x", "y", "z"], query_key="k", reference_key="id", k=4, exclude_self=exclude, cell_rows=cell_rows)
    assert got(found) == brute(queries, refs, 4, exclude)


def test_few_rows_and_none(spark):
    refs = points(3, 2)
    q = frame(spark, points(5, 3), "k")
    asked = lambda r: knn.nearest(q, frame(spark, r, "id"), ["x", "y", "z"], query_key="k", reference_key="id", k=5)
    assert got(asked(refs)) == brute(points(5, 3), refs, 5, False)
    empty = frame(spark, refs, "id").limit(0)
    assert knn.nearest(q, empty, ["x", "y", "z"], query_key="k", reference_key="id", k=5).count() == 0
    assert knn.nearest(q.limit(0), frame(spark, refs, "id"), ["x", "y", "z"], query_key="k", reference_key="id", k=5).count() == 0


def test_far_cells_are_not_visited():
    rng = np.random.default_rng(4)
    middles = rng.uniform(-100, 100, (30, 3))
    x = (middles[:, None, :] + rng.normal(0, 0.5, (30, 40, 3))).reshape(-1, 3)
    cells = knn.Cells(middles, np.full(30, 40), np.zeros(30), np.ones(30, np.int64))
    far = cells.distances(x)
    home = far.argmin(axis=1)
    cells.radius = np.array([far[home == c, c].max() for c in range(30)])
    cells.rows = np.bincount(home, minlength=30)
    reach = cells.reach(far, 5)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    fifth = np.sort(d, axis=1)[:, 4]
    assert (reach >= fifth - 1e-12).all()
    seen = cells.visited(far, fifth)
    needed = np.zeros_like(seen)
    for i in range(len(x)):
        needed[i, home[d[i] <= fifth[i]]] = True
    assert (seen | ~needed).all() and seen.mean() < 0.1


def test_no_driver_side_queries(spark):
    """However many queries there are, their number of jobs and plan branches is the same."""
    refs, tracker = points(200, 5), spark.sparkContext.statusTracker()
    jobs = []
    for n in (20, 180):
        spark.sparkContext.setJobGroup(f"knn-{n}", "")
        knn.nearest(frame(spark, refs[:n], "k"), frame(spark, refs, "id"), ["x", "y", "z"], query_key="k", reference_key="id", k=2, cell_rows=40).agg(F.count("*")).collect()
        jobs.append(len(tracker.getJobIdsForGroup(f"knn-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(jobs[0] - jobs[1]) <= 3
