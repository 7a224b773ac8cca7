import math

import numpy as np
import pytest

from movelens.llm import vector_range_join as vr


def brute(rows, t):
    good = {}
    for i, (_, e, label, _) in enumerate(rows):
        if label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            good[i] = np.array(e, float) / np.linalg.norm(np.array(e, float))
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in good:
        for j in good:
            if i < j and rows[i][2] == rows[j][2] and len(good[i]) == len(good[j]) and good[i] @ good[j] >= t:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 60), r[0])
    return sorted((r[0], links[i], least[find(i)], least[find(i)] == r[0]) for i, r in enumerate(rows))


@pytest.mark.parametrize(("cell", "block"), [(2000, 2000), (40, 25), (1000, 30)])
def test_equals_brute_force(spark, cell, block):
    rng = np.random.default_rng(2)
    rows, k = [], 0
    for label in (0, 1, None, 2):
        centres = rng.normal(size=(12, 16))
        for _ in range(220 if label == 1 else 60):
            e = centres[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.05, 0.25, 1.0])
            rows.append((k, [float(np.float32(x)) for x in e], label, "x"))
            k += 1
    copy = rows[5][1]
    rows += [(k + i, copy, 0, "y") for i in range(70)]
    rows += [(k + 100, None, 0, ""), (k + 101, [], 0, ""), (k + 102, [0.0] * 16, 0, ""), (k + 103, [None] + [1.0] * 15, 0, ""),
             (k + 104, [float("nan")] + [1.0] * 15, 0, ""), (k + 105, [float("inf")] + [1.0] * 15, 0, ""), (k + 106, [1.0, 2.0], 0, ""), (k + 107, [2.0, 4.0], 0, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, links string").repartition(4)
    got = vr.range_join(df, "vec_id", "embedding", "label", 0.93, cell, block).collect()
    assert sorted(map(tuple, got)) == brute(rows, 0.93)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vr.range_join(df, "vec_id", "embedding", "label", 0.93).count() == 0
    one = spark.createDataFrame([(None, [1.0], 1), (4, [2.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, vr.range_join(one, "vec_id", "embedding", "label", 0.93).collect()), key=repr) == [(4, 1, 4, True), (None, 1, 4, False)]
