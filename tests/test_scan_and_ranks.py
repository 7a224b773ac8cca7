"""Ordered scans, ranks and quantiles; the segmented path equals the plain one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from movelens.operators import scan
from movelens.operators.ranks import RankSpec, exact_quantiles, pct_rank, pct_ranks
from movelens.operators.reports import binned_trend, half_split_delta
from movelens.operators.scan import Skew, ordered_scan

PLAIN, HOT = Skew(rows_at_most=1), Skew(hot_rows=20, pieces=6)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    n = 600
    # one key holds two thirds of the rows
    key = np.where(rng.random(n) < 0.66, "hot", rng.choice(list("abcdefgh"), n))
    return pd.DataFrame(
        {"k": key, "t": rng.integers(0, 90, n), "id": range(n), "x": rng.integers(0, 40, n).astype(float), "y": rng.random(n).round(3)}
    ).assign(x=lambda d: d.x.where(rng.random(n) > 0.1))


@pytest.fixture(scope="module")
def df(spark, data):
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in data.itertuples(index=False)]
    return spark.createDataFrame(rows, "k string, t int, id int, x double, y double")


@pytest.mark.parametrize("by", [["k"], []])
def test_segments_do_not_change_results(df, by):
    results = []
    for skew in (PLAIN, HOT):
        out = ordered_scan(
            df, by, ["t", "id"], last={"l": F.when(F.col("id") % 3 == 0, F.col("id"))},
            following={"f": F.when(F.col("id") % 5 == 0, F.col("id"))}, lead={"n": F.col("x")},
            sums={"s": F.col("id")}, totals={"all": F.col("id")}, skew=skew,
        )
        results.append(out.select("id", "l", "f", "n", "s", "all").toPandas().sort_values("id").reset_index(drop=True))
    pd.testing.assert_frame_equal(*results)


@pytest.mark.parametrize("by", [["k"], []])
def test_segments_agree_where_boundaries_vary(df, data, by, monkeypatch):
    """Approximate quantiles may differ each time they are computed; the scan's parts use the same ones."""
    boundaries = scan._boundaries

    def varying(ord_col, pieces):
        noise = "CAST(pmod(CAST(java_method('java.lang.System', 'nanoTime') AS BIGINT), 41) - 20 AS DOUBLE)"
        return F.array_sort(F.transform(boundaries(ord_col, pieces), lambda b: b + F.expr(noise)))

    monkeypatch.setattr(scan, "_boundaries", varying)
    d = data.sort_values([*by, "t", "id"])
    want = (d.groupby(by).id if by else d.id).cumsum()
    for _ in range(3):
        got = ordered_scan(df, by, ["t", "id"], sums={"s": F.col("id")}, skew=HOT).toPandas().set_index("id").s
        assert got.to_dict() == dict(zip(d.id, want))


def test_scan_against_pandas(df, data):
    out = ordered_scan(df, ["k"], ["t", "id"], lead={"n": F.col("id")}, sums={"s": F.col("id")}, skew=HOT)
    got = out.toPandas().set_index("id").sort_index()
    d = data.sort_values(["k", "t", "id"])
    assert got.n.dropna().astype(int).to_dict() == d.assign(n=d.groupby("k").id.shift(-1)).set_index("id").n.dropna().astype(int).to_dict()
    assert got.s.to_dict() == d.assign(s=d.groupby("k").id.cumsum()).set_index("id").s.to_dict()


@pytest.mark.parametrize("skew", [PLAIN, HOT])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_rank_matches_pandas(df, data, by, skew):
    got = pct_rank(df, "x", "p", by, skew=skew).toPandas().set_index("id").p.sort_index()
    want = (data.groupby(by).x if by else data.x).rank(pct=True) * 100
    assert np.allclose(got, want, equal_nan=True)


def test_rank_endpoints(spark):
    d = spark.createDataFrame([(float(v),) for v in (10, 20, 30, 40, 50)], "v double")
    ranks = sorted(r.p for r in pct_rank(d, "v", "p").collect())
    assert ranks[0] == 20.0 and ranks[-1] == 100.0


def test_conditional_rank_and_stacking(df, data):
    specs = [RankSpec("a", F.col("x"), ("k",)), RankSpec("b", F.col("y"), (), F.col("x") > 20), RankSpec("c", -F.col("x"))]
    got = pct_ranks(df, ["id"], specs, HOT).toPandas().set_index("id").sort_index()
    assert np.allclose(got.a, data.groupby("k").x.rank(pct=True) * 100, equal_nan=True)
    some = data.x > 20
    assert np.allclose(got.b[some], data.y[some].rank(pct=True) * 100) and got.b[~some].isna().all()
    assert np.allclose(got.c, (-data.x).rank(pct=True) * 100, equal_nan=True)


def test_union_then_split_keeps_the_order(df):
    u = df.withColumn("pop", F.col("id") % 2)
    joint = pct_rank(u, "x", "p").filter("pop = 0 and x is not null").toPandas()
    alone = pct_rank(u.filter("pop = 0"), "x", "p").filter("x is not null").toPandas()
    assert (joint.sort_values(["p", "id"]).id.values == alone.sort_values(["p", "id"]).id.values).all()


@pytest.mark.parametrize("k", [1, 2, 7, 100])
def test_quantiles_are_exact(df, data, k):
    for r in exact_quantiles(df, "x", k, ["k"], HOT).collect():
        v = data[data.k == r.k].x.dropna()
        assert np.allclose(r.q, v.quantile([i / k for i in range(k + 1)])), (r.k, k)
        assert r.n == len(v)


@pytest.mark.parametrize("q", [4, 10])
def test_binned_trend_matches_qcut(df, data, q):
    got = binned_trend(df, "x", "y", q, skew=HOT).toPandas().sort_values("x").reset_index(drop=True)
    d = data.dropna(subset=["x"])
    g = d.groupby(pd.qcut(d.x, q, duplicates="drop"), observed=True).agg(x=("x", "median"), y=("y", "mean"), n=("y", "size"))
    assert np.allclose(got.x, g.x) and np.allclose(got.avg_y, g.y) and (got.n.values == g.n.values).all()


def test_half_split(df, data):
    got = {r.k: r.score_improvement for r in half_split_delta(df, "k", ["t", "id"], "y", 5, skew=HOT).collect()}
    for k, g in data.sort_values(["t", "id"]).groupby("k"):
        if len(g) >= 5:
            mid = len(g) // 2
            assert got[k] == pytest.approx(g.y[mid:].mean() - g.y[:mid].mean())


def test_partitioning_does_not_matter(df):
    a = pct_rank(df.repartition(1), "x", "p", ["k"], skew=HOT).select("id", "p").toPandas().sort_values("id")
    b = pct_rank(df.repartition(7, "y"), "x", "p", ["k"], skew=HOT).select("id", "p").toPandas().sort_values("id")
    assert a.p.equals(b.p) or np.allclose(a.p.values, b.p.values, equal_nan=True)
