"""Scans by user are guarded by one count of the tables' keys; ranks group their rows once."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from movelens.operators import scan
from movelens.operators.ranks import RankSpec, pct_ranks
from movelens.operators.scan import Skew
from movelens.plans.queries import base

FOLDER = "/root/testdata/sf0.001"


def test_large_tables_need_no_pass_per_scan(spark, monkeypatch):
    """Above the limit only the scan by nation and that of the ranks, which reads a stored table, count their rows."""
    plain = sorted(map(tuple, queries()["breakdown_rows"](spark, FOLDER).collect()))
    counted, segments = [], scan._with_segments

    def watched(df, by, skew):
        if skew.rows_at_most is None or skew.rows_at_most > skew.hot_rows:
            counted.append(list(by))
        return segments(df, by, skew)

    monkeypatch.setattr(scan, "_with_segments", watched)
    monkeypatch.setattr(base.Tables, "skew", lambda self, *n: Skew(hot_rows=700, rows_at_most=1000))
    t = base.Tables(spark, FOLDER)
    assert t.most("events", "user_id") == t.events.groupBy("user_id").count().agg(F.max("count")).first()[0]
    assert sorted(map(tuple, queries()["breakdown_rows"](spark, FOLDER).collect())) == plain
    assert counted == [["_b0"], ["_m", "_g"]]


def test_a_hot_user_is_still_cut(spark, monkeypatch):
    plain = sorted(map(tuple, base.purchase_spells(base.Tables(spark, FOLDER)).collect()))
    monkeypatch.setattr(base.Tables, "skew", lambda self, *n: Skew(hot_rows=3, pieces=4, rows_at_most=1000))
    t = base.Tables(spark, FOLDER)
    assert base.user_skew(t).rows_at_most is None
    assert sorted(map(tuple, base.purchase_spells(t).collect())) == plain


def test_ranks_group_large_inputs_once(spark):
    rows = [(i, f"g{i % 3}", float(i % 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    specs = [RankSpec("one", F.col("v"), ("g",)), RankSpec("two", F.col("v"))]
    large = pct_ranks(df, ["id"], specs, skew=Skew(hot_rows=100, rows_at_most=600))
    assert "value-counts" in large._jdf.queryExecution().toString()
    assert sorted(map(tuple, large.collect())) == sorted(map(tuple, pct_ranks(df, ["id"], specs).collect()))
