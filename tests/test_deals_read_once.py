"""Queries on deals add up the line items once, however often they use the deals."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from movelens.operators.ranks import RankSpec, pct_ranks
from movelens.operators.scan import Skew
from movelens.plans.queries import base

FOLDER = "/root/testdata/sf0.001"
SCENARIOS = ("batch_predict", "marginalised_predict", "loo_explanation", "sensitivity", "factor_spread", "verdict")
REPORTS = ("head_to_head", "report_card_full", "report_card_resale", "leaderboard_gated", "resale_profit", "group_references")


class Counted(base.Tables):
    reads = 0

    def __getattr__(self, name):
        if name == "lineitem":
            type(self).reads += 1
        return super().__getattr__(name)


@pytest.mark.parametrize("name", SCENARIOS + REPORTS)
def test_line_items_are_added_up_once(spark, monkeypatch, name):
    monkeypatch.setattr(base, "Tables", Counted)
    Counted.reads = 0
    df = queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert Counted.reads == 1 and "l_orderkey" not in plan
    assert df.count() > 0


def test_guard_counts_the_keys_of_the_tables(spark, monkeypatch):
    """Where the tables are large, the bound is a subject's deals, not all of them; a hot subject is still found."""
    t = base.Tables(spark, FOLDER)
    monkeypatch.setattr(base.Tables, "skew", lambda self, *n: Skew(hot_rows=100, rows_at_most=1500))
    most = t.orders.groupBy("o_custkey").count().agg(F.max("count")).first()[0]
    assert base.subject_skew(t).rows_at_most == most < 100
    monkeypatch.setattr(base.Tables, "skew", lambda self, *n: Skew(hot_rows=most - 1, rows_at_most=1500))
    guard = base.subject_skew(t)
    assert guard.rows_at_most is None
    plain = sorted(map(tuple, base.resold(t).select("deal_id", "next_fee").collect()))
    monkeypatch.undo()
    assert plain == sorted(map(tuple, base.resold(base.Tables(spark, FOLDER)).select("deal_id", "next_fee").collect()))


def test_one_rank_moves_the_rows_once_and_equals_the_stacked_ranks(spark):
    rows = [(i, f"g{i % 3}" if i % 7 else None, None if i % 5 == 0 else float(i % 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    specs = [RankSpec("one", F.col("v"), ("g",), F.col("id") % 2 == 0), RankSpec("two", F.col("v"))]
    both = pct_ranks(df, ["id"], specs)
    for spec in specs:
        single = pct_ranks(df, ["id"], [spec])
        assert single.columns == ["id", "g", "v", spec.out]
        assert sorted(map(tuple, single.collect()), key=repr) == sorted(map(tuple, both.select("id", "g", "v", spec.out).collect()), key=repr)
        joins = [x for x in single._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
        assert len(joins) == 1, joins
