"""The scoring job's queries do no more work than their rows need, and give the same rows for it."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from movelens.operators.baselines import rate_baselines, weighted_baselines
from movelens.plans import scoring as plan
from movelens.plans.queries import jobs
from tests import careers

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return careers.to_spark(spark, careers.build())


def test_baselines_without_the_whole_job(spark, monkeypatch):
    monkeypatch.setattr(jobs, "run_scoring", lambda *a, **k: pytest.fail("the whole job was run"))
    assert queries()["scoring_baselines"](spark, FOLDER).count() > 5


def test_baselines_equal_those_of_single_appearances(tables, as_rows):
    apps = tables["appearances"].withColumn("goals", F.when(F.col("minutes_played") % 7 != 0, F.col("goals")))
    players = tables["players"]
    single = rate_baselines(
        apps.join(players.select("player_id", "position"), "player_id", "left"), region="competition_id", group="position",
        num=F.col("goals") + F.col("assists"), den=F.col("minutes_played"), out="ga_p90_baseline",
    )
    assert as_rows(plan.league_baselines(apps, players)) == as_rows(single.select("competition_id", "position", "ga_p90_baseline"))


def test_one_pass_over_the_facts_serves_both_populations(spark, tables, monkeypatch):
    """Windows, values and staged facts are built once, not once per population."""
    calls = []
    for name in ("window_sums", "asof_join", "disjoint_window_agg", "apply_corrections"):
        monkeypatch.setattr(plan, name, lambda *a, _f=getattr(plan, name), _n=name, **k: calls.append(_n) or _f(*a, **k))

    class Enough(Exception):
        pass

    def stop(*a, **k):
        raise Enough

    monkeypatch.setattr(plan, "next_value_at", stop)
    with pytest.raises(Enough):
        plan.run_scoring(spark, tables, careers.NOW)
    assert {n: calls.count(n) for n in set(calls)} == {"window_sums": 2, "asof_join": 2, "disjoint_window_agg": 1, "apply_corrections": 1}


def test_rows_per_player_bounds_every_player(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "player_id long")
    assert plan.rows_per_player(a, a.filter("player_id = 2"), a.limit(0)) == 3


def test_baselines_read_their_facts_once(spark, tables):
    """Cells and group totals come from one pass: the facts are in the plan once."""
    facts = tables["appearances"].withColumn("position", F.lit("x"))
    rate = rate_baselines(facts, region="competition_id", group="position", num=F.col("goals"), den=F.col("minutes_played"))
    w = weighted_baselines(facts, ["goals"], region="competition_id", group="position", weight="minutes_played")
    for out in (rate, w):
        plan_text = out._jdf.queryExecution().optimizedPlan().toString()
        assert sum(plan_text.count(x) for x in ("Relation [", "LogicalRDD", "LocalRelation")) == 1, plan_text
        assert out.filter("competition_id = '_default'").count() == 1 and out.count() > 1


def test_form_against_own_league_moves_no_single_appearances_for_its_baselines(spark):
    """Corrections join the recent appearances only, and once."""
    text = queries()["form_vs_own_league"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in text.splitlines() if "Join" in x and "appearance_id" in x]
    assert len(joins) == 1, joins
