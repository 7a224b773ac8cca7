import re

import pytest
from pyspark.sql import functions as F

from movelens.operators import small_side as ss
from movelens.operators.baselines import center_by, group_means, lookup_baseline, weighted_baselines


def facts(spark):
    return spark.range(3000).select(
        "id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("g"), F.col("id") % 4)).alias("grp"),
        F.concat(F.lit("r"), F.col("id") % 3).alias("region"), (F.col("id") % 11).cast("double").alias("v"), F.lit(1.0).alias("w"))


@pytest.mark.parametrize("limit", [10_000, 0])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_equals_a_plain_join(spark, limit, how):
    df = facts(spark)
    small = spark.createDataFrame([("g0", 1, {"a": 1}), ("g1", 2, {}), ("g9", 3, None), (None, 4, None)], "k string, x int, m map<string,int>")
    got = ss.small_join(df, small, [("grp", "k")], how, limit)
    expected = df.join(small, F.col("grp") == F.col("k"), how)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect()))
    assert got.columns == expected.columns


def hashed_on(df):
    """Column lists that the plan's exchanges deal rows by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"hashpartitioning\((.*?), \d+\)", plan)]


@pytest.mark.parametrize("limit", [10_000, 0])
def test_no_plan_hashes_facts_by_few_keys(spark, monkeypatch, limit):
    monkeypatch.setattr(ss, "LIMIT_ROWS", limit)
    df = facts(spark)
    base = weighted_baselines(df, ["v"], region="region", group="grp", weight="w")
    looked = lookup_baseline(df, base, region="region", group="grp", take={"b": "v"})
    centred = center_by(df, "v", "grp", group_means(df, "v", "grp"), "c")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (looked, centred):
            by = hashed_on(out)
            assert all("_salt" in x or "_copy" in x for x in by), by
            assert bool(by) == (limit == 0)
            assert out.count() == 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = {r.id: r.b for r in looked.collect()}
    every = df.toPandas()
    cells = every.groupby(["region", "grp"]).v.mean()
    groups = every.groupby("grp").v.mean()
    for r in every.itertuples():
        assert abs(rows[r.id] - (groups.mean() if r.grp is None else cells[r.region, r.grp])) < 1e-9
