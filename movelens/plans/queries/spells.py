"""Queries on spells, windows, as-of joins and baselines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movelens.functions.numeric import decay_weight, per_unit, ratio, weighted_known_mean
from movelens.functions.text import season_start
from movelens.operators import scoring as sc
from movelens.operators.asof import asof_join, first_after
from movelens.operators.baselines import group_means, lookup_baseline, rate_baselines, weighted_baselines
from movelens.operators.quality import burst_distinct, violations
from movelens.operators.ranks import RankSpec, pct_ranks
from movelens.operators.resolve import shared_ids
from movelens.operators.snapshots import null_if_uncovered
from movelens.operators.spells import build_spells
from movelens.operators.stitch import drop_contaminated, explode_seasons, stitch
from movelens.operators.windows import TimeWindow, window_sums
from movelens.plans.queries.base import (
    NOW, SPELLS_SQL, WINDOWS_SQL, Tables, cents, micros, placed_events, purchase_spells, query, rank_sql,
    spell_values, spell_windows, user_events, user_skew, values_sql,
)
from movelens.sources.staging import stage


@query("spell_builder", f"""WITH {SPELLS_SQL}
SELECT event_id, user_id, epoch_us(ts) AS start_us, epoch_us(end_ts) AS end_us, next_cents,
  epoch_us(end_ts) - epoch_us(ts) AS duration_us, end_ts >= TIMESTAMP '2024-02-01 00:00:00' AS still_open
FROM spells""")
def spell_builder(t: Tables) -> DataFrame:
    return purchase_spells(t).select(
        "event_id", "user_id", micros("ts").alias("start_us"), micros("end_ts").alias("end_us"), "next_cents",
        (micros("end_ts") - micros("ts")).alias("duration_us"),
        (F.col("end_ts") >= F.lit(NOW).cast("timestamp_ntz")).alias("still_open"),
    )


KINDS_SQL = """kinds AS (SELECT event_id, user_id, ts, event_type, CAST(round(value * 100) AS BIGINT) AS cents
  FROM events WHERE event_type IN ('purchase', 'error'))"""


@query("spell_excluding_kind", f"""WITH {KINDS_SQL}
SELECT event_id, user_id, epoch_us(coalesce(lead(ts) OVER w, TIMESTAMP '2024-02-01 00:00:00')) AS end_us, lead(cents) OVER w AS next_cents
FROM kinds WHERE event_type <> 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def spell_excluding_kind(t: Tables) -> DataFrame:
    """Errors stand in for loans: they leave before the next move is looked up."""
    spells = build_spells(
        user_events(t, "purchase", "error"), NOW, subject="user_id", ts="ts", tie=["event_id"], end="end_ts",
        carry={"next_cents": "cents"}, exclude=F.col("event_type") == "error", skew=t.skew("events"),
    )
    return spells.select("event_id", "user_id", micros("end_ts").alias("end_us"), "next_cents")


@query("spell_any_kind", f"""WITH {KINDS_SQL}, s AS (
  SELECT *, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '2024-02-01 00:00:00') AS end_ts FROM kinds)
SELECT event_id, user_id, epoch_us(end_ts) AS end_us FROM s
WHERE event_type = 'error' AND epoch_us(end_ts) - epoch_us(ts) >= 86400000000""")
def spell_any_kind(t: Tables) -> DataFrame:
    """Loan-like spells end at the next move of any kind and last at least a day."""
    spells = build_spells(
        user_events(t, "purchase", "error"), NOW, subject="user_id", ts="ts", tie=["event_id"], end="end_ts",
        keep=F.col("event_type") == "error", skew=t.skew("events"),
    )
    return spells.filter(micros("end_ts") - micros("ts") >= 86_400_000_000).select(
        "event_id", "user_id", micros("end_ts").alias("end_us")
    )


@query("window_stats_pre_post", f"""WITH {WINDOWS_SQL}
SELECT event_id, pre_apps, CAST(pre_cents AS BIGINT) AS pre_cents, post_apps, CAST(post_cents AS BIGINT) AS post_cents FROM active""")
def window_stats_pre_post(t: Tables) -> DataFrame:
    start, end = F.col("ts"), F.col("end_ts")
    return window_sums(
        purchase_spells(t), user_events(t, "click", "view"), key=["event_id"], facts_by=["user_id"], ts="ts",
        windows=[
            TimeWindow("pre_", ("user_id",), start - F.expr("INTERVAL 7 DAYS"), start, True, False),
            TimeWindow("post_", ("user_id",), start, end),
        ],
        sums={"apps": F.lit(1), "cents": F.col("cents")}, skew=user_skew(t),
    ).select(
        "event_id", F.col("pre_apps").cast("long"), "pre_cents", F.col("post_apps").cast("long"), "post_cents"
    )


@query("entity_interval_count", f"WITH {WINDOWS_SQL} SELECT event_id, nation, games FROM facts")
def entity_interval_count(t: Tables) -> DataFrame:
    home = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("nation"))
    spells = purchase_spells(t).join(home, "user_id")
    games = window_sums(
        spells, placed_events(t), key=["event_id", "nation"], facts_by=["nation"], ts="ts",
        windows=[TimeWindow("", ("nation",), F.col("ts"), F.col("end_ts"))], sums={"games": F.lit(1)},
        skew=t.skew("events"),
    )
    return games.select("event_id", "nation", F.col("games").cast("long"))


@query("asof_backward_tolerance", """
WITH v AS (SELECT user_id, ts, CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE event_type = 'signup')
SELECT e.event_id, CASE WHEN v.ts >= e.ts - INTERVAL 5 DAY THEN v.cents END AS before_cents
FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN v ON v.user_id = e.user_id AND e.ts >= v.ts""")
def asof_backward_tolerance(t: Tables) -> DataFrame:
    return asof_join(
        user_events(t, "purchase"), user_events(t, "signup"), by=["user_id"], left_on="ts", right_on="ts",
        take={"before_cents": "cents"}, tolerance=dt.timedelta(days=5), right_tie=["event_id"], skew=t.skew("events"),
    ).select("event_id", "before_cents")


@query("asof_nearest_tolerance", """
WITH v AS (SELECT user_id, ts, CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE event_type = 'signup'),
p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
b AS (SELECT p.event_id, v.ts AS bt, v.cents AS bc FROM p ASOF LEFT JOIN v ON v.user_id = p.user_id AND p.ts >= v.ts),
f AS (SELECT p.event_id, v.ts AS ft, v.cents AS fc FROM p ASOF LEFT JOIN v ON v.user_id = p.user_id AND p.ts <= v.ts),
x AS (SELECT p.event_id, CASE WHEN bt >= p.ts - INTERVAL 3 DAY THEN bc END AS bc, CASE WHEN ft <= p.ts + INTERVAL 3 DAY THEN fc END AS fc,
  epoch_us(p.ts) - epoch_us(bt) AS bd, epoch_us(ft) - epoch_us(p.ts) AS fd FROM p JOIN b USING (event_id) JOIN f USING (event_id))
SELECT event_id, CASE WHEN fc IS NULL OR (bc IS NOT NULL AND bd <= fd) THEN bc ELSE fc END AS near_cents FROM x""")
def asof_nearest_tolerance(t: Tables) -> DataFrame:
    return asof_join(
        user_events(t, "purchase"), user_events(t, "signup"), by=["user_id"], left_on="ts", right_on="ts",
        take={"near_cents": "cents"}, direction="nearest", tolerance=dt.timedelta(days=3), right_tie=["event_id"],
        skew=t.skew("events"),
    ).select("event_id", "near_cents")


@query("interval_peak", f"WITH {SPELLS_SQL}, {values_sql()} SELECT event_id, before, after, peak FROM valued")
def interval_peak(t: Tables) -> DataFrame:
    return spell_values(t).select("event_id", "before", "after", "peak")


@query("first_later_match", """
SELECT s.event_id, min(epoch_us(p.ts)) AS next_us, arg_min(CAST(round(p.value * 100) AS BIGINT), (p.ts, p.event_id)) AS next_cents
FROM (SELECT * FROM events WHERE event_type = 'signup') s
LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON p.user_id = s.user_id AND p.ts > s.ts GROUP BY s.event_id""")
def first_later_match(t: Tables) -> DataFrame:
    """The first purchase after each signup."""
    bought = user_events(t, "purchase").withColumn("at", micros("ts"))
    return first_after(
        user_events(t, "signup"), bought, by=["user_id"], left_on="ts", right_on="ts",
        take={"next_us": "at", "next_cents": "cents"}, right_tie=["event_id"], skew=t.skew("events"),
    ).select("event_id", "next_us", "next_cents")


# ---------------------------------------------------------------- baselines

LINES_SQL = """lines AS (
  SELECT l.*, CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS price, CAST(l_quantity AS BIGINT) AS qty,
    c.c_nationkey AS region, c.c_mktsegment AS segment
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey)"""


def lines(t: Tables) -> DataFrame:
    """Line items with the customer's nation and segment, amounts as integers."""
    home = t.customer.select("c_custkey", F.col("c_nationkey").alias("region"), F.col("c_mktsegment").alias("segment"))
    o = t.orders.select("o_orderkey", "o_custkey").join(home, F.col("o_custkey") == F.col("c_custkey"))
    item = t.lineitem.withColumns(
        {
            "disc": F.round(F.col("l_discount") * 100).cast("long"), "tax": F.round(F.col("l_tax") * 100).cast("long"),
            "price": cents("l_extendedprice"), "qty": F.col("l_quantity").cast("long"),
        }
    )
    return item.join(o, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey", "o_custkey", "c_custkey")


CELLS_SQL = LINES_SQL + """,
sums AS (SELECT region, segment, GROUPING(region) AS total, sum(CASE WHEN l_returnflag = 'R' THEN qty ELSE 0 END) AS num, sum(qty) AS den
  FROM lines GROUP BY GROUPING SETS ((region, segment), (segment))),
cells AS (SELECT CASE WHEN total = 1 THEN '_default' ELSE CAST(region AS VARCHAR) END AS region, segment,
  num / greatest(den, 1) * 90.0 AS baseline FROM sums WHERE total = 1 OR den >= 12000)"""


def cell_baselines(t: Tables) -> DataFrame:
    return rate_baselines(
        lines(t).withColumn("region", F.col("region").cast("string")), region="region", group="segment",
        num=F.when(F.col("l_returnflag") == "R", F.col("qty")).otherwise(F.lit(0)), den=F.col("qty"), min_den=12_000,
    )


@query("baseline_grouping_sets", f"WITH {CELLS_SQL} SELECT region, segment, round(baseline, 8) AS baseline FROM cells")
def baseline_grouping_sets(t: Tables) -> DataFrame:
    return cell_baselines(t).select("region", "segment", F.round("baseline", 8).alias("baseline"))


@query("baseline_weighted", f"""WITH {LINES_SQL}, sums AS (
  SELECT region, segment, GROUPING(region) AS total, sum(disc * qty) AS xd, sum(tax * qty) AS xt, sum(qty) AS w, count(*) AS n
  FROM lines GROUP BY GROUPING SETS ((region, segment), (segment)))
SELECT CASE WHEN total = 1 THEN '_default' ELSE CAST(region AS VARCHAR) END AS region, segment,
  CASE WHEN total = 1 OR n >= 450 THEN round(xd / greatest(w, 1), 8) END AS disc,
  CASE WHEN total = 1 OR n >= 450 THEN round(xt / greatest(w, 1), 8) END AS tax FROM sums""")
def baseline_weighted(t: Tables) -> DataFrame:
    table = weighted_baselines(
        lines(t).withColumn("region", F.col("region").cast("string")), ["disc", "tax"],
        region="region", group="segment", weight="qty", min_rows=450,
    )
    return table.select("region", "segment", F.round("disc", 8).alias("disc"), F.round("tax", 8).alias("tax"))


@query("baseline_fallback_lookup", f"""WITH {CELLS_SQL},
asked AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(c_nationkey AS VARCHAR) END AS region,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'OTHER' ELSE c_mktsegment END AS segment
  FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT a.o_orderkey, round(coalesce(f.baseline, d.baseline, (SELECT avg(baseline) FROM cells WHERE region = '_default')), 8) AS baseline
FROM asked a LEFT JOIN cells f ON f.region = a.region AND f.segment = a.segment
LEFT JOIN cells d ON d.region = '_default' AND d.segment = a.segment""")
def baseline_fallback_lookup(t: Tables) -> DataFrame:
    """Null regions and unknown groups exercise both fallbacks."""
    home = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    asked = t.orders.join(home, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("c_nationkey").cast("string")).alias("region"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "OTHER").otherwise(F.col("c_mktsegment")).alias("segment"),
    )
    found = lookup_baseline(asked, cell_baselines(t), region="region", group="segment", take={"baseline": "baseline"})
    return found.select("o_orderkey", F.round("baseline", 8).alias("baseline"))


@query("height_vs_group", """
SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 5) AS centered FROM orders""")
def height_vs_group(t: Tables) -> DataFrame:
    from movelens.operators.baselines import center_by

    fitted = group_means(t.orders, "o_totalprice", "o_orderpriority")
    return center_by(t.orders, "o_totalprice", "o_orderpriority", fitted, "centered").select(
        "o_orderkey", F.round("centered", 5).alias("centered")
    )


# ---------------------------------------------------------------- components

VALUED_SQL = f"""WITH {SPELLS_SQL}, {values_sql()},
ok AS (SELECT * FROM valued WHERE before > 0 AND after IS NOT NULL)"""


def valued(t: Tables) -> DataFrame:
    return spell_values(t).filter((F.col("before") > 0) & F.col("after").isNotNull())


@query("value_growth_blend", VALUED_SQL + f""",
r AS (SELECT event_id, {rank_sql('peak / greatest(before, 1)')} AS rp, {rank_sql('after / greatest(before, 1)')} AS re,
  {rank_sql('peak - before')} AS ap, {rank_sql('after - before')} AS ae FROM ok)
SELECT event_id, round(0.2 * (0.8 * rp + 0.2 * re) + 0.8 * (0.8 * ap + 0.2 * ae), 8) AS value_growth_pct FROM r""")
def value_growth_blend(t: Tables) -> DataFrame:
    df = sc.value_growth(valued(t), ["event_id"], "before", "peak", "after", skew=t.skew("events"))
    return df.select("event_id", F.round("value_growth_pct", 8).alias("value_growth_pct"))


@query("fee_penalty", VALUED_SQL + f""",
o AS (SELECT event_id, {rank_sql('cents / greatest(before, 1) - 1.3')} AS p FROM ok WHERE cents / greatest(before, 1) > 1.3)
SELECT ok.event_id, round(coalesce(o.p, 0.0), 8) AS fee_penalty_pct FROM ok LEFT JOIN o USING (event_id)""")
def fee_penalty(t: Tables) -> DataFrame:
    df = sc.fee_penalty(valued(t), ["event_id"], "cents", "before", skew=t.skew("events"))
    return df.select("event_id", F.round("fee_penalty_pct", 8).alias("fee_penalty_pct"))


@query("decay_weights", f"""WITH {SPELLS_SQL}
SELECT event_id, round(0.02 + (0.20 - 0.02) * exp(-((epoch_us(end_ts) - epoch_us(ts)) / 86400000000.0) / 5.0), 10) AS resale_weight,
  round(0.02 + (0.15 - 0.02) * exp(-((epoch_us(end_ts) - epoch_us(ts)) / 86400000000.0) / 8.0), 10) AS value_weight FROM spells""")
def decay_weights(t: Tables) -> DataFrame:
    days = (micros("end_ts") - micros("ts")) / F.lit(86_400_000_000.0)
    return purchase_spells(t).select(
        "event_id", F.round(decay_weight(days, 0.02, 0.20, 5.0), 10).alias("resale_weight"),
        F.round(decay_weight(days, 0.02, 0.15, 8.0), 10).alias("value_weight"),
    )


SHARE_SQL = """least(least(post_apps + CASE WHEN games >= 15.0 * yrs THEN allow * (1 - exp(-greatest(greatest(games, 1) - post_apps, 0) / allow)) ELSE 0.0 END,
  greatest(games, 1)) / greatest(games, 1), 1.0)"""
AVAIL_SQL = f"""avail AS (SELECT *, {SHARE_SQL} AS share FROM (
  SELECT *, greatest(days / 365.25, 1 / 365.25) AS yrs, 10.0 * greatest(days / 365.25, 1 / 365.25) AS allow FROM (
    SELECT *, (epoch_us(end_ts) - epoch_us(ts)) / 86400000000.0 AS days FROM facts)))"""


def spell_days(t: Tables) -> DataFrame:
    return spell_windows(t).withColumn("days", (micros("end_ts") - micros("ts")) / F.lit(86_400_000_000.0))


@query("availability_forgiveness", f"""WITH {WINDOWS_SQL}, {AVAIL_SQL}
SELECT event_id, round(0.6 * ({rank_sql('round(share, 9)')}) + 0.4 * ({rank_sql('post_apps')}), 8) AS playing_time_pct FROM avail""")
def availability_forgiveness(t: Tables) -> DataFrame:
    """The share is rounded before ranking, so that both engines see the same ties."""
    df = spell_days(t)
    share = F.round(sc.effective_share(F.col("post_apps"), F.col("games"), F.col("days")), 9)
    ranked = pct_ranks(
        df, ["event_id"], [RankSpec("_share", share), RankSpec("_apps", F.col("post_apps"))], skew=t.skew("events")
    )
    return ranked.select("event_id", F.round(sc.availability_blend(), 8).alias("playing_time_pct"))


WEIGHTS_SQL = """weights(k, w_level, w_growth, w_time, w_rating) AS (VALUES
  ('AUTOMOBILE', 0.4, 0.2, 0.2, 0.2), ('BUILDING', 0.1, 0.3, 0.3, 0.3), ('FURNITURE', 0.25, 0.25, 0.25, 0.25),
  ('HOUSEHOLD', 0.0, 0.0, 0.5, 0.5), ('MACHINERY', 0.7, 0.1, 0.1, 0.1))"""
SEGMENT_WEIGHTS = [
    ("AUTOMOBILE", 0.4, 0.2, 0.2, 0.2), ("BUILDING", 0.1, 0.3, 0.3, 0.3), ("FURNITURE", 0.25, 0.25, 0.25, 0.25),
    ("HOUSEHOLD", 0.0, 0.0, 0.5, 0.5), ("MACHINERY", 0.7, 0.1, 0.1, 0.1),
]
# Flagship: level (output against the nation's going rate, by segment), growth,
# playing time and rating (value per activity), missing-aware, with value for
# money and resale blended in by the length of the spell.
SCORE_SQL = f"""WITH {WINDOWS_SQL}, {values_sql("facts")}, {WEIGHTS_SQL},
rates AS (SELECT p.nation, c.c_mktsegment AS segment, sum(CAST(round(p.value * 100) AS BIGINT)) AS num, count(*) AS den
  FROM placed p JOIN customer c ON c.c_custkey = p.user_id WHERE p.event_type IN ('click', 'view') GROUP BY 1, 2),
fine AS (SELECT nation, segment, num / den AS base FROM rates WHERE den >= 25),
coarse AS (SELECT segment, sum(num) / sum(den) AS base FROM rates GROUP BY 1),
elig AS (
  SELECT v.*, (epoch_us(end_ts) - epoch_us(ts)) / 86400000000.0 AS days,
    (post_cents / greatest(post_apps, 1)) / greatest(coalesce(f.base, c.base, (SELECT avg(base) FROM coarse)), 0.05) AS level,
    CASE WHEN post_apps >= 2 THEN post_cents / post_apps END AS rate_
  FROM valued v LEFT JOIN fine f ON f.nation = v.nation AND f.segment = v.segment LEFT JOIN coarse c ON c.segment = v.segment
  WHERE pre_apps >= 1 AND before > 0 AND after IS NOT NULL),
avail AS (SELECT *, round({SHARE_SQL}, 9) AS share FROM (
  SELECT *, greatest(days / 365.25, 1 / 365.25) AS yrs, 10.0 * greatest(days / 365.25, 1 / 365.25) AS allow FROM elig)),
ranks AS (SELECT *, {rank_sql('round(level, 9)', 'segment')} AS level_pct, {rank_sql('share')} AS s_pct, {rank_sql('post_apps')} AS a_pct,
  {rank_sql('peak / greatest(before, 1)')} AS rp, {rank_sql('after / greatest(before, 1)')} AS re,
  {rank_sql('peak - before')} AS ap, {rank_sql('after - before')} AS ae FROM avail),
rated AS (SELECT event_id, {rank_sql('round(rate_, 9)', 'segment')} AS rating_pct FROM avail WHERE rate_ IS NOT NULL),
over_ AS (SELECT event_id, {rank_sql('cents / greatest(before, 1) - 1.3')} AS penalty FROM avail WHERE cents / greatest(before, 1) > 1.3),
sold AS (SELECT event_id, {rank_sql('(next_cents - cents) / greatest(cents, 5000)')} AS resale_pct FROM avail WHERE next_cents > 0),
comp AS (
  SELECT r.event_id, r.user_id, r.segment, r.days, w.*, r.level_pct, t.rating_pct, coalesce(o.penalty, 0.0) AS penalty, s.resale_pct,
    0.2 * (0.8 * rp + 0.2 * re) + 0.8 * (0.8 * ap + 0.2 * ae) AS growth_pct, 0.6 * s_pct + 0.4 * a_pct AS time_pct
  FROM ranks r JOIN weights w ON w.k = r.segment LEFT JOIN rated t USING (event_id) LEFT JOIN over_ o USING (event_id) LEFT JOIN sold s USING (event_id)),
worth AS (SELECT *, round(coalesce((w_level * level_pct + CASE WHEN rating_pct IS NOT NULL THEN w_rating * rating_pct ELSE 0 END)
    / nullif(w_level + CASE WHEN rating_pct IS NOT NULL THEN w_rating ELSE 0 END, 0), level_pct) - penalty, 8) AS worth FROM comp),
vfm AS (SELECT *, {rank_sql('worth')} AS value_pct FROM worth),
others AS (SELECT *, (w_level * level_pct + w_growth * growth_pct + w_time * time_pct + CASE WHEN rating_pct IS NOT NULL THEN w_rating * rating_pct ELSE 0 END)
    / (w_level + w_growth + w_time + CASE WHEN rating_pct IS NOT NULL THEN w_rating ELSE 0 END) AS others_,
  0.02 + 0.13 * exp(-days / 8.0) AS vw, 0.02 + 0.18 * exp(-days / 5.0) AS rw FROM vfm),
scored AS (SELECT event_id, user_id, segment, level_pct, growth_pct, time_pct, rating_pct, value_pct, resale_pct,
  CASE WHEN resale_pct IS NOT NULL THEN others_ * (1 - vw - rw) + vw * value_pct + rw * resale_pct
    ELSE others_ * (1 - vw) + vw * value_pct END AS score FROM others)"""


def scored_spells(t: Tables) -> DataFrame:
    """Every step of the scoring job on purchases; see :data:`SCORE_SQL`."""
    guard = t.skew("events")
    df = spell_values(t, spell_windows(t)).withColumn("days", (micros("end_ts") - micros("ts")) / F.lit(86_400_000_000.0))
    df = df.filter((F.col("pre_apps") >= 1) & (F.col("before") > 0) & F.col("after").isNotNull())
    segment = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    activity = placed_events(t, "click", "view").join(segment, "user_id").withColumn("nation", F.col("nation").cast("string"))
    base = rate_baselines(
        activity, region="nation", group="segment", num=F.col("cents"), den=F.lit(1), scale=1.0, min_den=25, out="base"
    )
    df = lookup_baseline(
        df.withColumn("_n", F.col("nation").cast("string")), base, region="_n", group="segment", take={"base": "base"},
        base_region="nation",
    )
    # Both rank passes read the eligible spells several times.
    df = stage(df, "eligible")
    level = F.round(ratio(per_unit(F.col("post_cents"), F.col("post_apps")), F.col("base"), 0.05), 9)
    rating = F.round(F.when(F.col("post_apps") >= 2, F.col("post_cents") / F.col("post_apps")), 9)
    share = F.round(sc.effective_share(F.col("post_apps"), F.col("games"), F.col("days")), 9)
    ranked = pct_ranks(
        df, ["event_id"],
        [
            RankSpec("level_pct", level, ("segment",)), RankSpec("rating_pct", rating, ("segment",)),
            RankSpec("_share", share), RankSpec("_apps", F.col("post_apps")),
            *sc.growth_specs("before", "peak", "after"), sc.overpay_spec("cents", "before"),
            sc.resale_spec("cents", "next_cents", floor=5000.0, out="resale_pct"),
        ],
        skew=guard,
    )
    names = ("w_level", "w_growth", "w_time", "w_rating")
    weights = t.spark.createDataFrame(SEGMENT_WEIGHTS, "k string, " + ", ".join(f"{n} double" for n in names))
    ranked = ranked.join(F.broadcast(weights), F.col("segment") == F.col("k")).withColumns(
        {"growth_pct": sc.growth_blend(), "time_pct": sc.availability_blend()}
    )
    quality = weighted_known_mean([(F.col("level_pct"), F.col("w_level")), (F.col("rating_pct"), F.col("w_rating"))])
    worth = F.round(F.coalesce(quality, F.col("level_pct")) - F.coalesce("_fee_rank", F.lit(0.0)), 8)
    ranked = stage(ranked.withColumn("_worth", worth), "ranked")
    ranked = pct_ranks(ranked, ["event_id"], [RankSpec("value_pct", F.col("_worth"))], skew=guard)
    others = weighted_known_mean(
        [(F.col(f"{c}_pct"), F.col(f"w_{c}")) for c in ("level", "growth", "time", "rating")]
    )
    vw, rw = decay_weight(F.col("days"), 0.02, 0.15, 8.0), decay_weight(F.col("days"), 0.02, 0.20, 5.0)
    with_resale = others * (1 - vw - rw) + vw * F.col("value_pct") + rw * F.col("resale_pct")
    without = others * (1 - vw) + vw * F.col("value_pct")
    score = F.when(F.col("resale_pct").isNotNull(), with_resale).otherwise(without)
    return ranked.withColumn("score", score).select(
        "event_id", "user_id", "segment", "level_pct", "growth_pct", "time_pct", "rating_pct", "value_pct", "resale_pct", "score"
    )


PCTS = ("level_pct", "growth_pct", "time_pct", "rating_pct", "value_pct", "resale_pct")


@query("spell_score", SCORE_SQL + " SELECT event_id, user_id, segment, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in (*PCTS, "score")) + " FROM scored")
def spell_score(t: Tables) -> DataFrame:
    return scored_spells(t).select("event_id", "user_id", "segment", *[F.round(c, 6).alias(c) for c in (*PCTS, "score")])


@query("missing_aware_composite", SCORE_SQL + """
SELECT segment, count(*) AS n, count(rating_pct) AS n_rated, count(resale_pct) AS n_resold, round(avg(score), 6) AS avg_score FROM scored GROUP BY segment""")
def missing_aware_composite(t: Tables) -> DataFrame:
    return scored_spells(t).groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), F.count("rating_pct").alias("n_rated"), F.count("resale_pct").alias("n_resold"),
        F.round(F.avg("score"), 6).alias("avg_score"),
    )


@query("breakdown_rows", SCORE_SQL + " " + " UNION ALL ".join(
    f"SELECT event_id, {i} AS place, '{c}' AS component, round({c}, 6) AS value FROM scored WHERE {c} IS NOT NULL" for i, c in enumerate(PCTS)))
def breakdown_rows(t: Tables) -> DataFrame:
    entries = F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(c).alias("component"), F.round(c, 6).alias("value")) for i, c in enumerate(PCTS)
    ])
    rows = scored_spells(t).select("event_id", F.explode(entries).alias("e")).select("event_id", "e.*")
    return rows.filter(F.col("value").isNotNull())


@query("quality_violations", SCORE_SQL + """
SELECT 'bounds' AS rule, count(*) FILTER (WHERE NOT (score BETWEEN 0 AND 100)) AS violations FROM scored
UNION ALL SELECT 'level_present', count(*) FILTER (WHERE level_pct IS NULL) FROM scored
UNION ALL SELECT 'resale_matches', count(*) FILTER (WHERE (resale_pct IS NOT NULL) <> (f.next_cents IS NOT NULL AND f.next_cents > 0)) FROM scored JOIN facts f USING (event_id)
UNION ALL SELECT 'rating_high', count(*) FILTER (WHERE rating_pct IS NULL OR rating_pct <= 50) FROM scored""")
def quality_violations(t: Tables) -> DataFrame:
    """Three rules that hold and one that must find violations."""
    nxt = purchase_spells(t).select("event_id", "next_cents")
    return violations(
        scored_spells(t).join(nxt, "event_id"),
        {
            "bounds": F.col("score").between(0, 100),
            "level_present": F.col("level_pct").isNotNull(),
            "resale_matches": F.col("resale_pct").isNotNull() == F.coalesce(F.col("next_cents") > 0, F.lit(False)),
            "rating_high": F.col("rating_pct") > 50,
        },
    )


# ---------------------------------------------------------------- form, seasons, checks


@query("recent_form", """
WITH form AS (SELECT user_id, count(*) AS apps, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events
  WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-15 00:00:00' AND ts <= TIMESTAMP '2024-02-01 00:00:00' GROUP BY 1)
SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN coalesce(apps, 0) END AS recent_apps,
  CASE WHEN c_nationkey < 20 THEN CAST(coalesce(cents, 0) AS BIGINT) END AS recent_cents,
  CASE WHEN c_nationkey < 20 THEN round(coalesce(cents / greatest(apps, 1) * 90, 0), 6) END AS recent_p90
FROM customer LEFT JOIN form ON user_id = c_custkey""")
def recent_form(t: Tables) -> DataFrame:
    """Activity of the last weeks; unknown, not zero, outside the covered nations."""
    recent = user_events(t, "click", "view").filter(
        F.col("ts").between(F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), F.lit(NOW).cast("timestamp_ntz"))
    )
    form = recent.groupBy("user_id").agg(F.count(F.lit(1)).alias("recent_apps"), F.sum("cents").alias("recent_cents"))
    form = form.withColumn("recent_p90", per_unit(F.col("recent_cents"), F.col("recent_apps"), 90))
    joined = t.customer.join(form, F.col("c_custkey") == F.col("user_id"), "left")
    known = null_if_uncovered(joined, ["recent_apps", "recent_cents", "recent_p90"], F.col("c_nationkey") < 20)
    return known.select("c_custkey", "recent_apps", "recent_cents", F.round("recent_p90", 6).alias("recent_p90"))


@query("season_explode", """
WITH s AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a,
  coalesce(CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE), DATE '2001-08-31') AS z FROM orders),
b AS (SELECT o_orderkey, CASE WHEN month(a) >= 8 THEN year(a) ELSE year(a) - 1 END AS y0,
  CASE WHEN month(least(z, DATE '2001-06-30')) >= 8 THEN year(least(z, DATE '2001-06-30')) ELSE year(least(z, DATE '2001-06-30')) - 1 END AS y1 FROM s)
SELECT o_orderkey, CAST(unnest(generate_series(y0, y1)) AS INTEGER) AS season FROM b WHERE y0 <= y1""")
def season_explode(t: Tables) -> DataFrame:
    return explode_seasons(order_spells(t), "a", "z", dt.date(2001, 6, 30)).select("o_orderkey", "season")


def order_spells(t: Tables) -> DataFrame:
    """Orders as spells up to the customer's next order."""
    o = t.orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("a"), "o_orderdate", "o_orderpriority")
    s = build_spells(
        o, dt.date(2001, 8, 31), subject="o_custkey", ts="o_orderdate", tie=["o_orderkey"], end="_z",
        carry={"next_priority": "o_orderpriority"}, skew=t.skew("orders"),
    )
    return s.withColumn("z", F.to_date("_z"))


SEASON_SQL = """
s AS (SELECT o_orderkey, o_orderpriority AS prio, CAST(o_orderdate AS DATE) AS a,
  lead(o_orderpriority) OVER w AS next_prio, lag(o_orderpriority) OVER w AS prev_prio,
  coalesce(CAST(lead(o_orderdate) OVER w AS DATE), DATE '2001-08-31') AS z FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
b AS (SELECT *, CASE WHEN month(a) >= 8 THEN year(a) ELSE year(a) - 1 END AS y0, CASE WHEN month(z) >= 8 THEN year(z) ELSE year(z) - 1 END AS y1 FROM s),
x AS (SELECT *, unnest(generate_series(y0, y1)) AS season FROM b),
clean AS (SELECT * FROM x WHERE NOT coalesce(prev_prio = prio AND month(a) NOT IN (6, 7, 8) AND season = y0, false)
  AND NOT coalesce(next_prio = prio AND month(z) NOT IN (6, 7, 8) AND season = y1, false))"""


def clean_seasons(t: Tables) -> DataFrame:
    """Seasons of order spells; the priority plays the league."""
    from movelens.operators.scan import ordered_scan

    spells = order_spells(t)
    # the previous order's priority is the origin: the latest one seen before this row
    marked = ordered_scan(
        spells.withColumns({"_at": F.lit(0)}).select(*spells.columns, "_at"), ["o_custkey"], ["o_orderdate", "o_orderkey"],
        sums={"_place": F.lit(1)}, skew=t.skew("orders"),
    )
    prior = marked.select(
        F.col("o_custkey").alias("_pc"), (F.col("_place") + 1).alias("_pp"), F.col("o_orderpriority").alias("prev_priority")
    )
    joined = marked.join(prior, (F.col("o_custkey") == F.col("_pc")) & (F.col("_place") == F.col("_pp")), "left")
    seasons = explode_seasons(joined, "a", "z", dt.date(2001, 8, 31))
    return drop_contaminated(
        seasons, joined="a", left="z", league="o_orderpriority", origin="prev_priority", next_league="next_priority"
    )


@query("boundary_exclusion", f"WITH {SEASON_SQL} SELECT o_orderkey, CAST(season AS INTEGER) AS season FROM clean")
def boundary_exclusion(t: Tables) -> DataFrame:
    return clean_seasons(t).select("o_orderkey", "season")


@query("season_stitch", """
WITH rows_ AS (SELECT l_suppkey, year(l_shipdate) AS season, sum(CAST(l_quantity AS BIGINT)) AS minutes, count(*) AS matches,
  sum(CAST(round(l_discount * 100) AS BIGINT)) AS total, CASE WHEN count(*) >= 60 THEN sum(CAST(round(l_tax * 100) AS BIGINT)) / count(*) END AS rate
  FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, count(*) AS seasons_used, CAST(sum(minutes) AS BIGINT) AS total_minutes, CAST(sum(matches) AS BIGINT) AS total_matches,
  CAST(sum(total) AS BIGINT) AS total, round(coalesce(sum(rate * minutes) / nullif(sum(CASE WHEN rate IS NOT NULL THEN minutes END), 0), avg(rate)), 8) AS rate
FROM rows_ GROUP BY 1""")
def season_stitch(t: Tables) -> DataFrame:
    """A supplier's yearly rows to one: a rate known in some years, and a count."""
    item = t.lineitem
    tax = F.sum(F.round(F.col("l_tax") * 100).cast("long")) / F.count(F.lit(1))
    rows = item.groupBy("l_suppkey", F.year("l_shipdate").alias("season")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("minutes_played"), F.count(F.lit(1)).alias("matches_played"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("total"),
        F.when(F.count(F.lit(1)) >= 60, tax).alias("rate"),
    )
    out = stitch(rows, ["l_suppkey"], ["rate"], ["total"], prefix="")
    return out.select("l_suppkey", "seasons_used", "total_minutes", "total_matches", "total", F.round("rate", 8).alias("rate"))


@query("coverage_report", f"""WITH {SEASON_SQL},
covered AS (SELECT o_orderpriority AS prio, season FROM (SELECT o_orderpriority, CASE WHEN month(o_orderdate) >= 8 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS season
  FROM orders WHERE o_orderstatus = 'F' AND month(o_orderdate) = 3) GROUP BY 1, 2),
m AS (SELECT x.o_orderkey, x.prio, c.season IS NOT NULL AS cov, k.o_orderkey IS NULL AS spoiled FROM x
  LEFT JOIN covered c ON c.prio = x.prio AND c.season = x.season LEFT JOIN clean k ON k.o_orderkey = x.o_orderkey AND k.season = x.season),
g AS (SELECT o_orderkey, prio, bool_or(cov) AS cov, bool_or(cov AND spoiled) AS excl, bool_or(cov AND NOT spoiled) AS ok FROM m GROUP BY 1, 2)
SELECT g.prio AS league, count(*) AS n_transfers, count(*) FILTER (WHERE cov) AS n_with_any_season_coverage,
  count(*) FILTER (WHERE cov AND ok) AS n_matched, count(*) FILTER (WHERE excl) AS n_contaminated_excluded,
  count(*) FILTER (WHERE cov AND o.o_totalprice >= 100000 AND NOT ok) AS n_identified_no_data,
  count(*) FILTER (WHERE cov AND NOT o.o_totalprice >= 100000) AS n_unidentified
FROM g JOIN orders o USING (o_orderkey) GROUP BY 1""")
def coverage_report(t: Tables) -> DataFrame:
    """Coverage per priority; orders of at least 100,000 count as identified."""
    from movelens.operators.stitch import coverage_report as report

    clean = clean_seasons(t).select("o_orderkey", "season").withColumn("_kept", F.lit(True))
    every = explode_seasons(order_spells(t), "a", "z", dt.date(2001, 8, 31)).select(
        "o_orderkey", F.col("o_orderpriority").alias("league"), "season"
    )
    lookups = every.join(clean, ["o_orderkey", "season"], "left").withColumn("_spoiled", F.col("_kept").isNull())
    march = t.orders.filter((F.col("o_orderstatus") == "F") & (F.month("o_orderdate") == 3))
    covered = march.select(F.col("o_orderpriority").alias("league"), season_start(F.col("o_orderdate")).alias("season")).distinct()
    found = t.orders.filter(F.col("o_totalprice") >= 100_000).select("o_orderkey")
    have = lookups.filter(~F.col("_spoiled")).join(covered, ["league", "season"], "left_semi").select("o_orderkey").distinct()
    out = report(lookups, covered, found, have, ["o_orderkey"])
    return out.drop("match_rate_of_covered")


@query("burst_distinct", """
WITH d AS (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS d FROM events),
w AS (SELECT a.user_id, a.d, count(DISTINCT b.event_type) AS n FROM d a JOIN d b
  ON b.user_id = a.user_id AND b.d > a.d - 3 AND b.d <= a.d GROUP BY 1, 2)
SELECT user_id, CAST(max(n) AS BIGINT) AS peak FROM w GROUP BY 1 HAVING max(n) >= 4""")
def bursts(t: Tables) -> DataFrame:
    """Users with four or more kinds of events within three days."""
    return burst_distinct(t.events, "user_id", "event_type", "ts", days=3, n=4, skew=t.skew("events"))


@query("duplicate_claims", """
WITH k AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id FROM events)
SELECT k, count(DISTINCT user_id) AS claimants FROM k GROUP BY 1 HAVING count(DISTINCT user_id) >= 2""")
def duplicate_claims(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return shared_ids(t.events.select(k.alias("k"), "user_id"), "k", "user_id")
