"""Queries on report cards, trends, flows and careers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movelens.operators import careers as ca
from movelens.operators import reports as rp
from movelens.operators.ranks import pct_ranks
from movelens.operators.scan import ordered_scan
from movelens.operators.scoring import resale_spec
from movelens.plans.queries.base import (
    DEALS, DEALS_SQL, RESOLD_SQL, Tables, day, deals, query, rank_sql, resold, user_events,
)
from movelens.sources.staging import stage

RANKED_SQL = RESOLD_SQL + f""",
rk AS (SELECT deal_id, {rank_sql('(next_fee - fee) / greatest(fee, 10000000)')} AS resale_pct FROM resold WHERE next_fee > 0),
ranked AS (SELECT x.*, rk.resale_pct FROM resold x LEFT JOIN rk USING (deal_id))"""


def ranked(t: Tables) -> DataFrame:
    """Deals with the rank of their resale profit; written once before the ranks, which read them several times."""
    spec = resale_spec("fee", "next_fee", floor=10_000_000.0, out="resale_pct")
    rows = stage(resold(t).drop("status", "priority", "name", "segment", "balance"), "resold-rows")
    return pct_ranks(rows, ["deal_id"], [spec], skew=t.skew("orders"))


@query("report_card_buyer", f"""WITH {DEALS_SQL}
SELECT buyer AS club_name, count(*) AS transfers_in, round(avg(score), 8) AS avg_incoming_score, CAST(sum(fee) AS BIGINT) AS total_spent
FROM deals GROUP BY buyer""")
def report_card_buyer(t: Tables) -> DataFrame:
    return rp.report_in(deals(t), DEALS).select(
        "club_name", "transfers_in", F.round("avg_incoming_score", 8).alias("avg_incoming_score"), "total_spent"
    )


@query("report_card_seller", f"""WITH {DEALS_SQL}
SELECT seller AS club_name, count(*) AS transfers_out, round(avg(score), 8) AS avg_departure_score FROM deals WHERE seller IS NOT NULL GROUP BY seller""")
def report_card_seller(t: Tables) -> DataFrame:
    return rp.report_out(deals(t), DEALS).select(
        "club_name", "transfers_out", F.round("avg_departure_score", 8).alias("avg_departure_score")
    )


@query("report_card_resale", f"""WITH {RANKED_SQL}
SELECT buyer AS club_name, count(*) AS resales_count, round(avg(resale_pct), 6) AS avg_resale_profit_pct, CAST(sum(next_fee - fee) AS BIGINT) AS total_resale_profit
FROM ranked WHERE next_fee > 0 GROUP BY buyer""")
def report_card_resale(t: Tables) -> DataFrame:
    return rp.report_resale(ranked(t), DEALS).select(
        "club_name", "resales_count", F.round("avg_resale_profit_pct", 6).alias("avg_resale_profit_pct"), "total_resale_profit"
    )


@query("report_card_extremes", f"""WITH {RESOLD_SQL},
a AS (SELECT buyer AS club_name, arg_min(deal_id, (-score, deal_id)) AS best_signing, arg_min(deal_id, (score, deal_id)) AS worst_signing FROM deals GROUP BY 1),
b AS (SELECT buyer AS club_name, arg_min(deal_id, (fee - next_fee, deal_id)) AS best_flip, arg_min(deal_id, (next_fee - fee, deal_id)) AS worst_flip FROM resold WHERE next_fee > 0 GROUP BY 1),
c AS (SELECT seller AS club_name, arg_min(deal_id, (-score, deal_id)) AS best_departure, arg_min(deal_id, (score, deal_id)) AS worst_departure FROM deals WHERE seller IS NOT NULL GROUP BY 1)
SELECT a.club_name, best_signing, worst_signing, best_flip, worst_flip, best_departure, worst_departure FROM a JOIN b USING (club_name) JOIN c USING (club_name)""")
def report_card_extremes(t: Tables) -> DataFrame:
    df = resold(t).withColumn("resale_pct", F.lit(None).cast("double"))
    cards = rp.report_in(df, DEALS).join(rp.report_resale(df, DEALS), "club_name").join(rp.report_out(df, DEALS), "club_name")
    fields = ("best_signing", "worst_signing", "best_flip", "worst_flip", "best_departure", "worst_departure")
    return cards.select("club_name", *[F.col(f"{c}.deal_id").alias(c) for c in fields])


MODAL_SQL = """
ml AS (SELECT buyer AS club_name, arg_min(buyer_region, (-n, buyer_region)) AS r FROM (SELECT buyer, buyer_region, count(*) AS n FROM deals GROUP BY 1, 2) GROUP BY 1),
sl AS (SELECT seller AS club_name, arg_min(seller_region, (-n, seller_region)) AS r FROM (SELECT seller, seller_region, count(*) AS n FROM deals WHERE seller IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""
HALF_SQL = """
hp AS (SELECT buyer, score, row_number() OVER (PARTITION BY buyer ORDER BY d, deal_id) AS p, count(*) OVER (PARTITION BY buyer) AS n FROM deals),
half AS (SELECT buyer AS club_name, avg(CASE WHEN p > n // 2 THEN score END) - avg(CASE WHEN p <= n // 2 THEN score END) AS delta FROM hp WHERE n >= 5 GROUP BY 1)"""


@query("report_card_full", f"""WITH {RANKED_SQL}, {MODAL_SQL}, {HALF_SQL},
i AS (SELECT buyer AS club_name, count(*) AS n_in, avg(score) AS s_in, sum(fee) AS spent FROM deals GROUP BY 1),
r AS (SELECT buyer AS club_name, count(*) AS n_r, avg(resale_pct) AS p_r, sum(next_fee - fee) AS profit FROM ranked WHERE next_fee > 0 GROUP BY 1),
o AS (SELECT seller AS club_name, count(*) AS n_out, avg(score) AS s_out FROM deals WHERE seller IS NOT NULL GROUP BY 1)
SELECT club_name, coalesce(ml.r, sl.r) AS league_id, coalesce(n_in, 0) AS transfers_in, round(s_in, 8) AS avg_incoming_score,
  CAST(coalesce(spent, 0) AS BIGINT) AS total_spent, coalesce(n_r, 0) AS resales_count, round(p_r, 6) AS avg_resale_profit_pct,
  CAST(coalesce(profit, 0) AS BIGINT) AS total_resale_profit, coalesce(n_out, 0) AS transfers_out, round(s_out, 8) AS avg_departure_score,
  round(delta, 8) AS score_improvement
FROM i FULL JOIN o USING (club_name) LEFT JOIN r USING (club_name) LEFT JOIN ml USING (club_name) LEFT JOIN sl USING (club_name) LEFT JOIN half USING (club_name)""")
def report_card_full(t: Tables) -> DataFrame:
    cards = rp.report_cards(stage(ranked(t), "ranked-rows"), DEALS, skew=t.skew("orders"))
    return cards.select(
        "club_name", "league_id", F.col("transfers_in").cast("long"), F.round("avg_incoming_score", 8).alias("avg_incoming_score"),
        F.col("total_spent").cast("long"), F.col("resales_count").cast("long"),
        F.round("avg_resale_profit_pct", 6).alias("avg_resale_profit_pct"), F.col("total_resale_profit").cast("long"),
        F.col("transfers_out").cast("long"), F.round("avg_departure_score", 8).alias("avg_departure_score"),
        F.round("score_improvement", 8).alias("score_improvement"),
    )


@query("half_split_improvement", f"WITH {DEALS_SQL}, {HALF_SQL} SELECT club_name, round(delta, 8) AS score_improvement FROM half")
def half_split_improvement(t: Tables) -> DataFrame:
    df = rp.half_split_delta(deals(t), "buyer", ["d", "deal_id"], "score", skew=t.skew("orders"))
    return df.select(F.col("buyer").alias("club_name"), F.round("score_improvement", 8).alias("score_improvement"))


@query("league_summary", f"""WITH {DEALS_SQL}
SELECT buyer_region AS league_id, count(*) AS transfers, round(avg(score), 8) AS avg_score, round(avg(fee), 4) AS avg_fee
FROM deals GROUP BY 1 HAVING count(*) >= 15""")
def league_summary(t: Tables) -> DataFrame:
    return rp.league_summary(deals(t), DEALS).select(
        "league_id", "transfers", F.round("avg_score", 8).alias("avg_score"), F.round("avg_fee", 4).alias("avg_fee")
    )


ERA_SQL = """
yr AS (SELECT *, year(d) AS year FROM deals WHERE year(d) < (SELECT max(year(d)) FROM deals)),
yy AS (SELECT buyer AS league_id, year, count(*) AS n, sum(fee) AS fees, sum(score) AS scores FROM yr GROUP BY 1, 2),
pl AS (SELECT *, row_number() OVER (PARTITION BY league_id ORDER BY year) AS u, count(*) OVER (PARTITION BY league_id) AS a FROM yy),
era AS (SELECT league_id, min(year) FILTER (WHERE u <= 3) AS e0, max(year) FILTER (WHERE u <= 3) AS e1, min(year) FILTER (WHERE u > a - 3) AS r0, max(year) FILTER (WHERE u > a - 3) AS r1,
  sum(fees) FILTER (WHERE u <= 3) / sum(n) FILTER (WHERE u <= 3) AS ef, sum(fees) FILTER (WHERE u > a - 3) / sum(n) FILTER (WHERE u > a - 3) AS rf,
  sum(scores) FILTER (WHERE u <= 3) / sum(n) FILTER (WHERE u <= 3) AS es, sum(scores) FILTER (WHERE u > a - 3) / sum(n) FILTER (WHERE u > a - 3) AS rs
  FROM pl WHERE a >= 6 GROUP BY 1)"""


@query("era_compare", f"""WITH {DEALS_SQL}, {ERA_SQL}
SELECT league_id, e0 || '–' || e1 AS early_years, r0 || '–' || r1 AS recent_years, round(ef, 3) AS early_avg_fee, round(rf, 3) AS recent_avg_fee,
  round((rf - ef) / ef * 100, 6) AS fee_growth_pct, round(rs - es, 6) AS score_change FROM era""")
def era_compare(t: Tables) -> DataFrame:
    from dataclasses import replace

    out = rp.era_compare(deals(t), replace(DEALS, buyer_region="buyer"))
    return out.select(
        "league_id", "early_years", "recent_years", F.round("early_avg_fee", 3).alias("early_avg_fee"),
        F.round("recent_avg_fee", 3).alias("recent_avg_fee"), F.round("fee_growth_pct", 6).alias("fee_growth_pct"),
        F.round("score_change", 6).alias("score_change"),
    )


@query("yearly_min_sample", f"""WITH {DEALS_SQL}
SELECT buyer, year(d) AS year, count(*) AS transfers, round(avg(score), 8) AS avg_score, CAST(sum(fee) AS BIGINT) AS total_spent
FROM deals WHERE year(d) < (SELECT max(year(d)) FROM deals) GROUP BY 1, 2 HAVING count(*) >= 90""")
def yearly_min_sample(t: Tables) -> DataFrame:
    out = rp.yearly(deals(t), "d", {"avg_score": F.avg("score"), "total_spent": F.sum(rp.paid("fee"))}, ["buyer"], min_n=90)
    return out.select("buyer", F.col("year").cast("long"), "transfers", F.round("avg_score", 8).alias("avg_score"), "total_spent")


@query("market_by_year", f"""WITH {DEALS_SQL}
SELECT year(d) AS year, count(*) AS transfers, round(avg(fee), 4) AS avg_fee FROM deals WHERE year(d) < (SELECT max(year(d)) FROM deals) GROUP BY 1""")
def market_by_year(t: Tables) -> DataFrame:
    out = rp.yearly(deals(t), "d", {"avg_fee": F.avg(rp.paid("fee"))})
    return out.select(F.col("year").cast("long"), "transfers", F.round("avg_fee", 4).alias("avg_fee"))


@query("accuracy_by_year", f"""WITH {DEALS_SQL}
SELECT year(d) AS year, round(avg(abs(score - floor(balance / 100))), 8) AS mae, count(*) AS n FROM deals
WHERE year(d) < (SELECT max(year(d)) FROM deals) GROUP BY 1 HAVING count(*) >= 10""")
def accuracy_by_year(t: Tables) -> DataFrame:
    """The customer's balance plays the held-out prediction."""
    df = deals(t).withColumn("delta", F.col("score") - F.floor(F.col("balance") / 100))
    out = rp.yearly(df, "d", {"mae": F.avg(F.abs("delta"))}, min_n=10, count="n")
    return out.select(F.col("year").cast("long"), F.round("mae", 8).alias("mae"), "n")


@query("position_mix", f"""WITH {DEALS_SQL}, c AS (SELECT buyer, segment, count(*) AS transfers FROM deals GROUP BY 1, 2)
SELECT buyer, segment, transfers, round_even(transfers / sum(transfers) OVER (PARTITION BY buyer) * 100, 1) AS pct,
  row_number() OVER (PARTITION BY buyer ORDER BY transfers DESC, segment) AS rank FROM c""")
def position_mix(t: Tables) -> DataFrame:
    return rp.mix(deals(t), "buyer", "segment").select("buyer", "segment", "transfers", "pct", F.col("rank").cast("long"))


@query("mix_scored", f"""WITH {DEALS_SQL}, c AS (SELECT buyer, segment, count(*) AS transfers, avg(score) AS s FROM deals GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT buyer, segment, transfers, round(s, 8) AS avg_score, row_number() OVER (PARTITION BY buyer ORDER BY s DESC, segment) AS rank FROM c""")
def mix_scored(t: Tables) -> DataFrame:
    out = rp.mix_scored(deals(t), "buyer", "segment", "score")
    return out.select("buyer", "segment", "transfers", F.round("avg_score", 8).alias("avg_score"), F.col("rank").cast("long"))


FLOW_SQL = """
pr AS (SELECT seller AS s, buyer AS b, count(*) AS transfers FROM deals WHERE seller IS NOT NULL AND seller <> buyer GROUP BY 1, 2),
bo AS (SELECT b AS league_id, 'buys_from' AS direction, s AS partner, transfers FROM pr UNION ALL SELECT s, 'sells_to', b, transfers FROM pr),
fl AS (SELECT *, row_number() OVER (PARTITION BY league_id, direction ORDER BY transfers DESC, partner) AS rank FROM bo)"""


@query("cross_region_flow", f"WITH {DEALS_SQL}, {FLOW_SQL} SELECT * FROM fl WHERE rank <= 8")
def cross_region_flow(t: Tables) -> DataFrame:
    return rp.flows(deals(t), "seller", "buyer").withColumn("rank", F.col("rank").cast("long"))


def _listed(items: Column, render) -> Column:
    return F.array_join(F.transform(items, render), ";")


@query("league_trends_nested", f"""WITH {DEALS_SQL}, {FLOW_SQL.replace('seller IS NOT NULL AND seller <> buyer', 'seller_region IS NOT NULL AND seller_region <> buyer_region').replace('seller AS s, buyer AS b', 'seller_region AS s, buyer_region AS b')},
y AS (SELECT buyer_region AS id, year(d) AS year, count(*) AS n FROM deals WHERE year(d) < (SELECT max(year(d)) FROM deals) GROUP BY 1, 2 HAVING count(*) >= 5),
m AS (SELECT buyer_region AS id, segment, count(*) AS n FROM deals GROUP BY 1, 2)
SELECT CAST(l.id AS INTEGER) AS league_id, l.n AS transfers,
  (SELECT string_agg(year || ':' || n, ';' ORDER BY year) FROM y WHERE y.id = l.id) AS by_year,
  (SELECT string_agg(partner || ':' || transfers, ';' ORDER BY rank) FROM fl WHERE fl.league_id = l.id AND direction = 'buys_from' AND rank <= 8) AS buys_from,
  (SELECT string_agg(partner || ':' || transfers, ';' ORDER BY rank) FROM fl WHERE fl.league_id = l.id AND direction = 'sells_to' AND rank <= 8) AS sells_to,
  (SELECT string_agg(segment || ':' || n, ';' ORDER BY n DESC, segment) FROM m WHERE m.id = l.id) AS position_mix
FROM (SELECT buyer_region AS id, count(*) AS n FROM deals GROUP BY 1 HAVING count(*) >= 15) l""")
def league_trends_nested(t: Tables) -> DataFrame:
    """League rows with their nested series, rendered as text."""
    out = rp.league_trends(deals(t), DEALS)
    return out.select(
        "league_id", "transfers",
        _listed(F.col("by_year"), lambda x: F.concat_ws(":", x["year"], x["count"])).alias("by_year"),
        _listed(F.col("buys_from"), lambda x: F.concat_ws(":", x["partner"], x["transfers"])).alias("buys_from"),
        _listed(F.col("sells_to"), lambda x: F.concat_ws(":", x["partner"], x["transfers"])).alias("sells_to"),
        _listed(F.col("position_mix"), lambda x: F.concat_ws(":", x["segment"], x["transfers"])).alias("position_mix"),
    )


@query("modal_category", """SELECT l_partkey, arg_min(l_returnflag || l_linestatus, (-n, l_returnflag || l_linestatus)) AS modal
FROM (SELECT l_partkey, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1""")
def modal_category(t: Tables) -> DataFrame:
    df = t.lineitem.select("l_partkey", F.concat("l_returnflag", "l_linestatus").alias("kind"))
    return rp.modal(df, "l_partkey", "kind")


@query("role_override", """WITH m AS (SELECT l_partkey, arg_min(k, (-n, k)) AS role FROM
  (SELECT l_partkey, l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1)
SELECT p_partkey, coalesce(role, p_type) AS role FROM part LEFT JOIN m ON l_partkey = p_partkey""")
def role_override(t: Tables) -> DataFrame:
    """The most frequent category of a part's line items, else its own type."""
    role = rp.modal(t.lineitem, "l_partkey", "l_returnflag", "role").withColumnRenamed("l_partkey", "p_partkey")
    return rp.override_from(t.part.select("p_partkey", "p_type"), "p_partkey", "p_type", role, "role").select(
        "p_partkey", F.col("p_type").alias("role")
    )


@query("index_to_base", f"""WITH {DEALS_SQL}, y AS (SELECT buyer_region, year(d) AS year, count(*) AS transfers, avg(score) AS s
  FROM deals WHERE year(d) < (SELECT max(year(d)) FROM deals) GROUP BY 1, 2)
SELECT buyer_region, year, round(transfers / first_value(transfers) OVER w * 100, 8) AS transfers_index, round(s / first_value(s) OVER w * 100, 8) AS avg_score_index
FROM y WINDOW w AS (PARTITION BY buyer_region ORDER BY year)""")
def index_to_base(t: Tables) -> DataFrame:
    y = rp.yearly(deals(t), "d", {"avg_score": F.avg("score")}, ["buyer_region"])
    out = rp.index_to_base(y, "year", ["transfers", "avg_score"], ["buyer_region"])
    return out.select(
        "buyer_region", F.col("year").cast("long"), F.round("transfers_index", 8).alias("transfers_index"),
        F.round("avg_score_index", 8).alias("avg_score_index"),
    )


@query("share_of_total", f"""WITH {DEALS_SQL}, s AS (SELECT buyer_region, buyer, sum(fee) AS spent FROM deals GROUP BY 1, 2)
SELECT buyer_region, buyer, CAST(spent AS BIGINT) AS spent, round(spent / sum(spent) OVER (PARTITION BY buyer_region) * 100, 8) AS share_pct FROM s""")
def share_of_total(t: Tables) -> DataFrame:
    s = deals(t).groupBy("buyer_region", "buyer").agg(F.sum("fee").alias("spent"))
    return rp.share_of_total(s, "buyer_region", "spent").select("buyer_region", "buyer", "spent", F.round("share_pct", 8).alias("share_pct"))


@query("head_to_head", f"""WITH {RANKED_SQL},
i AS (SELECT buyer AS c, count(*) AS n, avg(score) AS s, sum(fee) AS f FROM deals GROUP BY 1),
r AS (SELECT buyer AS c, avg(resale_pct) AS p FROM ranked WHERE next_fee > 0 GROUP BY 1),
o AS (SELECT seller AS c, count(*) AS n, avg(score) AS s FROM deals WHERE seller IS NOT NULL GROUP BY 1),
m AS (SELECT i.c, unnest([0, 1, 2, 3, 4, 5]) AS place, unnest(['transfers_in', 'avg_incoming_score', 'total_spent', 'avg_resale_profit_pct', 'transfers_out', 'avg_departure_score']) AS metric,
  unnest([CAST(i.n AS DOUBLE), i.s, CAST(i.f AS DOUBLE), r.p, CAST(o.n AS DOUBLE), o.s]) AS v FROM i JOIN r USING (c) JOIN o USING (c)),
pr AS (SELECT * FROM (SELECT n_nationkey AS a, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation) WHERE b IS NOT NULL)
SELECT pr.a, pr.b, CAST(x.place AS INTEGER) AS place, x.metric, round(x.v, 6) AS a_value, round(y.v, 6) AS b_value,
  CASE WHEN x.metric IN ('avg_incoming_score', 'avg_resale_profit_pct') THEN CASE WHEN x.v > y.v THEN pr.a WHEN y.v > x.v THEN pr.b END END AS winner
FROM pr JOIN m x ON x.c = pr.a JOIN m y ON y.c = pr.b AND y.metric = x.metric""")
def head_to_head(t: Tables) -> DataFrame:
    """Every nation against the next one of its region."""
    cards = stage(rp.report_cards(stage(ranked(t), "ranked-rows"), DEALS, skew=t.skew("orders")), "cards")
    pairs = ordered_scan(t.nation, ["n_regionkey"], ["n_nationkey"], lead={"b": F.col("n_nationkey")}, skew=t.skew("nation"))
    pairs = pairs.filter(F.col("b").isNotNull()).select(F.col("n_nationkey").alias("a"), "b")
    return rp.head_to_head(cards, pairs).select(
        "a", "b", "place", "metric", F.round("a_value", 6).alias("a_value"), F.round("b_value", 6).alias("b_value"), "winner"
    )


# ---------------------------------------------------------------- careers

STOPS_SQL = """
stops AS (SELECT o_custkey AS subject, 'order' AS type, o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, CAST(floor(o_totalprice / 5000) AS DOUBLE) AS score FROM orders
  UNION ALL SELECT user_id, 'event', event_id, CAST(ts AS DATE), CAST(floor(value) AS DOUBLE) FROM events WHERE event_type = 'purchase')"""


def stops(t: Tables) -> DataFrame:
    orders = t.orders.select(
        F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"),
        F.floor(F.col("o_totalprice") / 5000).cast("double").alias("success_score"),
    )
    events = user_events(t, "purchase").select(
        F.col("user_id").alias("subject"), F.col("event_id").alias("id"), F.to_date("ts").alias("d"),
        F.floor(F.col("cents") / 100).cast("double").alias("loan_success_score"),
    )
    return ca.timeline(orders, events, ["subject", "id", "d"]).withColumn(
        "type", F.when(F.col("type") == "permanent", "order").otherwise("event")
    )


@query("timeline_union", f"WITH {STOPS_SQL} SELECT subject, type, id, strftime(d, '%Y-%m-%d') AS d, score, c_mktsegment AS segment FROM stops LEFT JOIN customer ON c_custkey = subject")
def timeline_union(t: Tables) -> DataFrame:
    head = t.customer.select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("segment"))
    return stops(t).join(head, "subject", "left").select("subject", "type", "id", day("d").alias("d"), "score", "segment")


@query("merged_timelines", f"""WITH {STOPS_SQL},
pr AS (SELECT * FROM (SELECT c_custkey AS a, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS b FROM customer) WHERE b IS NOT NULL),
sd AS (SELECT a AS pair, 'a' AS side, a AS subject FROM pr UNION ALL SELECT a, 'b', b FROM pr)
SELECT pair, side, row_number() OVER (PARTITION BY pair ORDER BY d, side, type, id) AS place, type, id, strftime(d, '%Y-%m-%d') AS d, score FROM stops JOIN sd USING (subject)""")
def merged_timelines(t: Tables) -> DataFrame:
    """Every customer's career merged with the next one's of the same nation."""
    pairs = ordered_scan(t.customer, ["c_nationkey"], ["c_custkey"], lead={"b": F.col("c_custkey")}, skew=t.skew("customer"))
    pairs = pairs.filter(F.col("b").isNotNull()).select(F.col("c_custkey").alias("pair"), F.col("c_custkey").alias("a"), "b")
    guard = t.skew("orders", "events").times(2)
    merged = ca.merge_careers(stops(t), pairs, "subject", "d", ["type", "id"], guard)
    return merged.select("pair", "side", "place", "type", "id", day("d").alias("d"), "score")


@query("peak_stop", f"WITH {STOPS_SQL} SELECT subject, strftime(arg_min(d, (-score, d)), '%Y-%m-%d') AS d, max(score) AS score FROM stops GROUP BY 1")
def peak_stop(t: Tables) -> DataFrame:
    return ca.peak_stop(stops(t), "subject", "d", "score").select("subject", day("d").alias("d"), "score")


@query("distinct_subjects", """SELECT s.subject, coalesce(c_name, 'user ' || s.subject) AS name FROM
  (SELECT DISTINCT o_custkey AS subject FROM orders UNION SELECT DISTINCT user_id FROM events) s
LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) ON c_custkey = s.subject""")
def distinct_subjects(t: Tables) -> DataFrame:
    named = t.orders.select(F.col("o_custkey").alias("subject")).join(
        t.customer.select(F.col("c_custkey").alias("subject"), F.col("c_name").alias("name")), "subject"
    )
    users = t.events.select(F.col("user_id").alias("subject"), F.concat(F.lit("user "), F.col("user_id")).alias("name"))
    return ca.distinct_subjects([named, users], "subject", "name")


SHAPE_SQL = f"""{STOPS_SQL},
shape AS (SELECT subject, count(*) AS n_stops, arg_min(score, (d, id, score)) AS first_score, arg_max(score, (d, id, score)) AS last_score, avg(score) AS avg_score,
  max(score) - min(score) AS score_range, arg_max(score, (d, id, score)) - arg_min(score, (d, id, score)) AS score_trend, date_diff('day', min(d), max(d)) / 365.25 AS span_years FROM stops GROUP BY 1)"""
SHAPE = ca.SHAPE_FEATURES


def shapes(t: Tables) -> DataFrame:
    return ca.shape_vectors(stops(t), "subject", "d", "score", ["id"])


@query("shape_vectors", f"WITH {SHAPE_SQL} SELECT subject, n_stops, " + ", ".join(f"round({c}, 8) AS {c}" for c in SHAPE[1:]) + " FROM shape")
def shape_vectors(t: Tables) -> DataFrame:
    return shapes(t).select("subject", "n_stops", *[F.round(c, 8).alias(c) for c in SHAPE[1:]])


Z_SQL = SHAPE_SQL + ", z AS (SELECT s.subject, s.n_stops, " + ", ".join(
    f"(s.{c} - avg(s.{c}) OVER ()) / CASE WHEN stddev_samp(s.{c}) OVER () = 0 THEN 1 ELSE stddev_samp(s.{c}) OVER () END AS {c}_z" for c in SHAPE
) + " FROM shape s)"


@query("zscore", f"WITH {Z_SQL} SELECT subject, " + ", ".join(f"round({c}_z, 7) AS {c}_z" for c in SHAPE) + " FROM z")
def zscore(t: Tables) -> DataFrame:
    return ca.zscore(shapes(t), SHAPE).select("subject", *[F.round(f"{c}_z", 7).alias(f"{c}_z") for c in SHAPE])


@query("similar_subjects", f"""WITH {Z_SQL},
q AS (SELECT subject FROM z WHERE n_stops >= 2 AND subject % 50 = 0),
p AS (SELECT a.subject, b.subject AS neighbour, {" + ".join(f"(b.{c}_z - a.{c}_z) * (b.{c}_z - a.{c}_z)" for c in SHAPE)} AS d2
  FROM z a JOIN q USING (subject) JOIN z b ON b.subject <> a.subject)
SELECT subject, rank, neighbour, round(sqrt(d2), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY round(d2, 10), neighbour) AS rank FROM p) WHERE rank <= 5""")
def similar_subjects(t: Tables) -> DataFrame:
    """For every fiftieth subject, the five careers most alike of all."""
    s = shapes(t)
    asked = s.filter(F.col("subject") % 50 == 0).select("subject")
    out = ca.similar_entities(s, "subject", queries=asked)
    return out.select("subject", F.col("rank").cast("long"), "neighbour", F.round("distance", 6).alias("distance"))
