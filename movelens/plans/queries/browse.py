"""Queries of the browse layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movelens.functions.numeric import convert, money_label, ordinal, safe_round
from movelens.operators import reports as rp
from movelens.operators.snapshots import entity_total
from movelens.plans.queries.base import DEALS, DEALS_SQL, Tables, day, deals, query
from movelens.plans.queries.deals import RANKED_SQL, ranked

FILTER_SQL = DEALS_SQL + """,
f AS (SELECT * FROM deals WHERE segment = 'MACHINERY' AND fee >= 5000000 AND fee <= 45000000 AND contains(lower(strip_accents(name)), '#0000'))"""


def filtered(t: Tables) -> DataFrame:
    return rp.filter_moves(
        deals(t), position="MACHINERY", q="R#0000", ranges={"fee": (5_000_000, 45_000_000)}, text_columns=("name",),
        position_column="segment",
    )


@query("browse_page", f"WITH {FILTER_SQL} SELECT deal_id, name, strftime(d, '%Y-%m-%d') AS d, fee, score FROM f ORDER BY score DESC, deal_id LIMIT 25 OFFSET 50")
def browse_page(t: Tables) -> DataFrame:
    f = filtered(t)
    order = rp.ordered(f, rp.sort_field("score", ["score", "fee", "d"], "score"), ["deal_id"])
    return rp.page(f, order, 25, 50).select("deal_id", "name", day("d").alias("d"), "fee", "score")


@query("browse_summary", f"WITH {FILTER_SQL} SELECT count(*) AS total, round_even(avg(score), 1) AS avg_score, CAST(coalesce(sum(fee), 0) AS BIGINT) AS total_spent FROM f")
def browse_summary(t: Tables) -> DataFrame:
    return rp.summarise(
        filtered(t), {"avg_score": F.bround(F.avg("score"), 1), "total_spent": F.coalesce(F.sum(rp.paid("fee")), F.lit(0))}
    )


@query("facets", """SELECT s_nationkey AS id, n_name AS name FROM (SELECT DISTINCT s_nationkey FROM supplier) JOIN nation ON n_nationkey = s_nationkey""")
def facets(t: Tables) -> DataFrame:
    names = t.nation.select(F.col("n_nationkey").alias("competition_id"), F.col("n_name").alias("display_name"))
    return rp.facets(t.supplier, "s_nationkey", names)


@query("leaderboard_gated", f"""WITH {RANKED_SQL}, r AS (SELECT buyer AS club_name, count(*) AS n, avg(resale_pct) AS p FROM ranked WHERE next_fee > 0 GROUP BY 1)
SELECT club_name, n AS resales_count, round(p, 6) AS avg_resale_profit_pct FROM r WHERE n >= 3 AND p IS NOT NULL ORDER BY p DESC, club_name LIMIT 10""")
def leaderboard_gated(t: Tables) -> DataFrame:
    cards = rp.report_resale(ranked(t), DEALS)
    gated = rp.gate(cards, "avg_resale_profit_pct", rp.CLUB_RULES)
    top = rp.page(gated, rp.ordered(gated, "avg_resale_profit_pct", ["club_name"]), 10)
    return top.select("club_name", "resales_count", F.round("avg_resale_profit_pct", 6).alias("avg_resale_profit_pct"))


@query("surprise_leaderboard", f"""WITH {DEALS_SQL}, s AS (SELECT *, score - floor(balance / 100) AS delta FROM deals WHERE status <> 'P')
SELECT deal_id, score, delta FROM s ORDER BY abs(delta), deal_id LIMIT 25""")
def surprise_leaderboard(t: Tables) -> DataFrame:
    """The best calls among deals with a prediction (the balance, unknown for status P)."""
    df = deals(t).withColumn("predicted_score", F.when(F.col("status") != "P", F.floor(F.col("balance") / 100)))
    s = rp.with_prediction(df).withColumn("delta", F.col("score") - F.col("predicted_score"))
    s = s.withColumn("abs_delta", F.abs("delta"))
    return rp.page(s, rp.ordered(s, "abs_delta", ["deal_id"], descending=False), 25).select("deal_id", "score", "delta")


@query("search_names", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '#00000012') ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def search_names(t: Tables) -> DataFrame:
    found = rp.search(t.customer, "c_name", "R#00000012", [F.col("c_acctbal").desc(), F.col("c_custkey")])
    return found.select("c_custkey", "c_name")


@query("point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77 AND o_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 77)")
def point_lookup(t: Tables) -> DataFrame:
    return rp.point_lookup(t.orders, o_orderkey=77).select("o_orderkey", "o_custkey", "o_totalprice")


@query("latest_by", f"WITH {DEALS_SQL} SELECT name, buyer, arg_max(deal_id, (d, deal_id)) AS deal_id, strftime(max(d), '%Y-%m-%d') AS d FROM deals GROUP BY 1, 2")
def latest_by(t: Tables) -> DataFrame:
    return rp.latest_by(deals(t), ["name", "buyer"], ["d", "deal_id"], ["deal_id", "d"]).select("name", "buyer", "deal_id", day("d").alias("d"))


@query("kind_breakdown", f"WITH {DEALS_SQL} SELECT status, count(*) AS n FROM deals GROUP BY 1")
def kind_breakdown(t: Tables) -> DataFrame:
    return rp.breakdown(deals(t), "status")


@query("flag_coverage", f"WITH {DEALS_SQL} SELECT count(*) AS n, round(avg(CASE WHEN seller IS NOT NULL THEN 100.0 ELSE 0 END), 6) AS has_seller FROM deals")
def flag_coverage(t: Tables) -> DataFrame:
    c = rp.coverage(deals(t).withColumn("has_seller", F.col("seller").isNotNull()), ["has_seller"])
    return c.select("n", F.round("has_seller", 6).alias("has_seller"))


@query("entity_total", "SELECT c_nationkey, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS total FROM customer GROUP BY 1")
def nation_total(t: Tables) -> DataFrame:
    c = t.customer.withColumn("v", F.round(F.col("c_acctbal") * 100).cast("long"))
    return entity_total(c, "c_nationkey", "v", "total")


@query("top_k_per_group", f"""WITH {DEALS_SQL} SELECT segment, deal_id, score, rank FROM
  (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY score DESC, fee DESC, deal_id) AS rank FROM deals) WHERE rank <= 3""")
def top_k_per_group(t: Tables) -> DataFrame:
    best = rp.top_k(deals(t), ["segment"], [F.col("score").desc(), F.col("fee").desc(), F.col("deal_id")], 3)
    return best.select("segment", "deal_id", "score", F.col("rank").cast("long"))


@query("display_values", """
SELECT o_orderkey, CASE WHEN o_totalprice / 100 > 0 AND round_even(o_totalprice / 100, -3) <= 0 THEN 1000.0 ELSE round_even(o_totalprice / 100, -3) END AS rounded,
  round(o_totalprice * 1.16, 6) AS usd,
  CASE WHEN o_totalprice * 100 < 1000000 THEN '€' || format('{:.1f}', o_totalprice * 100 / 1000000) || 'm' ELSE '€' || format('{:.0f}', o_totalprice * 100 / 1000000) || 'm' END AS label,
  CASE WHEN o_orderkey % 300 = 0 THEN 'free' WHEN (o_orderkey % 300) * 50000 < 1000000 THEN '€' || format('{:.1f}', (o_orderkey % 300) * 50000.0::DOUBLE / 1000000) || 'm'
    ELSE '€' || format('{:.0f}', (o_orderkey % 300) * 50000.0::DOUBLE / 1000000) || 'm' END AS half_label,
  o_orderkey % 200 || CASE WHEN (o_orderkey % 200) % 100 BETWEEN 11 AND 13 THEN 'th' WHEN o_orderkey % 10 = 1 THEN 'st' WHEN o_orderkey % 10 = 2 THEN 'nd' WHEN o_orderkey % 10 = 3 THEN 'rd' ELSE 'th' END AS place
FROM orders""")
def display_values(t: Tables) -> DataFrame:
    """Display rounding, currency, money labels and ordinals."""
    halves = (F.col("o_orderkey") % 300) * 50_000.0  # many lie half-way between two labels
    return t.orders.select(
        "o_orderkey", safe_round(F.col("o_totalprice") / 100, -3).alias("rounded"),
        F.round(convert(F.col("o_totalprice"), F.lit("USD")), 6).alias("usd"), money_label(F.col("o_totalprice") * 100).alias("label"), money_label(halves).alias("half_label"),
        ordinal((F.col("o_orderkey") % 200).cast("double")).alias("place"),
    )
