"""Queries on percentile ranks, quantiles and components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movelens.functions.numeric import interp
from movelens.operators import scoring as sc
from movelens.operators.ranks import exact_quantiles, pct_rank, pct_ranks
from movelens.operators.reports import binned_trend
from movelens.operators.scan import ordered_scan
from movelens.plans.queries.base import DEALS_SQL, RESOLD_SQL, Tables, deals, query, rank_sql, resold, subject_skew
from movelens.plans.queries.spells import LINES_SQL, lines
from movelens.sources.staging import stage


@query("pct_rank_global", f"SELECT o_orderkey, {rank_sql('o_totalprice')} AS pct FROM orders")
def pct_rank_global(t: Tables) -> DataFrame:
    return pct_rank(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "pct").select("o_orderkey", "pct")


@query("pct_rank_group", f"WITH {DEALS_SQL} SELECT deal_id, segment, {rank_sql('score', 'segment')} AS pct FROM deals")
def pct_rank_group(t: Tables) -> DataFrame:
    df = deals(t).select("deal_id", "segment", "score")
    return pct_rank(df, "score", "pct", ["segment"], skew=t.skew("orders")).select("deal_id", "segment", "pct")


@query("pct_rank_conditional", f"""WITH {DEALS_SQL}, f AS (SELECT deal_id, {rank_sql('score')} AS pct FROM deals WHERE status = 'F')
SELECT d.deal_id, coalesce(f.pct, 0.0) AS pct FROM deals d LEFT JOIN f USING (deal_id)""")
def pct_rank_conditional(t: Tables) -> DataFrame:
    df = deals(t).select("deal_id", "status", "score")
    return pct_rank(df, "score", "pct", where=F.col("status") == "F", other=F.lit(0.0)).select("deal_id", "pct")


@query("pct_rank_joint", f"""
WITH u AS (SELECT 'order' AS population, o_orderkey AS id, CAST(floor(o_totalprice / 1000) AS DOUBLE) AS v FROM orders
  UNION ALL SELECT 'part', p_partkey, CAST(floor(p_retailprice / 10) AS DOUBLE) FROM part)
SELECT population, id, {rank_sql('v')} AS pct FROM u""")
def pct_rank_joint(t: Tables) -> DataFrame:
    """Two populations ranked together, told apart by a tag."""
    a = t.orders.select(F.lit("order").alias("population"), F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("v"))
    b = t.part.select(F.lit("part").alias("population"), F.col("p_partkey").alias("id"), F.floor(F.col("p_retailprice") / 10).cast("double").alias("v"))
    return pct_rank(a.unionByName(b), "v", "pct").select("population", "id", "pct")


@query("component_percentiles", f"""WITH {LINES_SQL},
raw AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, region, segment, qty, disc AS a, CASE WHEN l_linestatus = 'O' THEN tax END AS b,
  CASE WHEN l_returnflag = 'R' THEN disc + tax END AS c FROM lines),
cell AS (SELECT region, segment, sum(a * qty) / greatest(sum(CASE WHEN a IS NOT NULL THEN qty END), 1) AS a, count(a) AS na,
  sum(b * qty) / greatest(sum(CASE WHEN b IS NOT NULL THEN qty END), 1) AS b, count(b) AS nb,
  sum(c * qty) / greatest(sum(CASE WHEN c IS NOT NULL THEN qty END), 1) AS c, count(c) AS nc FROM raw GROUP BY 1, 2),
tot AS (SELECT segment, sum(a * qty) / greatest(sum(CASE WHEN a IS NOT NULL THEN qty END), 1) AS a,
  sum(b * qty) / greatest(sum(CASE WHEN b IS NOT NULL THEN qty END), 1) AS b,
  sum(c * qty) / greatest(sum(CASE WHEN c IS NOT NULL THEN qty END), 1) AS c FROM raw GROUP BY 1),
adj AS (SELECT r.*, r.a - coalesce(CASE WHEN na >= 200 THEN cell.a END, tot.a) AS xa, r.b - coalesce(CASE WHEN nb >= 200 THEN cell.b END, tot.b) AS xb,
  r.c - coalesce(CASE WHEN nc >= 200 THEN cell.c END, tot.c) AS xc
  FROM raw r JOIN cell ON cell.region = r.region AND cell.segment = r.segment JOIN tot ON tot.segment = r.segment),
pa AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {rank_sql('xa', 'segment')} AS p FROM adj WHERE xa IS NOT NULL),
pb AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {rank_sql('xb', 'segment')} AS p FROM adj WHERE xb IS NOT NULL),
pc AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {rank_sql('xc', 'segment')} AS p FROM adj WHERE xc IS NOT NULL),
k AS (SELECT raw.*, pa.p AS p1, pb.p AS p2, pc.p AS p3 FROM raw LEFT JOIN pa USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)
  LEFT JOIN pb USING (l_orderkey, l_linenumber, l_partkey, l_suppkey) LEFT JOIN pc USING (l_orderkey, l_linenumber, l_partkey, l_suppkey))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(p1, 6) AS one_pct,
  round((coalesce(p2, 0) + coalesce(p3, 0)) / nullif(CAST(p2 IS NOT NULL AS INT) + CAST(p3 IS NOT NULL AS INT), 0), 6) AS two_pct FROM k""")
def component_percentiles(t: Tables) -> DataFrame:
    """Statistics less their cell's weighted baseline, ranked by segment, averaged per bucket."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    raw = lines(t).select(
        *key, F.col("region").cast("string").alias("region"), "segment", "qty", F.col("disc").alias("a"),
        F.when(F.col("l_linestatus") == "O", F.col("tax")).alias("b"),
        F.when(F.col("l_returnflag") == "R", F.col("disc") + F.col("tax")).alias("c"),
    )
    out = sc.component_pcts(
        stage(raw, "component-rows"), key, {"one": ("a",), "two": ("b", "c")}, region="region", group="segment", weight="qty", min_rows=200,
        skew=t.skew("lineitem"),
    )
    return out.select(*key, F.round("one_pct", 6).alias("one_pct"), F.round("two_pct", 6).alias("two_pct"))


PRIOR_SQL = DEALS_SQL + """,
pp AS (SELECT *, lag(score) OVER (PARTITION BY subject ORDER BY d, deal_id) AS prior FROM deals),
q AS (SELECT * FROM pp WHERE prior IS NOT NULL)"""


def with_prior(t: Tables) -> DataFrame:
    """Deals with the subject's previous score: the row before in the same order."""
    placed = ordered_scan(deals(t), ["subject"], ["d", "deal_id"], lag={"prior": F.col("score")}, skew=subject_skew(t))
    return placed.filter(F.col("prior").isNotNull())


@query("expected_level_residual", f"""WITH {PRIOR_SQL},
f AS (SELECT segment, regr_slope(score, prior) AS b, regr_intercept(score, prior) AS a FROM q GROUP BY 1),
r AS (SELECT deal_id, q.segment, round(score - (a + b * prior), 7) AS res FROM q JOIN f ON f.segment = q.segment)
SELECT deal_id, res AS residual, round({rank_sql('res', 'segment')}, 8) AS pct FROM r""")
def expected_level_residual(t: Tables) -> DataFrame:
    df = sc.expected_level(with_prior(t), "score", "prior", "segment").withColumn(
        "res", F.round(F.col("score") - F.col("expected"), 7)
    )
    ranked = pct_rank(df.select("deal_id", "segment", "res"), "res", "pct", ["segment"], skew=t.skew("orders"))
    return ranked.select("deal_id", F.col("res").alias("residual"), F.round("pct", 8).alias("pct"))


@query("resale_profit", f"""WITH {RESOLD_SQL},
r AS (SELECT deal_id, {rank_sql('(next_fee - fee) / greatest(fee, 10000000)')} AS pct FROM resold WHERE next_fee > 0)
SELECT x.deal_id, x.next_fee, x.next_fee IS NOT NULL AS has_resale, round(r.pct, 8) AS resale_pct FROM resold x LEFT JOIN r USING (deal_id)""")
def resale_profit(t: Tables) -> DataFrame:
    spec = sc.resale_spec("fee", "next_fee", floor=10_000_000.0, out="resale_pct")
    rows = stage(resold(t).select("deal_id", "fee", "next_fee"), "resold-rows")
    df = pct_ranks(rows, ["deal_id"], [spec], skew=t.skew("orders"))
    return df.select("deal_id", "next_fee", F.col("next_fee").isNotNull().alias("has_resale"), F.round("resale_pct", 8).alias("resale_pct"))


def _binned_sql(source: str, x: str, y: str, q: int, by: str | None = None) -> str:
    g = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"JOIN e ON e.{by} = s.{by}" if by else "CROSS JOIN e"
    col = f"s.{by}, " if by else ""
    probs = ", ".join(f"CAST({i} AS DOUBLE) / {q}" for i in range(q + 1))
    return f"""
e AS (SELECT {g}list_distinct(quantile_cont({x}, [{probs}])) AS edges FROM {source} {group}),
b AS (SELECT {col}s.{x} AS x_, s.{y} AS y_, greatest(len(list_filter(e.edges, lambda z: z < s.{x})), 1) AS bin FROM {source} s {join})
SELECT {g}bin, median(x_) AS x, avg(y_) AS avg_y, count(*) AS n FROM b GROUP BY {g}bin"""


@query("binned_trend", "WITH i AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(round(l_discount * 100) AS BIGINT) AS y FROM lineitem), " + _binned_sql("i", "x", "y", 10))
def binned(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100).cast("long").alias("y"))
    return binned_trend(rows, "x", "y", 10).select(F.col("bin").cast("long"), "x", "avg_y", "n")


@query("binned_trend_by_group", f"WITH {DEALS_SQL}, " + _binned_sql("deals", "fee", "score", 6, "segment").replace("median(x_) AS x", "CAST(median(x_) AS DOUBLE) AS x"))
def binned_by_group(t: Tables) -> DataFrame:
    out = binned_trend(deals(t).select("segment", "fee", "score"), "fee", "score", 6, ["segment"], skew=t.skew("orders"))
    return out.select("segment", F.col("bin").cast("long"), F.col("x").cast("double"), "avg_y", "n")


PROBS = ", ".join(f"CAST({i} AS DOUBLE) / 100" for i in range(101))
TABLE_SQL = f"""tab AS (SELECT segment, quantile_cont(score, [{PROBS}]) AS q FROM deals GROUP BY segment HAVING count(*) >= 20)"""


@query("percentile_table", f"""WITH {DEALS_SQL}, {TABLE_SQL}
SELECT segment, CAST(i AS INTEGER) AS place, q[i + 1] AS value FROM tab, (SELECT unnest(generate_series(0, 100)) AS i)""")
def percentile_table(t: Tables) -> DataFrame:
    q = exact_quantiles(deals(t).select("segment", "score"), "score", 100, ["segment"], skew=t.skew("orders"))
    return q.filter(F.col("n") >= 20).select("segment", F.posexplode("q").alias("place", "value"))


@query("interpolated_percentile", f"""WITH {DEALS_SQL}, {TABLE_SQL},
p AS (SELECT d.deal_id, d.balance / 100 AS v, q, len(list_filter(q, lambda z: z <= d.balance / 100)) AS k FROM deals d JOIN tab USING (segment))
SELECT deal_id, round(CASE WHEN k = 0 THEN 0.0 WHEN k >= 101 THEN 100.0 ELSE (k - 1) + (v - q[k]) / (q[k + 1] - q[k]) END, 8) AS pct FROM p""")
def interpolated_percentile(t: Tables) -> DataFrame:
    """Another value placed on the fitted breakpoints."""
    d = deals(t).select("deal_id", "segment", "score", "balance")
    q = exact_quantiles(d, "score", 100, ["segment"], skew=t.skew("orders")).filter(F.col("n") >= 20).select("segment", "q")
    return d.join(q, "segment").select("deal_id", F.round(interp(F.col("balance") / 100, F.col("q")), 8).alias("pct"))

