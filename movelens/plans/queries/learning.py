"""Queries on training, prediction, explanation and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movelens.functions.numeric import clip
from movelens.operators import model as md
from movelens.operators import predict as pr
from movelens.operators.baselines import category_baselines, regress
from movelens.operators.folds import fit_folds, predicted
from movelens.operators.reports import binned_trend, nearest_bucket
from movelens.operators.small_side import small_join
from movelens.plans.queries.base import DEALS_SQL, Tables, deals, query
from movelens.plans.queries.ranking import PRIOR_SQL, with_prior
from movelens.sources.staging import stage

NUMERIC = ("log_fee", "balance", "prior", "year")
CATEGORICAL = ("segment", "priority", "buyer_name")


def rows(t: Tables) -> DataFrame:
    """Training rows: score next to price, balance, previous score and categories."""
    return with_prior(t).withColumns(
        {
            "log_fee": F.log1p("fee"), "year": F.year("d").cast("double"),
            "buyer_name": F.concat(F.lit("N"), F.col("buyer").cast("string")),
        }
    )


@query("recency_weights", """
SELECT o_orderkey, round(pow(0.5, (date_diff('day', CAST(o_orderdate AS DATE), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) / 365.25) / 3.0), 10) AS w FROM orders""")
def recency_weights(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return md.recency_weight(o, "d", out="w").select("o_orderkey", F.round("w", 10).alias("w"))


@query("temporal_split", f"""WITH {DEALS_SQL} SELECT deal_id, CASE WHEN d < DATE '2000-06-01' THEN 'train' ELSE 'test' END AS part FROM deals""")
def temporal_split(t: Tables) -> DataFrame:
    past, future = md.temporal_split(deals(t), "d", "2000-06-01")
    return past.select("deal_id", F.lit("train").alias("part")).unionByName(future.select("deal_id", F.lit("test").alias("part")))


@query("infrequent_pooling", """
WITH n AS (SELECT p_name || p_type AS k, count(*) AS n FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN n >= 8 THEN p_name || p_type ELSE '__infrequent__' END AS name_level FROM part JOIN n ON k = p_name || p_type""")
def infrequent_pooling(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", F.concat("p_name", "p_type").alias("name"))
    return md.encode(p, ["name"], md.category_levels(p, ["name"], 8)).select("p_partkey", "name_level")


@query("reference_values", """
SELECT 'o_totalprice' AS stat, CAST(median(o_totalprice) AS DOUBLE) AS median, NULL AS mode FROM orders
UNION ALL SELECT 'score', median(CAST(floor(o_totalprice / 5000) AS DOUBLE)), NULL FROM orders
UNION ALL SELECT 'o_orderpriority', NULL, arg_min(o_orderpriority, (-n, o_orderpriority)) FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
UNION ALL SELECT 'o_orderstatus', NULL, arg_min(o_orderstatus, (-n, o_orderstatus)) FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)""")
def reference_values(t: Tables) -> DataFrame:
    o = t.orders.withColumn("score", F.floor(F.col("o_totalprice") / 5000).cast("double"))
    return pr.reference_values(o, ["o_totalprice", "score"], ["o_orderpriority", "o_orderstatus"], t.skew("orders"))


@query("conditional_references", f"""WITH {DEALS_SQL}
SELECT CAST(median(fee) FILTER (WHERE status = 'F') AS DOUBLE) AS paid_fee, CAST(median(score) FILTER (WHERE status = 'F') AS DOUBLE) AS paid_score,
  round_even(avg(CASE WHEN status <> 'F' THEN 1.0 ELSE 0.0 END), 3) AS free_share FROM deals""")
def conditional_references(t: Tables) -> DataFrame:
    """Medians of one status only, and the share of the others."""
    d = deals(t)
    paid = md.as_struct(md.medians(d.filter("status = 'F'"), ["fee", "score"], skew=t.skew("orders")), ["fee", "score"], "median")
    share = d.agg(F.bround(F.avg((F.col("status") != "F").cast("double")), 3).alias("free_share"))
    return paid.select(F.col("v.fee").alias("paid_fee"), F.col("v.score").alias("paid_score")).withColumn("free_share", share.scalar())


@query("group_references", f"""WITH {DEALS_SQL}, m AS (SELECT segment, CAST(median(fee) AS DOUBLE) AS fee, CAST(median(score) AS DOUBLE) AS score FROM deals GROUP BY 1),
c AS (SELECT segment, arg_min(priority, (-n, priority)) AS priority FROM (SELECT segment, priority, count(*) AS n FROM deals GROUP BY 1, 2) GROUP BY 1)
SELECT segment, fee, score, priority FROM m JOIN c USING (segment)""")
def group_references(t: Tables) -> DataFrame:
    d = stage(deals(t).select("segment", "priority", "fee", "score"), "reference-rows")
    m = md.as_struct(md.medians(d, ["fee", "score"], ["segment"], t.skew("orders")), ["fee", "score"], "median", ["segment"])
    role = pr.modes(d, ["priority"], ["segment"]).select("segment", F.col("mode").alias("priority"))
    return m.join(role, "segment").select("segment", "v.fee", "v.score", "priority")


@query("category_baselines", f"""WITH {DEALS_SQL},
u AS (SELECT 'segment' AS feature, segment AS level, score FROM deals UNION ALL SELECT 'priority', priority, score FROM deals UNION ALL SELECT 'status', status, score FROM deals)
SELECT feature, level, count(*) AS n, round_even(avg(score), 1) AS mean FROM u GROUP BY 1, 2 HAVING count(*) >= 3000""")
def categories(t: Tables) -> DataFrame:
    return category_baselines(deals(t), ["segment", "priority", "status"], "score", 3000)


@query("value_regression", f"""WITH {DEALS_SQL} SELECT round(regr_slope(ln(1 + fee), ln(1 + balance + 2000)), 8) AS slope, round(regr_intercept(ln(1 + fee), ln(1 + balance + 2000)), 7) AS intercept FROM deals WHERE status = 'F'""")
def value_regression(t: Tables) -> DataFrame:
    line = regress(deals(t).filter("status = 'F'"), F.log1p("fee"), F.log1p(F.col("balance") + 2000))
    return line.select(F.round("slope", 8).alias("slope"), F.round("intercept", 7).alias("intercept"))


# ---------------------------------------------------------------- training

# The weighted ridge on two standardised features has a closed form, so SQL
# can check it: two unknowns after centring with the weights.
RIDGE_SQL = PRIOR_SQL + """,
w AS (SELECT *, pow(0.5, (date_diff('day', d, (SELECT max(d) FROM q)) / 365.25) / 3.0) AS wt FROM q),
s AS (SELECT avg(prior) AS mp, stddev_pop(prior) AS dp, avg(balance) AS mb, stddev_pop(balance) AS db FROM w),
z AS (SELECT score AS y, wt, (prior - mp) / dp AS a, (balance - mb) / db AS b FROM w, s),
c AS (SELECT sum(wt * y) / sum(wt) AS my, sum(wt * a) / sum(wt) AS ma, sum(wt * b) / sum(wt) AS mb FROM z),
g AS (SELECT sum(wt * (a - ma) * (a - ma)) + 1 AS aa, sum(wt * (a - ma) * (b - mb)) AS ab, sum(wt * (b - mb) * (b - mb)) + 1 AS bb,
  sum(wt * (a - ma) * (y - my)) AS ay, sum(wt * (b - mb) * (y - my)) AS byy FROM z, c),
k AS (SELECT (ay * bb - byy * ab) / (aa * bb - ab * ab) AS ka, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS kb FROM g)"""


@query("weighted_ridge", f"""WITH {RIDGE_SQL}
SELECT '(intercept)' AS feature, round(my - ka * ma - kb * c.mb, 5) AS coefficient FROM k, c
UNION ALL SELECT 'prior', round(ka, 5) FROM k UNION ALL SELECT 'balance', round(kb, 5) FROM k""")
def weighted_ridge(t: Tables) -> DataFrame:
    df = stage(md.recency_weight(with_prior(t), "d"), "ridge-rows")
    model = md.fit_ridge(df, "score", "recency_weight", ["prior", "balance"])
    return model.coefficients(t.spark).select("feature", F.round("coefficient", 5).alias("coefficient"))


def _folded(t: Tables) -> DataFrame:
    """Deals with their fold and recency weight."""
    df = rows(t).select("deal_id", "d", "score", *NUMERIC, *CATEGORICAL)
    return stage(md.recency_weight(df, "d").withColumn("fold", md.fold_of(["deal_id"])), "folded-rows")


def _ridge_sql(trainings: str, member: str) -> str:
    """CTEs up to ``beta`` (t, ix, v): the ridge of each training set ``t``, from its normal equations by elimination.

    ``member`` tells which rows of ``src`` (with feature columns, y and w) belong to training set ``t``.
    """
    numbers = " UNION ALL ".join(f"SELECT t, deal_id, '{c}' AS f, '' AS lv, ({c} - m_{c}) / CASE WHEN d_{c} = 0 THEN 1 ELSE d_{c} END AS x FROM src, st WHERE true" for c in NUMERIC)
    levels = " UNION ALL ".join(
        f"SELECT c.t, src.deal_id, '{c}', coalesce(l.lv, '{md.POOLED}'), 1.0 FROM trainings c CROSS JOIN src LEFT JOIN lv l ON l.t = c.t AND l.f = '{c}' AND l.lv = src.{c}" for c in CATEGORICAL)
    counts = " UNION ALL ".join(f"SELECT t, '{c}' AS f, {c} AS lv, count(*) AS n FROM trainings, src WHERE {member} GROUP BY ALL" for c in CATEGORICAL)
    return f"""trainings AS ({trainings}),
st AS (SELECT t, {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in NUMERIC)} FROM trainings, src WHERE {member} GROUP BY t),
lv AS (SELECT t, f, lv FROM ({counts}) WHERE n >= {md.fv.MIN_CATEGORY_ROWS}),
ent AS (SELECT t, deal_id, '' AS f, '' AS lv, 1.0::DOUBLE AS x FROM trainings, src UNION ALL {numbers} UNION ALL {levels}),
en AS MATERIALIZED (SELECT e.t, e.deal_id, e.f, e.lv, e.x, src.w, src.y, {member.replace("trainings.", "e.")} AS learn FROM ent e JOIN src USING (deal_id)),
cols AS (SELECT t, f, lv, row_number() OVER (PARTITION BY t ORDER BY f, lv) AS ix FROM (SELECT DISTINCT t, f, lv FROM en WHERE learn)),
at_ AS MATERIALIZED (SELECT en.*, cols.ix FROM en JOIN cols USING (t, f, lv)),
prod AS (SELECT a.t, a.ix AS i, b.ix AS j, sum(a.w * a.x * b.x) AS v FROM at_ a JOIN at_ b ON a.t = b.t AND a.deal_id = b.deal_id WHERE a.learn GROUP BY ALL),
rhs AS (SELECT t, ix AS i, sum(w * x * y) AS v FROM at_ WHERE learn GROUP BY ALL),
cell AS (
  SELECT a.t, a.ix AS i, b.ix AS j, coalesce(p.v, 0) + CASE WHEN a.ix = b.ix AND a.f <> '' THEN {md.fv.RIDGE_ALPHA} ELSE 0 END AS v
  FROM cols a JOIN cols b ON a.t = b.t LEFT JOIN prod p ON p.t = a.t AND p.i = a.ix AND p.j = b.ix
  UNION ALL SELECT t, i, 1000000, v FROM rhs),
mat AS (SELECT t, list(r ORDER BY i) AS m FROM (SELECT t, i, list(v ORDER BY j) AS r FROM cell GROUP BY t, i) GROUP BY t),
elim AS (
  SELECT t, 1 AS k, m FROM mat
  UNION ALL
  SELECT t, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / m[k][k])
    ELSE list_transform(r, lambda x, j: x - r[k] * m[k][j] / m[k][k]) END) FROM elim WHERE k <= len(m)),
beta AS (SELECT t, ix, m[ix][-1] AS v FROM (SELECT t, m, unnest(range(1, len(m) + 1)) AS ix FROM elim WHERE k = len(m) + 1))"""


SRC_SQL = PRIOR_SQL + """,
src AS (SELECT deal_id, ln(1 + fee) AS log_fee, balance, prior, CAST(year(d) AS DOUBLE) AS year, segment, priority, 'N' || buyer AS buyer_name, score AS y,
  pow(0.5, (date_diff('day', d, (SELECT max(d) FROM q)) / 365.25) / 3.0) AS w,
  CAST(('0x' || substr(md5(CAST(deal_id AS VARCHAR)), 1, 8))::BIGINT % 5 AS INTEGER) AS fold FROM q)"""


# The same on two numeric features, where each fold's fit has a closed form.
OOF_SQL = PRIOR_SQL + """,
w AS (SELECT *, pow(0.5, (date_diff('day', d, (SELECT max(d) FROM q)) / 365.25) / 3.0) AS wt,
  CAST(('0x' || substr(md5(CAST(deal_id AS VARCHAR)), 1, 8))::BIGINT % 5 AS INTEGER) AS fold FROM q),
i AS (SELECT unnest([0, 1, 2, 3, 4]) AS i),
s AS (SELECT i, avg(prior) AS mp, stddev_pop(prior) AS dp, avg(balance) AS mb, stddev_pop(balance) AS db FROM w JOIN i ON fold <> i GROUP BY 1),
z AS (SELECT s.i, deal_id, fold, score AS y, wt, (prior - mp) / dp AS a, (balance - mb) / db AS b FROM w, s),
c AS (SELECT i, sum(wt * y) / sum(wt) AS my, sum(wt * a) / sum(wt) AS ma, sum(wt * b) / sum(wt) AS mb FROM z WHERE fold <> i GROUP BY 1),
g AS (SELECT z.i, sum(wt * (a - ma) * (a - ma)) + 1 AS aa, sum(wt * (a - ma) * (b - mb)) AS ab, sum(wt * (b - mb) * (b - mb)) + 1 AS bb,
  sum(wt * (a - ma) * (y - my)) AS ay, sum(wt * (b - mb) * (y - my)) AS byy FROM z JOIN c ON c.i = z.i WHERE fold <> z.i GROUP BY 1),
k AS (SELECT i, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS ka, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS kb FROM g)"""


@query("oof_numeric", f"""WITH {OOF_SQL}
SELECT deal_id, fold, round(greatest(least(my - ka * ma - kb * mb + ka * a + kb * b, 100.0), 0.0), 5) AS predicted
FROM z JOIN c ON c.i = z.i JOIN k ON k.i = z.i WHERE fold = z.i""")
def oof_numeric(t: Tables) -> DataFrame:
    folded = _folded(t)
    models = fit_folds(folded, "score", "recency_weight", ["prior", "balance"], fold="fold")
    return folded.select("deal_id", "fold", F.round(clip(predicted(models, "fold"), 0.0, 100.0), 5).alias("predicted"))


@query("oof_predictions", f"""WITH RECURSIVE {SRC_SQL}, {_ridge_sql("SELECT unnest([0, 1, 2, 3, 4]) AS t", "src.fold <> trainings.t")},
p AS (SELECT at_.deal_id, any_value(at_.y) AS y, any_value(at_.t) AS fold, greatest(least(sum(x * v), 100.0), 0.0) AS p
  FROM at_ JOIN beta USING (t, ix) WHERE NOT learn GROUP BY at_.deal_id)
SELECT deal_id, fold, y AS score, round_even(p, 1) AS predicted_score, round_even(y - round_even(p, 1), 1) AS surprise_delta,
  abs(round_even(y - round_even(p, 1), 1)) AS abs_surprise_delta FROM p""")
def oof_predictions(t: Tables) -> DataFrame:
    """Out-of-fold predictions with numeric and categorical features, all folds from one pass."""
    folded = _folded(t)
    models = fit_folds(folded, "score", "recency_weight", NUMERIC, CATEGORICAL, fold="fold")
    out = folded.select("deal_id", "fold", "score", F.bround(clip(predicted(models, "fold"), 0.0, 100.0), 1).alias("predicted_score"))
    return md.surprise(out, "score")


@query("fold_assignment", f"""WITH {DEALS_SQL} SELECT deal_id, CAST(('0x' || substr(md5(CAST(deal_id AS VARCHAR)), 1, 8))::BIGINT % 5 AS INTEGER) AS fold FROM deals""")
def fold_assignment(t: Tables) -> DataFrame:
    return deals(t).select("deal_id", md.fold_of(["deal_id"]).alias("fold"))


@query("ridge_metrics", f"""WITH {RIDGE_SQL}, p AS (SELECT y, my - ka * ma - kb * c.mb + ka * a + kb * b AS p FROM z, c, k)
SELECT count(*) AS n, round(avg(abs(y - p)), 5) AS mae, round(1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(y)), 5) AS r2,
  round(avg(abs(y - (SELECT avg(y) FROM z))), 5) AS baseline_mae FROM p""")
def ridge_metrics(t: Tables) -> DataFrame:
    df = stage(md.recency_weight(with_prior(t), "d"), "ridge-rows")
    model = md.fit_ridge(df, "score", "recency_weight", ["prior", "balance"])
    m = md.evaluate(df.withColumn("p", model.predict()), "score", "p")
    return m.select("n", *[F.round(c, 5).alias(c) for c in ("mae", "r2", "baseline_mae")])


@query("feature_importance", f"""WITH RECURSIVE {SRC_SQL}, {_ridge_sql("SELECT 0 AS t", "src.fold >= trainings.t")}
SELECT f AS feature, f AS label, round(v, 3) AS coefficient FROM beta JOIN cols USING (t, ix) WHERE f IN ({", ".join(f"'{c}'" for c in NUMERIC)})""")
def feature_importance(t: Tables) -> DataFrame:
    """Coefficients of the numeric features of a fit with categories, by size."""
    model = md.fit_ridge(_folded(t), "score", "recency_weight", NUMERIC, CATEGORICAL)
    return md.feature_importance(model, t.spark)


# ---------------------------------------------------------------- prediction

# Fixed coefficients, so that SQL can state the same model.
MODEL = md.LinearModel(
    50.0,
    {"prior": (4.0, 50.0, 28.0), "log_fee": (12.0, 16.5, 1.0), "balance": (-3.0, 4500.0, 3100.0)},
    {
        "segment": {"AUTOMOBILE": 2.0, "BUILDING": -1.5, "FURNITURE": 0.5, md.POOLED: 0.25},
        "priority": {"1-URGENT": 1.0, "2-HIGH": -2.0, md.POOLED: 0.0},
    },
)
SEG = "CASE {0} WHEN 'AUTOMOBILE' THEN 2.0 WHEN 'BUILDING' THEN -1.5 WHEN 'FURNITURE' THEN 0.5 ELSE 0.25 END"
PRI = "CASE {0} WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN -2.0 ELSE 0.0 END"


def linear_sql(prior: str = "prior", log_fee: str = "log_fee", balance: str = "balance", segment: str = "segment", priority: str = "priority") -> str:
    return (
        f"(50.0 + ({prior} - 50.0) / 28.0 * 4.0 + ({log_fee} - 16.5) / 1.0 * 12.0 + ({balance} - 4500.0) / 3100.0 * -3.0"
        f" + {SEG.format(segment)} + {PRI.format(priority)})"
    )


# Every third deal lacks its previous score, as a subject without recent form.
SCEN_SQL = PRIOR_SQL + """,
med AS (SELECT segment, CAST(median(prior) AS DOUBLE) AS prior, CAST(median(ln(1 + fee)) AS DOUBLE) AS log_fee FROM q GROUP BY 1),
sc AS (SELECT q.deal_id, q.subject, q.segment, q.priority, q.balance, ln(1 + q.fee) AS log_fee, q.deal_id % 3 <> 0 AS has_recent,
  CASE WHEN q.deal_id % 3 <> 0 THEN q.prior ELSE med.prior END AS prior, med.prior AS ref_prior, med.log_fee AS ref_log_fee, 4000.0 AS ref_balance,
  'BUILDING' AS ref_segment, '3-MEDIUM' AS ref_priority FROM q JOIN med ON med.segment = q.segment)"""


def scenario_rows(t: Tables) -> DataFrame:
    """What scenarios need of the deals, written once: the typical values and the scenarios read it."""
    picked = with_prior(t).select("deal_id", "subject", "segment", "priority", "balance", "prior", F.log1p("fee").alias("log_fee"))
    return stage(picked, "scenario-rows")


def scenarios(t: Tables, base: DataFrame | None = None) -> DataFrame:
    """Deals as scenarios, with typical values per segment to compare with."""
    base = scenario_rows(t) if base is None else base
    guard = t.skew("orders")
    med = md.as_struct(md.medians(base, ["prior", "log_fee"], ["segment"], guard), ["prior", "log_fee"], "median", ["segment"])
    med = med.select(F.col("segment").alias("_ms"), F.col("v.prior").alias("ref_prior"), F.col("v.log_fee").alias("ref_log_fee"))
    has = F.col("deal_id") % 3 != 0
    return small_join(base, med, [("segment", "_ms")], "inner").drop("_ms").withColumns(
        {
            "has_recent": has, "prior": F.when(has, F.col("prior")).otherwise(F.col("ref_prior")),
            "ref_balance": F.lit(4000.0), "ref_segment": F.lit("BUILDING"), "ref_priority": F.lit("3-MEDIUM"),
        }
    ).withColumn("point_score", MODEL.predict())


@query("batch_predict", f"WITH {SCEN_SQL} SELECT deal_id, round(greatest(least({linear_sql()}, 100.0), 0.0), 6) AS predicted FROM sc")
def batch_predict(t: Tables) -> DataFrame:
    return scenarios(t).select("deal_id", F.round(clip(F.col("point_score"), 0.0, 100.0), 6).alias("predicted"))


@query("marginalised_predict", f"""WITH {SCEN_SQL}, pf AS (SELECT segment, avg(prior) AS mean_prior FROM q GROUP BY 1)
SELECT deal_id, round(CASE WHEN has_recent THEN {linear_sql()} ELSE {linear_sql(prior='mean_prior', segment='sc.segment')} END, 6) AS raw FROM sc JOIN pf ON pf.segment = sc.segment""".replace(
    linear_sql(), linear_sql(segment="sc.segment")))
def marginalised_predict(t: Tables) -> DataFrame:
    """Without recent form: the mean over all profiles of the segment."""
    base = scenario_rows(t)
    profiles = base.groupBy("segment").agg(F.struct(F.avg("prior").alias("prior")).alias("v"))
    df = pr.marginalise(scenarios(t, base), MODEL, profiles, group="segment", out="raw", features=["prior"])
    return df.select("deal_id", F.round("raw", 6).alias("raw"))


@query("neighbour_range", f"""WITH {PRIOR_SQL},
st AS (SELECT avg(prior) AS m1, stddev_pop(prior) AS d1, avg(balance) AS m2, stddev_pop(balance) AS d2 FROM q),
r AS (SELECT deal_id, score, (prior - m1) / d1 AS a, (balance - m2) / d2 AS b FROM q, st),
n AS (SELECT buyer, (avg(prior) - any_value(m1)) / any_value(d1) AS a, (avg(balance) - any_value(m2)) / any_value(d2) AS b FROM q, st GROUP BY 1),
p AS (SELECT n.buyer, r.score, row_number() OVER (PARTITION BY n.buyer ORDER BY round((r.a - n.a) * (r.a - n.a) + (r.b - n.b) * (r.b - n.b), 12), r.deal_id) AS rn FROM n, r)
SELECT buyer, round_even(min(score), 1) AS range_low, round_even(max(score), 1) AS range_high FROM p WHERE rn <= 5 GROUP BY 1""")
def neighbour_range(t: Tables) -> DataFrame:
    """Each nation's average profile against all deals."""
    df = stage(with_prior(t).select("deal_id", "buyer", "prior", "balance", "score"), "neighbour-rows")
    profile = df.groupBy("buyer").agg(F.avg("prior").alias("prior"), F.avg("balance").alias("balance"))
    return pr.neighbour_range(
        profile, df, md.standard_stats(df, ["prior", "balance"]), query_key="buyer", reference_key="deal_id", score="score"
    )


SWAPS = {
    "form_and_fee": {"prior": "ref_prior", "log_fee": "ref_log_fee"}, "balance": {"balance": "ref_balance"},
    "segment": {"segment": "ref_segment"}, "priority": {"priority": "ref_priority"},
}
CONTRIB_SQL = SCEN_SQL + f""",
cb AS (SELECT deal_id, subject, unnest(['form_and_fee', 'balance', 'segment', 'priority']) AS factor, unnest([
  round_even(((prior - 50.0) / 28.0 * 4.0 - (ref_prior - 50.0) / 28.0 * 4.0) + ((log_fee - 16.5) / 1.0 * 12.0 - (ref_log_fee - 16.5) / 1.0 * 12.0), 1) + 0.0,
  round_even((balance - 4500.0) / 3100.0 * -3.0 - (ref_balance - 4500.0) / 3100.0 * -3.0, 1) + 0.0,
  round_even({SEG.format('segment')} - {SEG.format('ref_segment')}, 1) + 0.0, round_even({PRI.format('priority')} - {PRI.format('ref_priority')}, 1) + 0.0]) AS contribution,
  {linear_sql()} AS base FROM sc)"""


@query("loo_explanation", f"""WITH {CONTRIB_SQL},
rk AS (SELECT *, row_number() OVER (PARTITION BY deal_id ORDER BY abs(contribution) DESC, factor) AS rank FROM cb)
SELECT deal_id, factor, contribution, rank, rank <= 2 AS shown, round_even(sum(CASE WHEN rank > 2 THEN contribution ELSE 0 END) OVER (PARTITION BY deal_id), 1) + 0.0 AS other_total FROM rk""")
def loo_explanation(t: Tables) -> DataFrame:
    e = pr.explain(scenarios(t), MODEL, SWAPS, ["deal_id"], top=2)
    return e.select("deal_id", "factor", "contribution", F.col("rank").cast("long"), "shown", "other_total")


@query("sensitivity", f"""WITH {SCEN_SQL},
g AS (SELECT deal_id, has_recent, 'prior' AS feature, prior AS actual, least(prior + 15.0, 95.0) AS target, round_even((least(prior + 15.0, 95.0) - prior) / 28.0 * 4.0, 1) AS gain FROM sc
  UNION ALL SELECT deal_id, true, 'balance', balance, balance * 1.25, round_even(balance * 0.25 / 3100.0 * -3.0, 1) FROM sc WHERE balance > 0
  UNION ALL SELECT deal_id, true, 'log_fee', log_fee, log_fee * 1.25, round_even(log_fee * 0.25 * 12.0, 1) FROM sc)
SELECT deal_id, row_number() OVER (PARTITION BY deal_id ORDER BY gain DESC, feature) AS rank, feature, round(target, 6) AS target, gain FROM g
WHERE gain > 0 AND target > actual AND has_recent""")
def sensitivity(t: Tables) -> DataFrame:
    s = pr.sensitivity(
        scenarios(t), MODEL, ["deal_id"], {"prior": F.col("has_recent")}, features=["prior", "balance", "log_fee"], composites=["prior"]
    )
    return s.select("deal_id", F.col("rank").cast("long"), "feature", F.round("target", 6).alias("target"), "gain")


@query("factor_spread", f"""WITH {CONTRIB_SQL}, f AS (SELECT subject, factor, round_even(max(contribution) - min(contribution), 1) + 0.0 AS spread, arg_min(deal_id, (-contribution, deal_id)) AS winner FROM cb GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY subject ORDER BY spread DESC, factor) AS rank FROM f""")
def factor_spread(t: Tables) -> DataFrame:
    """A customer's deals compared factor by factor."""
    e = pr.explain(scenarios(t), MODEL, SWAPS, ["subject", "deal_id"])
    return pr.factor_spread(e, ["subject"], "deal_id").withColumn("rank", F.col("rank").cast("long"))


@query("verdict", f"""WITH {SCEN_SQL}, p AS (SELECT subject, deal_id, round_even(greatest(least({linear_sql()}, 100.0), 0.0), 1) AS s FROM sc),
r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY s DESC, deal_id) AS rn FROM p)
SELECT subject, max(deal_id) FILTER (WHERE rn = 1) AS winner, max(s) FILTER (WHERE rn = 1) AS best_score, max(deal_id) FILTER (WHERE rn = 2) AS runner_up,
  round_even(max(s) FILTER (WHERE rn = 1) - max(s) FILTER (WHERE rn = 2), 1) AS gap,
  coalesce(round_even(max(s) FILTER (WHERE rn = 1) - max(s) FILTER (WHERE rn = 2), 1) < 3, false) AS toss_up FROM r WHERE rn <= 2 GROUP BY 1""")
def verdict(t: Tables) -> DataFrame:
    df = scenarios(t).withColumn("predicted_score", F.bround(clip(F.col("point_score"), 0.0, 100.0), 1))
    return pr.verdict(df, ["subject"], "deal_id", "predicted_score").drop("second_score")


@query("nearest_bucket", f"""WITH {DEALS_SQL},
e AS (SELECT list_distinct(quantile_cont(score, [{', '.join(f'CAST({i} AS DOUBLE) / 10' for i in range(11))}])) AS edges FROM deals),
b AS (SELECT score, balance, greatest(len(list_filter(e.edges, lambda z: z < score)), 1) AS bin FROM deals, e),
t AS (SELECT bin, median(score) AS x, avg(floor(balance)) AS y FROM b GROUP BY 1),
n AS (SELECT d.deal_id, floor(d.balance) AS s, (SELECT arg_min(t.y, (abs(t.x - d.balance / 100), t.x, t.y)) FROM t) AS trend_avg FROM deals d)
SELECT deal_id, round(trend_avg, 6) AS trend_avg, CASE WHEN abs(s - trend_avg) < 2 THEN 'in line with' WHEN s > trend_avg THEN 'above' ELSE 'below' END AS lands FROM n""")
def buckets(t: Tables) -> DataFrame:
    """Each deal's balance against the trend bucket nearest to a hundredth of it."""
    d = deals(t).withColumns({"whole": F.floor("balance").cast("double"), "at": F.col("balance") / 100})
    trend = binned_trend(d.select("score", "whole"), "score", "whole", 10).select("x", "avg_y")
    out = nearest_bucket(d, trend, "at", "whole")
    return out.select("deal_id", F.round("trend_avg", 6).alias("trend_avg"), "lands")


@query("scenario_validation", """
WITH s AS (SELECT c_custkey, c_acctbal / 250.0 AS age_at_transfer, 150.0 + c_custkey % 70 AS height_in_cm, CASE WHEN c_custkey % 7 = 0 THEN 4 WHEN c_custkey % 7 = 1 THEN 5 ELSE 0 END AS given FROM customer)
SELECT c_custkey, (CASE WHEN age_at_transfer < 15 OR age_at_transfer > 42 THEN 1 ELSE 0 END) + (CASE WHEN height_in_cm > 210 THEN 1 ELSE 0 END)
  + (CASE WHEN given = 4 THEN 1 ELSE 0 END) AS n_reasons FROM s""")
def scenario_validation(t: Tables) -> DataFrame:
    """Customers as scenarios that break none, one or several of the rules."""
    some = F.col("c_custkey") % 7
    recent = {c: F.when((some == 1) | ((some == 0) & F.lit(i > 0)), F.lit(1.0)) for i, c in enumerate(md.fv.RECENT_FEATURES)}
    df = t.customer.withColumns(
        {
            "age_at_transfer": F.col("c_acctbal") / 250.0, "height_in_cm": 150.0 + F.col("c_custkey") % 70, "transfer_fee": F.lit(0.0),
            "value_before": F.lit(1.0), "from_total_market_value": F.lit(0.0), "to_total_market_value": F.lit(0.0),
            **{c: F.lit("x") for c in md.fv.CATEGORICAL_FEATURES}, **recent,
        }
    )
    return pr.validate_scenarios(df).select("c_custkey", F.size("reasons").alias("n_reasons"))
