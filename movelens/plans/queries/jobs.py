"""The whole scoring job on the driver's tables, with its steps.

Reading of the tables: a customer is a player, an order a move between two
nations (one a day), a line item a run of appearances around its move and a
valuation, an order also a game of two nations, a region a league. Dates are
moved forward so that they fall into the scope of the job.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movelens import fixed_values as fv
from movelens.operators import quality as qa
from movelens.operators import scoring as sc
from movelens.operators import snapshots as sn
from movelens.operators.spells import candidate_moves, loan_spells, permanent_spells
from movelens.plans.queries.base import Tables, day, query
from movelens.plans.queries.base import rank_sql as bare_rank_sql
from movelens.plans.scoring import Scored, league_baselines, run_scoring
from movelens.schemas import RAW_TABLES
from movelens.sources.staging import stage
from movelens.sources.tables import attach_type, load_types, with_backfill

NOW = dt.date(2019, 3, 1)
LEAGUES = ("GB1", "ES1", "IT1", "L1", "FR1")

# Columns of moves, in SQL that both engines read; k is the order, price its total.
FROM_CLUB = "(k * 3 + player_id) % 25"
TO_CLUB = "CASE WHEN k % 83 = 0 THEN NULL ELSE (k * 7 + player_id * 5) % 25 END"
FEE = "CASE WHEN k % 6 = 0 THEN CAST(0 AS DOUBLE) WHEN k % 41 = 0 THEN NULL ELSE price * 100 END"
LISTED = "CASE WHEN k % 9 = 0 THEN NULL ELSE price * 80 END"
FEED_KIND = "CASE WHEN k % 4 = 1 THEN 'loan' WHEN k % 6 = 0 THEN 'free' ELSE 'paid' END"
FEED_TEXT = "CASE WHEN k % 4 <> 1 THEN '' WHEN k % 20 = 1 THEN 'End of loan' ELSE 'loan transfer' END"
MANUAL, IN_FEED = "k % 31 = 0", "k % 31 <> 0 AND k % 13 <> 0"
HAND_KIND = "CASE WHEN k % 62 = 0 THEN 'loan' ELSE '' END"
LEAGUE = "CASE n_regionkey " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LEAGUES)) + " END"
POSITION = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Attack' WHEN 'BUILDING' THEN 'Midfield' WHEN 'FURNITURE' THEN 'Defender' WHEN 'HOUSEHOLD' THEN 'Goalkeeper' ELSE CASE WHEN c_custkey % 2 = 0 THEN 'Midfield' ELSE 'Missing' END END"
ROLE = "CASE WHEN c_custkey % 3 = 0 THEN 'Right-Back' END"
FIELDED = "CASE o_orderkey % 5 WHEN 0 THEN 'Left Winger' WHEN 1 THEN 'midfield' WHEN 2 THEN 'Centre-Back' WHEN 3 THEN 'Attacking Midfield' END"
HEIGHT = "CASE WHEN c_custkey % 19 <> 0 THEN CAST(170 + c_custkey % 25 AS DOUBLE) END"
WORTH = "CASE WHEN c_acctbal >= -500 THEN (c_acctbal + 1000) * 1500 END"
RUN = "1 + CAST(l_quantity AS BIGINT) % 10"
SHIFT = "CAST(i * 11 + l_linenumber * 23 + l_partkey % 17 - 150 AS INT)"


def raw_tables(t: Tables) -> dict[str, DataFrame]:
    """Input tables of the scoring job."""
    first = t.orders.groupBy(F.col("o_custkey").alias("player_id"), F.date_add(F.to_date("o_orderdate"), 6500).alias("transfer_date")).agg(F.min("o_orderkey").alias("k"))
    moves = first.join(t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price")), "k").selectExpr(
        "k", "player_id", "transfer_date", f"{FROM_CLUB} AS from_club_id", f"{TO_CLUB} AS to_club_id", f"{FEE} AS transfer_fee",
        f"{LISTED} AS market_value_in_eur", "CAST(NULL AS STRING) AS player_name",
    ).withColumns({f"{s}_club_name": F.concat(F.lit("NATION_"), F.col(f"{s}_club_id")) for s in ("from", "to")})
    lines = t.lineitem.join(moves.select("k", "player_id", "transfer_date", "from_club_id", "to_club_id"), F.col("l_orderkey") == F.col("k"))
    clubs = t.nation.selectExpr("CAST(n_nationkey AS BIGINT) AS club_id", "n_name AS name", f"CASE WHEN n_nationkey <> 24 THEN {LEAGUE} END AS domestic_competition_id")
    played = lines.withColumn("i", F.explode(F.expr(f"sequence(1, {RUN})"))).withColumn("date", F.expr(f"date_add(transfer_date, {SHIFT})"))
    played = played.withColumns({
        "player_club_id": F.expr("CASE WHEN date < transfer_date THEN from_club_id ELSE to_club_id END"),
        "appearance_id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "i"),
        "goals": F.expr("(l_partkey + i) % 3"), "assists": F.expr("(l_suppkey + i) % 2"), "minutes_played": F.expr("30 + (l_partkey + 7 * i) % 61")})
    fixes = played.filter("i = 1 AND l_orderkey % 17 = 0").select(
        "appearance_id", F.col("to_club_id").alias("wrong_club_id"), F.col("from_club_id").alias("correct_club_id")).distinct()
    played = played.join(clubs.selectExpr("club_id AS player_club_id", "domestic_competition_id AS competition_id"), "player_club_id", "left")
    tables = {
        "transfers": moves.filter(f"NOT ({MANUAL})"),
        "manual_transfers": moves.filter(MANUAL).withColumns({"transfer_type": F.expr(HAND_KIND), "fee_raw": F.lit("")}),
        "transfer_types": moves.filter(IN_FEED).withColumns({"transfer_type": F.expr(FEED_KIND), "fee_raw": F.expr(FEED_TEXT)}),
        "game_lineups": t.orders.selectExpr("o_custkey AS player_id", f"{FIELDED} AS position"),
        "players": t.customer.selectExpr(
            "c_custkey AS player_id", "c_name AS name", "date_add(DATE '1978-01-01', CAST(c_custkey * 37 % 9000 AS INT)) AS date_of_birth",
            f"{POSITION} AS position", f"{ROLE} AS sub_position", "CASE WHEN c_custkey % 7 <> 0 THEN 'right' END AS foot", f"{HEIGHT} AS height_in_cm",
            "CASE WHEN c_custkey % 50 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS current_club_id", "CONCAT('NATION_', c_nationkey) AS current_club_name",
            f"{WORTH} AS market_value_in_eur").join(
                clubs.selectExpr("club_id AS current_club_id", "domestic_competition_id AS current_club_domestic_competition_id"), "current_club_id", "left"),
        "clubs": clubs, "appearances": played,
        "games": t.orders.selectExpr("o_orderkey AS game_id", "CASE WHEN o_orderkey % 89 <> 0 THEN date_add(to_date(o_orderdate), 6503) END AS date"),
        "club_games": t.orders.selectExpr("o_orderkey AS game_id", "explode(array(o_orderkey % 25, (o_orderkey * 11 + 5) % 25)) AS club_id"),
        "player_valuations": lines.selectExpr(
            "player_id", "date_add(transfer_date, CAST(l_partkey % 500 - 250 AS INT)) AS date", "CASE WHEN l_suppkey % 37 <> 0 THEN l_extendedprice * 900 END AS market_value_in_eur"),
        "manual_appearance_corrections": fixes,
    }
    return {n: df.select(*[F.col(f.name).cast(f.dataType) for f in RAW_TABLES[n].fields]) for n, df in tables.items()}


def scored_job(t: Tables) -> Scored:
    return run_scoring(t.spark, raw_tables(t), NOW, skew=t.skew("lineitem").times(12))


def rank_sql(value: str, by: str = "") -> str:
    return f"({bare_rank_sql(value, by)})"


def half_even_sql(x: str) -> str:
    """``x`` with one decimal, halves to the even side; a product that only rounds to a half is told from one."""
    return (f"CASE WHEN ({x}) * 10 - floor(({x}) * 10) = 0.5 AND ({x}) <> (floor(({x}) * 10) + 0.5) / 10 "
            f"THEN (floor(({x}) * 10) + CASE WHEN ({x}) > (floor(({x}) * 10) + 0.5) / 10 THEN 1 ELSE 0 END) / 10 ELSE round_even({x}, 1) END")


def _weights_sql(name: str, components: tuple[str, ...], positions: Mapping, roles: Mapping) -> str:
    rows = [f"('{level}', '{k}', {', '.join(f'{float(x)}::DOUBLE' for x in w)})" for level, table in (("p", positions), ("s", roles)) for k, w in table.items() if not k.startswith("_")]
    return f"{name}(lv, wk, {', '.join(f'w_{c}' for c in components)}) AS (VALUES {', '.join(rows)})"


MOVES_SQL = f"""
mv AS (SELECT k, player_id, transfer_date, {FROM_CLUB} AS from_club_id, {TO_CLUB} AS to_club_id, {FEE} AS transfer_fee, {LISTED} AS market_value_in_eur,
    CASE WHEN {MANUAL} THEN CASE WHEN k % 62 = 0 THEN 'loan' ELSE 'unknown' END WHEN {IN_FEED} THEN {FEED_KIND} ELSE 'unknown' END AS transfer_type,
    CASE WHEN {IN_FEED} THEN {FEED_TEXT} ELSE '' END AS fee_raw
  FROM (SELECT o_custkey AS player_id, CAST(o_orderdate AS DATE) + 6500 AS transfer_date, min(o_orderkey) AS k FROM orders GROUP BY 1, 2)
  JOIN (SELECT o_orderkey, o_totalprice AS price FROM orders) ON o_orderkey = k),
cand AS (SELECT * FROM mv WHERE transfer_date BETWEEN DATE '2013-01-01' AND DATE '{NOW}' AND from_club_id <> to_club_id),
sp AS (
  SELECT 'permanent' AS population, player_id, transfer_date, from_club_id, to_club_id, transfer_fee, market_value_in_eur,
    coalesce(lead(transfer_date) OVER w, DATE '{NOW}') AS tenure_end, lead(transfer_fee) OVER w AS next_fee
  FROM cand WHERE transfer_type <> 'loan' WINDOW w AS (PARTITION BY player_id ORDER BY transfer_date, from_club_id, to_club_id)
  UNION ALL
  SELECT * EXCLUDE (transfer_type, fee_raw) FROM (
    SELECT 'loan', player_id, transfer_date, from_club_id, to_club_id, transfer_fee, market_value_in_eur, coalesce(lead(transfer_date) OVER w, DATE '{NOW}') AS e,
      CAST(NULL AS DOUBLE), transfer_type, fee_raw FROM cand WINDOW w AS (PARTITION BY player_id ORDER BY transfer_date, from_club_id, to_club_id))
  WHERE transfer_type = 'loan' AND fee_raw <> 'End of loan' AND e - transfer_date >= 14)"""

KEY4 = "population, player_id, transfer_date, from_club_id, to_club_id"
PERSONS_SQL = f"""
clubs AS (SELECT n_nationkey AS club_id, CASE WHEN n_nationkey <> 24 THEN {LEAGUE} END AS league FROM nation),
fielded AS (SELECT o_custkey AS player_id, {FIELDED.replace("'midfield'", "'Midfield'")} AS r FROM orders),
roles AS (SELECT player_id, arg_min(r, (-n, r)) AS r FROM (SELECT player_id, r, count(*) AS n FROM fielded WHERE r IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
players AS (SELECT c_custkey AS player_id, c_name AS name, DATE '1978-01-01' + CAST(c_custkey * 37 % 9000 AS INT) AS born, {POSITION} AS position, coalesce(roles.r, {ROLE}) AS sub_position,
    {HEIGHT} AS height_in_cm, CASE WHEN c_custkey % 50 <> 0 THEN c_nationkey END AS current_club_id, {WORTH} AS worth
  FROM customer LEFT JOIN roles ON roles.player_id = c_custkey)"""
PLAYERS_SQL = f"""{PERSONS_SQL},
lines AS (SELECT * FROM lineitem JOIN mv ON l_orderkey = k),
app0 AS (SELECT *, transfer_date + {SHIFT} AS date FROM (SELECT *, unnest(range(1, {RUN} + 1)) AS i FROM lines)),
app1 AS (SELECT player_id, date, CASE WHEN date < transfer_date THEN from_club_id ELSE to_club_id END AS club0, from_club_id, to_club_id, l_orderkey, i,
    (l_partkey + i) % 3 AS goals, (l_suppkey + i) % 2 AS assists, 30 + (l_partkey + 7 * i) % 61 AS minutes FROM app0),
app AS (SELECT app1.*, CASE WHEN i = 1 AND l_orderkey % 17 = 0 AND club0 = to_club_id THEN from_club_id ELSE club0 END AS club, league
  FROM app1 LEFT JOIN clubs ON club_id = club0),
cells AS (SELECT league, position, sum(goals + assists) AS ga, sum(minutes) AS m FROM app LEFT JOIN players USING (player_id) GROUP BY 1, 2),
fine AS (SELECT league, position, ga / greatest(m, 1) * 90 AS b FROM cells WHERE m >= 5000 AND league IS NOT NULL AND position IS NOT NULL),
coarse AS (SELECT position, sum(ga) / greatest(sum(m), 1) * 90 AS b FROM cells WHERE position IS NOT NULL GROUP BY 1)"""

FACTS_SQL = f"""
val AS (SELECT player_id, transfer_date + CAST(l_partkey % 500 - 250 AS INT) AS date, CASE WHEN l_suppkey % 37 <> 0 THEN l_extendedprice * 900 END AS v FROM lines),
known AS (SELECT * FROM val WHERE v IS NOT NULL),
game AS (SELECT CASE WHEN o_orderkey % 89 <> 0 THEN CAST(o_orderdate AS DATE) + 6503 END AS date, unnest([o_orderkey % 25, (o_orderkey * 11 + 5) % 25]) AS club FROM orders),
pre AS (SELECT {", ".join(f"s.{c}" for c in KEY4.split(", "))}, count(*) AS pre_apps, sum(minutes) AS pre_minutes, sum(goals) AS pre_goals, sum(assists) AS pre_assists
  FROM sp s JOIN app a ON a.player_id = s.player_id AND a.club = s.from_club_id AND a.date >= s.transfer_date - 365 AND a.date < s.transfer_date GROUP BY ALL),
post AS (SELECT {", ".join(f"s.{c}" for c in KEY4.split(", "))}, count(*) AS post_apps, sum(minutes) AS post_minutes, sum(goals) AS post_goals, sum(assists) AS post_assists
  FROM sp s JOIN app a ON a.player_id = s.player_id AND a.club = s.to_club_id AND a.date > s.transfer_date AND a.date <= s.tenure_end GROUP BY ALL),
w AS (SELECT sp.*, coalesce(pre_apps, 0) AS pre_apps, coalesce(pre_minutes, 0) AS pre_minutes, coalesce(pre_goals, 0) AS pre_goals, coalesce(pre_assists, 0) AS pre_assists,
    coalesce(post_apps, 0) AS post_apps, coalesce(post_minutes, 0) AS post_minutes, coalesce(post_goals, 0) AS post_goals, coalesce(post_assists, 0) AS post_assists
  FROM sp LEFT JOIN pre USING ({KEY4}) LEFT JOIN post USING ({KEY4})
  WHERE coalesce(pre_apps, 0) >= 10 AND coalesce(post_apps, 0) >= CASE WHEN population = 'permanent' THEN 10 ELSE 0 END),
tg AS (SELECT {", ".join(f"w.{c}" for c in KEY4.split(", "))}, count(*) AS games FROM w JOIN game g ON g.club = w.to_club_id AND g.date > w.transfer_date AND g.date <= w.tenure_end GROUP BY ALL),
bef AS (SELECT {", ".join(f"w.{c}" for c in KEY4.split(", "))}, arg_max(v, (date, v)) AS b FROM w JOIN known ON known.player_id = w.player_id AND date <= w.transfer_date AND date >= w.transfer_date - 730 GROUP BY ALL),
aft AS (SELECT {KEY4}, v AS a FROM (SELECT {", ".join(f"w.{c}" for c in KEY4.split(", "))}, v, row_number() OVER (
    PARTITION BY {", ".join(f"w.{c}" for c in KEY4.split(", "))} ORDER BY abs(date - w.tenure_end), date, CASE WHEN date <= w.tenure_end THEN -v ELSE v END) AS rn
  FROM w JOIN known ON known.player_id = w.player_id AND abs(date - w.tenure_end) <= 400) WHERE rn = 1),
pk AS (SELECT {", ".join(f"w.{c}" for c in KEY4.split(", "))}, max(v) AS p FROM w JOIN known ON known.player_id = w.player_id AND date > w.transfer_date AND date <= w.tenure_end GROUP BY ALL),
worth AS (SELECT current_club_id AS club, sum(worth) AS total FROM players WHERE current_club_id IS NOT NULL GROUP BY 1),
f0 AS (
  SELECT w.*, pl.name, pl.position, pl.sub_position, pl.height_in_cm, coalesce(games, 0) AS games, coalesce(b, market_value_in_eur) AS value_before, a AS value_after,
    CASE WHEN p IS NULL THEN a WHEN a IS NULL THEN p ELSE greatest(p, a) END AS value_peak, w.tenure_end - w.transfer_date AS days, w.tenure_end >= DATE '{NOW}' AS still,
    (w.transfer_date - born) / 365.25 AS age, cf.league AS from_league, ct.league AS to_league, vf.total AS from_total, vt.total AS to_total,
    (pre_goals + pre_assists) / greatest(pre_minutes, 1) * 90 AS pre_ga, (post_goals + post_assists) / greatest(post_minutes, 1) * 90 AS post_ga
  FROM w LEFT JOIN players pl USING (player_id) LEFT JOIN tg USING ({KEY4}) LEFT JOIN bef USING ({KEY4}) LEFT JOIN aft USING ({KEY4}) LEFT JOIN pk USING ({KEY4})
  LEFT JOIN clubs cf ON cf.club_id = w.from_club_id LEFT JOIN clubs ct ON ct.club_id = w.to_club_id
  LEFT JOIN worth vf ON vf.club = w.from_club_id LEFT JOIN worth vt ON vt.club = w.to_club_id),
f1 AS (
  SELECT f0.*, coalesce(x.b, g.b, (SELECT avg(b) FROM coarse)) AS from_base, coalesce(y.b, g.b, (SELECT avg(b) FROM coarse)) AS to_base
  FROM f0 LEFT JOIN fine x ON x.league = from_league AND x.position = f0.position LEFT JOIN fine y ON y.league = to_league AND y.position = f0.position
  LEFT JOIN coarse g ON g.position = f0.position
  WHERE age BETWEEN 15 AND 42 AND value_before > 0 AND value_after IS NOT NULL AND f0.position IN ({", ".join(f"'{p}'" for p in fv.POSITION_WEIGHTS if not p.startswith("_"))})),
f AS (SELECT *, pre_ga / greatest(from_base, 0.05) AS pre_level, post_ga / greatest(to_base, 0.05) AS post_level, greatest(days / 365.25, 1 / 365.25) AS years FROM f1),
ln AS (SELECT population, position, regr_slope(post_level, pre_level) AS slope, regr_intercept(post_level, pre_level) AS icpt FROM f GROUP BY 1, 2),
e AS (
  SELECT f.*, icpt + slope * pre_level AS expected, post_level - (icpt + slope * pre_level) AS residual, greatest(games, 1) AS total,
    CASE WHEN games >= 15.0 * years THEN (10.0 * years) * (1 - exp(-greatest(greatest(games, 1) - post_apps, 0) / (10.0 * years))) ELSE 0.0 END AS forgiven,
    value_peak / greatest(value_before, 1) AS g1, value_after / greatest(value_before, 1) AS g2, value_peak - value_before AS g3, value_after - value_before AS g4,
    coalesce(transfer_fee, 0.0) / greatest(value_before, 1.0) AS paid, coalesce(transfer_fee, 0.0) AS fee0
  FROM f JOIN ln USING (population, position)),
e2 AS (SELECT *, least(least(post_apps + forgiven, total) / total, 1.0) AS share FROM e),
r AS (
  SELECT *, {rank_sql("post_level", "population, position")} AS perf_level_pct, {rank_sql("residual", "population, position")} AS perf_delta_pct,
    0.2 * (0.8 * {rank_sql("g1", "population")} + 0.2 * {rank_sql("g2", "population")}) + 0.8 * (0.8 * {rank_sql("g3", "population")} + 0.2 * {rank_sql("g4", "population")}) AS value_growth_pct,
    0.6 * {rank_sql("share", "population")} + 0.4 * {rank_sql("post_apps", "population")} AS playing_time_pct
  FROM e2)"""

P_WEIGHTS = _weights_sql("pw", fv.COMPONENTS, fv.POSITION_WEIGHTS, fv.SUB_POSITION_WEIGHTS)
L_WEIGHTS = _weights_sql("lw", fv.LOAN_COMPONENTS, fv.LOAN_POSITION_WEIGHTS, fv.LOAN_SUB_POSITION_WEIGHTS)
SHARED = ("perf_level", "perf_delta", "value_growth", "playing_time")
OTHERS = f"({' + '.join(f'{c}_pct * w_{c}' for c in SHARED)}) / nullif({' + '.join(f'w_{c}' for c in SHARED)}, 0)"
PERMANENT_SQL = f"""{MOVES_SQL}, {PLAYERS_SQL}, {FACTS_SQL}, {P_WEIGHTS},
fr AS (SELECT {KEY4}, {rank_sql("greatest(paid - 1.3, 0.0)")} AS fee_rank FROM r WHERE population = 'permanent' AND paid > 1.3),
rr AS (SELECT {KEY4}, {rank_sql("(next_fee - fee0) / greatest(fee0, 1000000.0)")} AS resale_profit_pct FROM r WHERE population = 'permanent' AND next_fee > 0),
wt AS (
  SELECT r.*, fee_rank, resale_profit_pct, {", ".join(f"coalesce(n.w_{c}, b.w_{c}) AS w_{c}" for c in fv.COMPONENTS)}
  FROM r JOIN pw b ON b.lv = 'p' AND b.wk = r.position LEFT JOIN pw n ON n.lv = 's' AND n.wk = r.sub_position LEFT JOIN fr USING ({KEY4}) LEFT JOIN rr USING ({KEY4})
  WHERE population = 'permanent'),
vm AS (SELECT *, CASE WHEN w_perf_level > 0 THEN (perf_level_pct * w_perf_level) / w_perf_level ELSE perf_level_pct END - coalesce(fee_rank, 0.0) AS worth_ FROM wt),
vr AS (SELECT *, {rank_sql("worth_")} AS value_for_money_pct, {OTHERS} AS others, 0.02 + (0.15 - 0.02) * exp(-(days / 365.25) / 3.0) AS vw,
    0.02 + (0.20 - 0.02) * exp(-(days / 365.25) / 2.0) AS rw, coalesce(next_fee > 0, false) AS resold FROM vm),
raws AS (SELECT *, CASE WHEN resold THEN others * (1 - vw - rw) + vw * value_for_money_pct + rw * resale_profit_pct ELSE others * (1 - vw) + vw * value_for_money_pct END AS raw_score FROM vr),
done AS (SELECT *, {half_even_sql("raw_score")} AS success_score FROM raws)"""
LOAN_SQL = f"""{MOVES_SQL}, {PLAYERS_SQL}, {FACTS_SQL}, {L_WEIGHTS},
wt AS (SELECT r.*, {", ".join(f"coalesce(n.w_{c}, b.w_{c}) AS w_{c}" for c in fv.LOAN_COMPONENTS)}
  FROM r JOIN lw b ON b.lv = 'p' AND b.wk = r.position LEFT JOIN lw n ON n.lv = 's' AND n.wk = r.sub_position WHERE population = 'loan'),
raws AS (SELECT *, {OTHERS} AS raw_score FROM wt),
done AS (SELECT *, {half_even_sql("raw_score")} AS loan_success_score FROM raws)"""

# output column -> expression of the twin
COMMON = {
    "player_id": "player_id", "transfer_date": "strftime(transfer_date, '%Y-%m-%d')", "name": "name", "position": "position", "sub_position": "sub_position",
    "from_club_name": "'NATION_' || from_club_id", "to_club_name": "'NATION_' || to_club_id", "from_domestic_competition_id": "from_league", "to_domestic_competition_id": "to_league",
    "pre_apps": "pre_apps", "pre_minutes": "pre_minutes", "pre_goals": "pre_goals", "pre_assists": "pre_assists", "post_apps": "post_apps", "post_minutes": "post_minutes",
    "post_goals": "post_goals", "post_assists": "post_assists", "team_games_in_tenure": "games", "tenure_days": "days"}
COUNTS = ("pre_apps", "pre_minutes", "pre_goals", "pre_assists", "post_apps", "post_minutes", "post_goals", "post_assists", "team_games_in_tenure", "tenure_days")
ROUNDED = {
    "age_at_transfer": "age", "height_in_cm": "height_in_cm", "transfer_fee": "transfer_fee", "value_before": "value_before", "value_after": "value_after", "value_peak": "value_peak",
    "pre_ga_p90": "pre_ga", "pre_goals_p90": "pre_goals / greatest(pre_minutes, 1) * 90", "pre_mins_per_app": "pre_minutes / greatest(pre_apps, 1) * 1.0", "post_ga_p90": "post_ga",
    "from_league_ga_baseline": "from_base", "to_league_ga_baseline": "to_base", "pre_ga_p90_vs_league": "pre_level", "post_ga_p90_vs_league": "post_level",
    "expected_post_ga_p90_vs_league": "expected", "pct_team_games_played": "least(post_apps / greatest(games, 1), 1.0)",
    "perf_level_pct": "perf_level_pct", "perf_delta_pct": "perf_delta_pct", "value_growth_pct": "value_growth_pct", "playing_time_pct": "playing_time_pct"}
MORE = {
    "fee_to_value_ratio": "transfer_fee / greatest(value_before, 1)", "club_quality_ratio": "to_total / greatest(from_total, 1)", "from_total_market_value": "from_total",
    "to_total_market_value": "to_total", "next_transfer_fee": "next_fee", "resale_weight": "rw", "value_for_money_weight": "vw", "value_for_money_pct": "value_for_money_pct",
    "resale_profit_pct": "resale_profit_pct"}


def _picked(rounded: Mapping[str, str], last: Mapping[str, str]) -> str:
    parts = [f"{e} AS {c}" if c not in COUNTS else f"CAST({e} AS BIGINT) AS {c}" for c, e in COMMON.items()]
    return ", ".join([*parts, *[f"round({e}, 6) AS {c}" for c, e in rounded.items()], *[f"{e} AS {c}" for c, e in last.items()]])


def _shown(df: DataFrame, rounded: Mapping[str, str], last: Mapping[str, str]) -> DataFrame:
    parts = [day("transfer_date").alias(c) if c == "transfer_date" else F.col(c).cast("long").alias(c) if c in COUNTS else F.col(c) for c in COMMON]
    return df.select(*parts, *[F.round(c, 6).alias(c) for c in rounded], *last)


LAST_MOVES = {"still_at_club": "still", "has_resale_data": "resold", "has_rating_data": "false", "success_score": "success_score"}
LAST_LOANS = {"still_on_loan": "still", "has_fotmob_data": "false", "loan_success_score": "loan_success_score"}


@query("scoring_moves", f"WITH {PERMANENT_SQL} SELECT {_picked(ROUNDED | MORE, LAST_MOVES)} FROM done")
def scoring_moves(t: Tables) -> DataFrame:
    """Scored permanent moves of the whole job."""
    return _shown(scored_job(t).moves, ROUNDED | MORE, LAST_MOVES)


@query("scoring_loans", f"WITH {LOAN_SQL} SELECT {_picked(ROUNDED, LAST_LOANS)} FROM done")
def scoring_loans(t: Tables) -> DataFrame:
    """Scored loans of the whole job."""
    return _shown(scored_job(t).loans, ROUNDED, LAST_LOANS)


@query("scoring_baselines", f"""WITH {MOVES_SQL}, {PLAYERS_SQL}
SELECT league AS competition_id, position, round(b, 8) AS ga_p90_baseline FROM fine UNION ALL SELECT '_default', position, round(b, 8) FROM coarse""")
def scoring_baselines(t: Tables) -> DataFrame:
    """League baselines that the job stores."""
    raw = raw_tables(t)
    baselines = league_baselines(raw["appearances"], raw["players"])
    return baselines.select("competition_id", "position", F.round("ga_p90_baseline", 8).alias("ga_p90_baseline"))


@query("scoring_spells", f"WITH {MOVES_SQL} SELECT population, player_id, strftime(transfer_date, '%Y-%m-%d') AS transfer_date, from_club_id, to_club_id, strftime(tenure_end, '%Y-%m-%d') AS tenure_end, next_fee FROM sp")
def scoring_spells(t: Tables) -> DataFrame:
    """Permanent and loan spells from fed, hand-kept and typed moves."""
    raw, guard = raw_tables(t), t.skew("orders")
    moves = candidate_moves(with_backfill(raw["transfers"], raw["manual_transfers"]), NOW)
    moves = attach_type(moves, load_types(raw["transfer_types"], raw["manual_transfers"]))
    columns = ("player_id", day("transfer_date").alias("transfer_date"), "from_club_id", "to_club_id", day("tenure_end").alias("tenure_end"))
    kept = permanent_spells(moves, NOW, guard).select(F.lit("permanent").alias("population"), *columns, F.col("next_transfer_fee").alias("next_fee"))
    return kept.unionByName(loan_spells(moves, NOW, guard).select(F.lit("loan").alias("population"), *columns, F.lit(None).cast("double").alias("next_fee")))


def _breakdown_sql(loan: bool) -> str:
    keeper = f"position = '{fv.KEEPER}'"
    shown = {"value_for_money": "true", "value_growth": "true", "resale_profit": "resold", "perf_level": f"NOT ({keeper})", "perf_delta": f"NOT ({keeper})", "playing_time": "true"}
    order = ["value_for_money", "value_growth", "resale_profit", "perf_level", "perf_delta", "attacking", "possession", "defensive", "rating", "playing_time"]
    if loan:
        order = [c for c in order if c not in ("value_for_money", "resale_profit")]
    return " UNION ALL ".join(
        f"SELECT {str(loan).lower()} AS loan, player_id, strftime(transfer_date, '%Y-%m-%d') AS transfer_date, from_club_id, to_club_id, {i} AS place, '{c}' AS component, {half_even_sql(c + '_pct')} AS value FROM done WHERE {shown[c]}"
        for i, c in enumerate(order) if c in shown)


@query("scoring_breakdown", f"""WITH a AS (WITH {PERMANENT_SQL} {_breakdown_sql(False)}), b AS (WITH {LOAN_SQL} {_breakdown_sql(True)})
SELECT loan, player_id, transfer_date, 'NATION_' || to_club_id AS to_club_name, place, component, value FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def scoring_breakdown(t: Tables) -> DataFrame:
    """Shown components of every scored move and loan."""
    done = scored_job(t)
    parts = [sc.breakdown_rows(df, ["player_id", "transfer_date", "to_club_name"], loan).withColumn("loan", F.lit(loan)) for df, loan in ((done.moves, False), (done.loans, True))]
    return parts[0].unionByName(parts[1]).select("loan", "player_id", day("transfer_date").alias("transfer_date"), "to_club_name", "place", "component", "value")


@query("scoring_quality", f"""WITH {PERMANENT_SQL}
SELECT 'success_score_in_bounds' AS rule, count(*) FILTER (WHERE coalesce(NOT (success_score BETWEEN 0 AND 100), true)) AS violations FROM done
UNION ALL SELECT 'resale_profit_pct_in_bounds', count(*) FILTER (WHERE resale_profit_pct IS NOT NULL AND NOT (resale_profit_pct BETWEEN 0 AND 100)) FROM done
UNION ALL SELECT 'value_growth_pct_in_bounds', count(*) FILTER (WHERE coalesce(NOT (value_growth_pct BETWEEN 0 AND 60), true)) FROM done
UNION ALL SELECT 'has_resale_data_matches', count(*) FILTER (WHERE resold <> (resale_profit_pct IS NOT NULL)) FROM done
UNION ALL SELECT 'has_rating_data_matches', 0
UNION ALL SELECT 'pre_level_ratio', count(*) FILTER (WHERE abs(pre_level - pre_ga / greatest(from_base, 0.05)) > 1e-6) FROM done
UNION ALL SELECT 'post_level_ratio', count(*) FILTER (WHERE abs(post_level - post_ga / greatest(to_base, 0.05)) > 1e-6) FROM done
UNION ALL SELECT 'share_of_games', 0
UNION ALL SELECT 'peak_not_below_end', count(*) FILTER (WHERE coalesce(value_peak < value_after, true)) FROM done
UNION ALL SELECT 'weights_sum', count(*) FILTER (WHERE abs({" + ".join(f"w_{c}" for c in fv.COMPONENTS)} - 1) > 1e-6) FROM pw
UNION ALL SELECT 'recomposition', count(*) FILTER (WHERE abs(success_score - (others * (1 - vw - CASE WHEN resold THEN rw ELSE 0 END) + vw * value_for_money_pct + CASE WHEN resold THEN rw * resale_profit_pct ELSE 0 END)) > 0.15) FROM done""")
def scoring_quality(t: Tables) -> DataFrame:
    """Violations of the rules for scored moves; one rule is set so that rows break it."""
    moves, weights = stage(scored_job(t).moves, "scored-moves"), sc.load_weights(t.spark)  # read by two rules' jobs
    rules = {
        **qa.bounds(["success_score"]), **qa.bounds(["resale_profit_pct"], nullable=True), **qa.bounds(["value_growth_pct"], hi=60.0),
        **qa.flag_iff_value({"has_resale_data": "resale_profit_pct", "has_rating_data": "rating_pct"}), **qa.derived_rules()}
    counted = {"weights_sum": qa.check_weights(weights), "recomposition": qa.check_recomposition(moves, weights, ["player_id"])}
    out = qa.violations(moves, rules)
    for rule, bad in counted.items():
        out = out.unionByName(bad.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("violations")))
    return out


SNAPSHOT_SQL = f"""{MOVES_SQL}, {PLAYERS_SQL},
mine AS (SELECT a.player_id, count(*) AS apps, sum(minutes) AS minutes, sum(goals) AS goals, sum(assists) AS assists
  FROM app a JOIN players p ON p.player_id = a.player_id AND a.club = p.current_club_id AND a.date BETWEEN DATE '{NOW}' - 365 AND DATE '{NOW}' WHERE worth >= 1000000 GROUP BY 1),
snap AS (SELECT p.player_id, p.worth, p.position, p.sub_position, p.height_in_cm, p.current_club_id, (DATE '{NOW}' - born) / 365.25 AS age_now, c.league, c.league IS NOT NULL AND c.league IN ({", ".join(f"'{x}'" for x in fv.COVERED_LEAGUES)}) AS cov,
    coalesce(apps, 0) AS apps, coalesce(minutes, 0) AS minutes, coalesce(goals, 0) AS goals, coalesce(assists, 0) AS assists
  FROM players p LEFT JOIN clubs c ON c.club_id = p.current_club_id LEFT JOIN mine USING (player_id) WHERE worth >= 1000000)"""
NO_STATS = ", ".join(f"recent_fotmob_{c} double" for c in ("seasons_used", "total_minutes", "total_matches", *fv.PROVIDER_STATS))


def snapshot(t: Tables) -> DataFrame:
    """Valuable players today, without provider statistics."""
    raw = raw_tables(t)
    players = sn.players_with_role(raw["players"], raw["game_lineups"])
    fixed = sn_corrected(raw)
    return sn.player_snapshot(players, fixed, t.spark.createDataFrame([], f"player_id long, {NO_STATS}"), NOW)


def sn_corrected(raw: Mapping[str, DataFrame]) -> DataFrame:
    from movelens.operators.spells import apply_corrections

    return apply_corrections(raw["appearances"], raw["manual_appearance_corrections"], "appearance_id", "player_club_id", "wrong_club_id", "correct_club_id")


@query("snapshot_players", f"""WITH {SNAPSHOT_SQL}
SELECT player_id, position, sub_position, round(age_now, 6) AS age_now, CASE WHEN cov THEN CAST(apps AS BIGINT) END AS recent_apps, CASE WHEN cov THEN CAST(minutes AS BIGINT) END AS recent_minutes,
  CASE WHEN cov THEN round((goals + assists) / greatest(minutes, 1) * 90, 8) END AS recent_ga_p90, CASE WHEN cov THEN round(goals / greatest(minutes, 1) * 90, 8) END AS recent_goals_p90,
  CASE WHEN cov THEN round(minutes / greatest(apps, 1) * 1.0, 8) END AS recent_mins_per_app FROM snap""")
def snapshot_players(t: Tables) -> DataFrame:
    """Recent form of valuable players: zero inside covered leagues, unknown outside."""
    return snapshot(t).select(
        "player_id", "position", "sub_position", F.round("age_now", 6).alias("age_now"), F.col("recent_apps").cast("long"), F.col("recent_minutes").cast("long"),
        *[F.round(c, 8).alias(c) for c in ("recent_ga_p90", "recent_goals_p90", "recent_mins_per_app")])


@query("snapshot_scenarios", f"""WITH {SNAPSHOT_SQL},
cl AS (SELECT club_id, league, v FROM clubs JOIN (SELECT current_club_id, sum(worth) AS v FROM players WHERE current_club_id IS NOT NULL GROUP BY 1) ON current_club_id = club_id WHERE v > 0),
pr AS (SELECT s.*, (s.player_id * 7 + 3) % 25 AS to_club_id FROM snap s)
SELECT pr.player_id, pr.to_club_id, round(age_now, 6) AS age_at_transfer, height_in_cm, position, coalesce(sub_position, position) AS sub_position,
  CASE WHEN pr.player_id % 7 <> 0 THEN 'right' ELSE 'unknown' END AS foot, least(round_even(worth / 1000000, 0) * 1000000, 150000000.0) AS transfer_fee, round(worth, 4) AS value_before,
  coalesce(o.league, pr.league, 'unknown') AS from_domestic_competition_id, coalesce(t.league, 'unknown') AS to_domestic_competition_id,
  round(coalesce(o.v, 1.0), 3) AS from_total_market_value, round(t.v, 3) AS to_total_market_value, CASE WHEN cov THEN CAST(apps AS BIGINT) END AS pre_apps
FROM pr JOIN cl t ON t.club_id = pr.to_club_id LEFT JOIN cl o ON o.club_id = pr.current_club_id""")
def snapshot_scenarios(t: Tables) -> DataFrame:
    """Hypothetical moves of every valuable player to one club."""
    raw, players = raw_tables(t), snapshot(t)
    clubs = sn.club_snapshot(raw["clubs"], raw["players"])
    pairs = players.select("player_id", ((F.col("player_id") * 7 + 3) % 25).alias("to_club_id"))
    s = sn.make_scenarios(pairs, players, clubs)
    return s.select(
        "player_id", "to_club_id", F.round("age_at_transfer", 6).alias("age_at_transfer"), "height_in_cm", "position", "sub_position", "foot", "transfer_fee", F.round("value_before", 4).alias("value_before"),
        "from_domestic_competition_id", "to_domestic_competition_id", F.round("from_total_market_value", 3).alias("from_total_market_value"),
        F.round("to_total_market_value", 3).alias("to_total_market_value"), F.col("pre_apps").cast("long"))
