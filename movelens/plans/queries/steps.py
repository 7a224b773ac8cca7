"""Steps around the scoring job that other queries do not reach: sources, sinks, browsing, features."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movelens import fixed_values as fv
from movelens.operators import model as md
from movelens.operators import reports as rp
from movelens.operators import scoring as sc
from movelens.operators import snapshots as sn
from movelens.operators.spells import candidate_moves, loan_spells, next_value_at, normalise_category, spell_facts
from movelens.plans.queries.base import DEALS, DEALS_SQL, Tables, day, deals, query
from movelens.plans.queries.deals import ERA_SQL
from movelens.plans.queries.jobs import (
    FEE, FIELDED, FROM_CLUB, LISTED, MOVES_SQL, NOW, P_WEIGHTS, PERSONS_SQL, PLAYERS_SQL, SNAPSHOT_SQL, TO_CLUB, half_even_sql, raw_tables, snapshot,
)
from movelens.plans.scoring import league_baselines
from movelens.schemas import TRANSFERS
from movelens.sources.feeds import flatten_history
from movelens.sources.sinks import as_json, export_csv, load_fitted, save_fitted, write_stage
from movelens.sources.staging import stage_root
from movelens.sources.tables import attach, attach_both, attach_type, keep_known, load_types, parse_dates, read_or_empty, read_table, with_backfill


def _folder(t: Tables, name: str) -> str:
    """A folder of its own below the shared one."""
    return f"{stage_root(t.spark).rstrip('/')}/movelens/{name}-{uuid.uuid4().hex}"


@query("csv_round_trip", f"""WITH {MOVES_SQL}
SELECT player_id, CASE WHEN player_id % 11 <> 0 THEN strftime(transfer_date, '%Y-%m-%d') END AS transfer_date, from_club_id, to_club_id, round(transfer_fee, 4) AS transfer_fee FROM mv WHERE k % 31 <> 0""")
def csv_round_trip(t: Tables) -> DataFrame:
    """Moves written as CSV with placeholder dates, and read again with declared types."""
    moves = raw_tables(t)["transfers"]
    dated = F.when(F.col("player_id") % 11 == 0, F.lit("0000-00-00")).otherwise(day("transfer_date"))
    path = _folder(t, "moves") + ".csv"
    export_csv(moves.withColumns({"transfer_date": dated, "to_club_id": F.col("to_club_id").cast("double")}), path)
    back = read_table(t.spark, path, TRANSFERS)
    missing = read_or_empty(t.spark, path + "-not-there.csv", TRANSFERS)
    return with_backfill(back, missing).select(
        "player_id", day("transfer_date").alias("transfer_date"), "from_club_id", "to_club_id", F.round("transfer_fee", 4).alias("transfer_fee"))


@query("dated_rows", f"WITH {MOVES_SQL} SELECT player_id, strftime(transfer_date, '%Y-%m-%d') AS transfer_date FROM mv WHERE k % 31 <> 0 AND player_id % 11 <> 0")
def dated_rows(t: Tables) -> DataFrame:
    """Rows with a placeholder for a date are dropped."""
    moves = raw_tables(t)["transfers"]
    text = F.when(F.col("player_id") % 11 == 0, F.lit("0000-00-00")).otherwise(day("transfer_date"))
    return parse_dates(moves.withColumn("transfer_date", text), "transfer_date").select("player_id", day("transfer_date").alias("transfer_date"))


@query("stage_output", f"""WITH {MOVES_SQL} SELECT year(transfer_date) AS year, count(*) AS n, round(sum(transfer_fee), 2) AS fees FROM mv WHERE k % 31 <> 0 GROUP BY 1""")
def stage_output(t: Tables) -> DataFrame:
    """A stage's table written by year and read again."""
    path = _folder(t, "moves")
    write_stage(raw_tables(t)["transfers"], path, ["player_id", "transfer_date", "transfer_fee"], "transfer_date")
    back = t.spark.read.parquet(path)
    return back.groupBy(F.col("year").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("transfer_fee"), 2).alias("fees"))


@query("fitted_tables", f"""WITH {MOVES_SQL}, {PLAYERS_SQL} SELECT position, avg(height_in_cm) AS mean FROM (SELECT position, height_in_cm FROM players) GROUP BY position
UNION ALL SELECT '_default', avg(height_in_cm) FROM players""")
def fitted_tables(t: Tables) -> DataFrame:
    """Statistics stored and loaded again."""
    from movelens.operators.baselines import group_means

    path = _folder(t, "fitted")
    save_fitted({"heights": group_means(raw_tables(t)["players"], "height_in_cm", "position")}, path)
    return load_fitted(t.spark, path, ["heights"])["heights"].select("position", "mean")


@query("json_rows", f"""WITH {MOVES_SQL} SELECT player_id, k % 41 = 0 AND k % 6 <> 0 AS no_fee, round(transfer_fee, 4) AS fee FROM mv WHERE k % 31 <> 0""")
def json_rows(t: Tables) -> DataFrame:
    """Rows as JSON documents (NaN as null) and back."""
    moves = raw_tables(t)["transfers"].select("player_id", F.coalesce("transfer_fee", F.lit(float("nan"))).alias("fee"))
    parsed = as_json(moves).select(F.from_json("json", "player_id long, fee double").alias("r"), F.contains("json", F.lit('"fee":null')).alias("no_fee"))
    return parsed.select("r.player_id", "no_fee", F.round("r.fee", 4).alias("fee"))


@query("history_flatten", f"""WITH {MOVES_SQL}
SELECT player_id, strftime(transfer_date, '%Y-%m-%d') AS transfer_date, from_club_id, to_club_id, CASE WHEN k % 4 = 1 THEN 'loan' WHEN k % 6 = 0 THEN 'free' WHEN k % 7 = 0 THEN 'unknown' ELSE 'paid' END AS transfer_type
FROM mv WHERE player_id % 17 <> 0""")
def history_flatten(t: Tables) -> DataFrame:
    """Move-history documents, one per player, back to classified rows."""
    raw = raw_tables(t)
    moves = with_backfill(raw["transfers"], raw["manual_transfers"])
    keys = t.orders.groupBy(F.col("o_custkey").alias("player_id"), F.date_add(F.to_date("o_orderdate"), 6500).alias("transfer_date")).agg(F.min("o_orderkey").alias("k"))
    href = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("/a/startseite/verein/"), F.col(c), F.lit("/saison_id/2020")))
    fee = F.expr("CASE WHEN k % 4 = 1 THEN 'Loan fee:<br /><i>x</i>' WHEN k % 6 = 0 THEN 'free transfer' WHEN k % 7 = 0 THEN '-' ELSE '€5.00m' END")
    dated = F.when(F.col("player_id") % 17 == 0, "0000-00-00").otherwise(day("transfer_date"))
    entry = F.struct(dated.alias("dateUnformatted"), F.struct(href("from_club_id").alias("href")).alias("from"), F.struct(href("to_club_id").alias("href")).alias("to"), fee.alias("fee"))
    docs = moves.join(keys, ["player_id", "transfer_date"]).groupBy("player_id").agg(F.collect_list(entry).alias("transfers"))  # a player's moves
    flat = flatten_history(docs.select("player_id", F.to_json(F.struct("transfers")).alias("body")))
    return flat.select("player_id", day("transfer_date").alias("transfer_date"), "from_club_id", "to_club_id", "transfer_type")


@query("attached_dimensions", f"""WITH {MOVES_SQL}, clubs AS (SELECT n_nationkey AS club_id, n_name AS name, n_regionkey AS r FROM nation WHERE n_nationkey <> 24),
kinds AS (SELECT o_orderkey AS k, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 = 0)
SELECT mv.k AS id, a.name AS from_name, b.name AS to_name, coalesce(status, 'none') AS status FROM mv LEFT JOIN clubs a ON a.club_id = from_club_id LEFT JOIN clubs b ON b.club_id = to_club_id
LEFT JOIN kinds USING (k) WHERE a.r IS NOT NULL AND a.r <> 3""")
def attached_dimensions(t: Tables) -> DataFrame:
    """Both ends' clubs, an optional kind with a default, and only known leagues."""
    first = t.orders.groupBy(F.col("o_custkey").alias("player_id"), F.date_add(F.to_date("o_orderdate"), 6500).alias("d")).agg(F.min("o_orderkey").alias("k"))
    moves = first.selectExpr("k AS id", f"{FROM_CLUB} AS from_club_id", f"{TO_CLUB} AS to_club_id")
    clubs = t.nation.filter("n_nationkey <> 24").selectExpr("n_nationkey AS club_id", "n_name AS name", "n_regionkey AS r")
    both = attach_both(moves, clubs, "club_id", ["name", "r"])
    kinds = t.orders.filter("o_orderkey % 3 = 0").selectExpr("o_orderkey AS id", "o_orderstatus AS status")
    known = t.region.filter("r_regionkey <> 3").selectExpr("r_regionkey AS from_r")
    return keep_known(attach(both, kinds, ["id"], {"status": "none"}), known, ["from_r"]).select("id", "from_name", "to_name", "status")


@query("category_normalised", f"""SELECT r, count(*) AS n FROM (SELECT {FIELDED.replace("'midfield'", "'Midfield'")} AS r FROM orders) GROUP BY r""")
def category_normalised(t: Tables) -> DataFrame:
    return rp.breakdown(normalise_category(raw_tables(t)["game_lineups"], "position", {"midfield": "Midfield"}), "position").withColumnRenamed("position", "r")


def _loans(t: Tables) -> DataFrame:
    raw = raw_tables(t)
    moves = candidate_moves(with_backfill(raw["transfers"], raw["manual_transfers"]), NOW)
    moves = attach_type(moves, load_types(raw["transfer_types"], raw["manual_transfers"]))
    spells = loan_spells(moves, NOW, t.skew("orders")).join(raw["players"].select("player_id", "name", "date_of_birth", "position"), "player_id")
    spells = attach_both(spells, raw["clubs"], "club_id", ["domestic_competition_id"])
    return spell_facts(spells, NOW, open_flag="still_on_loan")


LOANS_SQL = f"""{MOVES_SQL}, {PLAYERS_SQL},
ls AS (SELECT sp.*, name, born, position, ct.league AS to_league, tenure_end - transfer_date AS days, 'NATION_' || to_club_id AS to_name FROM sp JOIN players USING (player_id)
  LEFT JOIN clubs ct ON ct.club_id = to_club_id WHERE population = 'loan')"""


@query("loan_browse", f"""WITH {LOANS_SQL}
SELECT player_id, strftime(transfer_date, '%Y-%m-%d') AS transfer_date, to_name AS to_club_name, days AS tenure_days, round(days / 30.4375, 1) AS months FROM ls
WHERE position = 'Defender' AND to_league = 'ES1' AND days BETWEEN 60 AND 400 AND (contains(lower(name), '#0000') OR contains(lower(to_name), '#0000'))""")
def loan_browse(t: Tables) -> DataFrame:
    """Loans by position, league, text and duration."""
    found = rp.filter_moves(_loans(t), position="Defender", league="ES1", q="R#0000", ranges={"tenure_days": (60, 400)})
    return found.select("player_id", day("transfer_date").alias("transfer_date"), "to_club_name", F.col("tenure_days").cast("long").alias("tenure_days"), F.round(F.col("tenure_days") / 30.4375, 1).alias("months"))


@query("loan_facts", f"""WITH {LOANS_SQL} SELECT player_id, strftime(transfer_date, '%Y-%m-%d') AS transfer_date, days AS tenure_days, tenure_end >= DATE '{NOW}' AS still_on_loan, round((transfer_date - born) / 365.25, 8) AS age FROM ls""")
def loan_facts(t: Tables) -> DataFrame:
    return _loans(t).select("player_id", day("transfer_date").alias("transfer_date"), F.col("tenure_days").cast("long").alias("tenure_days"), "still_on_loan", F.round("age_at_transfer", 8).alias("age"))


@query("next_league", f"""WITH {MOVES_SQL}, {PLAYERS_SQL},
land AS (SELECT player_id, transfer_date, min(league) AS league FROM cand JOIN clubs ON club_id = to_club_id WHERE league IS NOT NULL GROUP BY 1, 2)
SELECT sp.player_id, strftime(sp.transfer_date, '%Y-%m-%d') AS transfer_date, league AS next_competition_id FROM sp LEFT JOIN land ON land.player_id = sp.player_id AND land.transfer_date = sp.tenure_end WHERE population = 'loan'""")
def next_league(t: Tables) -> DataFrame:
    """League of the move that ends a loan."""
    raw = raw_tables(t)
    moves = candidate_moves(with_backfill(raw["transfers"], raw["manual_transfers"]), NOW)
    landed = attach_both(moves, raw["clubs"], "club_id", ["domestic_competition_id"])
    return next_value_at(_loans(t), landed).select("player_id", day("transfer_date").alias("transfer_date"), "next_competition_id")


@query("weight_profiles", f"""WITH {PERSONS_SQL}, {P_WEIGHTS} SELECT player_id, {", ".join(f"coalesce(n.w_{c}, b.w_{c}) AS w_{c}" for c in fv.COMPONENTS)} FROM players p JOIN pw b ON b.lv = 'p' AND b.wk = p.position LEFT JOIN pw n ON n.lv = 's' AND n.wk = p.sub_position""")
def weight_profiles(t: Tables) -> DataFrame:
    """Each player's weights: the role's profile if there is one, else the position's."""
    raw = raw_tables(t)
    players = sn.players_with_role(raw["players"], raw["game_lineups"]).select("player_id", "position", "sub_position")
    return sc.lookup_weights(players, sc.load_weights(t.spark)).select("player_id", *[f"w_{c}" for c in fv.COMPONENTS])


@query("derived_features", f"""WITH {MOVES_SQL} SELECT k AS id, round(ln(1 + coalesce(transfer_fee, 0.0)), 8) AS log_fee, round(ln(1 + market_value_in_eur), 8) AS log_value FROM mv WHERE market_value_in_eur IS NOT NULL""")
def derived_features(t: Tables) -> DataFrame:
    """Log features, and only rows with every required value."""
    first = t.orders.groupBy(F.col("o_custkey").alias("player_id"), F.date_add(F.to_date("o_orderdate"), 6500).alias("d")).agg(F.min("o_orderkey").alias("k"))
    moves = first.join(t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price")), "k").selectExpr(
        "k AS id", f"{FEE} AS transfer_fee", f"{LISTED} AS value_before", "price AS from_total_market_value", "price AS to_total_market_value", "CAST(NULL AS STRING) AS foot",
        "CAST(NULL AS STRING) AS from_domestic_competition_id", "CAST(NULL AS STRING) AS to_domestic_competition_id")
    ready = md.trainable(md.derive(moves), ["log_value_before", "foot", "from_domestic_competition_id"])
    return ready.select("id", F.round("log_transfer_fee", 8).alias("log_fee"), F.round("log_value_before", 8).alias("log_value"))


@query("imputed_heights", f"""WITH {PERSONS_SQL}
SELECT player_id, coalesce(height_in_cm, (SELECT median(height_in_cm) FROM players)) AS height_in_cm FROM players""")
def imputed_heights(t: Tables) -> DataFrame:
    """Missing heights filled with the exact median."""
    players = raw_tables(t)["players"].select("player_id", "height_in_cm")
    typical = md.as_struct(md.medians(players, ["height_in_cm"], skew=t.skew("customer")), ["height_in_cm"], "median")
    return md.impute(players, ["height_in_cm"], typical)


@query("form_vs_own_league", f"""WITH {SNAPSHOT_SQL}
SELECT s.player_id, round(CASE WHEN cov THEN (goals + assists) / greatest(minutes, 1) * 90 END / coalesce(f.b, g.b, (SELECT avg(b) FROM coarse)), 8) AS ratio
FROM snap s LEFT JOIN fine f ON f.league = s.league AND f.position = s.position LEFT JOIN coarse g ON g.position = s.position""")
def form_vs_own_league(t: Tables) -> DataFrame:
    """Recent output of valuable players against their own league's average."""
    raw = raw_tables(t)
    players = sn.players_with_role(raw["players"], raw["game_lineups"])
    cells = league_baselines(raw["appearances"], players)
    return sn.vs_own_league(snapshot(t), cells).select("player_id", F.round("recent_ga_p90_vs_league", 8).alias("ratio"))


@query("league_leaderboard", f"""WITH {DEALS_SQL}, {ERA_SQL}
SELECT league_id, row_number() OVER (ORDER BY (rf - ef) / ef * 100 DESC, league_id) AS place, round((rf - ef) / ef * 100, 6) AS fee_growth_pct FROM era WHERE ef IS NOT NULL AND rf IS NOT NULL""")
def league_leaderboard(t: Tables) -> DataFrame:
    """Leagues by the growth of their fees."""
    from dataclasses import replace

    moves = replace(DEALS, buyer_region="buyer")
    leagues = rp.league_summary(deals(t), moves).join(rp.era_compare(deals(t), moves), "league_id", "left")
    ranked = rp.league_leaderboard(leagues, "fee_growth_pct")
    return ranked.select("league_id", F.col("place").cast("long").alias("place"), F.round("fee_growth_pct", 6).alias("fee_growth_pct"))


@query("presented_moves", f"""WITH {MOVES_SQL} SELECT player_id, {half_even_sql("transfer_fee / 1000000.0")} AS fee_m, market_value_in_eur AS listed FROM mv WHERE k % 31 <> 0""")
def presented_moves(t: Tables) -> DataFrame:
    """Display columns with half-even rounding; nulls stay."""
    moves = raw_tables(t)["transfers"].withColumn("m", F.col("transfer_fee") / 1_000_000.0)
    return rp.present(moves, {"player_id": "player_id", "fee_m": ("m", 1), "listed": "market_value_in_eur"})
