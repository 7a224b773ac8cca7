"""Schemas of the input tables and column lists of the stored ones."""

from __future__ import annotations

from pyspark.sql import types as T

from movelens import fixed_values as fv


def _schema(spec: str) -> T.StructType:
    kinds = {
        "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
        "string": T.StringType(), "date": T.DateType(), "boolean": T.BooleanType(),
    }
    fields = [f.split() for f in spec.split(",")]
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


TRANSFERS = _schema(
    "player_id long, transfer_date date, from_club_id long, to_club_id long, from_club_name string,"
    "to_club_name string, transfer_fee double, market_value_in_eur double, player_name string"
)
MANUAL_TRANSFERS = T.StructType(
    TRANSFERS.fields + _schema("transfer_type string, fee_raw string").fields
)
TRANSFER_TYPES = _schema(
    "player_id long, transfer_date date, from_club_id long, to_club_id long, transfer_type string, fee_raw string"
)
GAME_LINEUPS = _schema("player_id long, position string")
PLAYERS = _schema(
    "player_id long, name string, date_of_birth date, position string, sub_position string, foot string,"
    "height_in_cm double, current_club_id long, current_club_name string, market_value_in_eur double,"
    "current_club_domestic_competition_id string"
)
CLUBS = _schema("club_id long, name string, domestic_competition_id string")
APPEARANCES = _schema(
    "appearance_id string, player_id long, player_club_id long, competition_id string, date date,"
    "goals long, assists long, minutes_played long"
)
GAMES = _schema("game_id long, date date")
CLUB_GAMES = _schema("game_id long, club_id long")
VALUATIONS = _schema("player_id long, date date, market_value_in_eur double")
CORRECTIONS = _schema("appearance_id string, wrong_club_id long, correct_club_id long")
COMPETITIONS = _schema("competition_id string, name string, country_name string")
LEADERBOARD = T.StructType(
    _schema("fotmob_id long, fotmob_name string, fotmob_team string, minutes_played double, matches_played double").fields
    + [T.StructField(f"{fv.PROVIDER_PREFIX}{s}", T.DoubleType()) for s in fv.PROVIDER_STATS]
)
BOARD = T.StructType(
    _schema("league string, season int, provider_id long, provider_name string, team string,"
            "minutes_played double, matches_played double").fields
    + [T.StructField(f"{fv.PROVIDER_PREFIX}{s}", T.DoubleType()) for s in fv.PROVIDER_STATS]
)
MOVE_HISTORY = (
    "struct<transfers: array<struct<dateUnformatted: string, `from`: struct<href: string>,"
    " `to`: struct<href: string>, fee: string>>>"
)

RAW_TABLES = {
    "transfers": TRANSFERS, "manual_transfers": MANUAL_TRANSFERS, "transfer_types": TRANSFER_TYPES,
    "game_lineups": GAME_LINEUPS, "players": PLAYERS, "clubs": CLUBS, "appearances": APPEARANCES,
    "games": GAMES, "club_games": CLUB_GAMES, "player_valuations": VALUATIONS,
    "manual_appearance_corrections": CORRECTIONS,
}

_IDENTITY = ("player_id", "name", "transfer_date", "from_club_name", "to_club_name")
_PERSON = ("position", "sub_position", "foot", "height_in_cm", "age_at_transfer")
_VALUES = ("transfer_fee", "market_value_in_eur", "value_before", "value_after", "value_peak")
_LEAGUES = ("from_domestic_competition_id", "to_domestic_competition_id")
_WINDOWS = (
    "pre_apps", "pre_minutes", "pre_goals", "pre_assists", "pre_ga_p90", "pre_goals_p90", "pre_mins_per_app",
    "post_apps", "post_minutes", "post_goals", "post_assists", "post_ga_p90",
    "team_games_in_tenure", "pct_team_games_played",
    "from_league_ga_baseline", "to_league_ga_baseline",
    "pre_ga_p90_vs_league", "post_ga_p90_vs_league", "expected_post_ga_p90_vs_league", "tenure_days",
)
_FLAGS = ("has_fotmob_data", "has_rating_data", "has_attacking_data", "has_defensive_data", "has_possession_data")

SCORED_MOVES = (
    *_IDENTITY, *_PERSON, *_VALUES,
    "fee_to_value_ratio", "club_quality_ratio", "from_total_market_value", "to_total_market_value",
    *_LEAGUES, *_WINDOWS, "still_at_club",
    "next_transfer_fee", "has_resale_data", "resale_weight", "value_for_money_weight",
    *_FLAGS, *fv.PROVIDER_COLUMNS, *fv.PRE_PROVIDER_COLUMNS, "pre_fotmob_chances_created_p90",
    "perf_level_pct", "perf_delta_pct", "value_growth_pct", "playing_time_pct", "value_for_money_pct",
    "rating_pct", "attacking_pct", "defensive_pct", "possession_pct", "resale_profit_pct",
    "success_score",
)
SCORED_LOANS = (
    *_IDENTITY, *_PERSON, *_VALUES, *_LEAGUES, *_WINDOWS, "still_on_loan",
    *_FLAGS, *fv.PROVIDER_COLUMNS,
    "perf_level_pct", "perf_delta_pct", "value_growth_pct", "playing_time_pct",
    "rating_pct", "attacking_pct", "defensive_pct", "possession_pct",
    "loan_success_score",
)
