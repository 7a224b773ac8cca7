"""Landed JSON: season leaderboards and move histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movelens import fixed_values as fv
from movelens.functions.text import classify_fee, id_from_path
from movelens.schemas import BOARD, LEADERBOARD, MOVE_HISTORY
from movelens.sources.tables import parse_date


def load_leaderboards(spark: SparkSession, path: str) -> DataFrame:
    """Season files ``<league>_<year>-<year>.json`` as wide rows per player and season.

    Each file is a list of players, or ``null`` for a season that the provider
    does not cover; such a season has no rows.
    """
    rows = (
        spark.read.schema(LEADERBOARD).option("multiLine", True).json(path)
        .withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
        .filter(F.col("fotmob_id").isNotNull())
    )
    named = rows.withColumns(
        {
            "league": F.regexp_extract("_file", r"^(.+)_([0-9]{4})-[0-9]{4}\.json", 1),
            "season": F.regexp_extract("_file", r"^(.+)_([0-9]{4})-[0-9]{4}\.json", 2).cast("int"),
            "provider_id": F.col("fotmob_id"),
            "provider_name": F.col("fotmob_name"),
            "team": F.col("fotmob_team"),
        }
    )
    return named.select(*BOARD.fieldNames())


def pivot_leaderboards(
    rows: DataFrame, key: Sequence[str], stat: str, value: str, stats: Sequence[str], prefix: str = ""
) -> DataFrame:
    """Long leaderboard rows (one list per statistic) to one wide row per key.

    The statistics are known, so nothing has to be collected to find them.
    """
    wide = rows.groupBy(*key).pivot(stat, list(stats)).agg(F.max(value))
    return wide.select(*key, *[F.col(s).alias(f"{prefix}{s}") for s in stats])


def flatten_history(df: DataFrame, json: str = "body", subject: str = "player_id") -> DataFrame:
    """Move-history documents to one classified row per move; undated moves are dropped."""
    doc = F.from_json(json, T._parse_datatype_string(MOVE_HISTORY))
    moves = df.select(subject, F.explode(doc["transfers"]).alias("m"))
    flat = moves.select(
        subject,
        parse_date(F.col("m.dateUnformatted")).alias("transfer_date"),
        id_from_path(F.col("m.from.href")).alias("from_club_id"),
        id_from_path(F.col("m.to.href")).alias("to_club_id"),
        F.col("m.fee").alias("fee_raw"),
        classify_fee(F.col("m.fee")).alias("transfer_type"),
    )
    return flat.filter(F.col("transfer_date").isNotNull())


def parse_json_map(column: str, kind: str = "map<string,double>") -> F.Column:
    """A JSON object column as a map."""
    return F.from_json(column, kind)


COVERED_LEAGUES = tuple(fv.COVERED_LEAGUES)
