"""Moves into spells: candidate filters, spell building, eligibility."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movelens.operators.scan import DEFAULT_SKEW, Skew, ordered_scan

# Scope of the scored moves.
FIRST_MOVE_DATE = dt.date(2013, 1, 1)
MIN_WINDOW_APPEARANCES = 10
AGE_RANGE = (15, 42)
MIN_LOAN_DAYS = 14
DAYS_PER_YEAR = 365.25

MOVE_KEY = ("player_id", "transfer_date", "from_club_id", "to_club_id")


def candidate_moves(
    moves: DataFrame,
    now: dt.date,
    first: dt.date = FIRST_MOVE_DATE,
    ts: str = "transfer_date",
    source: str = "from_club_id",
    target: str = "to_club_id",
) -> DataFrame:
    """Moves with a date inside ``[first, now]`` between two different, known clubs."""
    return moves.filter(
        F.col(ts).between(F.lit(first), F.lit(now))
        & F.col(source).isNotNull()
        & F.col(target).isNotNull()
        & (F.col(source) != F.col(target))
    )


def build_spells(
    moves: DataFrame,
    now: dt.date | dt.datetime,
    *,
    subject: str = "player_id",
    ts: str = "transfer_date",
    tie: Sequence[str] = ("from_club_id", "to_club_id"),
    end: str = "tenure_end",
    carry: Mapping[str, str] | None = None,
    exclude: Column | None = None,
    keep: Column | None = None,
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """One spell per move, ending at the subject's next move or at ``now``.

    ``carry`` names values of the next move to bring along (output: input), for
    instance the next fee. ``exclude`` drops moves *before* the next move is
    looked up, so a spell reaches across them; ``keep`` selects spells *after*
    it, so dropped moves still end the spell before them.
    """
    if exclude is not None:
        moves = moves.filter(~F.coalesce(exclude, F.lit(False)))
    leads = {end: F.col(ts), **{out: F.col(c) for out, c in (carry or {}).items()}}
    spells = ordered_scan(moves, [subject], [ts, *tie], lead=leads, skew=skew)
    spells = spells.withColumn(end, F.coalesce(F.col(end), F.lit(now).cast(moves.schema[ts].dataType)))
    return spells if keep is None else spells.filter(keep)


def permanent_spells(moves: DataFrame, now: dt.date, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Permanent spells: loans leave before the next move is looked up."""
    return build_spells(
        moves,
        now,
        carry={"next_transfer_fee": "transfer_fee"},
        exclude=F.col("transfer_type") == "loan",
        skew=skew,
    ).drop("transfer_type", "fee_raw")


def is_loan_start(kind: str = "transfer_type", text: str = "fee_raw") -> Column:
    """A loan that is not the closing "end of loan" entry."""
    return (F.col(kind) == "loan") & ~F.lower(F.coalesce(text, F.lit(""))).contains("end of loan")


def loan_spells(moves: DataFrame, now: dt.date, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Loan spells: any later move ends them; very short ones are entry errors."""
    spells = build_spells(moves, now, keep=is_loan_start(), skew=skew)
    long_enough = F.datediff("tenure_end", "transfer_date") >= MIN_LOAN_DAYS
    return spells.filter(long_enough).drop("transfer_type", "fee_raw")


def spell_facts(
    spells: DataFrame,
    now: dt.date,
    *,
    start: str = "transfer_date",
    end: str = "tenure_end",
    born: str = "date_of_birth",
    days: str = "tenure_days",
    open_flag: str = "still_at_club",
    age: str = "age_at_transfer",
) -> DataFrame:
    """Duration in days, whether the spell is still open, age at its start."""
    return spells.withColumns(
        {
            days: F.datediff(end, start),
            open_flag: F.col(end) >= F.lit(now),
            age: F.datediff(start, born) / F.lit(DAYS_PER_YEAR),
        }
    )


def eligible(
    spells: DataFrame,
    *,
    min_pre: int = MIN_WINDOW_APPEARANCES,
    min_post: int = MIN_WINDOW_APPEARANCES,
    pre: str = "pre_apps",
    post: str = "post_apps",
    age: str = "age_at_transfer",
    before: str = "value_before",
    after: str = "value_after",
) -> DataFrame:
    """Spells that can be scored. Loans use ``min_post=0``: not playing is an outcome."""
    return spells.filter(
        (F.col(pre) >= min_pre)
        & (F.col(post) >= min_post)
        & F.col(age).between(*AGE_RANGE)
        & (F.col(before) > 0)
        & F.col(after).isNotNull()
    )


def fill_counters(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero for window counters without any matching fact; nothing else is filled."""
    return df.fillna(0, subset=list(columns))


def coalesce_values(
    df: DataFrame,
    before: str = "value_before",
    after: str = "value_after",
    peak: str = "value_peak",
    listed: str = "market_value_in_eur",
) -> DataFrame:
    """Value fallbacks: before <- listed value, peak <- after and never below it."""
    return df.withColumns(
        {
            before: F.coalesce(before, listed),
            # greatest() skips nulls, so a missing peak becomes the value after
            peak: F.greatest(peak, after),
        }
    )


def apply_corrections(
    df: DataFrame, fixes: DataFrame, key: str, column: str, wrong: str, right: str
) -> DataFrame:
    """Overwrite ``column`` for listed keys, only where it still holds the wrong value."""
    fix = fixes.select(F.col(key).alias("_fk"), F.col(wrong).alias("_wrong"), F.col(right).alias("_right"))
    joined = df.join(fix, F.col(key) == F.col("_fk"), "left")
    corrected = F.when(F.col(column) == F.col("_wrong"), F.col("_right")).otherwise(F.col(column))
    return joined.withColumn(column, corrected).select(*df.columns)


def normalise_category(df: DataFrame, column: str, spellings: Mapping[str, str]) -> DataFrame:
    """Fold alternative spellings of a category before it is counted."""
    return df.replace(dict(spellings), subset=[column])


def next_value_at(
    spells: DataFrame,
    moves: DataFrame,
    *,
    subject: str = "player_id",
    end: str = "tenure_end",
    ts: str = "transfer_date",
    value: str = "to_domestic_competition_id",
    out: str = "next_competition_id",
) -> DataFrame:
    """A value of the move made exactly when the spell ends (destination league)."""
    landed = (
        moves.filter(F.col(value).isNotNull())
        .groupBy(F.col(subject).alias("_ns"), F.col(ts).alias("_nt"))
        .agg(F.min(value).alias(out))
    )
    joined = spells.join(landed, (F.col(subject) == F.col("_ns")) & (F.col(end) == F.col("_nt")), "left")
    return joined.drop("_ns", "_nt")
