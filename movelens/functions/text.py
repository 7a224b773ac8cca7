"""Text columns: folding, names, fee texts, ids, seasons."""

from __future__ import annotations

import difflib
import json
import re
import unicodedata
from collections.abc import Iterable, Mapping, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movelens import fixed_values as fv

_LATIN = [*range(0x00A0, 0x0250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07)]


def _base(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def _fold_maps() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(letters, their base letters, letters of several base letters), by rule from Unicode.

    Letters to drop (combining marks) follow the mapped ones, as translate() expects.
    """
    source, target, dropped, several = [], [], [], []
    for code in range(0x80, 0x10000):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue  # Hangul syllables stay composed; surrogates are no letters
        ch = chr(code)
        base = _base(ch)
        if base == ch:
            continue
        if not base:
            dropped.append(ch)
        elif len(base) == 1:
            source.append(ch)
            target.append(base)
        elif code in _LATIN:
            several.append((ch, base))
    return "".join(source + dropped), "".join(target), tuple(several)


def _expand(c: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def strip_accents(c: Column) -> Column:
    """Compatibility-decomposed text without combining marks, case kept.

    Pure ASCII text, the usual case, skips the translation. Hangul syllables
    and non-Latin letters that decompose into several letters stay as they are.
    """
    letters, bases, several = _fold_maps()
    full = F.translate(_expand(c, several), letters, bases)
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(full)


def fold(c: Column) -> Column:
    """Lower case without accents: a plain search term finds accented names."""
    return F.lower(strip_accents(c))


@lru_cache(maxsize=1)
def _fold_table() -> dict[int, str]:
    letters, bases, several = _fold_maps()
    table = {ord(ch): bases[i] if i < len(bases) else "" for i, ch in enumerate(letters)}
    return table | {ord(ch): base for ch, base in several}


def fold_text(value: str) -> str:
    """:func:`fold` for a literal search term: by the same table, so that what is kept in a text is kept here."""
    return value.translate(_fold_table()).lower()


def has_text(c: Column, term: str) -> Column:
    """Accent- and case-insensitive substring test; null never matches."""
    return F.coalesce(fold(c).contains(fold_text(term)), F.lit(False))


def norm_name(c: Column) -> Column:
    """ASCII words in lower case, for matching names across sources."""
    single = {k: v for k, v in fv.NORDIC_SLAVIC.items() if len(v) == 1}
    double = [(k, v) for k, v in fv.NORDIC_SLAVIC.items() if len(v) > 1]
    text = F.translate(_expand(c, double), "".join(single), "".join(single.values()))
    ascii_only = F.regexp_replace(strip_accents(text), r"[^\x00-\x7F]", "")
    words = F.regexp_replace(F.lower(ascii_only), "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(words, r"\s+", " "))


def tokens(c: Column) -> Column:
    """Words of a normalised text, without empty ones."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def club_key(
    c: Column,
    nicknames: Sequence[Sequence[str]] = fv.CLUB_NICKNAMES,
    force_split: Sequence[str] = fv.CLUB_FORCE_SPLIT,
    strip: Sequence[str] = fv.CLUB_STRIP_TOKENS,
) -> Column:
    """Key shared by the spellings of one club.

    A forced split beats a nickname group, which beats the mechanical key: the
    folded name without legal-entity words and a leading "1. FC".
    """
    folded = F.regexp_replace(fold(c), r"^1\.?\s*fc\s+", "")
    words = tokens(F.regexp_replace(folded, "[^a-z0-9 ]", " "))
    plain = F.array_join(F.filter(words, lambda w: ~w.isin(*strip)), " ") if strip else F.array_join(words, " ")
    groups = {name: f"nickname:{i}" for i, group in enumerate(nicknames) for name in group}
    key = plain
    if groups:
        # folded to a map literal when the plan is optimised
        table = F.from_json(F.lit(json.dumps(groups)), "map<string,string>")
        key = F.coalesce(F.try_element_at(table, c), plain)
    return F.when(c.isin(*force_split), F.concat(F.lit("force_split:"), c)).otherwise(key) if force_split else key


def key_words(
    norm: Column,
    filler: Sequence[str] = fv.CLUB_FILLER_WORDS,
    synonyms: Mapping[str, str] = fv.CLUB_WORD_SYNONYMS,
    min_length: int = 4,
) -> Column:
    """Distinct words of a normalised name that can identify a club."""
    long_words = F.filter(tokens(norm), lambda w: (F.length(w) >= min_length) & ~w.isin(*filler))
    def canonical(w: Column) -> Column:
        out = w
        for old, new in synonyms.items():
            out = F.when(w == old, F.lit(new)).otherwise(out)
        return out
    return F.array_distinct(F.transform(long_words, canonical))


def contains_all(a: Column, b: Column) -> Column:
    """Whether one token set contains the other."""
    return (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts; meant for already blocked pairs."""
    return pd.Series(
        [
            None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio()
            for x, y in zip(a, b)
        ],
        dtype="float64",
    )


def strip_tags(c: Column) -> Column:
    """Text without markup tags, trimmed."""
    return F.trim(F.regexp_replace(c, "<[^>]+>", ""))


def classify_fee(c: Column) -> Column:
    """Kind of move from its fee text: loan, free, paid or unknown."""
    text = F.lower(strip_tags(c))
    return (
        F.when(text.contains("loan"), "loan")
        .when(text == "free transfer", "free")
        .when(text.startswith("€") | text.startswith("eur"), "paid")
        .otherwise("unknown")
    )


def id_from_path(c: Column, marker: str = "verein") -> Column:
    """Number that follows ``/marker/`` in a path, else null."""
    found = F.regexp_extract(c, f"/{re.escape(marker)}/([0-9]+)", 1)
    return F.nullif(found, F.lit("")).cast("long")


def season_start(d: Column) -> Column:
    """First year of the season a date falls into; seasons start in August."""
    return F.when(F.month(d) >= 8, F.year(d)).otherwise(F.year(d) - 1)


def season_label(start_year: Column) -> Column:
    """Label "2019/2020" of the season starting in 2019."""
    return F.concat(start_year.cast("string"), F.lit("/"), (start_year + 1).cast("string"))


def provider_season(label: Column, league: Column, single_year: Sequence[str] = fv.SINGLE_YEAR_LEAGUES) -> Column:
    """The provider's season name: the second year for calendar-year leagues."""
    return F.when(league.isin(*single_year), F.element_at(F.split(label, "/"), 2)).otherwise(label)
