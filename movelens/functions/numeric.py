"""Numeric columns: rates, ratios, rounding, interpolation, labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from movelens import fixed_values as fv


def per_unit(num: Column, den: Column, scale: float = 1.0) -> Column:
    """``num`` per ``den`` times ``scale``; a denominator below 1 counts as 1."""
    return num / F.greatest(den, F.lit(1)) * scale


def ratio(num: Column, den: Column, floor: float = 1.0) -> Column:
    """``num / den`` with the denominator raised to ``floor``; null stays null."""
    return num / F.when(den.isNotNull(), F.greatest(den, F.lit(floor)))


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Limit to ``[lo, hi]``, keeping nulls (greatest/least alone would fill them)."""
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


def known_mean(*columns: Column) -> Column:
    """Mean of the non-null values of a row; null if there is none."""
    known = F.filter(F.array(*columns), lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(known) > 0, total / F.size(known))


def weighted_known_mean(parts: list[tuple[Column, Column]]) -> Column:
    """Weighted mean over the known (value, weight) pairs; null if their weights sum to 0."""
    num = den = F.lit(0.0)
    for value, weight in parts:
        num = num + F.when(value.isNotNull(), value * weight).otherwise(0.0)
        den = den + F.when(value.isNotNull(), weight).otherwise(0.0)
    return F.when(den > 0, num / den)


def decay_weight(years: Column, low: float, high: float, tau: float) -> Column:
    """Weight that falls from ``high`` at 0 years towards ``low``."""
    return low + (high - low) * F.exp(-years / tau)


def safe_round(c: Column, digits: int) -> Column:
    """Half-even rounding that never turns a positive value into 0."""
    floor = 10.0 ** -digits
    rounded = F.bround(c, digits)
    return F.when((c > 0) & (rounded <= 0), F.lit(floor)).otherwise(rounded)


def nan_to_null(c: Column) -> Column:
    """Missing is NULL everywhere; NaN would sort and aggregate as a value."""
    return F.when(~F.isnan(c), c)


def interp(value: Column, points: Column) -> Column:
    """Position of ``value`` on 101 breakpoints, 0 to 100, by linear interpolation.

    Values outside are clamped. On repeated breakpoints the last one wins.
    """
    n = F.size(points)

    def place(below: Column) -> Column:
        left, right = F.get(points, below - 1), F.get(points, below)
        inside = (below - 1) + (value - left) / F.when(right > left, right - left)
        return F.when(below == 0, F.lit(0.0)).when(below >= n, (n - 1).cast("double")).otherwise(inside)

    # transform() over one element binds the count of breakpoints at or below
    # the value, so that it is computed once
    below = F.size(F.filter(points, lambda p: p <= value))
    found = F.get(F.transform(F.array(below), place), 0)
    return F.when(value.isNotNull() & points.isNotNull(), found)


def fixed_text(value: Column, digits: int, form: str = "%s", sign: str = "") -> Column:
    """``value`` with a fixed number of decimals, exact halves to the even side.

    What counts is the value's exact binary form: the product with the power of
    ten is taken with its rounding error, which tells on which side of a half
    it lies. ``form`` goes around the number, ``sign`` is a format flag.
    """
    scale = float(10**digits)
    product = value * scale
    big = value * 134217729.0  # splits the 53 bits in two halves
    high = big - (big - value)
    error = (high * scale - product) + (value - high) * scale
    half = product - F.floor(product) == 0.5
    nearest = (
        F.when(half & (error > 0), F.ceil(product)).when(half & (error < 0), F.floor(product)).otherwise(F.rint(product))
    )
    return F.format_string(form.replace("%s", f"%{sign}.{digits}f"), nearest / scale)


def money_label(c: Column, currency: str = "EUR") -> Column:
    """Short amount: "free", "€0.3m", "€50m", "€2.05b"."""
    rate, sign = fv.EXCHANGE_RATES[currency]
    v = c * rate
    m = v / 1_000_000
    small = fixed_text(m, 1, f"{sign}%sm")
    return (
        F.when(c.isNull() | (c == 0), "free")
        .when(F.abs(v) >= 1_000_000_000, fixed_text(v / 1_000_000_000, 2, f"{sign}%sb"))
        .when(m < 1, small)
        .otherwise(fixed_text(m, 0, f"{sign}%sm"))
    )


def convert(c: Column, currency: Column, rates: Mapping[str, tuple[float, str]] = fv.EXCHANGE_RATES) -> Column:
    """Amount in another currency at a fixed rate; null for an unknown currency."""
    rate = F.lit(None).cast("double")
    for name, (r, _) in rates.items():
        rate = F.when(currency == name, F.lit(r)).otherwise(rate)
    return c * rate


def ordinal(c: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th ... of the half-even rounded number."""
    n = F.bround(c).cast("int")
    suffix = (
        F.when((n % 100).between(11, 13), "th")
        .when(n % 10 == 1, "st")
        .when(n % 10 == 2, "nd")
        .when(n % 10 == 3, "rd")
        .otherwise("th")
    )
    return F.concat(n.cast("string"), suffix)


def feature_label(feature: str, value: Column) -> Column:
    """A model feature's value in readable form."""
    if feature in ("log_transfer_fee", "log_value_before", "log_from_club_value", "log_to_club_value"):
        amount = fixed_text(F.expm1(value) / 1_000_000, 1, "€%sm")
        return F.when(value == 0, "free").otherwise(amount) if feature == "log_transfer_fee" else amount
    formats = {
        "age_at_transfer": (1, "%s yrs", ""), "height_vs_position": (0, "%s cm", "+"),
        "pre_ga_p90": (2, "%s per 90", ""), "pre_goals_p90": (2, "%s per 90", ""), "pre_apps": (0, "%s apps", ""),
        "pre_minutes": (0, "%s mins", ""), "pre_mins_per_app": (0, "%s min/app", ""),
        "fee_to_value_ratio": (2, "%s×", ""), "club_quality_ratio": (2, "%s×", ""),
    }
    if feature not in formats:
        return value.cast("string")
    digits, form, sign = formats[feature]
    return fixed_text(value.cast("double"), digits, form, sign)
