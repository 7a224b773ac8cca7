"""Report cards, leaderboards, trends and flows over scored moves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from movelens import fixed_values as fv
from movelens.functions.text import has_text
from movelens.operators.ranks import quantiles, value_counts
from movelens.operators.scan import DEFAULT_SKEW, Skew, ordered_scan


@dataclass(frozen=True)
class Moves:
    """Column roles of a scored move table; the defaults fit the scored spells."""

    key: tuple[str, ...] = ("player_id", "transfer_date")
    ts: str = "transfer_date"
    buyer: str = "to_club_name"
    seller: str = "from_club_name"
    buyer_region: str = "to_domestic_competition_id"
    seller_region: str = "from_domestic_competition_id"
    group: str = "position"
    fee: str = "transfer_fee"
    next_fee: str = "next_transfer_fee"
    resale_pct: str = "resale_profit_pct"
    score: str = "success_score"
    card: tuple[str, ...] = ("player_id", "name", "success_score", "transfer_date")


SCORED = Moves()


def paid(fee: str) -> Column:
    """Fee with an unknown one counted as 0."""
    return F.coalesce(F.col(fee), F.lit(0))


def extremes(metric: Column, key: Sequence[str], payload: Column, where: Column | None = None) -> tuple[Column, Column]:
    """Best and worst payload by ``metric``; the smaller key wins a tie.

    Plain max/min aggregates over structs, so they combine before the shuffle.
    """
    tie = [F.col(k) for k in key]
    ok = metric.isNotNull() if where is None else where & metric.isNotNull()
    best = F.min(F.when(ok, F.struct((-metric).alias("m"), *tie, payload.alias("p"))))["p"]
    worst = F.min(F.when(ok, F.struct(metric.alias("m"), *tie, payload.alias("p"))))["p"]
    return best, worst


def report_in(df: DataFrame, m: Moves = SCORED) -> DataFrame:
    """Buyer side: number of moves, mean score, money spent, best and worst signing."""
    best, worst = extremes(F.col(m.score), m.key, F.struct(*m.card))
    return df.filter(F.col(m.buyer).isNotNull()).groupBy(F.col(m.buyer).alias("club_name")).agg(
        F.count(F.lit(1)).alias("transfers_in"),
        F.avg(m.score).alias("avg_incoming_score"),
        F.sum(paid(m.fee)).alias("total_spent"),
        best.alias("best_signing"),
        worst.alias("worst_signing"),
    )


def report_resale(df: DataFrame, m: Moves = SCORED) -> DataFrame:
    """Resales, credited to the buyer who sold on: count, mean rank, profit, extremes."""
    sold = df.filter((F.col(m.next_fee) > 0) & F.col(m.buyer).isNotNull())
    profit = F.col(m.next_fee) - paid(m.fee)
    flip = F.struct(
        *[F.col(c) for c in m.card if c not in (m.score, m.ts)], F.col(m.seller).alias("bought_from"),
        paid(m.fee).alias("fee_paid"), F.col(m.next_fee).alias("fee_received"), F.col(m.ts).alias("transfer_date"),
    )
    best, worst = extremes(profit, m.key, flip)
    return sold.groupBy(F.col(m.buyer).alias("club_name")).agg(
        F.count(F.lit(1)).alias("resales_count"),
        F.avg(m.resale_pct).alias("avg_resale_profit_pct"),
        F.sum(profit).alias("total_resale_profit"),
        best.alias("best_flip"),
        worst.alias("worst_flip"),
    )


def report_out(df: DataFrame, m: Moves = SCORED) -> DataFrame:
    """Seller side: how departed subjects did at their next club."""
    best, worst = extremes(F.col(m.score), m.key, F.struct(*m.card))
    return df.filter(F.col(m.seller).isNotNull()).groupBy(F.col(m.seller).alias("club_name")).agg(
        F.count(F.lit(1)).alias("transfers_out"),
        F.avg(m.score).alias("avg_departure_score"),
        best.alias("best_departure"),
        worst.alias("worst_departure"),
    )


def modal(df: DataFrame, key: str, category: str, out: str = "modal") -> DataFrame:
    """Most frequent category per key; the smallest one wins a tie."""
    counts = df.filter(F.col(category).isNotNull()).groupBy(key, category).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(category).alias("c")))["c"].alias(out))


def override_from(df: DataFrame, key: str, column: str, table: DataFrame, value: str) -> DataFrame:
    """Replace ``column`` by a looked-up value where there is one."""
    t = table.select(F.col(key).alias("_ok"), F.col(value).alias("_ov"))
    joined = df.join(t, F.col(key) == F.col("_ok"), "left")
    return joined.withColumn(column, F.coalesce("_ov", column)).select(*df.columns)


def half_split_delta(
    df: DataFrame, by: str, order: Sequence[str], value: str, min_n: int = fv.MIN_CLUB_MOVES,
    out: str = "score_improvement", skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """Mean of the later half minus mean of the earlier half, split by count.

    Only for keys with at least ``min_n`` rows. An odd middle row is late.
    """
    rows = df.filter(F.col(by).isNotNull()).select(by, *order, value)
    placed = ordered_scan(
        rows, [by], order, sums={"_place": F.lit(1)}, totals={"_n": F.lit(1)}, skew=skew
    )
    late = F.col("_place") > F.floor(F.col("_n") / 2)
    delta = F.avg(F.when(late, F.col(value))) - F.avg(F.when(~late, F.col(value)))
    return placed.filter(F.col("_n") >= min_n).groupBy(by).agg(delta.alias(out))


def report_cards(df: DataFrame, m: Moves = SCORED, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """One row per organisation that bought or sold: both sides with typed defaults."""
    bought, sold_on, sold = report_in(df, m), report_resale(df, m), report_out(df, m)
    in_league = modal(df.withColumnRenamed(m.buyer, "club_name"), "club_name", m.buyer_region, "_in_league")
    out_league = modal(df.withColumnRenamed(m.seller, "club_name"), "club_name", m.seller_region, "_out_league")
    trend = half_split_delta(df, m.buyer, [m.ts, *[k for k in m.key if k != m.ts]], m.score, skew=skew).withColumnRenamed(
        m.buyer, "club_name"
    )
    cards = bought.join(sold, "club_name", "full_outer")
    for side in (sold_on, trend, in_league, out_league):
        cards = cards.join(side, "club_name", "left")
    return cards.select(
        "club_name",
        F.coalesce("_in_league", "_out_league").alias("league_id"),
        F.coalesce("transfers_in", F.lit(0)).alias("transfers_in"),
        "avg_incoming_score",
        F.coalesce("total_spent", F.lit(0)).alias("total_spent"),
        "best_signing", "worst_signing",
        F.coalesce("resales_count", F.lit(0)).alias("resales_count"),
        "avg_resale_profit_pct",
        F.coalesce("total_resale_profit", F.lit(0)).alias("total_resale_profit"),
        "best_flip", "worst_flip",
        F.coalesce("transfers_out", F.lit(0)).alias("transfers_out"),
        "avg_departure_score", "best_departure", "worst_departure",
        "score_improvement",
    )


# ---------------------------------------------------------------- leagues


def _before_latest(df: DataFrame, ts: str) -> DataFrame:
    """Rows with their ``year``, without the data's latest (incomplete) year."""
    latest = df.agg(F.max(F.year(ts)).alias("y"))
    return df.withColumn("year", F.year(ts)).filter(F.col("year") < latest.scalar())


def league_summary(df: DataFrame, m: Moves = SCORED, min_n: int = fv.MIN_LEAGUE_MOVES) -> DataFrame:
    """Moves, mean score and mean fee per destination league with enough moves."""
    return (
        df.filter(F.col(m.buyer_region).isNotNull())
        .groupBy(F.col(m.buyer_region).alias("league_id"))
        .agg(
            F.count(F.lit(1)).alias("transfers"),
            F.avg(m.score).alias("avg_score"),
            F.avg(paid(m.fee)).alias("avg_fee"),
        )
        .filter(F.col("transfers") >= min_n)
    )


def yearly(
    df: DataFrame, ts: str, aggs: Mapping[str, Column], by: Sequence[str] = (), min_n: int = 1, count: str = "transfers"
) -> DataFrame:
    """Aggregates per complete year (and ``by``) with at least ``min_n`` rows."""
    grouped = _before_latest(df, ts).groupBy(*by, "year").agg(
        F.count(F.lit(1)).alias(count), *[c.alias(o) for o, c in aggs.items()]
    )
    return grouped.filter(F.col(count) >= min_n)


def era_compare(df: DataFrame, m: Moves = SCORED, k: int = fv.ERA_YEARS) -> DataFrame:
    """First ``k`` against last ``k`` distinct complete years of each league.

    Leagues with fewer than ``2 k`` such years are absent. Works on one row
    per league and year, whatever the number of moves.
    """
    years = (
        _before_latest(df, m.ts)
        .filter(F.col(m.buyer_region).isNotNull())
        .groupBy(F.col(m.buyer_region).alias("league_id"), "year")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(paid(m.fee)).alias("fees"), F.sum(m.score).alias("scores"))
    )
    up = Window.partitionBy("league_id").orderBy("year")
    placed = years.withColumn("_up", F.row_number().over(up)).withColumn(
        "_all", F.count(F.lit(1)).over(Window.partitionBy("league_id"))
    )
    placed = placed.filter(F.col("_all") >= 2 * k)
    early, recent = F.col("_up") <= k, F.col("_up") > F.col("_all") - k

    def mean(c: str, era: Column) -> Column:
        return F.sum(F.when(era, F.col(c))) / F.sum(F.when(era, F.col("n")))

    out = placed.groupBy("league_id").agg(
        F.min(F.when(early, F.col("year"))).alias("_e0"), F.max(F.when(early, F.col("year"))).alias("_e1"),
        F.min(F.when(recent, F.col("year"))).alias("_r0"), F.max(F.when(recent, F.col("year"))).alias("_r1"),
        mean("fees", early).alias("early_avg_fee"), mean("fees", recent).alias("recent_avg_fee"),
        mean("scores", early).alias("early_avg_score"), mean("scores", recent).alias("recent_avg_score"),
    )
    growth = (F.col("recent_avg_fee") - F.col("early_avg_fee")) / F.col("early_avg_fee") * 100
    return out.select(
        "league_id",
        F.concat_ws("–", "_e0", "_e1").alias("early_years"),
        F.concat_ws("–", "_r0", "_r1").alias("recent_years"),
        "early_avg_fee", "recent_avg_fee",
        F.when(F.col("early_avg_fee") > 0, growth).alias("fee_growth_pct"),
        "early_avg_score", "recent_avg_score",
        (F.col("recent_avg_score") - F.col("early_avg_score")).alias("score_change"),
    )


def mix(df: DataFrame, by: str, category: str) -> DataFrame:
    """Count and share of each category within a group, ranked."""
    counts = df.filter(F.col(category).isNotNull()).groupBy(by, category).agg(F.count(F.lit(1)).alias("transfers"))
    totals = df.groupBy(F.col(by).alias("_mb")).agg(F.count(F.lit(1)).alias("_all"))
    joined = counts.join(totals, F.col(by) == F.col("_mb")).drop("_mb")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col("transfers").desc(), category))
    return joined.withColumns(
        {"pct": F.bround(F.col("transfers") / F.col("_all") * 100, 1), "rank": rank}
    ).drop("_all")


def mix_scored(df: DataFrame, by: str, category: str, value: str, min_n: int = fv.MIN_CLUB_POSITION) -> DataFrame:
    """Count and mean per category with a minimum sample, best first."""
    grouped = (
        df.filter(F.col(by).isNotNull() & F.col(category).isNotNull())
        .groupBy(by, category)
        .agg(F.count(F.lit(1)).alias("transfers"), F.avg(value).alias("avg_score"))
        .filter(F.col("transfers") >= min_n)
    )
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col("avg_score").desc(), category))
    return grouped.withColumn("rank", rank)


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows per group; the limit is applied before the shuffle too."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= k)


def flows(df: DataFrame, source: str, target: str, k: int = fv.TOP_PARTNERS) -> DataFrame:
    """Top partners of every region in both directions, without moves inside it.

    ``direction`` is buys_from or sells_to; null regions are no partners.
    """
    pairs = (
        df.filter(F.col(source).isNotNull() & F.col(target).isNotNull() & (F.col(source) != F.col(target)))
        .groupBy(F.col(source).alias("_s"), F.col(target).alias("_t"))
        .agg(F.count(F.lit(1)).alias("transfers"))
    )
    both = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("_t").alias("league_id"), F.lit("buys_from").alias("direction"), F.col("_s").alias("partner"), "transfers"),
                F.struct(F.col("_s").alias("league_id"), F.lit("sells_to").alias("direction"), F.col("_t").alias("partner"), "transfers"),
            )
        ).alias("_f")
    ).select("_f.*")
    return top_k(both, ["league_id", "direction"], [F.col("transfers").desc(), F.col("partner")], k)


def packed(df: DataFrame, by: str, order: str, fields: Sequence[str], out: str) -> DataFrame:
    """Per-group rows as one ordered array of structs; for a bounded number of rows each."""
    item = F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("r"))
    return df.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["r"]).alias(out))


def league_trends(df: DataFrame, m: Moves = SCORED) -> DataFrame:
    """League rows with eras, yearly series, partners and position mix nested."""
    base = league_summary(df, m)
    eras = era_compare(df, m)
    region = m.buyer_region
    by_year = yearly(
        df.filter(F.col(region).isNotNull()), m.ts,
        {"avg_score": F.avg(m.score), "avg_fee": F.avg(paid(m.fee))}, [region], fv.MIN_LEAGUE_YEAR, "count",
    ).withColumnRenamed(region, "league_id")
    partner = flows(df, m.seller_region, region)
    position = mix(df.filter(F.col(region).isNotNull()), region, m.group).withColumnRenamed(region, "league_id")
    nested = [
        packed(by_year, "league_id", "year", ["year", "avg_score", "avg_fee", "count"], "by_year"),
        packed(partner.filter("direction = 'buys_from'"), "league_id", "rank", ["partner", "transfers"], "buys_from"),
        packed(partner.filter("direction = 'sells_to'"), "league_id", "rank", ["partner", "transfers"], "sells_to"),
        packed(position, "league_id", "rank", [m.group, "transfers", "pct"], "position_mix"),
    ]
    out = base.join(eras, "league_id", "left")
    for table in nested:
        out = out.join(table, "league_id", "left")
    # A league too young for two eras shows no yearly series either.
    return out.withColumn("by_year", F.when(F.col("early_years").isNotNull(), F.col("by_year")))


# ---------------------------------------------------------------- trends


def binned_trend(
    df: DataFrame, x: str, y: str, q: int, by: Sequence[str] = (), skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """Equal-frequency bins of ``x``: median x, mean y and size of each.

    Edges are exact quantiles, duplicates dropped, bins closed on the right, so
    equal values always share a bin. Everything follows from the distinct
    values with their counts; the rows are shuffled once.
    """
    by = list(by)
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    counts = value_counts(rows, x, by, aggs={"_sy": F.sum(y)}, skew=skew)
    edges = quantiles(counts, x, q, by).select(*by, F.array_distinct("q").alias("_edges"))
    if by:
        names = [f"_e{i}" for i in range(len(by))]
        edges = edges.toDF(*names, "_edges")
        cond = [F.col(b).eqNullSafe(F.col(n)) for b, n in zip(by, names)]
        binned = counts.join(edges, cond).drop(*names)
    else:
        binned = counts.withColumn("_edges", edges.scalar())
    # Index of the first edge at or above the value; the lowest value joins bin 1.
    place = F.size(F.filter("_edges", lambda e: e < F.col(x)))
    binned = binned.withColumn("bin", F.greatest(place, F.lit(1)))
    sizes = binned.groupBy(*by, "bin").agg(
        F.sum("cnt").alias("n"), F.min("before").alias("_from"), (F.sum("_sy") / F.sum("cnt")).alias("avg_y")
    )
    names = [f"_s{i}" for i in range(len(by) + 1)]
    keyed = sizes.select(*[F.col(c).alias(n) for c, n in zip([*by, "bin"], names)], F.col("n").alias("_n"), "_from", "avg_y")
    cond = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip([*by, "bin"], names)]
    inside = binned.join(keyed, cond).drop(*names)
    first = F.col("before") - F.col("_from")
    last = first + F.col("cnt") - 1
    lo, hi = F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)
    return (
        inside.groupBy(*by, "bin")
        .agg(
            F.max(F.when(lo.between(first, last), F.col(x))).alias("_a"),
            F.max(F.when(hi.between(first, last), F.col(x))).alias("_b"),
            F.first("avg_y").alias("avg_y"),
            F.first("_n").alias("n"),
        )
        .select(*by, "bin", ((F.col("_a") + F.col("_b")) / 2).alias("x"), "avg_y", "n")
    )


def nearest_bucket(df: DataFrame, trend: DataFrame, value: str, score: str, dead_zone: float = 2.0) -> DataFrame:
    """Mean of the trend bucket nearest to ``value``, and where the score lands.

    A trend has at most as many buckets as its ``q``, so it travels with every
    row as one array.
    """
    buckets = trend.agg(F.array_sort(F.collect_list(F.struct("x", "avg_y"))).alias("b"))
    df = df.withColumn("_b", buckets.scalar())
    near = F.array_min(
        F.transform("_b", lambda t: F.struct(F.abs(t["x"] - F.col(value)).alias("d"), t["x"].alias("x"), t["avg_y"].alias("y")))
    )["y"]
    diff = F.col(score) - F.col("trend_avg")
    lands = F.when(F.abs(diff) < dead_zone, "in line with").when(diff > 0, "above").otherwise("below")
    return df.withColumn("trend_avg", near).withColumn("lands", lands).drop("_b")


def index_to_base(df: DataFrame, order: str, values: Sequence[str], by: Sequence[str] = (), base: Mapping[str, Column] | None = None) -> DataFrame:
    """Yearly values as an index: 100 in the first period, or against ``base``."""
    base = dict(base or {})
    out = {}
    if any(v not in base for v in values):
        if by:
            first = Window.partitionBy(*by).orderBy(order)
            for v in values:
                base.setdefault(v, F.first_value(v).over(first))
        else:
            start = df.agg(F.min(F.struct(order, *values)).alias("s"))
            df = df.withColumn("_start", start.scalar())
            for v in values:
                base.setdefault(v, F.col(f"_start.{v}"))
    for v in values:
        out[f"{v}_index"] = F.when(base[v] > 0, F.col(v) / base[v] * 100).otherwise(100.0)
    return df.withColumns(out).drop("_start")


def share_of_total(df: DataFrame, by: str, value: str, out: str = "share_pct") -> DataFrame:
    """Value as a percentage of its group's total."""
    totals = df.groupBy(F.col(by).alias("_tb")).agg(F.sum(value).alias("_tv"))
    joined = df.join(totals, F.col(by) == F.col("_tb"))
    return joined.withColumn(out, F.col(value) / F.col("_tv") * 100).drop("_tb", "_tv")


def head_to_head(cards: DataFrame, pairs: DataFrame, name: str = "club_name") -> DataFrame:
    """Organisations side by side; a winner only where higher is clearly better.

    ``pairs`` has ``a`` and ``b``. One row per pair and metric with both values.
    """
    metrics = {
        "transfers_in": False, "avg_incoming_score": True, "total_spent": False,
        "avg_resale_profit_pct": True, "transfers_out": False, "avg_departure_score": False,
    }
    values = F.struct(*[F.col(k).cast("double").alias(k) for k in metrics])
    left = cards.select(F.col(name).alias("a"), values.alias("_va"))
    right = cards.select(F.col(name).alias("b"), values.alias("_vb"))
    entries = F.array(
        *[F.struct(F.lit(i).alias("place"), F.lit(k).alias("metric"), F.col(f"_va.{k}").alias("a_value"),
                   F.col(f"_vb.{k}").alias("b_value"), F.lit(c).alias("c")) for i, (k, c) in enumerate(metrics.items())]
    )
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", F.explode(entries).alias("e")).select("a", "b", "e.*")
    x, y = F.col("a_value"), F.col("b_value")
    winner = F.when(F.col("c") & (x > y), F.col("a")).when(F.col("c") & (y > x), F.col("b"))
    return rows.withColumn("winner", winner).drop("c")


# ---------------------------------------------------------------- browsing


def filter_moves(
    df: DataFrame,
    *,
    position: str | None = None,
    league: str | None = None,
    q: str | None = None,
    ranges: Mapping[str, tuple[float | None, float | None]] | None = None,
    text_columns: Sequence[str] = ("name", "to_club_name", "from_club_name"),
    position_column: str = "position",
    league_column: str = "to_domestic_competition_id",
) -> DataFrame:
    """The browse filters: category, league, folded text, numeric ranges.

    A null value never passes a range bound. Loans use a duration range where
    purchases use a fee range; predictions use :func:`with_prediction` first.
    """
    if position:
        df = df.filter(F.col(position_column) == position)
    if league:
        df = df.filter(F.col(league_column) == league)
    for column, (lo, hi) in (ranges or {}).items():
        if lo is not None:
            df = df.filter(F.col(column) >= lo)
        if hi is not None:
            df = df.filter(F.col(column) <= hi)
    if q:
        found = F.lit(False)
        for c in text_columns:
            found = found | has_text(F.col(c), q)
        df = df.filter(found)
    return df


def with_prediction(df: DataFrame, column: str = "predicted_score") -> DataFrame:
    """Rows that have a held-out prediction."""
    return df.filter(F.col(column).isNotNull())


def sort_field(field: str | None, allowed: Sequence[str], default: str) -> str:
    """The requested sort field if it is allowed, else the default."""
    return field if field in allowed else default


def ordered(df: DataFrame, field: str, key: Sequence[str], descending: bool = True) -> list[Column]:
    """Sort columns with nulls last and the key as tie break."""
    c = F.col(field)
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), *[F.col(k) for k in key]]


def page(df: DataFrame, order: Sequence[Column], limit: int = 25, offset: int = 0) -> DataFrame:
    """One page: limit within 1..100, offset not negative."""
    limit = max(1, min(limit, 100))
    return df.orderBy(*order).offset(max(0, offset)).limit(limit)


def summarise(df: DataFrame, aggs: Mapping[str, Column]) -> DataFrame:
    """Totals over the whole filtered set, independent of the page."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[c.alias(o) for o, c in aggs.items()])


def facets(df: DataFrame, column: str, names: DataFrame | None = None, name_key: str = "competition_id") -> DataFrame:
    """Distinct non-null values of a column with their display names, sorted."""
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("id")).distinct()
    if names is None:
        return values.orderBy("id")
    table = names.select(F.col(name_key).alias("_fk"), "display_name")
    joined = values.join(table, F.col("id") == F.col("_fk"), "left")
    return joined.select("id", F.coalesce(F.col("display_name"), F.col("id").cast("string")).alias("name")).orderBy("name", "id")


def gate(df: DataFrame, field: str, rules: Mapping[str, tuple[str | None, int]]) -> DataFrame:
    """Drop rows whose sample is too small for ranking by ``field``, and null values."""
    sample, least = rules[field]
    if sample:
        df = df.filter(F.col(sample) >= least)
    return df.filter(F.col(field).isNotNull())


CLUB_RULES: dict[str, tuple[str | None, int]] = {
    "avg_incoming_score": ("transfers_in", fv.MIN_CLUB_MOVES),
    "avg_resale_profit_pct": ("resales_count", fv.MIN_CLUB_RESALES),
    "avg_departure_score": ("transfers_out", fv.MIN_CLUB_MOVES),
    "total_spent": (None, 0),
    "total_resale_profit": (None, 0),
    "transfers_in": (None, 0),
    "transfers_out": (None, 0),
    "score_improvement": (None, 0),
}


def club_leaderboard(cards: DataFrame, sort: str | None = None, descending: bool = True, league: str | None = None,
                     q: str | None = None, limit: int = 25, offset: int = 0) -> DataFrame:
    """A page of the club ranking, gated by the sample the sort field needs."""
    field = sort_field(sort, list(CLUB_RULES), "avg_incoming_score")
    found = filter_moves(cards, league=league, q=q, league_column="league_id", text_columns=("club_name",))
    gated = gate(found, field, CLUB_RULES)
    return page(gated, ordered(gated, field, ["club_name"], descending), limit, offset)


LEAGUE_SORTS = ("transfers", "avg_score", "avg_fee", "fee_growth_pct", "score_change")


def league_leaderboard(leagues: DataFrame, sort: str | None = None, descending: bool = True) -> DataFrame:
    """Every league in the order of a whitelisted field, with its ``place``; leagues without that field are left out.

    Leagues are a bounded set: one row each, numbered in one ordered pass.
    """
    field = sort_field(sort, LEAGUE_SORTS, "transfers")
    known = leagues.filter(F.col(field).isNotNull())
    first = F.col(field).desc() if descending else F.col(field).asc()
    return ordered_place(known, [first, F.col("league_id")])


def ordered_place(df: DataFrame, order: Sequence[Column], out: str = "place") -> DataFrame:
    """Rows of a small table with their place in an order, from 1."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(*order)))


def search(df: DataFrame, column: str, q: str, order: Sequence[Column], limit: int = 10) -> DataFrame:
    """Folded substring search; fewer than two characters find nothing."""
    if len(q) < 2:
        return df.limit(0)
    return df.filter(has_text(F.col(column), q)).orderBy(*order).limit(max(1, min(limit, 50)))


def point_lookup(df: DataFrame, **key: object) -> DataFrame:
    """The row of a natural key."""
    for column, value in key.items():
        df = df.filter(F.col(column) == F.lit(value))
    return df


def latest_by(df: DataFrame, by: Sequence[str], order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """The latest row per key, as an aggregate that combines before the shuffle."""
    pick = F.max(F.struct(*order, F.struct(*carry).alias("r")))["r"]
    return df.groupBy(*by).agg(pick.alias("_r")).select(*by, "_r.*")


def breakdown(df: DataFrame, column: str) -> DataFrame:
    """Rows per category."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def present(df: DataFrame, columns: Mapping[str, str | tuple[str, int]]) -> DataFrame:
    """Display columns: ``out: input`` as is, ``out: (input, digits)`` rounded half-even; nulls stay null."""
    shown = {o: F.col(c) if isinstance(c, str) else F.bround(c[0], c[1]) for o, c in columns.items()}
    return df.select(*[c.alias(o) for o, c in shown.items()])


def coverage(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Percentage of rows with each flag set."""
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(f).cast("int") * 100.0).alias(f) for f in flags])


def display_names(df: DataFrame, key: str, name: str, qualifier: str) -> DataFrame:
    """``display_name``: the name, with its qualifier where several rows share it."""
    shared = df.groupBy(F.col(name).alias("_dn")).agg(F.count(F.lit(1)).alias("_c"))
    joined = df.join(shared, F.col(name) == F.col("_dn"), "left")
    several = (F.col("_c") > 1) & F.col(qualifier).isNotNull()
    shown = F.when(several, F.concat(F.col(name), F.lit(" ("), F.col(qualifier), F.lit(")"))).otherwise(F.col(name))
    return joined.withColumn("display_name", shown).drop("_dn", "_c")


def league_label(df: DataFrame, column: str, names: DataFrame, out: str, name_key: str = "competition_id") -> DataFrame:
    """Display name of a league id: "Unknown league" if null, the id if not listed."""
    t = names.select(F.col(name_key).alias("_lk"), F.col("display_name").alias("_ln"))
    joined = df.join(t, F.col(column) == F.col("_lk"), "left")
    shown = F.when(F.col(column).isNull(), "Unknown league").otherwise(F.coalesce(F.col("_ln"), F.col(column).cast("string")))
    return joined.withColumn(out, shown).drop("_lk", "_ln")
