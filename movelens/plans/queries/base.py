"""Registry, table access and the two readings shared by the queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from movelens.operators.asof import asof_join
from movelens.operators.reports import Moves
from movelens.operators.scan import Skew
from movelens.operators.spells import build_spells
from movelens.operators.windows import TimeWindow, disjoint_window_agg, window_sums
from movelens.sources.staging import stage

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NOW = "2024-02-01 00:00:00"


class Tables:
    """The driver's tables of one folder, as they are when a query is built."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._frames: dict[str, DataFrame] = {}
        self._rows: dict[str, int] = {}
        self._most: dict[tuple[str, str], int] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self._frames[name]

    def skew(self, *names: str) -> Skew:
        """Guard with the tables' row count, which Parquet footers give for free."""
        total = 0
        for n in names:
            if n not in self._rows:
                self._rows[n] = getattr(self, n).count()
            total += self._rows[n]
        return Skew(rows_at_most=total)

    def most(self, name: str, key: str) -> int:
        """Rows of the table's most frequent key, null included."""
        if (name, key) not in self._most:
            found = getattr(self, name).groupBy(key).count().agg(F.max("count").alias("n")).first().n
            self._most[name, key] = found or 1
        return self._most[name, key]


def query(name: str, sql: str | None = None):
    """Register a query and its SQL twin."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, path: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, path))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def micros(c: str) -> Column:
    """A timestamp as microseconds since 1970."""
    return F.unix_micros(F.col(c).cast("timestamp"))


def cents(c: str) -> Column:
    """An amount in whole cents, so that sums do not depend on their order."""
    return F.round(F.col(c) * 100).cast("long")


def day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


# ---------------------------------------------------------------- spells


def user_events(t: Tables, *kinds: str) -> DataFrame:
    e = t.events.filter(F.col("event_type").isin(*kinds)) if kinds else t.events
    return e.select("event_id", "user_id", "ts", "event_type", cents("value").alias("cents"))


def user_skew(t: Tables) -> Skew:
    """Guard for scans of events by user: no user has more than events of one user, repeated as the customers may be.

    One count of the tables' keys spares every scan a pass over all that comes before it, only to count.
    """
    guard = t.skew("events")
    if guard.rows_at_most <= guard.hot_rows:
        return guard
    most = t.most("events", "user_id") * t.most("customer", "c_custkey")
    return guard.bounded(most) if most <= guard.hot_rows else guard.bounded(None)


def purchase_spells(t: Tables) -> DataFrame:
    """One spell per purchase, up to the user's next purchase or now."""
    moves = user_events(t, "purchase").drop("event_type")
    return build_spells(
        moves, NOW, subject="user_id", ts="ts", tie=["event_id"], end="end_ts",
        carry={"next_cents": "cents"}, skew=user_skew(t),
    )


def placed_events(t: Tables, *kinds: str) -> DataFrame:
    """Events with the user's nation."""
    home = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("nation"))
    return user_events(t, *kinds).join(home, "user_id")


def spell_windows(t: Tables) -> DataFrame:
    """Spells with activity before and during, and events of the user's nation during."""
    person = t.customer.select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")
    )
    # read for both kinds of windows and once more for the rows themselves
    spells = stage(purchase_spells(t).join(person, "user_id"), "spells")
    start, end = F.col("ts"), F.col("end_ts")
    active = window_sums(
        spells, user_events(t, "click", "view"), key=["event_id"], facts_by=["user_id"], ts="ts",
        windows=[
            TimeWindow("pre_", ("user_id",), start - F.expr("INTERVAL 7 DAYS"), start, True, False),
            TimeWindow("post_", ("user_id",), start, end),
        ],
        sums={"apps": F.lit(1), "cents": F.col("cents")}, skew=user_skew(t),
    )
    games = window_sums(
        spells, placed_events(t), key=["event_id"], facts_by=["nation"], ts="ts",
        windows=[TimeWindow("", ("nation",), start, end)], sums={"games": F.lit(1)}, skew=t.skew("events"),
    )
    return spells.join(active, "event_id").join(games, "event_id")


def spell_values(t: Tables, spells: DataFrame | None = None) -> DataFrame:
    """Spells with the user's value before, after and at its peak."""
    import datetime as dt

    spells = purchase_spells(t) if spells is None else spells
    values = user_events(t, "signup").select("user_id", "ts", "cents", "event_id")
    guard = user_skew(t)
    df = asof_join(
        spells, values, by=["user_id"], left_on="ts", right_on="ts", take={"before": "cents"},
        direction="backward", tolerance=dt.timedelta(days=10), right_tie=["event_id"], skew=guard,
    )
    df = asof_join(
        df, values, by=["user_id"], left_on="end_ts", right_on="ts", take={"after": "cents"},
        direction="nearest", tolerance=dt.timedelta(days=5), right_tie=["event_id"], skew=guard,
    )
    df = stage(df, "spell-values")
    peak = disjoint_window_agg(
        df, values, key=["event_id"], by=["user_id"], start="ts", end="end_ts", ts="ts",
        carry=["cents"], aggs={"peak": F.max("cents")}, skew=guard,
    )
    return df.join(peak, "event_id", "left").withColumn("peak", F.greatest("peak", "after"))


SPELLS_SQL = """
spells AS (
  SELECT event_id, user_id, ts, CAST(round(value * 100) AS BIGINT) AS cents,
    coalesce(lead(ts) OVER w, TIMESTAMP '2024-02-01 00:00:00') AS end_ts,
    lead(CAST(round(value * 100) AS BIGINT)) OVER w AS next_cents
  FROM events WHERE event_type = 'purchase'
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
)"""
WINDOWS_SQL = SPELLS_SQL + """,
active AS (
  SELECT s.event_id,
    count(CASE WHEN a.ts >= s.ts - INTERVAL 7 DAY AND a.ts < s.ts THEN 1 END) AS pre_apps,
    coalesce(sum(CASE WHEN a.ts >= s.ts - INTERVAL 7 DAY AND a.ts < s.ts THEN CAST(round(a.value * 100) AS BIGINT) END), 0) AS pre_cents,
    count(CASE WHEN a.ts > s.ts AND a.ts <= s.end_ts THEN 1 END) AS post_apps,
    coalesce(sum(CASE WHEN a.ts > s.ts AND a.ts <= s.end_ts THEN CAST(round(a.value * 100) AS BIGINT) END), 0) AS post_cents
  FROM spells s LEFT JOIN events a ON a.user_id = s.user_id AND a.event_type IN ('click', 'view')
  GROUP BY s.event_id
),
placed AS (SELECT e.*, c.c_nationkey AS nation FROM events e JOIN customer c ON c.c_custkey = e.user_id),
games AS (
  SELECT s.event_id, count(p.event_id) AS games
  FROM spells s JOIN customer c ON c.c_custkey = s.user_id
  LEFT JOIN placed p ON p.nation = c.c_nationkey AND p.ts > s.ts AND p.ts <= s.end_ts
  GROUP BY s.event_id
),
facts AS (
  SELECT s.*, c.c_nationkey AS nation, c.c_mktsegment AS segment,
    a.pre_apps, a.pre_cents, a.post_apps, a.post_cents, g.games
  FROM spells s JOIN customer c ON c.c_custkey = s.user_id
  JOIN active a USING (event_id) JOIN games g USING (event_id)
)"""


def values_sql(source: str = "spells") -> str:
    """CTEs ``signups`` and ``valued``: ``source`` with before, after and peak."""
    return f"""
signups AS (SELECT user_id, ts, event_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE event_type = 'signup'),
before_ AS (
  SELECT s.event_id, arg_max(v.cents, (v.ts, v.event_id)) AS before
  FROM {source} s JOIN signups v ON v.user_id = s.user_id AND v.ts <= s.ts AND v.ts >= s.ts - INTERVAL 10 DAY GROUP BY 1
),
after_ AS (
  SELECT event_id, cents AS after FROM (
    SELECT s.event_id, v.cents, row_number() OVER (
      PARTITION BY s.event_id ORDER BY abs(epoch_us(v.ts) - epoch_us(s.end_ts)), v.ts,
        CASE WHEN v.ts <= s.end_ts THEN -v.event_id ELSE v.event_id END) AS rn
    FROM {source} s JOIN signups v ON v.user_id = s.user_id
      AND v.ts BETWEEN s.end_ts - INTERVAL 5 DAY AND s.end_ts + INTERVAL 5 DAY
  ) WHERE rn = 1
),
peak_ AS (
  SELECT s.event_id, max(v.cents) AS peak FROM {source} s JOIN signups v
    ON v.user_id = s.user_id AND v.ts > s.ts AND v.ts <= s.end_ts GROUP BY 1
),
valued AS (
  SELECT s.*, b.before, a.after, greatest(p.peak, a.after) AS peak
  FROM {source} s LEFT JOIN before_ b USING (event_id) LEFT JOIN after_ a USING (event_id) LEFT JOIN peak_ p USING (event_id)
)"""


def rank_sql(value: str, by: str = "") -> str:
    """Average-tie percentile rank over the rows of the FROM clause."""
    part = f"PARTITION BY {by} " if by else ""
    ties = f"PARTITION BY {by}, {value}" if by else f"PARTITION BY {value}"
    return (
        f"((rank() OVER ({part}ORDER BY {value}) - 1) + (count(*) OVER ({ties}) + 1) / 2.0)"
        f" / count(*) OVER ({part}) * 100"
    )


# ---------------------------------------------------------------- deals

DEALS = Moves(
    key=("deal_id",), ts="d", buyer="buyer", seller="seller", buyer_region="buyer_region",
    seller_region="seller_region", group="segment", fee="fee", next_fee="next_fee", resale_pct="resale_pct",
    score="score", card=("deal_id", "subject", "score", "d"),
)


def deals(t: Tables) -> DataFrame:
    """Orders as deals between nations."""
    first = t.lineitem.groupBy(F.col("l_orderkey").alias("deal_id")).agg(F.min("l_suppkey").alias("s_suppkey"))
    seller = first.join(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("seller")), "s_suppkey")
    nation = t.nation.select(F.col("n_nationkey").alias("_n"), F.col("n_regionkey").alias("_r"))
    orders = t.orders.select(
        F.col("o_orderkey").alias("deal_id"), F.col("o_custkey").alias("subject"), F.to_date("o_orderdate").alias("d"),
        cents("o_totalprice").alias("fee"), F.floor(F.col("o_totalprice") / 5000).cast("double").alias("score"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
    )
    person = t.customer.select(
        F.col("c_custkey").alias("subject"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("buyer"),
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"),
    )
    df = orders.join(person, "subject").join(seller.drop("s_suppkey"), "deal_id", "left")
    df = df.join(nation.withColumnRenamed("_r", "buyer_region"), F.col("buyer") == F.col("_n"), "left").drop("_n")
    return df.join(nation.withColumnRenamed("_r", "seller_region"), F.col("seller") == F.col("_n"), "left").drop("_n")


def subject_skew(t: Tables) -> Skew:
    """Guard for scans of deals by subject: no subject has more of them than orders, repeated as often as the joins may.

    Counting the keys of the tables spares a pass over the joined deals that only counts them.
    """
    guard = t.skew("orders")
    if guard.rows_at_most <= guard.hot_rows:
        return guard
    most = 1
    for name, key, times in (("orders", "o_custkey", 1), ("customer", "c_custkey", 1), ("supplier", "s_suppkey", 1), ("nation", "n_nationkey", 2)):
        rows = getattr(t, name).filter(F.col(key).isNotNull()).groupBy(key).count().agg(F.max("count").alias("n")).first().n
        most *= (rows or 1) ** times
    return guard.bounded(min(most, guard.rows_at_most)) if most <= guard.hot_rows else guard.bounded(None)


def resold(t: Tables) -> DataFrame:
    """Deals with the fee of the customer's next order."""
    from movelens.operators.scan import ordered_scan

    return ordered_scan(deals(t), ["subject"], ["d", "deal_id"], lead={"next_fee": F.col("fee")}, skew=subject_skew(t))


DEALS_SQL = """
deals AS (
  SELECT o.o_orderkey AS deal_id, o.o_custkey AS subject, CAST(o.o_orderdate AS DATE) AS d,
    CAST(round(o.o_totalprice * 100) AS BIGINT) AS fee, CAST(floor(o.o_totalprice / 5000) AS DOUBLE) AS score,
    o.o_orderstatus AS status, o.o_orderpriority AS priority,
    c.c_name AS name, c.c_nationkey AS buyer, c.c_mktsegment AS segment, c.c_acctbal AS balance,
    s.s_nationkey AS seller, nb.n_regionkey AS buyer_region, ns.n_regionkey AS seller_region
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS sk FROM lineitem GROUP BY 1) f ON f.l_orderkey = o.o_orderkey
  LEFT JOIN supplier s ON s.s_suppkey = f.sk
  LEFT JOIN nation nb ON nb.n_nationkey = c.c_nationkey
  LEFT JOIN nation ns ON ns.n_nationkey = s.s_nationkey
)"""
RESOLD_SQL = DEALS_SQL + """,
resold AS (SELECT *, lead(fee) OVER (PARTITION BY subject ORDER BY d, deal_id) AS next_fee FROM deals)"""
