"""Readers, feeds, refresh, sinks, seasons and snapshots."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from movelens import fixed_values as fv
from movelens import schemas
from movelens.operators import reports as rp
from movelens.operators import snapshots as sn
from movelens.operators import stitch as stx
from movelens.operators.careers import distinct_subjects, merge_careers, peak_stop, timeline
from movelens.operators.quality import burst_distinct
from movelens.sources import feeds, sinks, tables
from movelens.streaming.refresh import refresh_types

D = dt.date


def test_csv_with_placeholder_dates(spark, tmp_path):
    p = tmp_path / "transfer_types.csv"
    p.write_text("player_id,transfer_date,from_club_id,to_club_id,transfer_type,fee_raw,extra\n1,2020-01-05,10.0,11,paid,x,y\n2,0000-00-00,1,2,free,,\n3,junk,,2,loan,,\n")
    got = tables.read_table(spark, str(p), schemas.TRANSFER_TYPES)
    assert got.schema.fieldNames() == schemas.TRANSFER_TYPES.fieldNames()
    assert [tuple(r)[:4] for r in got.orderBy("player_id").collect()] == [(1, D(2020, 1, 5), 10, 11), (2, None, 1, 2), (3, None, None, 2)]


def test_missing_table_is_empty(spark, tmp_path):
    got = tables.read_or_empty(spark, str(tmp_path / "nothing.parquet"), schemas.CLUBS)
    assert got.count() == 0 and got.columns == schemas.CLUBS.fieldNames()


def test_types_prefer_the_feed(spark):
    fed = spark.createDataFrame([(1, D(2020, 1, 1), 1, 2, "loan", "a"), (1, D(2020, 1, 1), 1, 2, "loan", "a"), (9, None, 1, 2, "paid", "")], schemas.TRANSFER_TYPES)
    manual = spark.createDataFrame(
        [(1, D(2020, 1, 1), 1, 2, "", "", None, None, "", "paid", ""), (2, D(2020, 1, 1), 1, 2, "", "", None, None, "", "", "")], schemas.MANUAL_TRANSFERS
    )
    assert [(r.player_id, r.transfer_type) for r in tables.load_types(fed, manual).collect()] == [(1, "loan")]


def test_leaderboard_files(spark, tmp_path):
    row = {"fotmob_id": 7, "fotmob_name": "A", "fotmob_team": "T", "minutes_played": 90.0, "matches_played": 1.0, "fotmob_rating": 7.1}
    (tmp_path / "GB1_2019-2020.json").write_text(json.dumps([row]))
    (tmp_path / "GB1_2018-2019.json").write_text("null")
    got = feeds.load_leaderboards(spark, str(tmp_path)).collect()
    assert [(r.league, r.season, r.provider_id, r.fotmob_rating, r.fotmob_saves) for r in got] == [("GB1", 2019, 7, 7.1, None)]


HISTORY = {"transfers": [
    {"dateUnformatted": "2020-07-01", "from": {"href": "/a/verein/5/x"}, "to": {"href": "/b/verein/6"}, "fee": "€3.00m"},
    {"dateUnformatted": "0000-00-00", "from": {"href": "/a/verein/5"}, "to": {"href": "/b/verein/6"}, "fee": "-"},
    {"dateUnformatted": "2021-01-01", "from": None, "to": {"href": "/without-club"}, "fee": "End of loan"},
]}


def test_refresh_stores_every_subject_once(spark, tmp_path):
    landed, store, marks = tmp_path / "in", tmp_path / "store", tmp_path / "marks"
    landed.mkdir()
    def land(name, *ids):
        (landed / name).write_text("\n".join(json.dumps({"player_id": i, "body": json.dumps(HISTORY)}) for i in ids))
    land("one.json", 1, 2)
    refresh_types(spark, str(landed), str(store), str(marks))
    land("two.json", 2, 3, 3)
    refresh_types(spark, str(landed), str(store), str(marks))
    refresh_types(spark, str(landed), str(store), str(marks))
    got = spark.read.parquet(str(store))
    assert sorted((r.player_id, r["count"]) for r in got.groupBy("player_id").count().collect()) == [(1, 2), (2, 2), (3, 2)]
    first = got.filter("player_id = 1").orderBy("transfer_date").collect()
    assert [(r.from_club_id, r.to_club_id, r.transfer_type) for r in first] == [(5, 6, "paid"), (None, None, "loan")]
    asked = spark.createDataFrame([(1,), (4,), (4,)], "player_id long")
    assert [r[0] for r in tables.pending_keys(asked, got, ["player_id"]).collect()] == [4]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, D(2020, 1, 1), float("nan")), (1, D(2019, 5, 1), 1.5)], "id int, d date, v double")
    sinks.write_stage(df, str(tmp_path / "t"), ["id", "d", "v"], "d")
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.filter("year = 2019").count() == 1
    sinks.export_csv(df, str(tmp_path / "c"), [F.col("id")])
    assert [r.id for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()] == ["1", "2"]
    sinks.save_fitted({"x": df}, str(tmp_path / "fit"))
    assert sinks.load_fitted(spark, str(tmp_path / "fit"), ["x"])["x"].count() == 2
    assert [json.loads(r.json)["v"] for r in sinks.as_json(df.orderBy("id")).collect()] == [1.5, None]


def test_seasons(spark):
    d = spark.createDataFrame([(1, D(2019, 7, 31), D(2020, 8, 1)), (2, D(2021, 9, 1), D(2030, 1, 1))], "id int, a date, z date")
    got = {(r.id, r.season) for r in stx.explode_seasons(d, "a", "z", D(2022, 7, 1)).collect()}
    assert got == {(1, 2018), (1, 2019), (1, 2020), (2, 2021)}


def test_spoiled_seasons(spark):
    cols = "id int, transfer_date date, tenure_end date, league string, from_domestic_competition_id string, next_competition_id string, season int"
    rows = [
        (1, D(2020, 1, 10), D(2021, 7, 1), "L", "L", None, 2019),   # joined inside the league in winter
        (2, D(2020, 7, 10), D(2021, 7, 1), "L", "L", None, 2020),   # in summer
        (3, D(2020, 1, 10), D(2021, 7, 1), "L", "M", None, 2019),   # from another league
        (4, D(2019, 7, 10), D(2021, 2, 1), "L", "M", "L", 2020),    # left inside the league in winter
        (5, D(2019, 7, 10), D(2021, 2, 1), "L", None, "M", 2020),
    ]
    got = {r.id for r in stx.drop_contaminated(spark.createDataFrame(rows, cols)).collect()}
    assert got == {2, 3, 5}


def test_stitch_weights(spark):
    rows = [("a", 90.0, 1.0, 6.0, 2.0), ("a", 270.0, 3.0, 8.0, 3.0), ("a", 100.0, 1.0, None, None), ("b", 0.0, 1.0, 5.0, 1.0), ("b", 0.0, 1.0, 7.0, 1.0)]
    d = spark.createDataFrame(rows, "k string, minutes_played double, matches_played double, fotmob_rating double, fotmob_saves double")
    got = {r.k: r for r in stx.stitch(d, ["k"], ["fotmob_rating"], ["fotmob_saves"]).collect()}
    assert got["a"].fotmob_rating == pytest.approx((6 * 90 + 8 * 270) / 360) and got["a"].fotmob_saves == 5 and got["a"].fotmob_seasons_used == 3
    assert got["b"].fotmob_rating == 6.0  # no minutes at all: a plain mean


def test_player_snapshot_and_scenarios(spark):
    now = D(2022, 6, 30)
    players = spark.createDataFrame(
        [
            (1, "In", D(2000, 1, 1), "Attack", None, None, 180.0, 10, "Home", 2.26e6, "GB1"),
            (2, "Out", D(1990, 1, 1), "Attack", "X", "left", 180.0, 20, "Away", 200e6, "MLS1"),
            (3, "Cheap", D(1990, 1, 1), "Attack", "X", "left", 180.0, 10, "Home", 5e5, "GB1"),
            (4, "Idle", D(1990, 1, 1), "Attack", "X", "left", 180.0, 10, "Home", 3e6, "GB1"),
        ],
        schemas.PLAYERS,
    )
    apps = spark.createDataFrame(
        [("a", 1, 10, "GB1", D(2022, 5, 1), 1, 1, 90), ("b", 1, 11, "GB1", D(2022, 5, 2), 5, 5, 90), ("c", 1, 10, "GB1", D(2021, 5, 1), 5, 5, 90), ("d", 2, 20, "X", D(2022, 5, 1), 1, 0, 90)],
        schemas.APPEARANCES,
    )
    stats = spark.createDataFrame([(1, 900.0, 20.0)], "player_id long, recent_fotmob_total_minutes double, recent_fotmob_total_att_assist double")
    for s in fv.PRE_STATS:
        c = s.replace("pre_", "recent_", 1)
        if c != "recent_fotmob_chances_created_p90":
            stats = stats.withColumn(c, F.lit(None).cast("double"))
    snap = sn.player_snapshot(players, apps, stats, now)
    got = {r.player_id: r for r in snap.collect()}
    assert set(got) == {1, 2, 4}
    assert (got[1].recent_apps, got[1].recent_ga_p90, got[1].recent_fotmob_chances_created_p90) == (1, 2.0, 2.0)
    assert got[2].recent_apps is None and got[4].recent_apps == 0
    clubs = spark.createDataFrame([(10, "Home", "GB1"), (30, "New", None)], schemas.CLUBS)
    value = sn.club_snapshot(clubs, players)
    assert {r.club_id: r.club_value_proxy for r in value.collect()} == {10: 2.26e6 + 5e5 + 3e6}
    clubs = clubs.withColumn("club_value_proxy", F.lit(7.0))
    scen = {r.player_id: r for r in sn.make_scenarios(spark.createDataFrame([(1, 30), (2, 30)], "player_id long, to_club_id long"), snap, clubs).collect()}
    assert (scen[1].transfer_fee, scen[1].sub_position, scen[1].foot, scen[1].to_domestic_competition_id) == (2e6, "Attack", "unknown", "unknown")
    assert (scen[2].transfer_fee, scen[2].from_domestic_competition_id, scen[2].from_total_market_value) == (150e6, "MLS1", 1.0)


def test_role_from_lineups(spark):
    players = spark.createDataFrame([(1, "P", None, "Midfield", "Old", None, None, None, None, None, None), (2, "Q", None, "Midfield", "Kept", None, None, None, None, None, None)], schemas.PLAYERS)
    lineups = spark.createDataFrame([(1, "midfield"), (1, "Midfield"), (1, "Winger"), (1, "Winger"), (1, "midfield")], "player_id long, position string")
    got = {r.player_id: r.sub_position for r in sn.players_with_role(players, lineups).collect()}
    assert got == {1: "Midfield", 2: "Kept"}


def test_careers(spark):
    cols = "player_id int, name string, transfer_date date, success_score double"
    a = spark.createDataFrame([(1, "A", D(2020, 1, 1), 50.0), (1, "A", D(2022, 1, 1), 80.0), (2, "B", D(2021, 1, 1), 10.0)], cols)
    b = spark.createDataFrame([(1, "A2", D(2021, 1, 1), 80.0), (3, "C", D(2021, 1, 1), 5.0)], cols.replace("success", "loan_success"))
    stops = timeline(a, b, ["player_id", "name", "transfer_date"])
    assert stops.count() == 5
    assert {r.player_id: r.transfer_date for r in peak_stop(stops, "player_id", "transfer_date", "score").collect()}[1] == D(2021, 1, 1)
    pairs = spark.createDataFrame([(9, 1, 2)], "pair int, a int, b int")
    merged = merge_careers(stops, pairs, tie=["type"]).orderBy("place").collect()
    assert [r.side for r in merged] == ["a", "a", "b", "a"]
    assert {r.player_id: r["name"] for r in distinct_subjects([a, b], "player_id", "name").collect()} == {1: "A", 2: "B", 3: "C"}


def test_gates_pages_and_names(spark):
    cards = spark.createDataFrame([("a", 4, 90.0), ("b", 5, 50.0), ("c", 9, None), ("d", 8, 60.0)], "club_name string, transfers_in int, avg_incoming_score double")
    got = rp.club_leaderboard(cards.withColumn("league_id", F.lit("L")), sort="nonsense")
    assert [r.club_name for r in got.collect()] == ["d", "b"]
    df = spark.range(300).toDF("n")
    assert [r.n for r in rp.page(df, [F.col("n")], 1000, -5).collect()] == list(range(100))
    assert rp.search(df.select(F.col("n").cast("string").alias("s")), "s", "1", [F.col("s")]).count() == 0
    leagues = spark.createDataFrame([("A1", "Bundesliga", "Austria"), ("L1", "Bundesliga", "Germany"), ("X", "Cup", None)], schemas.COMPETITIONS)
    names = rp.display_names(leagues, "competition_id", "name", "country_name")
    assert {r.competition_id: r.display_name for r in names.collect()} == {"A1": "Bundesliga (Austria)", "L1": "Bundesliga (Germany)", "X": "Cup"}
    shown = rp.league_label(spark.createDataFrame([("A1",), (None,), ("ZZ",)], "l string"), "l", names, "shown")
    assert sorted(r.shown for r in shown.collect()) == ["Bundesliga (Austria)", "Unknown league", "ZZ"]


def test_fee_bounds_drop_unknown_fees(spark):
    d = spark.createDataFrame([("José", None), ("Ana", 5.0)], "name string, fee double")
    assert [r["name"] for r in rp.filter_moves(d, ranges={"fee": (0.0, None)}, text_columns=("name",)).collect()] == ["Ana"]
    assert [r["name"] for r in rp.filter_moves(d, q="jose", text_columns=("name",)).collect()] == ["José"]


def test_burst(spark):
    rows = [(1, "a", D(2020, 1, 1)), (1, "b", D(2020, 1, 15)), (1, "a", D(2020, 1, 29)), (1, "c", D(2020, 2, 10)), (2, "a", D(2020, 1, 1)), (2, "b", D(2020, 1, 31)), (2, "c", D(2020, 3, 1))]
    got = burst_distinct(spark.createDataFrame(rows, "k int, v string, d date"), "k", "v", "d", days=30, n=3)
    assert [(r.k, r.peak) for r in got.collect()] == [(1, 3)]
