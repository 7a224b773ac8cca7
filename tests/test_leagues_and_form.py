from movelens.operators import reports as rp
from movelens.operators import snapshots as sn


def test_league_leaderboard(spark):
    rows = [("a", 30, 50.0, 1.0, None), ("b", 20, 60.0, 5.0, 4.0), ("c", 20, 40.0, 5.0, -4.0), ("d", 90, None, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "league_id string, transfers int, avg_score double, avg_fee double, fee_growth_pct double")
    order = lambda **k: [r.league_id for r in rp.league_leaderboard(df, **k).orderBy("place").collect()]
    assert order() == ["d", "a", "b", "c"]
    assert order(sort="avg_fee") == ["b", "c", "d", "a"]
    assert order(sort="avg_fee", descending=False) == ["a", "d", "b", "c"]
    assert order(sort="fee_growth_pct") == ["b", "d", "c"]  # leagues without the field are left out
    assert order(sort="no such field") == order()
    assert rp.league_leaderboard(df.limit(0)).count() == 0


def test_form_against_the_own_league(spark):
    players = spark.createDataFrame(
        [(1, "X", "A", 0.6), (2, "Y", "A", 0.6), (3, "Z", "B", 0.5), (4, "X", "A", None), (5, None, "A", 0.3)],
        "id int, current_club_domestic_competition_id string, position string, recent_ga_p90 double")
    cells = spark.createDataFrame([("X", "A", 0.3), ("Y", "A", 0.0), ("_default", "A", 0.2), ("_default", "B", 0.25)], "competition_id string, position string, ga_p90_baseline double")
    got = {r.id: r.recent_ga_p90_vs_league for r in sn.vs_own_league(players, cells).collect()}
    assert {k: v if v is None else round(v, 9) for k, v in got.items()} == {1: 2.0, 2: None, 3: 2.0, 4: None, 5: 1.5}
