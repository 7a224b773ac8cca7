"""The scoring job against a plain recomputation on generated careers."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from movelens import fixed_values as fv
from movelens.operators import quality as qa
from movelens.operators.scoring import load_loan_weights, load_weights
from movelens.plans.scoring import run_scoring
from tests import careers


@pytest.fixture(scope="module")
def raw():
    return careers.build()


@pytest.fixture(scope="module")
def scored(spark, raw):
    tables = careers.to_spark(spark, raw)
    board = careers.board_to_spark(spark, careers.board(raw))
    return run_scoring(spark, tables, careers.NOW, board)


@pytest.fixture(scope="module")
def moves(scored):
    return scored.moves.toPandas()


def plain_spells(raw, loans):
    t = pd.concat([raw["transfers"], raw["manual_transfers"][raw["transfers"].columns]])
    t = t[t.from_club_id.notna() & t.to_club_id.notna()]
    t = t[(t.transfer_date >= dt.date(2013, 1, 1)) & (t.transfer_date <= careers.NOW) & (t.from_club_id != t.to_club_id)]
    kinds = {tuple(r[:4]): (r[4], r[5]) for r in raw["transfer_types"].itertuples(index=False)}
    out = []
    for pid, g in t.groupby("player_id"):
        g = g.sort_values(["transfer_date", "from_club_id", "to_club_id"])
        recs = []
        for r in g.itertuples(index=False):
            kind, text = kinds.get((r.player_id, r.transfer_date, r.from_club_id, r.to_club_id), ("unknown", ""))
            recs.append((r, kind, text))
        if not loans:
            recs = [x for x in recs if x[1] != "loan"]
        for i, (r, kind, text) in enumerate(recs):
            nxt = recs[i + 1][0] if i + 1 < len(recs) else None
            end = nxt.transfer_date if nxt is not None else careers.NOW
            if loans and not (kind == "loan" and "end of loan" not in text.lower() and (end - r.transfer_date).days >= 14):
                continue
            out.append({**r._asdict(), "tenure_end": end, "next_fee": None if nxt is None else nxt.transfer_fee})
    return out


def plain_facts(raw, spell):
    apps = raw["appearances"]
    fix = {r.appearance_id: (r.wrong_club_id, r.correct_club_id) for r in raw["manual_appearance_corrections"].itertuples()}
    mine = apps[apps.player_id == spell["player_id"]].copy()
    mine["club"] = [fix[a][1] if a in fix and fix[a][0] == c else c for a, c in zip(mine.appearance_id, mine.player_club_id)]
    start, end = spell["transfer_date"], spell["tenure_end"]
    pre = mine[(mine.club == spell["from_club_id"]) & (mine.date < start) & (mine.date >= start - dt.timedelta(days=365))]
    post = mine[(mine.club == spell["to_club_id"]) & (mine.date > start) & (mine.date <= end)]
    cg = raw["club_games"].merge(raw["games"], on="game_id")
    games = cg[(cg.club_id == spell["to_club_id"]) & (cg.date > start) & (cg.date <= end)]
    v = raw["player_valuations"]
    v = v[v.player_id == spell["player_id"]].sort_values("date")
    before = v[(v.date <= start) & (v.date >= start - dt.timedelta(days=730))]
    value_before = before.market_value_in_eur.iloc[-1] if len(before) else spell["market_value_in_eur"]
    gaps = [(abs((d - end).days), d, x) for d, x in zip(v.date, v.market_value_in_eur) if abs((d - end).days) <= 400]
    value_after = min(gaps)[2] if gaps else None
    inside = v[(v.date > start) & (v.date <= end)].market_value_in_eur
    peak = max([*inside, *([value_after] if value_after is not None else [])], default=None)
    return {
        "pre_apps": len(pre), "post_apps": len(post), "pre_minutes": pre.minutes_played.sum(), "post_minutes": post.minutes_played.sum(),
        "post_ga": post.goals.sum() + post.assists.sum(), "pre_ga": pre.goals.sum() + pre.assists.sum(),
        "team_games_in_tenure": len(games), "value_before": value_before, "value_after": value_after, "value_peak": peak,
        "days": (end - start).days,
    }


@pytest.fixture(scope="module")
def expected(raw):
    out = []
    player = raw["players"].set_index("player_id")
    for s in plain_spells(raw, loans=False):
        f = plain_facts(raw, s)
        p = player.loc[s["player_id"]]
        age = (s["transfer_date"] - p.date_of_birth).days / 365.25
        if min(f["pre_apps"], f["post_apps"]) < 10 or not 15 <= age <= 42 or p.position not in fv.POSITION_WEIGHTS:
            continue
        if not (f["value_before"] or 0) > 0 or pd.isna(f["value_before"]) or f["value_after"] is None:
            continue
        out.append({**s, **f, "position": p.position, "age": age})
    return pd.DataFrame(out)


def test_windows_and_values(moves, expected):
    assert len(expected) > 60
    a = moves.sort_values(["player_id", "transfer_date"]).reset_index(drop=True)
    b = expected.sort_values(["player_id", "transfer_date"]).reset_index(drop=True)
    assert len(a) == len(b)
    for c in ("pre_apps", "post_apps", "pre_minutes", "post_minutes", "team_games_in_tenure", "value_before", "value_after", "value_peak"):
        assert np.allclose(a[c].astype(float), b[c].astype(float)), c
    assert (a.tenure_days == b.days).all()
    assert np.allclose(a.age_at_transfer, b.age)


def rank(s):
    return s.rank(pct=True) * 100


def test_components_and_score(raw, moves, expected):
    m = moves.sort_values(["player_id", "transfer_date"]).reset_index(drop=True)
    e = expected.sort_values(["player_id", "transfer_date"]).reset_index(drop=True)
    before = e.value_before.clip(lower=1)
    growth = 0.2 * (0.8 * rank(e.value_peak / before) + 0.2 * rank(e.value_after / before)) + 0.8 * (
        0.8 * rank(e.value_peak - e.value_before) + 0.2 * rank(e.value_after - e.value_before)
    )
    assert np.allclose(m.value_growth_pct, growth)
    years = (e.days / 365.25).clip(lower=1 / 365.25)
    total = e.team_games_in_tenure.clip(lower=1)
    allow = 10 * years
    kept = np.where(e.team_games_in_tenure >= 15 * years, allow * (1 - np.exp(-(total - e.post_apps).clip(lower=0) / allow)), 0)
    share = (np.minimum(e.post_apps + kept, total) / total).clip(upper=1)
    assert np.allclose(m.playing_time_pct, 0.6 * rank(share) + 0.4 * rank(e.post_apps))
    level = m.post_ga_p90 / m.to_league_ga_baseline.clip(lower=0.05)
    assert np.allclose(m.post_ga_p90, e.post_ga / e.post_minutes.clip(lower=1) * 90)
    assert np.allclose(m.perf_level_pct, level.groupby(m.position).rank(pct=True) * 100)
    pre = m.pre_ga_p90_vs_league
    resid = pd.Series(np.nan, index=m.index)
    for _, g in m.groupby("position"):
        slope, icpt = np.polyfit(pre[g.index], level[g.index], 1)
        resid[g.index] = level[g.index] - (icpt + slope * pre[g.index])
    assert np.allclose(m.post_ga_p90_vs_league - m.expected_post_ga_p90_vs_league, resid)
    resold = e.next_fee.astype(float) > 0
    fee = e.transfer_fee.astype(float).fillna(0)
    profit = (e.next_fee.astype(float) - fee) / fee.clip(lower=1e6)
    assert np.allclose(m.resale_profit_pct[resold], rank(profit[resold]))
    assert m.resale_profit_pct[~resold].isna().all()
    # the whole score again
    weights = [fv.SUB_POSITION_WEIGHTS.get(r, fv.POSITION_WEIGHTS[p]) for r, p in zip(m.sub_position, m.position)]
    w = pd.DataFrame(weights, columns=list(fv.COMPONENTS))
    ratio = fee / before
    penalty = pd.Series(0.0, index=m.index)
    penalty[ratio > 1.3] = rank((ratio - 1.3)[ratio > 1.3])
    has = m.has_attacking_data.astype(bool)
    raw_attacking = np.where(has, 2 * m.attacking_pct - m.perf_level_pct, np.nan)
    parts = {c: m[f"{c}_pct"] for c in ("perf_level", "defensive", "possession", "rating")} | {"attacking": pd.Series(raw_attacking)}
    num = sum(np.where(v.notna(), w[c] * v.fillna(0), 0) for c, v in parts.items())
    den = sum(np.where(v.notna(), w[c], 0) for c, v in parts.items())
    proxy = pd.Series(np.where(den > 0, num / np.where(den > 0, den, 1), m.perf_level_pct))
    assert np.allclose(m.value_for_money_pct, rank((proxy - penalty).round(9)))
    lw = np.where(has, 0, w.perf_level)
    aw = np.where(has, w.attacking + w.perf_level, w.attacking)
    shared = {"perf_level": lw, "perf_delta": w.perf_delta, "value_growth": w.value_growth, "playing_time": w.playing_time,
              "rating": w.rating, "attacking": aw, "defensive": w.defensive, "possession": w.possession}
    num = sum(np.where(m[f"{c}_pct"].notna(), x * m[f"{c}_pct"].fillna(0), 0) for c, x in shared.items())
    den = sum(np.where(m[f"{c}_pct"].notna(), x, 0) for c, x in shared.items())
    y = e.days / 365.25
    vw, rw = 0.02 + 0.13 * np.exp(-y / 3), 0.02 + 0.18 * np.exp(-y / 2)
    score = np.where(resold, num / den * (1 - vw - rw) + vw * m.value_for_money_pct + rw * m.resale_profit_pct.fillna(0),
                     num / den * (1 - vw) + vw * m.value_for_money_pct)
    assert np.abs(m.success_score - score).max() <= 0.0501
    assert m.has_rating_data.any() and not m.has_rating_data.all()


def test_loans(raw, scored):
    loans = scored.loans.toPandas()
    keys = {(s["player_id"], s["transfer_date"]) for s in plain_spells(raw, loans=True) if plain_facts(raw, s)["pre_apps"] >= 10}
    assert len(loans) > 10
    assert {(p, d) for p, d in zip(loans.player_id, loans.transfer_date)} <= keys
    assert loans.loan_success_score.between(0, 100).all()


def test_quality_rules_hold(spark, scored):
    weights = load_weights(spark)
    assert qa.check_weights(weights, {"Goalkeeper": ["perf_level", "perf_delta", "attacking"]}).count() == 0
    assert qa.check_weights(load_loan_weights(spark)).count() == 0
    rules = {
        **qa.bounds(["success_score", "perf_level_pct", "value_growth_pct", "playing_time_pct", "value_for_money_pct"]),
        **qa.bounds(["rating_pct", "resale_profit_pct"], nullable=True),
        **qa.flag_iff_value({"has_rating_data": "rating_pct", "has_resale_data": "resale_profit_pct", "has_defensive_data": "defensive_pct"}),
        **qa.derived_rules(),
    }
    bad = {r.rule: r.violations for r in qa.violations(scored.moves, rules).collect()}
    assert set(bad.values()) == {0}, bad
    assert qa.check_recomposition(scored.moves, weights, ["player_id"]).count() == 0


def test_breakdown_visibility(scored):
    from movelens.operators.scoring import breakdown_rows

    rows = breakdown_rows(scored.moves, ["player_id", "transfer_date"]).toPandas()
    kinds = rows.groupby(["player_id", "transfer_date"]).component.apply(set)
    assert all(not {"perf_level", "attacking"} <= k for k in kinds)
    keepers = scored.moves.filter("position = 'Goalkeeper'").select("player_id", "transfer_date").toPandas()
    for r in keepers.itertuples(index=False):
        assert not kinds[(r.player_id, r.transfer_date)] & {"perf_level", "perf_delta", "attacking"}
