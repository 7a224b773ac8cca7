"""Seeded career tables with planted edge cases, as pandas frames."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd

NOW = dt.date(2022, 6, 30)
POSITIONS = ["Attack", "Midfield", "Defender", "Goalkeeper"]
ROLES = {
    "Attack": ["Left Winger", "Centre-Forward"], "Midfield": ["Defensive Midfield", "Central Midfield"],
    "Defender": ["Centre-Back", "Left-Back"], "Goalkeeper": ["Goalkeeper"],
}
LEAGUES = ["GB1", "ES1", "L1", None]
FIRST = ["Luis", "Marc", "José", "Bjørn", "Łukasz", "Ivan", "Noël", "Tom", "Ådne", "René"]
LAST = ["Silva", "Muñoz", "Sørensen", "Kowalski", "Petrov", "Meier", "Dupont", "Smith", "Rossi", "Çelik", "Okafor", "Nagy"]


def build(seed: int = 7, n_players: int = 90, n_clubs: int = 12) -> dict[str, pd.DataFrame]:
    rng = np.random.default_rng(seed)
    clubs = pd.DataFrame(
        {
            "club_id": range(100, 100 + n_clubs),
            "name": [f"Club {chr(65 + i)}town" for i in range(n_clubs)],
            "domestic_competition_id": [LEAGUES[i % len(LEAGUES)] for i in range(n_clubs)],
        }
    )
    ids = clubs.club_id.tolist()
    names = dict(zip(clubs.club_id, clubs.name))
    players, transfers, types, apps, vals, lineups = [], [], [], [], [], []
    serial = 0
    for p in range(1, n_players + 1):
        pos = "Missing" if p == 13 else POSITIONS[int(rng.choice(4, p=[0.35, 0.3, 0.25, 0.1]))]
        role = "Unknown" if pos == "Missing" else ROLES[pos][int(rng.integers(len(ROLES[pos])))]
        born = dt.date(1990, 1, 1) + dt.timedelta(days=int(rng.integers(0, 3000)))
        name = f"{FIRST[p % len(FIRST)]} {LAST[p % len(LAST)]}" + ("" if p % 4 else f" {LAST[(p * 5) % len(LAST)]}")
        club = int(rng.choice(ids))
        at = dt.date(2014, 7, 1) + dt.timedelta(days=int(rng.integers(0, 500)))
        moves = []
        for _ in range(int(rng.integers(2, 6))):
            target = int(rng.choice([c for c in ids if c != club]))
            kind = "loan" if rng.random() < 0.25 else ("paid" if rng.random() < 0.7 else "free")
            fee = None if rng.random() < 0.1 else (0.0 if kind != "paid" else float(rng.integers(1, 400)) * 100_000)
            moves.append((at, club, target, kind, fee))
            if kind == "loan":
                back = at + dt.timedelta(days=int(rng.integers(120, 400)))
                moves.append((back, target, club, "end", 0.0))
                at = back + dt.timedelta(days=int(rng.integers(5, 300)))
            else:
                club = target
                at = at + dt.timedelta(days=int(rng.integers(250, 900)))
        moves = [m for m in moves if m[0] <= NOW]
        # activity: the club at each week follows the moves
        day = dt.date(2013, 8, 1)
        timeline = sorted(moves)
        level = rng.random() * 0.6
        while day < NOW:
            here = timeline[0][1] if timeline else club
            for m in timeline:
                if m[0] < day:
                    here = m[2]
            if rng.random() < 0.55:
                serial += 1
                league = clubs.set_index("club_id").domestic_competition_id[here] or "XX"
                apps.append((f"a{serial}", p, here, league, day, int(rng.random() < level), int(rng.random() < level / 2), int(rng.integers(10, 91))))
            day += dt.timedelta(days=14)
        value = float(rng.integers(5, 200)) * 100_000
        day = dt.date(2013, 9, 1) + dt.timedelta(days=int(rng.integers(0, 200)))
        while day < NOW and p % 29:
            vals.append((p, day, value))
            value = max(25_000.0, round(value * float(rng.uniform(0.7, 1.45)), -3))
            day += dt.timedelta(days=int(rng.integers(90, 320)))
        for m in moves:
            text = {"loan": "Loan fee:<br />€1m", "end": "End of loan", "paid": "€1.00m", "free": "free transfer"}[m[3]]
            listed = None if rng.random() < 0.4 else float(rng.integers(5, 100)) * 100_000
            transfers.append((p, m[0], m[1], m[2], names[m[1]], names[m[2]], m[4], listed, name))
            if rng.random() < 0.97:
                types.append((p, m[0], m[1], m[2], {"end": "loan"}.get(m[3], m[3]), text))
        for _ in range(6):
            lineups.append((p, "midfield" if role == "Central Midfield" and rng.random() < 0.3 else role))
        height = None if p % 17 == 0 else float(rng.integers(168, 200))
        players.append((p, name, born, pos, None if p % 11 == 0 else role, rng.choice(["left", "right"]), height, club, names[club], value, clubs.set_index("club_id").domestic_competition_id[club]))
    # planted: a move without clubs, a no-op move, a move before the scope, a duplicate kind, a wrong club
    transfers.append((1, dt.date(2016, 1, 1), None, 101, None, names[101], None, None, "x"))
    transfers.append((2, dt.date(2016, 2, 1), 101, 101, names[101], names[101], None, None, "x"))
    transfers.append((3, dt.date(2012, 2, 1), 101, 102, names[101], names[102], None, None, "x"))
    types.append(types[0])
    wrong = apps[5]
    fixes = [(wrong[0], wrong[2], 111), (apps[9][0], -1, 111)]
    games, club_games = [], []
    g, day = 0, dt.date(2013, 8, 3)
    while day < NOW:
        order = rng.permutation(ids)
        for i in range(0, len(order) - 1, 2):
            g += 1
            games.append((g, day))
            club_games += [(g, int(order[i])), (g, int(order[i + 1]))]
        day += dt.timedelta(days=11)
    frame = lambda rows, cols: pd.DataFrame(rows, columns=cols.split())
    moves_cols = "player_id transfer_date from_club_id to_club_id from_club_name to_club_name transfer_fee market_value_in_eur player_name"
    return {
        "transfers": frame(transfers, moves_cols),
        "manual_transfers": frame([(4, dt.date(2021, 12, 1), 103, 104, names[103], names[104], 1e6, None, "m", "paid", "")], moves_cols + " transfer_type fee_raw"),
        "transfer_types": frame(types, "player_id transfer_date from_club_id to_club_id transfer_type fee_raw"),
        "game_lineups": frame(lineups, "player_id position"),
        "players": frame(players, "player_id name date_of_birth position sub_position foot height_in_cm current_club_id current_club_name market_value_in_eur current_club_domestic_competition_id"),
        "clubs": clubs,
        "appearances": frame(apps, "appearance_id player_id player_club_id competition_id date goals assists minutes_played"),
        "games": frame(games, "game_id date"),
        "club_games": frame(club_games, "game_id club_id"),
        "player_valuations": frame(vals, "player_id date market_value_in_eur"),
        "manual_appearance_corrections": frame(fixes, "appearance_id wrong_club_id correct_club_id"),
    }


def board(tables: dict[str, pd.DataFrame], seed: int = 3) -> pd.DataFrame:
    """Provider season rows for players who appeared in covered leagues."""
    from movelens import fixed_values as fv

    rng = np.random.default_rng(seed)
    a = tables["appearances"].copy()
    a["season"] = [d.year if d.month >= 8 else d.year - 1 for d in a.date]
    a = a[a.competition_id.isin(["GB1", "ES1"])]
    who = tables["players"].set_index("player_id").name
    club = tables["clubs"].set_index("club_id").name
    out = []
    for (pid, season, league), g in a.groupby(["player_id", "season", "competition_id"]):
        if rng.random() < 0.15:
            continue
        team = club[g.player_club_id.mode().iloc[0]]
        row = [league, int(season), 10_000 + pid, who[pid].split(" ")[-1] if pid % 9 == 0 else who[pid].upper(), team, float(g.minutes_played.sum()), float(len(g))]
        row += [None if rng.random() < 0.2 else round(float(rng.random() * 5), 3) for _ in fv.PROVIDER_STATS]
        out.append(row)
    cols = ["league", "season", "provider_id", "provider_name", "team", "minutes_played", "matches_played"]
    return pd.DataFrame(out, columns=cols + [f"fotmob_{s}" for s in fv.PROVIDER_STATS])


def to_spark(spark, tables: dict[str, pd.DataFrame]):
    from movelens.schemas import RAW_TABLES

    def clean(v):
        return None if v is None or (not isinstance(v, (str, dt.date)) and pd.isna(v)) else v

    out = {}
    for name, schema in RAW_TABLES.items():
        kinds = {f.name: f.dataType.typeName() for f in schema.fields}
        rows = []
        for r in tables[name][schema.fieldNames()].itertuples(index=False):
            cells = []
            for c, v in zip(schema.fieldNames(), r):
                v = clean(v)
                if v is not None:
                    v = {"long": int, "double": float, "string": str}.get(kinds[c], lambda x: x)(v)
                cells.append(v)
            rows.append(tuple(cells))
        out[name] = spark.createDataFrame(rows, schema)
    return out


def board_to_spark(spark, frame: pd.DataFrame):
    from movelens.schemas import BOARD

    rows = [tuple(None if v is None or (not isinstance(v, str) and pd.isna(v)) else (int(v) if c in ("season", "provider_id") else v) for c, v in zip(frame.columns, r)) for r in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, BOARD)
