import hashlib
import random

import pytest
from pyspark.sql import functions as F

from movelens.llm import conversation_repair as cr
from movelens.llm.queries import _damaged

WHITE = " \t\n\x0b\x0c\r"


def brute(rows):
    """Report of one conversation's (turn, role, text) rows by a DP over whole strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, flags, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        shown = text.strip(WHITE)
        fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else 3
        seen.add((role, text))
        flags.append(fault)
        if fault < 3:
            counts[fault] += 1
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    name = {"u": "user", "a": "assistant"}

    def put(best, state, value):
        if state not in best or value[:2] < best[state][:2]:
            best[state] = value

    def inserted(best):
        best = dict(best)
        for _ in range(4):
            for state, (c, e, lines) in list(best.items()):
                for to in set(after[state]) & {"u", "a"}:
                    put(best, to, (c + 3, e + "I", (*lines, name[to] + ":")))
        return best

    best = inserted({"": (0, "", ())})
    for (_, role, text), fault in zip(rows, flags):
        new = {}
        for state, (c, e, lines) in best.items():
            put(new, state, (c + 4, e + "D", lines))
            if fault >= 2:
                extra = 3 if fault == 2 else 0
                if role[:1] in after[state]:
                    put(new, role[:1], (c + extra, e + "K", (*lines, f"{role}:{text}")))
                for to in set(after[state]) & {"u", "a"}:
                    put(new, to, (c + 3 + extra, e + "R", (*lines, f"{name[to]}:{text}")))
        best = inserted(new)
    cost, audit, lines = min(best[s][:3] for s in ("", "a") if s in best)
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def conversation(rng, n):
    out, role = [], "system" if rng.random() < 0.5 else "user"
    for t in range(n):
        text = rng.choice(["Yes.", "No", "What?", "", " \t", "a\nb.", "é!", "Same.", f"row {t}.", f"cut {t}", "x. \n"])
        r = rng.choice(["system", "user", "assistant", "tool", "", " ", "ugly"]) if rng.random() < 0.25 else role
        out.append((None if rng.random() < 0.05 else t + (t > n // 2) * 2 - rng.randrange(2), r, text))
        role = "assistant" if role == "user" else "user"
    return out


def talks():
    rng = random.Random(11)
    return {i: conversation(rng, rng.randrange(0, 14)) for i in range(250)} | {1000: conversation(rng, 700)}


def frame(spark, rows):
    flat = [(c, t, r, x, "y") for c, v in rows.items() for t, r, x in v]
    return spark.createDataFrame(flat, "conv_id long, turn long, role string, text string, gone string").repartition(5)


@pytest.mark.parametrize("commit", [64, 1, 5])
def test_report_equals_brute_force(spark, monkeypatch, commit):
    monkeypatch.setattr(cr, "COMMIT_ROWS", commit)
    rows = talks()
    out = []
    for c, v in rows.items():
        talk, letters, lines = cr.Conversation(), "", []
        def take(edits):  # noqa: E306
            nonlocal letters
            for letter, _, r, t in edits:
                letters += letter
                if letter != "D":
                    lines.append(f"{r}:{t}")
        for t, r, x in sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
            take(talk.add(cr.Row(t, r, x)))
        cost, rest = talk.close()
        take(rest)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((talk.gaps, talk.blank, talk.duplicate, talk.truncated, talk.illegal, cost, letters, digest))
    assert out == [brute(v)[0] for v in rows.values()]


def test_spark_report_and_rows(spark):
    rows = {k: v for k, v in talks().items() if v}
    df = frame(spark, rows)
    got = {r.conv_id: tuple(r)[1:] for r in cr.repair_report(df, "conv_id", "turn", "role", "text").collect()}
    assert got == {c: brute(v)[0] for c, v in rows.items()}
    lines = {}
    for r in sorted(cr.repaired(df, "conv_id", "turn", "role", "text").collect(), key=lambda r: (r.conv_id, r.position)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert (r.turn is None) or r.edit != "I"
    assert lines == {c: list(brute(v)[1]) for c, v in rows.items() if brute(v)[1]}


def test_colliding_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(cr, "MOD", 2)
    for v in talks().values():
        dp, talk = "", cr.Conversation()
        for t, r, x in sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
            dp += "".join(e[0] for e in talk.add(cr.Row(t, r, x)))
        dp += "".join(e[0] for e in talk.close()[1])
        assert dp == brute(v)[0][6]


def test_nulls_gone_rows_and_empty_tables(spark):
    data = [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (1, None, None, None), (2, 3, "user", "gone."), (3, None, "user", "A?"), (3, None, "assistant", "B.")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in cr.repair_report(df, "conv_id", "turn", "role", "text", F.coalesce(F.col("conv_id") == 2, F.lit(False))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {
        None: (0, 0, 0, 0, 0, 0, "KK", sha("user:Hi.\nassistant:Yes.")), 1: (0, 1, 0, 0, 0, 4, "D", sha("")),
        2: (0, 0, 0, 0, 0, 0, "", sha("")), 3: brute([(None, "user", "A?"), (None, "assistant", "B.")])[0]}
    assert cr.repair_report(df.limit(0), "conv_id", "turn", "role", "text").count() == 0
    assert cr.repaired(df.limit(0), "conv_id", "turn", "role", "text").count() == 0


def test_damage(spark):
    import zlib

    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = sorted(((r.conv_id, r.turn, r.role, r.text, r.gone) for r in _damaged(df).collect()), key=repr)
    expected = []
    for r in df.collect():
        k = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if k == 1 else "".join(c for c in r.text if c not in ".!?") if k == 2 else r.text
        expected += [(r.conv_id, r.turn, "user" if k == 4 else r.role, text, k == 0)] * (2 if k == 3 else 1)
    assert got == sorted(expected, key=repr)
