import random
from collections import Counter

import pytest

from movelens.llm import line_dedup as ld


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def within(a, b, edits):
    """Whether a and b are within ``edits``; unlike ones are mostly told by length and letters."""
    if abs(len(a) - len(b)) > edits:
        return False
    x, y = Counter(a), Counter(b)
    return (x - y).total() <= edits and (y - x).total() <= edits and distance(a, b) <= edits


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s.insert(k, rng.choice("abé "))
        elif kind == 1 and len(s) > 3:
            s.pop(k)
        else:
            s[k] = rng.choice("abé")
    return "".join(s)


@pytest.mark.parametrize("most", [1, 2, 3, 5])
def test_distance_and_shared_segments(most):
    rng = random.Random(most)
    a = ["".join(rng.choice("abcé") for _ in range(rng.randrange(20, 60))) for _ in range(400)]
    b = [edited(rng, x, rng.randrange(0, most + 3)) for x in a]
    near = [distance(x, y) <= most for x, y in zip(a, b)]
    assert ld.edit_distance_within(a, b, most).tolist() == near
    for x, y, n in zip(a, b, near):
        if n and x != y:
            k = ld.segment_keys([x, y], most)
            own = most + 1
            assert (set(k[0][:own]) & set(k[1]) - {0}) or (set(k[1][:own]) & set(k[0]) - {0})


def brute(rows, edits=2):
    """Per row: numbers of lines and of exact and near ones to drop, and these."""
    first, out = {}, {}
    docs = sorted({(k is None, k or 0, t or "") for k, t in rows})
    for none, k, t in docs:
        for no, x in enumerate(t.split("\n")):
            if x.strip() and x not in first:
                first[x] = (none, k, no, t)
    order = sorted((x for x in first if len(x) >= 20), key=lambda x: first[x][:3])
    near = {x for i, x in enumerate(order) if any(within(x, y, edits) for y in order[:i])}
    for none, k, t in docs:
        lines = t.split("\n")
        exact = [no for no, x in enumerate(lines) if x.strip() and first[x] != (none, k, no, t)]
        close = [no for no, x in enumerate(lines) if x in near and first[x] == (none, k, no, t)]
        out[None if none else k, t] = (len(lines), len(exact), len(close), sorted(exact + close))
    return out


def corpus():
    rng = random.Random(8)
    line = lambda: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(3, 14)))
    pool = [line() for _ in range(60)]
    rows = []
    for i in range(70):
        lines = []
        for _ in range(rng.randrange(1, 7)):
            x = rng.choice(pool) if rng.random() < 0.5 else line()
            lines.append(edited(rng, x, rng.randrange(0, 4)) if rng.random() < 0.5 else x)
        rows.append((i * 2, "\n".join(lines)))
    similar = pool[1] + " and more words"
    rows += [(500 + i, edited(rng, similar, rng.randrange(0, 3))) for i in range(40)]
    rows += [(1001, None), (1002, ""), (1003, "\n\n"), (1004, rows[3][1]), (None, rows[4][1]), (1005, pool[0] + "\n" + pool[0]), (1006, "short line\nshort line"), (1007, "  \t \r" * 20)]
    return rows


@pytest.mark.parametrize("few", [32, 2, 0])
def test_report_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(ld, "FEW_LINES", few)  # 0: every key is crowded
    monkeypatch.setattr(ld, "BLOCK_LINES", 5)
    rows = corpus()
    df = spark.createDataFrame([(k, t, "x") for k, t in rows] + [(1002, "", "y")], "doc_id long, text string, no string").repartition(4)
    got = ld.dedup_report(df, "doc_id", "text").collect()
    expected = brute(rows)
    assert len(got) == len(rows) + 1
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(k, *expected[k, t or ""]) for k, t in [*rows, (1002, "")]], key=repr)
    assert sum(r.n_near for r in got) > 5


def test_text_without_dropped_lines(spark):
    rows = corpus()
    df = spark.createDataFrame([(k, t, k) for k, t in rows], "doc_id long, text string, rk long")
    expected = brute(rows)
    left = []
    for k, t in rows:
        gone = set(expected[k, t or ""][3])
        lines = (t or "").split("\n")
        if len(gone) < len(lines):
            left.append((k, "\n".join(x for i, x in enumerate(lines) if i not in gone) if t is not None else None))
    out = ld.without_repeated_lines(df, "doc_id", "text")
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(left, key=repr)
    assert ld.without_repeated_lines(df.limit(0), "doc_id", "text").count() == 0
    assert ld.dedup_report(df.limit(0), "doc_id", "text").count() == 0


def test_rows_that_meet_equal_a_plain_count(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(60), rng.random() < 0.4, i) for i in range(90)] + [(100, i < 2, 200 + i) for i in range(40)] + [(101, False, 300 + i) for i in range(40)]
    size = Counter(seg for seg, _, _ in rows)
    entered = {seg for seg, own, _ in rows if own}
    expected = sorted(r for r in rows if size[r[0]] > 1 and r[0] in entered)
    keys = spark.createDataFrame(rows, "seg long, own boolean, k1 long").repartition(7)
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(most)
    try:
        for n in (1, 2, 3, 1000):  # a seg may go on over several batches
            spark.conf.set(most, n)
            assert sorted(tuple(r) for r in ld._meeting(keys).collect()) == expected
    finally:
        spark.conf.set(most, before)


def test_lines_that_share_half_of_their_hash(spark, monkeypatch):
    whole = ld.line_keys
    monkeypatch.setattr(ld, "line_keys", lambda line: (len(line) % 2, whole(line)[1]))
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ld.dedup_report(df, "doc_id", "text").collect()
    expected = brute(rows)
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(k, *expected[k, t or ""]) for k, t in rows], key=repr)


def test_a_line_has_a_key_once():
    keys = ld.segment_keys(["a" * 30, "ab" * 20, "abc" * 9 + "d"], 2)
    for row in keys:
        assert len(set(row) - {0}) == (row != 0).sum()
