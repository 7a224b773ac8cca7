import hashlib
import random

import pytest

from movelens.llm import grace_dedup as gd


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    """Sorted (key, keep_id, group_size, text_sha256), and the number of groups."""
    groups = {}
    for k, t in rows:
        groups.setdefault(lowered(t), []).append(k)
    out = []
    for t, keys in groups.items():
        known = [k for k in keys if k is not None]
        out += [(k, max(known) if known else None, len(keys), hashlib.sha256(t.encode()).hexdigest()) for k in keys]
    return sorted(out, key=repr), len(groups)


def corpus(seed=3, n=900):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abCDÉé \n") for _ in range(rng.randrange(0, 60))) for _ in range(120)]
    rows = [(i, rng.choice(pool).swapcase() if i % 3 else "The hot text") for i in range(n)]
    rows += [(None, pool[0]), (None, None), (None, None), (5000, None), (5000, ""), (5001, "x" * 300_000), (5002, "X" * 300_000)]
    rows += [(7, "again"), (7, "again"), (None, "only null"), (None, "only null"), (8000, "É"), (8001, "é")]
    return rows


def check(got, rows):
    expected, groups = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == expected
    stay = [r for r in got if r.kept]
    assert len(stay) == groups == len({r.text_sha256 for r in stay})
    assert all(r.doc_id == r.keep_id for r in stay)


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(gd.exact_groups(df, "doc_id", "text").collect(), rows)


@pytest.mark.parametrize("table_bytes,hot", [(6_000, 4096), (400_000, 3)])
def test_buckets_that_do_not_fit_go_on(spark, table_bytes, hot):
    rows = corpus(n=200)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    check(gd.exact_groups(df, "doc_id", "text", table_bytes, hot).collect(), rows)


def test_content_decides_where_hashes_collide():
    table, rng = gd.ContentTable(), random.Random(1)
    texts = [str(rng.randrange(700)).encode() for _ in range(3000)]
    for i, t in enumerate(texts):
        assert table.texts[table.add(42, t, i, i)] == t
    assert sorted(table.texts) == sorted(set(texts))
    assert table.counts == [texts.count(t) for t in table.texts]
    assert [b[0] for b in table.best] == [max(i for i, x in enumerate(texts) if x == t) for t in table.texts]


def test_strings_as_keys_empty_tables_and_clashing_names(spark):
    rows = [("b", "T", 1, "p"), ("a", "t", 2, "q"), (None, "t", 3, "r"), ("c", None, 4, "s")]
    df = spark.createDataFrame(rows, "rep string, text string, uid int, row_no string")
    got = {(r.rep, r.keep_id, r.group_size, r.kept) for r in gd.exact_groups(df, "rep", "text").collect()}
    assert got == {("b", "b", 3, True), ("a", "b", 3, False), (None, "b", 3, False), ("c", "c", 1, True)}
    left = gd.drop_copies(df, "rep", "text")
    assert left.columns == df.columns and sorted(map(tuple, left.collect())) == [("b", "T", 1, "p"), ("c", None, 4, "s")]
    assert gd.exact_groups(df.limit(0), "rep", "text").count() == 0
    assert gd.drop_copies(df.limit(0), "rep", "text").count() == 0
