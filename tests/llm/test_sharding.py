import zlib
from collections import defaultdict

import numpy as np

from movelens.llm import sharding


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_against_scalar_form():
    keys = np.array([0, 1, 2, 10**12, 2**64 - 1, 12345678901234567890, *range(500)], np.uint64)
    for n in (1, 2, 8, 9, 1000):
        assert sharding.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]


def test_growth_moves_only_into_the_new_shard():
    keys = np.arange(20_000, dtype=np.uint64)
    a, b = sharding.jump(keys, 8), sharding.jump(keys, 9)
    moved = a != b
    assert set(b[moved]) == {8} and abs(moved.mean() - 1 / 9) < 0.02


def test_manifest(spark):
    texts = [None, "", "é", "abc", "abc", "x" * 100_000] + [f"t{i}" for i in range(300)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "n", 2)] + [(7, "same", 3)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.shard_manifest(df, "doc_id", "text", 8).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    plain = {r.doc_id: r for r in got if r.doc_id not in (None, 7)}
    for i, t in enumerate(texts):
        if i != 7:
            data = (t or "").encode()
            assert (plain[i].size, plain[i].text_crc32, plain[i].shard) == (len(data) + 1, zlib.crc32(data), plain_jump(i, 8))
    small = sharding.number_slots(sharding.assign_shards(df.drop("shard"), "doc_id", 2), 2, block_rows=10).collect()
    by = defaultdict(list)
    for r in small:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard_manifest(df.limit(0), "doc_id", "text", 8).count() == 0


def test_files(spark, tmp_path):
    df = spark.range(200).selectExpr("id AS doc_id", "concat('t', id) AS text")
    sharding.write_shards(df, "doc_id", 4, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(back) == 200 and all(r.shard == plain_jump(r.doc_id, 4) for r in back)


def test_text_keys(spark):
    df = spark.createDataFrame([(f"doc-{i}", "t", "x") for i in range(500)] + [(None, None, "x")], "doc_id string, text string, shard string")
    got = sharding.shard_manifest(df, "doc_id", "text", 8).collect()
    assert len(got) == 501 and {r.shard for r in got} == set(range(8))
    moved = [r for r in got if r.shard != r.grown_shard]
    assert 0 < len(moved) < 120 and {r.grown_shard for r in moved} == {8}
    again = {r.doc_id: r.shard for r in sharding.shard_manifest(df.repartition(7), "doc_id", "text", 8).collect()}
    assert again == {r.doc_id: r.shard for r in got}
