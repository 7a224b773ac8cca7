import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from movelens.llm import bpe, line_dedup
from tests.llm.test_decontaminate import brute as windows
from tests.llm.test_jaccard_join import brute as groups
from tests.llm.test_line_dedup import brute as lines

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Documents before and after each stage."""
    docs, out = corpus_pipeline._table(spark, FOLDER, "documents"), []
    out.append(docs.collect())
    for name, step in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        step(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_columns_and_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "benchmark_decontamination", "tokens"]
    for rows in steps[:-1]:
        assert list(rows[0].asDict()) == COLUMNS


def test_quality_drops_the_rejected(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    before, kept = {r.doc_id for r in steps[0]}, {r.doc_id for r in steps[1]}
    good = [d in kept for d in before if labels.get(d) == 1]
    bad = [d in kept for d in before if labels.get(d) == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_lines_equal_brute_force(steps):
    rows = [(r.doc_id, r.text) for r in steps[1]]
    gone = lines(rows, line_dedup.EDITS)
    expected = {}
    for k, t in rows:
        drop = set(gone[k, t][3])
        left = [x for i, x in enumerate(t.split("\n")) if i not in drop]
        if left:
            expected[k] = "\n".join(left)
    assert {r.doc_id: r.text for r in steps[2]} == expected
    assert all(r.n_chars == len(r.text) for r in steps[2])


def test_near_duplicates_equal_brute_force(steps):
    expected = {k for k, n, c in groups([(r.doc_id, r.text) for r in steps[2]], 5, 80, 100) if n == 0 or k == c}
    assert {r.doc_id for r in steps[3]} == expected


def test_decontamination_equals_brute_force(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rare = {x for _, t in items for x in t.lower().split()}
    assert {r.doc_id for r in steps[4]} == {r.doc_id for r in steps[3] if not (rare & set(r.text.lower().split()) and windows(r.text, items)[4])}


def test_tokens(steps):
    import public_tokenizers

    encoder = bpe.Encoder(bpe.Vocabulary(bpe.vocabulary_source(public_tokenizers.path("byte_bpe_50k.json"))))
    texts = {r.doc_id: r.text for r in steps[4]}
    assert {r.doc_id for r in steps[5]} == set(texts)
    for r in steps[5]:
        assert r.text == texts[r.doc_id] and r.n_tokens == len(r.token_ids)
        assert list(r.token_ids) == [i for part in encoder.encode(r.text) for i in part]


def test_run_is_the_stages(spark, steps):
    got = corpus_pipeline.run(spark, FOLDER).select("doc_id", F.xxhash64("token_ids").alias("h")).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in steps[-1])
