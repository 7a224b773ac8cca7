"""Tables that a stage of the pipeline wrote for itself are gone when its result is there."""

from pathlib import Path

from movelens.llm import jaccard_join, line_dedup
from movelens.sources import staging


def _left(monkeypatch, tmp_path, run):
    monkeypatch.setattr(staging, "stage_root", lambda spark: str(tmp_path))
    kept = run().collect()
    return kept, {p.name.rsplit("-", 1)[0] for p in Path(tmp_path, "movelens").iterdir()}


def _docs(spark):
    line = "the same long line in every document of this table"
    texts = [f"{line}\nline number {i} that only one document of the table has\n{line[:-2]}{i % 7}" for i in range(60)]
    return spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:20]])], "doc_id long, text string")


def test_line_dedup_leaves_its_result_only(spark, monkeypatch, tmp_path):
    kept, left = _left(monkeypatch, tmp_path, lambda: line_dedup.without_repeated_lines(_docs(spark), "doc_id", "text"))
    assert kept and left == {"dropped"}


def test_near_duplicates_leave_their_keys_only(spark, monkeypatch, tmp_path):
    kept, left = _left(monkeypatch, tmp_path, lambda: jaccard_join.keep_first_of_groups(_docs(spark), "doc_id", "text"))
    assert kept and not left & {"profiles", "heads", "facts", "nodes"}
