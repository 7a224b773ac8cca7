"""Exact copies of every line that is not blank are dropped; the edit join is bounded by code points alone."""

import pytest

from movelens.llm import line_dedup as ld
from tests.llm.test_line_dedup import brute, corpus


@pytest.mark.parametrize("few", [32, 0])
def test_report_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(ld, "FEW_LINES", few)
    monkeypatch.setattr(ld, "BLOCK_LINES", 5)
    rows = corpus()
    expected = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ld.dedup_report(df, "doc_id", "text").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(k, *expected[k, t or ""]) for k, t in rows], key=repr)
    assert sum(r.n_near for r in got) > 5


def test_short_and_unspaced_lines(spark):
    han = "".join(chr(0x4E00 + 7 * i) for i in range(40))
    url = "https://example.org/a/very/long/path?with=values,and,more"
    rows = [
        (1, f"Yes.\n{han}\n{url}\n \n\ncat"),
        (2, f"Yes.\n{han}\n{url}\n \n\nNo.\ncar"),  # short lines are dropped as copies only
        (3, f"{han[:9]}x{han[10:]}\n{url}/b\nkept here"),
        (4, "Yes.\nNo."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in ld.without_repeated_lines(df, "doc_id", "text").collect()}
    assert got == {1: rows[0][1], 2: " \n\nNo.\ncar", 3: "kept here"}
