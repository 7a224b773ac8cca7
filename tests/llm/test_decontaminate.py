import hashlib
import re

import pytest

from movelens.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def brute(text, items, width=10):
    w = WORD.findall(low(text))
    hit, ids = set(), set()
    for k, t in items:
        x = WORD.findall(low(t))
        n = min(len(x), width)
        for i in range(len(x) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j:j + n] == x[i:i + n]:
                    hit.update(range(j, j + n)), ids.add(str(k))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"), (10, "Short Item here"), (2, "ONE two three, four five six seven eight nine TEN!"),
    (3, None), (4, " ..."), (5, "Überall été O'Neil's naïve 42 don't a b c d e f"), (6, "x"), (9, "short item HERE"),
]
TEXTS = [
    None, "", "...", "one two three four five six seven eight nine", "zero one-two_three  FOUR five; six seven eight nine ten, and on",
    "a short item; here a short item here short item", "überall été", "ÜBERALL été o neil s naïve 42 don t a b c d e f",
    "Überall ÉTÉ o neil s naïve 42 don t a b", "Überall été o neil's naïve 42 don t a b c d e f g", "X marks x", "xx",
    "one two three four five six seven eight nine ten eleven twelve " * 30, "1 2'3\\4", "Kelvin x",
]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_report_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(dc, "MAX_SET", limit)
    rows = [(i, t, "z") for i, t in enumerate(TEXTS)] + [(3, "x", "z"), (None, "x", "z"), (4, TEXTS[4], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hit string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = dc.contamination_report(docs, "doc_id", "text", bench).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((k, *brute(t, ITEMS)) for k, t, _ in rows), key=repr)
    assert dc.contamination_report(docs.limit(0), "doc_id", "text", bench).count() == 0
    assert dc.contamination_report(docs, "doc_id", "text", bench.limit(0)).filter("contaminated").count() == 0


def test_removal(spark):
    docs = spark.createDataFrame([(1, "Keep this: One two, three four five six seven eight nine ten! And the rest. X", "r"), (2, "clean  text\n", "r"), (3, None, "r")], "doc_id long, text string, rk string")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    assert [r.doc_id for r in dc.decontaminate(docs, "doc_id", "text", bench).orderBy("doc_id").collect()] == [2, 3]
    out = dc.decontaminate(docs, "doc_id", "text", bench, remove="spans").orderBy("doc_id")
    assert out.columns == docs.columns
    assert [r.text for r in out.collect()] == ["Keep this: And the rest. X", "clean  text\n", None]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_what_stands_around_a_word_does_not_matter(spark, monkeypatch, limit):
    """A capital sigma has another small form at a word's end, by what comes after it."""
    monkeypatch.setattr(dc, "MAX_SET", limit)
    item = "ΤΗΣ ΟΔΟΣ ΑΒ ΓΔ ΕΖ ΗΘ ΙΚ ΛΜ ΝΞ ΟΠ"
    texts = [sep.join(item.split()) for sep in (" ", ".", "'", "1 "[1:], "--", "\n")] + [item.lower(), "İ I K ß ẞ " + item]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.n_hit for r in dc.contamination_report(docs, "doc_id", "text", bench).collect()}
    assert got == {i: brute(t, [(1, item)])[1] for i, t in enumerate(texts)}
    assert [got[i] for i in range(6)] == [10] * 6
