import pytest

from movelens.llm import host_reputation as hr
from movelens.llm.queries import URL_RULES


def judge(spark, urls, **more):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    return {r.page_id: r for r in hr.judge_urls(df, "url", URL_RULES, **more).collect()}


def test_parsing_and_rules(spark):
    cases = [
        (None, "", "", None), ("", "", "", None), ("no scheme/x", "", "", None),
        ("HTTP://WWW.Example.ORG/es/1?x#y", "www.example.org", "/es/1", "example.org/es/"),
        ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1"),
        ("https://example.org/en/2", "example.org", "/en/2", "org/"), ("https://badexample.org/es/1", "badexample.org", "/es/1", "org/"),
        ("https://a.com/fr/", "a.com", "/fr/", "com/fr/"), ("https://a.com/fr", "a.com", "/fr", None), ("https://com/de/x", "com", "/de/x", "com/de/"),
        ("https://example.org", "example.org", "", None), ("https://example.org?a=/es/", "example.org", "", None),
        ("x://É.org/a://b", "É.org", "/a://b", "org/"), ("https://a.net/", "a.net", "/", None), ("a\nb://h.com/de/\n", "h.com", "/de/\n", "com/de/"),
    ]
    got = judge(spark, [c[0] for c in cases])
    for i, (_, host, path, rule) in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict in ("allow", "block")
        if rule:
            assert got[i].verdict == next(r.verdict for r in URL_RULES if r.text == rule)


def test_shrinkage_follows_the_levels(spark):
    outcomes = [("bad.spam.net", 1)] * 300 + [("x.spam.net", 1)] * 300 + [(f"ok{i}.fine.net", 0) for i in range(40) for _ in range(20)]
    outcomes += [("one.fine.net", 1)]
    table = spark.createDataFrame(outcomes, "host string, bad int")
    urls = ["http://bad.spam.net/", "http://new.spam.net/", "http://new.fine.net/", "http://one.fine.net/", "http://new.net/", "http://far.off/", None]
    got = judge(spark, urls, outcomes=table)
    assert [got[i].verdict for i in range(7)] == ["block", "block", "allow", "allow", "allow", "allow", "allow"]
    known = {(r.level, r.name): r.a / (r.a + r.b) for r in hr.reputations(table).collect()}
    assert known["host", "ok1.fine.net"] < known["host", "one.fine.net"] < 0.5 < known["domain", "spam.net"]
    assert known["all", ""] == pytest.approx((601 + 1) / (len(outcomes) + 2))


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert hr.judge_urls(df, "url", URL_RULES).count() == 0
