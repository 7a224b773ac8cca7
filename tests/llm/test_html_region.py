import html
import re
from collections import Counter

import duckdb
import pytest

from movelens.llm import html_region as hr
from movelens.llm.queries import REGISTRY

WEIGHTS = hr.weights_from(Counter({"w": 5000, "<p": 100, ">p": 100}), Counter({"o": 30, "<body": 20}))

MIXED = """<!DOCTYPE html><html><head><title>T</title><script>var a="</div><p>no</p>"</script></head><body class="home">
<header id="masthead"><h1>Site</h1></header><div class="cookie-notice"><p>We use cookies here ok fine</p></div>
<ul class="menu"><li><a href=/>Home</a><li><a href=/b>News</a></ul>
<div id="content"><div class="post"><h2>Headline &amp; more</h2><p>First   paragraph with <b>bold</b> text<br>and a break &lt;x&gt; &#233;&nbsp;z.
<div class="ad-slot">Buy <p>now</p></div><p>Second para.<p class="share">Share this<ul><li>item one<li>item two</ul><blockquote>Quote</blockquote></div>
<form><input name=q><label>Search</label></form>
<section class="comments"><h3>Comments</h3><p>I am a reader and I say something long here</p></section></div>
<aside><p>Related stuff here and there</p></aside><footer><p>&copy; 2020 all rights</p></footer></body></html>"""


def test_mixed_page():
    assert hr.main_text(MIXED, WEIGHTS) == "\n\n".join(
        ["Headline & more", "First paragraph with bold text and a break <x> é z.", "Second para.", "item one", "item two", "Quote"])


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain words only", "plain words only"), ("<p>a<p>b", "a\n\nb"), ("<p>cut off <a hre", "cut off"),
    ("<script>x", ""), ("<!-- c", ""), ("<p>1 < 2 &amp;amp; 3</p>", "1 < 2 &amp; 3"), ("<div class=ad>never closed<p>text here", "never closed\n\ntext here"),
    ("<nav><p>menu</p></nav><p>x</p>", "x"), ("<p title='a>b'>q</p>", "q"), ("<article><header><h1>Head</h1></header><p>body text</p></article>", "Head\n\nbody text"),
])
def test_small_pages(page, text):
    assert hr.main_text(page, WEIGHTS) == text


def test_region_is_the_maximum():
    import random

    rng = random.Random(3)
    for _ in range(300):
        s = [rng.choice([-3, -1, -0.5, 1, 2]) for _ in range(rng.randrange(1, 14))]
        low, high = hr.region(s)
        assert sum(s[low:high]) == max(0, max(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)))


def test_articles_of_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{folder}/pages.parquet'").fetchall())
    got = REGISTRY["op3_html_region"](spark, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search("<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_table_cases(spark):
    df = spark.createDataFrame([(1, MIXED, "old"), (1, MIXED, "old"), (None, None, "old"), (2, "<p>" + "word " * 200_000, "old")], "page_id long, html string, text string")
    got = hr.extract(df, "html")
    assert got.columns == df.columns
    assert sorted(len(r.text) for r in got.collect())[0] == 0
    assert max(len(r.text) for r in got.collect()) == 5 * 200_000 - 1
    assert hr.extract(df.limit(0), "html").count() == 0
