"""Reader comments are no article text, whatever their length, headings and elements; reading takes linear time."""

import time

import pytest

from movelens.llm import html_region as hr
from tests.llm.test_html_region import WEIGHTS

BODY = "<h1>Head line here</h1>" + "".join(f"<p>paragraph {i} of the article says something of note</p>" for i in range(6))
TEXT = "\n\n".join(["Head line here", *[f"paragraph {i} of the article says something of note" for i in range(6)]])
NOTE = "<p>I read this and I have a lot to say about it, really a lot of things</p>"


@pytest.mark.parametrize("page", [
    f"<article>{BODY}<section class='comments'><article class='comment'>{NOTE}</article><article class='comment'>{NOTE * 9}</article></section></article>",
    f"<article>{BODY}</article><div id='comments'><article class='comment'>{NOTE * 9}</article><article class='comment'>{NOTE}</article></div>",
    f"<article>{BODY}</article><div id='comments'><article>{NOTE * 9}</article></div>",
    f"<main>{BODY}</main><section class='comment-list'><h1>All comments</h1>{NOTE * 5}</section>",
    f"<article>{BODY}</article><ol class='commentlist'>{''.join(f'<li>{NOTE}</li>' for _ in range(30))}</ol>",
    f"<div class='post'>{BODY}</div><div class='user-comments'>{NOTE * 40}</div>",
    f"<div class='post comments-open'><article>{BODY}</article><div id='respond'><h1>Reply</h1>{NOTE}</div></div>",
    f"<body class='has-comments'><div class='post comments-open'>{BODY}</div><div id='disqus_thread'>{NOTE * 20}</div></body>",
    f"<div class='comments-area'><article>{BODY}</article></div>",
])
def test_comments_are_left_out(page):
    assert hr.main_text(f"<html><body>{page}</body></html>", WEIGHTS) == TEXT


@pytest.mark.parametrize("page", [
    "<div><p>x" * 8000, "<b>" * 8000 + "word", "<b>" * 8000 + "<td>x</td>" * 8000, "<svg><g>" * 4000 + "<p>x</p>" * 4000, "<select>" + "<option>x" * 8000,
    "</i>" * 8000 + "<i>" * 8000, "<a href=\"x" * 8000, "<p class='comments'>" * 8000, "<div class='ad'>" * 4000 + "</div>" * 4000, "<" * 20000, "<!--" * 8000, "&amp;" * 20000,
])
def test_linear_time(page):
    start = time.process_time()
    hr.main_text(page, WEIGHTS)
    assert time.process_time() - start < 1.0
