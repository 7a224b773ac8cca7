"""Containers whose names or tag look like page furniture do not take the article with them."""

import pytest

from movelens.llm import html_region as hr
from tests.llm.test_html_region import WEIGHTS

BODY = "<p>" + "some words of the article itself " * 8 + "</p>"
TEXT = " ".join(("some words of the article itself " * 8).split())
LONG = BODY * 4


@pytest.mark.parametrize("page", [
    f'<div class="content has-sidebar"><article>{BODY}</article></div>', f'<div class="content-sidebar-wrap"><main>{BODY}</main></div>',
    f'<div id="search-page">{BODY}</div>', f"<form action=/x><div>{BODY}</div></form>", f'<div data-id="ad" data-class="menu">{BODY}</div>',
    f'<div title="a hidden menu">{BODY}</div>', f'<div class="content has-sidebar">{BODY}<div class="ad">Buy now</div></div>',
])
def test_article_in_a_named_container(page):
    assert hr.main_text(f"<html><body>{page}</body></html>", WEIGHTS) == TEXT


def test_small_named_elements_are_dropped():
    page = f'<body><div>{LONG}<div class="share">Share this</div><form><p>Your mail</p></form><p hidden>not shown</p></div></body>'
    assert hr.main_text(page, WEIGHTS) == "\n\n".join([TEXT] * 4)


def test_advert_longer_than_a_marked_article():
    page = '<body><div class="ad">Buy this now, it is the very best of all things</div><article><p>two words</p></article></body>'
    assert hr.main_text(page, WEIGHTS) == "two words"
    teaser = f'<body><article><p>two words</p></article><div class="content has-sidebar">{LONG}</div></body>'
    assert TEXT in hr.main_text(teaser, WEIGHTS)
