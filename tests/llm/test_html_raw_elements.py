"""Self-closed and unclosed elements that are not raw text cut no page short."""

import pytest

from movelens.llm import html_region as hr
from tests.llm.test_html_region import WEIGHTS

FIRST, LAST = "<p>first words of the article stand here</p>", "<p>last words of the article stand here</p>"
TEXT = "first words of the article stand here\n\nlast words of the article stand here"


@pytest.mark.parametrize("between", [
    "<svg/>", '<svg class="i" width=1 />', "<svg><path d=0 /></svg>", "<svg><title>no</title><text>no</text></svg>", "<noscript>", "<template>", "<svg>", "<iframe src=x />",
    "<div><svg><path/></div>", "<noscript><p>no</p></noscript>", "<template><p>no</p></template>", "<script>var x='<p>no</p>'</script>", "<title-card></title-card>",
])
@pytest.mark.parametrize("later", ["", "<footer><svg><path/></svg></footer>"])
def test_text_after_the_element_stays(between, later):
    assert hr.main_text(f"<body>{FIRST}{between}{LAST}{later}</body>", WEIGHTS).split("\n\n") == TEXT.split("\n\n")


def test_raw_text_runs_to_the_end():
    assert hr.main_text(f"<body>{FIRST}<script>{LAST}", WEIGHTS) == TEXT.split("\n\n")[0]
