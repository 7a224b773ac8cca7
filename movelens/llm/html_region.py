"""Main text of a page by a maximum-scoring region.

A page is a sequence of words and tags. Elements that are never article text
(scripts, menus, headers and footers, sidebars) are taken out with all they
hold. So are reader comments, by what class or id name them, whatever their
length and headings: an article named as a comment is one, and only an element
around the page's first other article stays. So are forms and what class, id or role name as a notice, advert or the
like, if they hold no article, main or h1 and at most ``SMALL_SHARE`` of the
page's words, or stand outside a marked article and have fewer words than it or
than ``FEW_WORDS``; others only count against the stretch that crosses into them.
What is left is scored: words are
positive, less so in links and outside paragraphs, tags negative. One linear
scan finds the contiguous stretch of the highest sum, and its blocks are the text.

The weights are log odds from labelled pages: in pages that mark their article
(``article`` or ``main``) what is inside is content and the rest is not.

Defined results: a null or empty page, and one without a word, has an empty
text; broken markup is read as far as it goes (an unclosed element ends with its
parent, a cut-off tag is no text); whole pages are read, whatever their length;
equal pages give equal texts; other columns stay, clashing ones are replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movelens.llm.text_ids import small_batches, whole_text

#: Pages that the weights are learned from at most (those of the smallest hash).
SAMPLE_PAGES = 1000

# Elements without article text, and words of class, id or role that name such elements.
DROPPED = frozenset("script style noscript template head title nav aside footer header button select textarea svg iframe object canvas menu dialog".split())
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar aside header footer masthead comment comments respond reply replies disqus notice notices cookie cookies consent gdpr popup modal "
    "overlay newsletter subscribe signup login search share sharing social related recommended toolbar pagination pager skip hidden widget "
    "contentinfo complementary alert dialog copyright disclaimer".split())
# Words that name reader comments, and words that only tell of their state.
COMMENTS = frozenset("comment comments commentlist respond reply replies disqus".split())
STATES = frozenset("has no with open opened closed enabled disabled allow allowed count counter".split())
BLOCKS = frozenset(
    "p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd article main section blockquote pre table thead tbody tfoot tr td th caption figure figcaption "
    "address hr body html details summary center fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that end where one of the same kind begins.
SELF_ENDING = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset(("article", "main"))
# Elements whose text counts as that of a paragraph.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd".split())
DRAWINGS = frozenset(("svg", "foreignobject", "desc"))
#: Share of a page's words up to which a form or named element without article, main or h1 is taken out.
SMALL_SHARE = 0.3
#: Words below which such an element is taken out of a page that marks an article elsewhere, however short that is.
FEW_WORDS = 50
#: What stands in the sequence where a larger one begins.
LARGE = "<:named"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|textarea|title)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)",
    re.S | re.I)
_ATTR = re.compile(r"([^\s=<>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

Token = tuple[str, str]


def _unwanted(name: str, attrs: str, in_content: bool) -> tuple[bool, bool, bool]:
    """Whether an element never is article text, whether it only looks so (a form, or by its names), and whether its names are those of comments."""
    if name in DROPPED and not (name == "header" and in_content):  # a heading of the article itself stays
        return True, False, False
    if not attrs or name in ("body", "html"):
        return False, name == "form", False
    named, comments = name == "form", False
    for m in _ATTR.finditer(attrs):
        key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name not in CONTENT and (key == "hidden" or (key == "aria-hidden" and value.lower().startswith("true"))):
            return True, False, False
        if key in ("class", "id", "role"):
            for word in value.split():
                parts = {x.lower() for x in _PARTS.findall(word)}
                named = named or bool(parts & NAMED)
                comments = comments or bool(parts & COMMENTS and not parts & STATES)
    return False, named and name not in CONTENT, comments


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """(kind, text, wanted): kind is ``w`` for text in a paragraph-like block, ``l`` for text in a link, ``o`` for other
    text, ``LARGE`` where a named element that stays begins, else ``<name`` or ``>name`` for a tag. Elements with an end
    somewhere are dropped up to it."""
    named: dict[int, bool] = {}
    found = list(_walk(page, named, {}))
    return iter(found) if not named else _walk(page, {}, named)


def _walk(page: str, named: dict[int, bool], judged: dict[int, bool]) -> Iterator[tuple[str, str, bool]]:
    """The tokens. ``named`` gets, by place, whether each form or named element is to be dropped; ``judged`` has it from a first walk."""
    at_open: dict[int, tuple[int, int, int]] = {}  # words, headings and articles before
    extent: dict[int, tuple[int, int, bool]] = {}
    remarks: dict[int, bool] = {}  # by place of an element of comments: whether the first article is inside
    words = heads = marked = articles = 0
    opened: list[tuple[str, bool, int, bool]] = []  # name, whether the element is unwanted, place, whether it is an article
    bad = running = in_content = 0
    at = 0
    names: Counter[str] = Counter()  # of what is open
    blocks: list[int] = []  # places in ``opened`` of blocks, options and drawings
    options: list[int] = []
    drawings: list[int] = []
    closers = Counter(m.lower() for m in re.findall(r"</\s*([a-zA-Z][a-zA-Z0-9:-]*)", page))

    def text(s: str) -> Iterator[tuple[str, str, bool]]:
        nonlocal words
        if s:
            words += 0 if bad else len(s.split())
            yield "l" if names["a"] else "w" if running else "o", s, not bad

    def pop(down_to: int) -> None:
        nonlocal bad, marked, running, in_content
        while len(opened) > down_to:
            name, unwanted, place, article = opened.pop()
            bad -= unwanted
            names[name] -= 1
            running -= name in RUNNING
            in_content -= article
            for kind in (blocks, options, drawings):
                if kind and kind[-1] == len(opened):
                    kind.pop()
            if place in at_open:
                n, before = words - at_open[place][0], at_open[place][2]
                if article:
                    marked = max(marked, n)
                elif place in remarks:
                    remarks[place] = before == 0 and articles > 0
                else:
                    extent[place] = n, heads - at_open[place][1], in_content > 0

    for m in _TOKEN.finditer(page):
        yield from text(page[at:m.start()])
        at = m.end()
        if m.group("cdata") is not None:
            yield from text(html.escape(m.group("cdata")))
            continue
        name = (m.group("name") or "").lower()
        if not name:
            continue
        if m.group("close"):
            closers[name] -= 1
            wanted = not bad
            if names[name]:
                i = len(opened) - 1
                while opened[i][0] != name:
                    i -= 1
                pop(i)
            yield f">{name}", "", wanted
            continue
        if name in BLOCKS and drawings and opened[drawings[-1]][0] == "svg":  # a block ends a drawing that was left open
            pop(drawings[-1])
        block = blocks[-1] if blocks else -1
        if name == "option" and options and options[-1] > block:
            pop(options[-1])
        elif name in SELF_ENDING and block >= 0 and opened[block][0] == name:
            pop(block)
        if name in BLOCKS and name not in ("li", "td", "th", "tr") and blocks and opened[blocks[-1]][0] == "p":  # a block ends a paragraph
            pop(blocks[-1])
        unwanted, looks, comments = _unwanted(name, m.group("attrs"), in_content > 0)
        article = name in CONTENT and not comments
        heads += article or name == "h1"
        place = m.start()
        ends = name in SELF_ENDING or closers[name] > 0
        empty = name in VOID or m.group("attrs").endswith("/")
        if (looks or comments) and ends:
            unwanted = unwanted or judged.get(place, False)
            if place in judged and not unwanted:
                yield LARGE, "", not bad
        if unwanted and not empty and name not in SELF_ENDING and closers[name] <= 0 and name not in ("footer", "nav"):
            unwanted = False  # it never ends: leave out no more than its tag
        yield f"<{name}", "", not bad and not unwanted
        if not empty:
            where = len(opened)
            opened.append((name, unwanted, place, article))
            names[name] += 1
            running += name in RUNNING
            in_content += article
            bad += unwanted
            if name in BLOCKS:
                blocks.append(where)
            if name == "option":
                options.append(where)
            if name in DRAWINGS:
                drawings.append(where)
            if article or ((looks or comments) and ends):
                at_open[place] = words, heads - (name == "h1"), articles
            if comments and ends:
                remarks[place] = False
            articles += article
    rest = page[at:]
    if "<" in rest:  # a tag that was cut off
        cut = re.search(r"<[a-zA-Z/!?]", rest)
        rest = rest[:cut.start()] if cut else rest
    yield from text(rest)
    pop(0)
    named.update((k, not h and (n <= SMALL_SHARE * words or (marked and not i and n < max(marked, FEW_WORDS)))) for k, (n, h, i) in extent.items())
    named.update((k, not first) for k, first in remarks.items())


def kinds_of(page: str) -> Iterator[tuple[str, int, bool]]:
    """(kind, number, inside the marked article) of what takes part in the scan, for learning."""
    depth = 0
    for kind, s, wanted in tokens(page):
        depth += kind[0] == "<" and kind[1:] in CONTENT
        n = len(s.split()) if kind in BASE else 1
        if n and wanted:
            yield kind, n, depth > 0
        if kind[0] == ">" and kind[1:] in CONTENT:
            depth = max(0, depth - 1)


#: Weights where no page says otherwise: words for, tags against, those of running text hardly.
BASE = {"w": 1.0, "o": 0.6, "l": 0.2}
TEXT_TAGS = frozenset(
    "p br b i u em strong span a h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre code table thead tbody tr td th caption figure figcaption "
    "sub sup small q cite abbr time mark article main img hr".split())
TEXT_TAG, OTHER_TAG = -0.05, -1.0
NAMED_TAG = -4.0
LEAST, MOST, SHARPEST_TAG = 0.2, 4.0, -4.0
#: Occurrences that count as much as the weight a kind starts from.
BELIEF = 20


def tag_weight(kind: str) -> float:
    if kind == LARGE:
        return NAMED_TAG
    return TEXT_TAG if kind[1:] in TEXT_TAGS else OTHER_TAG


def weights_from(inside: Counter, outside: Counter) -> dict[str, float]:
    """Log odds of each kind, drawn to its first weight where it is rare; words kept positive and tags negative."""
    out = dict(BASE)
    total_in, total_out = sum(inside.values()) + 1.0, sum(outside.values()) + 1.0
    for kind in set(inside) | set(outside):
        seen = inside[kind] + outside[kind]
        odds = math.log((inside[kind] + 1) / total_in) - math.log((outside[kind] + 1) / total_out)
        first = BASE.get(kind) or tag_weight(kind)
        mean = (seen * odds + BELIEF * first) / (seen + BELIEF)
        out[kind] = min(MOST, max(LEAST, mean)) if kind in BASE else max(SHARPEST_TAG, min(TEXT_TAG / 10, mean))
    return out


def region(scores: Sequence[float]) -> tuple[int, int]:
    """Start and end of the contiguous stretch of the highest sum; of equal ones the first and longest."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or (total == best and start == best_at[0]):
            best, best_at = total, (start, i + 1)
    return best_at


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Blocks of the best region, joined by an empty line."""
    kept = [(kind, s) for kind, s, wanted in tokens(page or "") if wanted]
    scores = [(weights[k] * len(s.split()) if k in BASE else weights.get(k, tag_weight(k))) for k, s in kept]
    low, high = region(scores)
    blocks, now = [], []

    def close() -> None:
        block = " ".join(html.unescape("".join(now)).split())
        if block:
            blocks.append(block)
        now.clear()

    for kind, s in kept[low:high]:
        if kind in BASE:
            now.append(s)
        elif kind[1:] in BLOCKS:
            close()
        elif kind == "<br":
            now.append(" ")
    close()
    return "\n\n".join(blocks)


def learn_weights(pages: DataFrame, page: str, rows: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from at most ``rows`` pages that mark their article."""
    marked = pages.select(whole_text(page).alias("p")).filter(F.col("p").rlike("(?i)<(article|main)[\\s>]"))
    keys = marked.select(F.xxhash64("p").alias("k")).distinct().orderBy("k").limit(rows)
    chosen = marked.withColumn("k", F.xxhash64("p")).join(F.broadcast(keys), "k")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(k, bool(i), n) for p in batch["p"] for k, n, i in kinds_of(p)]
            yield pd.DataFrame(found, columns=["kind", "inside", "n"]).groupby(["kind", "inside"], as_index=False).sum()

    counts = chosen.dropDuplicates(["k"]).select("p").mapInPandas(count, "kind string, inside boolean, n long")
    inside, outside = Counter(), Counter()
    # tag names of bounded many pages
    for r in counts.groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect():
        (inside if r.inside else outside)[r.kind] = r.n
    return weights_from(inside, outside)


def text_column(page: Column, weights: dict[str, float]) -> Column:
    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p, weights) for p in pages], dtype=object)

    return extract(page)


def extract(pages: DataFrame, page: str, out: str = "text") -> DataFrame:
    """``pages`` with the main text of each."""
    small_batches(pages.sparkSession)
    return pages.withColumn(out, text_column(whole_text(page), learn_weights(pages, page)))
