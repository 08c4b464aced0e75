"""Main text of HTML pages: flat text blocks classified by a decision tree.

A page is read as a flat list of text blocks. Every block has its word count and link density, those
of the blocks before and after it (links outside the article don't count beside a block of it), and what its markup says (inside an element that names itself
a menu, footer, advert, comment list and so on; inside or outside the page's article). Decision
trees (one for blocks inside the article, one for others), trained on the small labelled tables below,
tell article blocks from the rest.

Defined results: null or empty HTML gives an empty text; text outside any tag is a block; markup cut
off in the middle ends the page; whole pages are read, in time that grows as their length; repeated
rows give equal texts; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm._common import map_batches, texts

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*+|[^>]*)(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
EMPTY = re.compile(r"""(?:^|[\s"'])/$""")  # a slash that ends a tag, not an unquoted value
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# What elements and names mean.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
# Elements without text of the page: in the first, markup is text and a missing end tag takes the rest of the page; the others end
# where a block begins if their own end is missing, and those that can hold their like are matched as brackets.
RAW = frozenset("script style textarea title iframe".split())
SKIPPED = frozenset("noscript template select button svg math object canvas audio video datalist".split())
NESTING = frozenset("template svg math object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog".split())
BOILER_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus dropdown footer footers "
    "gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promos promoted promotion "
    "recommend recommended recommendations related replies reply respond search share shares sidebar sidebars signup skip social sponsor sponsored sponsors subscribe "
    "subscription taboola toolbar topbar trending widget widgets".split()
)
# Names that can also tell what a part of an article is about: there they count only if the rest of the name is about layout.
TOPICS = frozenset("ad ads banner comment comments consent copyright disclaimer login menu menus notice notices notification promo promos promotion recommend recommended recommendations related replies reply respond search share shares skip social sponsor sponsors subscribe subscription".split())
LAYOUT = frozenset(
    "area articles bar block body bottom box btn button buttons center col column container content feed fixed footer form form grid group head header icon icons inline inner item items js label left links list "
    "message module news outer page panel post posts right row section site slot sticky stories story tag tags text thread title top unit user wrap wrapper".split()
)
PAGE_NAMES = frozenset("header head".split())  # boilerplate only outside the article
MAIN_NAMES = frozenset("article content entry story post main body".split())
ARTICLE_NAMES = frozenset("article entry story post".split())
ARTICLE_PARTS = MAIN_NAMES | frozenset("text copy full single page".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Headings below which lists of links are the article's own.
SOURCES = frozenset("references reference sources bibliography literature citations notes footnotes literatur quellen einzelnachweise références sources bibliographie referencias bibliografía fuentes notas".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
# Classes and roles name an element's purpose on these, ids on the containers among them; a heading's id is a slug of its words.
NAMED = BLOCKS - frozenset("h1 h2 h3 h4 h5 h6 hgroup pre caption figcaption summary legend".split())
CONTAINERS = frozenset("address article aside dialog div dl fieldset figure footer form header main menu nav ol section table tbody td tr ul".split())
# Start tags before which an open element of the same list ends; any block ends an open p.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "boiler", "place")
# The labelled table: FEATURES, then 1 for a block of the article. place: 1 inside the article, 0 on
# a page without one, -1 outside it on a page that has one.
LABELLED = (
    # inside the article: titles, paragraphs, short lines, quotes
    (8, 0.0, 1, 1.0, 60, 0.0, 0, 1, 1), (60, 0.0, 8, 0.0, 45, 0.1, 0, 1, 1), (45, 0.1, 60, 0.0, 3, 0.0, 0, 1, 1), (3, 0.0, 45, 0.1, 70, 0.0, 0, 1, 1),
    (1, 0.0, 70, 0.0, 30, 0.0, 0, 1, 1), (30, 0.3, 1, 0.0, 12, 0.0, 0, 1, 1), (12, 0.0, 30, 0.3, 9, 1.0, 0, 1, 1), (5, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1),
    (200, 0.02, 4, 0.0, 6, 0.5, 0, 1, 1), (2, 0.5, 50, 0.0, 50, 0.0, 0, 1, 1), (6, 0.4, 20, 0.0, 20, 0.0, 0, 1, 1), (15, 0.0, 2, 1.0, 9, 1.0, 0, 1, 1),
    # inside the article, but lists of links
    (6, 1.0, 30, 0.0, 7, 1.0, 0, 1, 0), (7, 1.0, 6, 1.0, 5, 1.0, 0, 1, 0), (5, 1.0, 7, 1.0, 9, 0.0, 0, 1, 0), (9, 0.9, 4, 1.0, 0, 0.0, 0, 1, 0),
    (2, 1.0, 3, 1.0, 2, 1.0, 0, 1, 0), (12, 0.95, 40, 0.0, 11, 1.0, 0, 1, 0),
    # named boilerplate, wherever it is
    (40, 0.0, 60, 0.0, 40, 0.0, 1, 1, 0), (12, 0.0, 80, 0.0, 12, 0.0, 1, 1, 0), (90, 0.0, 90, 0.0, 3, 0.0, 1, 1, 0), (1, 1.0, 0, 0.0, 1, 1.0, 1, 1, 0),
    (2, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), (20, 0.1, 50, 0.0, 0, 0.0, 1, 0, 0), (55, 0.0, 60, 0.0, 60, 0.0, 1, 0, 0), (8, 0.5, 9, 1.0, 70, 0.0, 1, 0, 0),
    (1, 1.0, 1, 1.0, 2, 1.0, 1, -1, 0), (14, 0.2, 40, 0.0, 0, 0.0, 1, -1, 0), (70, 0.0, 12, 0.0, 9, 0.0, 1, -1, 0), (6, 0.0, 1, 1.0, 8, 0.0, 1, -1, 0),
    # outside the article of a page that has one
    (10, 0.0, 1, 1.0, 8, 0.0, 0, -1, 0), (30, 0.0, 50, 0.0, 0, 0.0, 0, -1, 0), (80, 0.0, 80, 0.0, 20, 0.1, 0, -1, 0), (3, 1.0, 0, 0.0, 3, 1.0, 0, -1, 0),
    (120, 0.0, 3, 0.0, 120, 0.0, 0, -1, 0), (1, 0.0, 0, 0.0, 60, 0.0, 0, -1, 0),
    # a page without an article: long blocks with few links, and titles and short lines beside them
    (50, 0.0, 8, 0.0, 40, 0.05, 0, 0, 1), (40, 0.05, 50, 0.0, 60, 0.0, 0, 0, 1), (8, 0.0, 2, 1.0, 50, 0.0, 0, 0, 1), (25, 0.2, 60, 0.0, 25, 0.0, 0, 0, 1),
    (14, 0.0, 40, 0.0, 3, 1.0, 0, 0, 1), (4, 0.0, 40, 0.0, 40, 0.0, 0, 0, 1), (18, 0.1, 5, 0.0, 0, 0.0, 0, 0, 1), (150, 0.1, 1, 1.0, 2, 1.0, 0, 0, 1),
    (3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (30, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (6, 0.0, 0, 0.0, 30, 0.0, 0, 0, 1), (11, 0.0, 60, 0.0, 0, 0.0, 0, 0, 1),
    (3, 0.0, 1, 1.0, 60, 0.0, 0, 0, 1), (2, 0.0, 2, 1.0, 80, 0.0, 0, 0, 1), (5, 0.0, 3, 1.0, 35, 0.0, 0, 0, 1), (2, 0.0, 70, 0.0, 60, 0.0, 0, 0, 1),
    (20, 0.0, 2, 1.0, 4, 0.0, 0, 0, 1), (40, 0.0, 3, 1.0, 3, 0.0, 0, 0, 1), (14, 0.0, 1, 1.0, 2, 0.0, 0, 0, 1), (4, 0.0, 2, 1.0, 3, 0.0, 0, 0, 1),
    (25, 0.0, 2, 1.0, 1, 1.0, 0, 0, 1), (18, 0.1, 4, 1.0, 0, 0.0, 0, 0, 1), (60, 0.0, 2, 1.0, 2, 1.0, 0, 0, 1), (3, 0.0, 30, 0.0, 2, 1.0, 0, 0, 1),
    # partly or wholly linked blocks among plain ones
    (6, 0.83, 40, 0.0, 30, 0.0, 0, 0, 1), (30, 0.9, 25, 0.0, 40, 0.0, 0, 0, 1), (7, 1.0, 40, 0.0, 50, 0.0, 0, 0, 1), (12, 0.6, 60, 0.1, 20, 0.0, 0, 0, 1),
    (4, 1.0, 20, 0.0, 12, 0.0, 0, 0, 1), (15, 0.7, 18, 0.0, 9, 0.3, 0, 0, 1),
    # a page without an article: links, and short lines among links
    (2, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0), (9, 0.8, 2, 1.0, 40, 0.0, 0, 0, 0), (30, 0.7, 4, 1.0, 5, 1.0, 0, 0, 0),
    (2, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0), (4, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0), (5, 0.6, 60, 0.0, 4, 1.0, 0, 0, 0), (3, 0.0, 2, 1.0, 0, 0.0, 0, 0, 0),
)

# More rows inside the article. A block goes there only if links make up nearly all of it and of the
# blocks around it (a list of links): any other is kept, whatever its words and neighbours.
LINKED = (
    # linked titles, headings and paragraphs beside plain blocks
    (8, 1.0, 1, 0.0, 60, 0.0, 0, 1, 1), (6, 1.0, 0, 0.0, 45, 0.0, 0, 1, 1), (3, 1.0, 70, 0.0, 50, 0.05, 0, 1, 1), (20, 1.0, 40, 0.0, 30, 0.0, 0, 1, 1),
    (9, 0.95, 2, 0.0, 0, 0.0, 0, 1, 1), (12, 1.0, 30, 0.1, 4, 0.0, 0, 1, 1), (2, 1.0, 8, 0.0, 15, 0.3, 0, 1, 1), (5, 0.9, 60, 0.3, 60, 0.0, 0, 1, 1),
    (4, 1.0, 30, 0.0, 2, 0.0, 0, 1, 1), (8, 1.0, 60, 0.2, 9, 0.0, 0, 1, 1), (6, 1.0, 1, 0.0, 3, 0.0, 0, 1, 1), (15, 1.0, 9, 0.5, 20, 0.0, 0, 1, 1),
    (7, 0.86, 12, 0.0, 30, 0.0, 0, 1, 1), (7, 0.86, 0, 0.0, 0, 0.0, 0, 1, 1), (30, 0.9, 25, 0.1, 25, 0.2, 0, 1, 1),
    # partly linked blocks: references, sentences around a link
    (14, 0.6, 2, 0.0, 12, 0.7, 0, 1, 1), (12, 0.7, 14, 0.6, 16, 0.85, 0, 1, 1), (16, 0.85, 12, 0.7, 15, 0.8, 0, 1, 1), (15, 0.8, 16, 0.85, 3, 0.0, 0, 1, 1),
    (10, 0.75, 10, 0.75, 0, 0.0, 0, 1, 1), (7, 0.86, 9, 0.8, 8, 0.85, 0, 1, 1), (5, 0.6, 6, 1.0, 7, 1.0, 0, 1, 1), (3, 0.67, 2, 1.0, 4, 0.75, 0, 1, 1),
    (9, 0.78, 5, 1.0, 60, 0.0, 0, 1, 1), (25, 0.55, 3, 1.0, 3, 1.0, 0, 1, 1), (6, 0.83, 40, 0.0, 6, 1.0, 0, 1, 1),
    # plain blocks beside linked ones, of any length
    (90, 0.0, 6, 1.0, 2, 0.0, 0, 1, 1), (15, 0.0, 5, 1.0, 3, 0.0, 0, 1, 1), (2, 0.0, 6, 1.0, 5, 0.0, 0, 1, 1), (3, 0.0, 70, 0.0, 12, 1.0, 0, 1, 1),
    (4, 0.3, 8, 1.0, 9, 1.0, 0, 1, 1), (1, 0.0, 9, 1.0, 0, 0.0, 0, 1, 1), (6, 0.0, 0, 0.0, 2, 1.0, 0, 1, 1), (18, 0.2, 4, 1.0, 4, 1.0, 0, 1, 1),
    (17, 0.0, 4, 1.0, 3, 0.0, 0, 1, 1), (40, 0.1, 6, 0.9, 1, 0.0, 0, 1, 1), (70, 0.0, 12, 0.8, 5, 0.0, 0, 1, 1), (3, 0.0, 2, 1.0, 2, 1.0, 0, 1, 1),
    (120, 0.0, 8, 1.0, 4, 1.0, 0, 1, 1), (10, 0.4, 3, 1.0, 80, 0.0, 0, 1, 1), (28, 0.0, 3, 0.7, 2, 0.5, 0, 1, 1), (7, 0.0, 7, 0.86, 7, 0.86, 0, 1, 1),
    # named boilerplate beside plain blocks and links
    (2, 1.0, 60, 0.0, 40, 0.0, 1, 1, 0), (8, 1.0, 50, 0.0, 0, 0.0, 1, 1, 0), (20, 0.9, 30, 0.1, 60, 0.0, 1, 1, 0), (5, 1.0, 0, 0.0, 70, 0.0, 1, 1, 0),
    (3, 0.0, 80, 0.0, 9, 1.0, 1, 1, 0), (25, 0.4, 3, 1.0, 3, 1.0, 1, 1, 0), (60, 0.0, 8, 0.8, 50, 0.0, 1, 1, 0), (14, 0.7, 12, 0.7, 15, 0.6, 1, 1, 0),
    # runs of linked blocks: their first, inner and last ones
    (6, 1.0, 40, 0.0, 20, 1.0, 0, 1, 0), (20, 1.0, 15, 1.0, 60, 0.0, 0, 1, 0), (14, 1.0, 18, 1.0, 25, 1.0, 0, 1, 0), (3, 1.0, 4, 1.0, 80, 0.0, 0, 1, 0),
    (4, 1.0, 1, 0.0, 25, 1.0, 0, 1, 0), (9, 1.0, 12, 1.0, 3, 0.0, 0, 1, 0), (30, 1.0, 80, 0.1, 4, 0.95, 0, 1, 0), (2, 1.0, 0, 0.0, 2, 1.0, 0, 1, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0), (5, 1.0, 2, 1.0, 7, 0.0, 0, 1, 0), (8, 0.95, 60, 0.0, 6, 1.0, 0, 1, 0), (11, 1.0, 3, 0.0, 9, 1.0, 0, 1, 0),
)

PAGES = "page_id long, url string, text string, n_chars long"


def _grow(x: np.ndarray, y: np.ndarray, depth: int) -> tuple | float:
    """A node (feature, cut, below, above), or a leaf's share of article blocks. Gini gain."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = (share * (1 - share) * len(y) - 1e-9, None)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, j] < cut
            cost = sum(s.mean() * (1 - s.mean()) * len(s) for s in (y[low], y[~low]))
            if cost < best[0]:
                best = (cost, (j, float(cut)))
    if best[1] is None:
        return share
    j, cut = best[1]
    low = x[:, j] < cut
    return (j, cut, _grow(x[low], y[low], depth - 1), _grow(x[~low], y[~low], depth - 1))


@functools.cache
def tree(inside: bool = False, depth: int = 9) -> tuple | float:
    """The tree trained on LABELLED; for blocks inside an article that on its rows there and LINKED."""
    rows = np.array([r for r in LABELLED if r[7] == 1] + list(LINKED) if inside else LABELLED, float)
    return _grow(rows[:, :-1], rows[:, -1], depth)


def verdict(node: tuple | float, row: tuple) -> bool:
    while isinstance(node, tuple):
        node = node[3] if row[node[0]] >= node[1] else node[2]
    return node >= 0.5


# Names of lists of articles.
LISTS = frozenset("archive card cards feed grid latest list lists more preview previews recent teaser teasers".split())


def _boiler_name(parts: set[str], inside: bool) -> bool:
    """Whether a class or id, by its parts, names boilerplate."""
    named = parts & BOILER_NAMES
    if not named or not inside or named - TOPICS:
        return bool(named)
    return all(p in named or p in LAYOUT or len(p) < 2 for p in parts)


def _ends(page: str, tag: str) -> dict[int, int]:
    """Where the content of an element of SKIPPED ends, by where it begins; those without an end tag aren't in it."""
    found, opened = {}, []
    for m in re.finditer(rf"<(/?){tag}\b[^>]*>", page, re.IGNORECASE):
        if not m[1]:
            if tag not in NESTING:
                opened.clear()  # the one before has no end
            opened.append(m.end())
        elif opened:
            found[opened.pop()] = m.end()
    return found


def _marks(tag: str, raw: str, inside: bool) -> tuple[bool, bool]:
    """(boilerplate, article) as the tag and its attributes have it."""
    boiler, main = tag in BOILER_TAGS or (tag == "header" and not inside), tag in ("article", "main")
    if not raw or tag in ("html", "body", "article", "main"):
        return boiler, main
    for name, value in ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"'")
        if (name == "class" and tag in NAMED) or (name == "id" and tag in CONTAINERS):
            names = [{x.lower() for x in NAME_PART.findall(v)} for v in value.split()]
            boiler |= any(_boiler_name(n, inside) for n in names) or (not inside and not main and any(n & PAGE_NAMES for n in names))
            # All of the name is about an article's whole: not a list, teaser or title of articles.
            main |= name == "class" and tag in ("div", "section", "td") and any(n & ARTICLE_NAMES and n <= ARTICLE_PARTS for n in names) and all(n <= ARTICLE_PARTS or not n & LISTS for n in names)
        elif name == "role" and tag in NAMED:
            boiler |= value.lower() in ROLES
            main |= value.lower() in ("main", "article")
        elif name == "itemprop":
            main |= value.lower() == "articlebody"
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE)):
            boiler = True
    return boiler, main


def blocks(page: str) -> list[tuple[str, int, bool, bool, bool]]:
    """(text, linked words, named boilerplate, inside the article, a heading) of every text block in page order."""
    out: list[tuple[str, int, bool, bool, bool]] = []
    ends: dict[str, dict[int, int]] = {}  # by tag, made when first needed
    pieces: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: tag, boilerplate, article
    held: Counter[str] = Counter()  # how many of each are open
    tops: list[int] = []  # places of blocks in the stack
    boiler = main = anchors = 0

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((text, len("".join(linked).split()), boiler > 0, main > 0, any(held[h] for h in HEADINGS)))
            pieces.clear()
            linked.clear()

    def add(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if anchors:
                linked.append(text)

    def pop() -> None:
        nonlocal boiler, main
        name, b, m = stack.pop()
        held[name] -= 1
        if name in BLOCKS:
            tops.pop()
        boiler -= b
        main -= m

    at = 0
    for m in iter(lambda: TOKEN.search(page, at), None):
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag, raw = m[2].lower(), m[3]
        closed = EMPTY.search(raw) is not None
        if tag in BLOCKS:
            flush()
            while stack and stack[-1][0] in SKIPPED:  # without an end tag
                pop()
        elif tag == "br":
            pieces.append(" ")
        if m[1]:  # an end tag
            if tag == "a":
                anchors = max(0, anchors - 1)
                linked.append(" ")
            elif held[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in RAW:
            end = re.compile(rf"<(/?){tag}\b[^>]*>", re.IGNORECASE).search(page, at)
            if closed and not (end and end[1]):
                continue  # written as an empty element, and no end tag belongs to it
            while end and not end[1]:
                end = re.compile(rf"<(/?){tag}\b[^>]*>", re.IGNORECASE).search(page, end.end())
            at = end.end() if end else len(page)
            continue
        if tag in SKIPPED:
            if tag not in ends:
                ends[tag] = _ends(page, tag)
            if end_at := ends[tag].get(at):
                at = end_at
            elif not closed:
                held[tag] += 1
                stack.append((tag, True, False))
                boiler += 1
            continue
        if tag == "a":
            anchors = 1  # links do not nest
        elif tag not in VOID and not closed:
            while tag in BLOCKS and tops and (stack[tops[-1]][0] == "p" or stack[tops[-1]][0] in CLOSES.get(tag, ())):
                end = tops[-1]
                while len(stack) > end:
                    pop()
            if tag in BLOCKS or raw:
                b, a = _marks(tag, raw, main > 0)
                if tag in BLOCKS:
                    tops.append(len(stack))
                held[tag] += 1
                stack.append((tag, b, a))
                boiler += b
                main += a
        if tag in BLOCKS:
            anchors = 0
    add(page[at:])
    flush()
    return out


def main_text(page: str) -> str:
    """The article's blocks, one a line."""
    found = blocks(page)
    if not found:
        return ""
    words = [len(t.split()) for t, *_ in found]
    links = [min(1.0, n / w) for (_, n, *_), w in zip(found, words, strict=True)]
    article = [m and not b for _, _, b, m, _ in found]
    listed = False  # below a heading of sources, where links are the text
    for i, (text, _, _, _, heading) in enumerate(found):
        if heading:
            listed = text.strip(" :.").lower() in SOURCES
        elif listed and article[i]:
            links[i] = 0.0
    has_main = any(article)

    def beside(i: int, j: int) -> float:
        return 0.0 if article[i] and not article[j] else links[j]

    kept = []
    for i, (text, _, boiler, inside, _) in enumerate(found):
        before = (words[i - 1], beside(i, i - 1)) if i else (0, 0.0)
        after = (words[i + 1], beside(i, i + 1)) if i + 1 < len(found) else (0, 0.0)
        row = (words[i], links[i], *before, *after, int(boiler), 1 if inside else -int(has_main))
        if verdict(tree(inside), row):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page of `pages` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h) for h in texts(batch["html"])]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run, PAGES)
