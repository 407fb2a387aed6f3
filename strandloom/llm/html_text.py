"""Main text of web pages from flat text blocks and a decision tree.

A page becomes a flat list of text blocks.  Each block is described by its words and link density and those of its
neighbours; what the markup hints at (an article element around it, a menu or advert by name) comes as two more
features.  A small CART tree, grown from the labelled table below when a task starts, says which blocks are content;
most of the table is learnt with and without the hints, so pages whose markup says nothing are told by words and links.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a block is described by: its own words and link density, those of the two blocks before and the two after it,
#: whether it and the next block are headings, how many blocks of the page (up to six) are mostly links, so that pages with a
#: menu are told from pages without, and two hints of the markup: inside is 1 in the page's article or main element, -1 outside it
#: where there is one, 0 where there is none; marked is 1 in a menu, advert, form, notice, comment or the like.
FEATURES = ("words", "links", "words_1", "links_1", "words_2", "links_2", "words_3", "links_3", "words_4", "links_4", "heading", "heading_3", "page_links", "inside", "marked")

#: The labelled table: pages as their blocks.  A block is + (content) or -, then a (in the article), o (outside it), m
#: (marked) or nothing, h for a heading, words/linked words, and *n where it stands n times.  Pages of the first part are
#: learnt twice, the second time without the hints a, o and m, so that words and links must tell what they can.  What stands in
#: the article unmarked is content whatever its links, and a page without links and hints is content as a whole.
LABELLED = """
-m1/1*6 -m8/0 +ah9/0 +a45/0 +a60/1 +a38/0 +a70/2 -m17/0
-m1/1*5 -m10/0 +ah7/0 +a12/0 +a8/0 -m14/1
-m2/2*7 -m5/0 +ah11/0 +a130/0 -m9/0
-m1/1*4 -m12/0 +ah6/0 +a5/0 +a90/0 +a2/0 +a55/0 +a7/0 -m11/2
-m2/1*8 -m6/1 +ah4/0 +a14/0 +a1/0 +a3/0 +a25/0 +a9/0 +a4/0 -m15/0
-m1/1*6 -m4/0 +ah8/0 +a6/0 +a5/0 -m12/0
-m1/1*3 -m11/0 +ah10/0 +a9/0 -m8/0
-m2/2*5 -m13/0 +ah3/0 +a2/0 +a4/0 +a1/0 +a3/0 +a2/0 +a5/0 -m10/1
-m1/1*6 -m9/0 +ah5/0 +a260/3 +a8/0 +a190/0 +a22/0 +a310/2 -m16/0
-m3/3*4 -m7/0 +ah12/0 +a33/0 +a41/4 +a18/0 -m5/5 -m6/6 -m4/4 -m13/3
-m1/1*7 -m7/0 +ah9/0 +a75/0 +a10/0 +a6/0 +a120/1 +a13/0 +a4/0 -m14/0
-m2/2*6 +ah6/0 +a20/0 +a45/0 +a9/0 -m9/9 -m7/7 -m8/8 -m3/0
-m1/1*6 -m8/0 +ah2/0 +a3/0 -m11/0
-m4/4 -m3/3*5 -m14/2 +ah8/0 +a66/0 +ah3/0 +a48/0 +ah4/0 +a72/5 +a5/5 +a39/0 -m2/2*4 -m18/1
-m1/1*9 +ah7/7 +a54/0 +a31/2 -m1/1 -m2/2 -m1/1 -m12/0
-m5/2 -m1/1*6 -m10/0 +ah13/0 +a8/0 +a17/0 +a11/0 +a24/0 +a5/0 +a16/0 +a20/0 -m13/0
-m6/0 -m2/2*6 +ah5/0 +a28/0 +a140/1 +a7/0 +a95/0 -m3/0 -m8/6 -m7/7 -m20/4
-m1/1*5 +ah8/0 +a100/0 +a80/0 -m4/4*6 -m22/1
-m2/2*6 -m9/0 +ah6/0 +a8/8 +a49/0 +a12/0 +a77/0 -m15/0
-m1/1*6 -m12/0 +ah10/0 +a1/0 +a1/0 +a2/0 +a1/0 +a14/0 +a1/0 -m9/0
-m1/1*6 -m6/0 +ah9/0 +a400/0 -m12/0
-1/1*5 +h8/0 +60/0 +85/3 +40/0 +h4/0 +120/2 -12/5
-2/2*6 +h7/0 +35/0 +90/0 +6/0 +48/1 +110/0 -2/2 -3/3 -2/2 -9/1
-1/1*4 -3/2 +55/0 +20/0 +70/2 +15/0 -4/4*3 -16/0
-3/3*3 -8/6 +h5/0 +30/0 +44/1 +9/0 +52/0 -6/6*3
+h6/0 +80/0 +150/4 +60/0
+70/0 +95/1 +12/0 +40/0
+40/1
+h3/0 +25/0
-1/1*6 +150/0 -1/1*4
-2/2 -3/3*4 +300/6 -5/5*5
-4/4*6 -5/5*8 -3/3*4
+60/0 -2/2*4
+45/0 -1/1*6
+h5/0 +58/0 -3/3*5
+10/0
+2/0
+20/0
+h4/0 +20/0
+h2/0 +12/0 +20/0
+h4/0 +20/0 +20/0 +20/0
+h6/0 +30/0 +9/0 +14/0
+18/0 +1/0 +17/0
+h3/0 +8/0
+h5/0 +16/0 +5/0 +h2/0 +11/0 +3/0
+h7/0 +14/0 +60/0 +4/0 +33/0 +12/0 +7/0
+25/0 +7/0 +90/0 +3/0 +15/0
-2/2 +18/0 +1/0 +17/0
-3/3 +h4/0 +30/0 +22/0
-6/6 +40/0 +31/0 +25/0 -5/5
-1/1 +12/0 +26/0
-1/1*5 +18/0 +1/0 +17/0 -16/0
-2/2*4 +25/0 +30/0 +22/0
-1/1*3 +19/0 +6/0 +34/0 -2/2
-1/1*6 +h5/0 +40/0 +24/0
-1/1*5 +h4/0 +20/0 -12/0
-2/2*6 +h6/0 +22/0 -3/3*4
-2/2*3 +h3/0 +21/0 +13/0 +26/0 -4/4*2 -9/0
-1/1*4 +h8/0 +11/0 +44/0 +h2/0 +23/0 +9/0 +31/0 -1/1*3
""", """
-o12/0 +ah5/0 +a30/0 +a8/0 -o20/0
-o48/0 +a1/0
-o60/0 -o55/1 +ah4/0 +a50/0 +a35/0 -o40/0
-o1/0 -o1/0 +ah1/0 +a1/0 -o3/0
-o90/0 +a200/0 +a150/1 -o30/2 -o70/0
-m1/1 +a3/0
+a5/0
+a1/0
+a2/0 -m1/0 +a1/0
+a3/0 -m7/0 +a1/0
+ah4/0 +a3/0 +a6/0 +a3/0
+a1/0 +a1/0
+a60/0 -m4/0 -m20/0 -m35/0 -m12/0 -m2/1
+a70/0 +a90/1 -mh2/0 -m45/0 -m8/0 -m120/0 -m60/0 -m30/0 -m5/2
+ah6/0 +a45/0 -m30/0 +a55/0 +a12/0 -m9/4 +a80/0 -m14/0
+ah9/0 +a50/0 -m70/2 +a65/0 -m26/0 -m90/0 -m40/1
+a48/0 +a2/2*6
+a60/0 +a3/3 +a3/3 +a4/4 +a3/3
+a75/0 +a20/0 +a6/6 +a5/5 +a7/7 +a6/6 +a8/7
+a50/0 +ah1/0 +a2/2*5
+ah1/0 +a3/3*6
+a2/2*12
-m1/1*5 +ah5/0 +a120/2 +ah1/0 +a9/6 +a11/7 +a8/5 -m12/0
-m1/1*5 +ah4/0 +a3/3*3 +a45/0 +a2/2*8 -m4/4*3
+ah2/2 +a4/0 +a1/1
+ah5/5 +a60/0 +a4/4 +a35/0
+ah3/3 +a40/0 +a2/2
+a50/0 +a9/9
+ah6/6 +a3/0 +a12/0 +a2/2
+a18/11 +a80/0 +a5/5 +a70/3
-m18/0 +m180/0 +m220/0 +m160/0 -m12/3
+m150/0 +m150/0 +m150/0
+m180/0 +m160/0 +m190/0 +m170/0
+m140/0 +m320/6 +m210/0 +m240/5 +m170/0
-m160/90 -m150/75 -m170/3 -m40/0
-m110/0 -m90/0 -m95/0
-m130/0 -m60/0 +a8/0 -m90/0 -m40/0
+ah7/0 +a150/0 +a20/0 -m200/0 -m90/0 -m40/0 -m260/0
-m2/2 -m2/0 +35/0 -m1/0
-m1/1*3 -m30/0 +h5/0 +60/0 +90/5 -m25/0 -m33/3
-m1/1*5 +h3/0 +12/0 +7/0 +45/0 -m3/0 -m18/0 -m60/0
-m2/0 +8/0 +5/0 -m9/0
+h4/0 +3/0 -m6/2
-m8/0 +56/0 -1/1*4
-m1/1 -m40/0 +25/0 +9/0 -m50/0
+5/0 +2/0 +3/0
-m1/0 +a1/0
-m2/0 +a1/0 -m1/0 +a2/0 -m1/0
-m1/0 +ah1/0 +a1/0 -o3/0
-m1/0 -o2/0 +ah1/0 +a2/0 -o4/0
-m1/0 +a2/0
-m2/0 +a3/0 +a1/0
-m1/0 +a1/0 +a1/0 +a2/0
-m1/0 +a33/0 -m1/0
-m3/0 +a2/0 -m2/0 -m1/0
+ah8/0 +a30/0 +a120/0 +a2/0 +a14/0 +a140/0 +a4/0 -m12/0
+a200/0 +a3/0 +a90/0 +a5/0 -m10/0
-m1/1*5 +ah6/0 +a90/0 +a1/0 +a9/0 +a110/0 +a3/0 +a5/0 +a70/0 +a2/0 -m8/0
-m1/1*5 -m9/0 +ah4/0 +a5/0 +a3/0 +a130/0 +a4/0 +a40/0 +a1/0 -m15/0
-m1/1*6 -m9/0 +ah3/0 +a2/0 -m14/0
-m1/1*6 -m12/0 +ah2/0 +a2/0 -m9/0
"""


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """FEATURES and labels (1 content) of the labelled pages' blocks."""
    rows, labels = [], []
    for part, pages in enumerate(LABELLED):
        for page in pages.strip().splitlines():
            blocks, own = [], []
            for sign, hint, heading, words, linked, times in re.findall(r"([+-])([aom]?)(h?)(\d+)/(\d+)(?:\*(\d+))?", page):
                block = ("", int(words), int(linked) / int(words), {"a": 1, "o": -1}.get(hint, 0), int(hint == "m"), int(heading == "h"))
                blocks += [block] * int(times or 1)
                own += [int(sign == "+")] * int(times or 1)
            for hints in (True, False)[: 2 - part]:
                rows.append(features(blocks if hints else [(*b[:3], 0, 0, b[5]) for b in blocks]))
                labels += own
    return np.concatenate(rows), np.array(labels, float)


#: Elements whose inside is never text of the page.
_UNSEEN = "script|style|noscript|template|iframe|object|svg|canvas|math|textarea|select|title|audio|video|datalist"
#: Elements that start and end a text block.
_BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre section summary table tbody td tfoot th thead tr ul".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_BOILER_TAGS = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"))
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words of a class or id, split at anything but letters, that mark what isn't the article.
_BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "discussion disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination "
    "paywall popup promo promoted promotion recommended related replies respond responses search share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription teaser teasers toolbar topbar widget widgets".split()
)
_MAIN_NAMES = frozenset("article articlebody content entry main post story maincontent".split())
_CONTAINERS = frozenset("article main section div td header footer nav aside form menu dialog button fieldset ul ol dl table blockquote figure center details span p li h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_UNSEEN})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_LETTERS = re.compile(r"[a-z]+")
#: Pages whose blocks are held and judged at once.
PAGES = 64


#: The place of what stands outside the holder of a page that has one; it counts as -1, but the holder may start there.
_OUTSIDE = -2
#: The place of what only a form sets apart; it counts as 0 where the form holds the whole page, else as -1.
_IN_FORM = -3
#: The place of what isn't shown; no holder starts there.
_HIDDEN = -4
_ARTICLE = re.compile(r"<article\b", re.IGNORECASE)
_MAIN = re.compile(r"<main\b", re.IGNORECASE)


def _place_of(tag: str, attributes: str, around: int, holder: str, in_holder: bool) -> tuple[int, bool]:
    """The place inside an element, from its name, class, id and role, given the place around it, and whether these mark
    it as a menu, advert, form or the like.

    `holder` is the element that holds the article on this page: article, else main, else what class or id call so.
    An element starts anew whatever stands around it and whatever its own names are, unless it isn't shown; what only
    class or id call so starts anew in a form.
    """
    names: set[str] = set()
    role = False
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name in ("class", "id"):
                names.update(_LETTERS.findall(value))
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return _HIDDEN, True
            elif name == "role" and value in _BOILER_ROLES:
                role = True
    if around == _HIDDEN:
        return _HIDDEN, False
    boiler = role or tag in _BOILER_TAGS or bool(names & _BOILER_NAMES) and tag not in ("body", "html")
    if not in_holder and (tag == holder or not holder and not boiler and around in (0, _IN_FORM) and names & _MAIN_NAMES and tag in ("div", "section", "td")):
        return 1, boiler
    if boiler:
        return (_IN_FORM if tag == "form" and around in (0, _IN_FORM) else -1), True
    if tag == "header":  # of the site, unless it is the article's own
        return (around if around == 1 and in_holder and holder else -1), False
    return around, False


def text_blocks(page: str) -> list[tuple[str, int, float, int, int, int]]:
    """(text, words, link density, inside, marked, heading) of each block in page order, references decoded.

    A holder's level is the number of marked elements around it, itself included.  The holder of most words decides
    which levels are the article's: those up to its own.  So an article in a marked layout or form is kept, and
    comments or teasers that are articles themselves, marked more often than the text they belong to, are not.
    """
    blocks: list[tuple[str, int, float, int, int]] = []
    open_tags: list[tuple[str, int, bool, int]] = []  # tag; place around it; whether it is marked; the holder around it
    held: list[int] = []  # of each block: the holder it stands in, or 0
    level, own = [0], 0
    pieces: list[str] = []
    linked: list[str] = []
    in_link = heading = 0
    holder = "article" if _ARTICLE.search(page) else "main" if _MAIN.search(page) else ""
    place = _OUTSIDE if holder else 0

    def end_block() -> None:
        nonlocal pieces, linked
        if pieces:
            words = html.unescape("".join(pieces)).split()
            if words and place != _HIDDEN:
                n_linked = len(html.unescape("".join(linked)).split()) if linked else 0
                blocks.append((" ".join(words), len(words), min(1.0, n_linked / len(words)), place, heading))
                held.append(own)
        pieces, linked = [], []

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            pieces.append(page[at : m.start()])
            if in_link:
                linked.append(pieces[-1])
        at = m.end()
        tag = (m.group(3) or "").lower()
        if not tag:
            continue
        closing = bool(m.group(2))
        if tag in _BLOCK:
            end_block()
            if tag in _HEADINGS:
                heading = int(not closing)
        elif tag == "a":
            in_link = 0 if closing else 1
            if linked or not closing:
                linked.append(" ")
        if tag not in _CONTAINERS:
            continue
        if not closing:
            while open_tags and tag in _BLOCK and open_tags[-1][0] in ("p", "li") and (open_tags[-1][0] == "p" or tag == "li"):  # these end by themselves
                _, place, _, own = open_tags.pop()
            if tag in ("article", "main"):  # a menu, header or form left open doesn't hold the article
                while open_tags and open_tags[-1][0] in ("nav", "header", "form", "ul", "ol", "li", "p", "menu"):
                    _, place, _, own = open_tags.pop()
            inside, marked = _place_of(tag, m.group(4), place, holder, own > 0)
            if inside != place and tag not in _BLOCK:
                end_block()
            open_tags.append((tag, place, marked, own))
            if inside == 1 and not own:
                level.append(sum(t[2] for t in open_tags))
                own = len(level) - 1
            place = inside
        elif any(t[0] == tag for t in open_tags):
            while True:
                name, outside, _, around = open_tags.pop()
                if outside != place:
                    end_block()
                place, own = outside, around
                if name == tag:
                    break
    if at < len(page):
        pieces.append(page[at:])
    end_block()
    n_words = [0] * len(level)
    for b, h in zip(blocks, held, strict=True):
        n_words[h] += b[1] * (b[3] == (h > 0))  # unmarked text without a holder counts as level 0
    most = level[max(range(len(level)), key=lambda h: (n_words[h], -level[h]))]
    form = 0 if all(b[3] in (-1, _IN_FORM) for b in blocks) else -1
    places = [-1 if level[h] > most else form if b[3] == _IN_FORM else b[3] for b, h in zip(blocks, held, strict=True)]
    return [(*b[:3], {_OUTSIDE: -1, -1: 0}.get(p, p), int(p == -1), b[4]) for b, p in zip(blocks, places, strict=True)]


def features(blocks: list[tuple[str, int, float, int, int, int]]) -> np.ndarray:
    """FEATURES of each block; beyond the ends of the page blocks count as empty.  Words count up to sixty: longer is only longer."""
    n = len(blocks)
    words = np.minimum(np.array([0, 0, *(b[1] for b in blocks), 0, 0], float), 60)
    links = np.array([0, 0, *(b[2] for b in blocks), 0, 0], float)
    around = [x[2 + at : 2 + at + n] for at in (0, -1, -2, 1, 2) for x in (words, links)]
    heading, inside, marked = (np.array([b[k] for b in blocks], float) for k in (5, 3, 4))
    menu = np.full(n, min(6.0, float((links > 0.5).sum())))
    return np.stack([*around, heading, np.append(heading[1:], 0.0)[:n], menu, inside, marked], 1)


def grow(x: np.ndarray, y: np.ndarray, depth: int) -> tuple:
    """A CART tree by Gini impurity: (feature, threshold, low, high) or a leaf (share of content,)."""
    if depth == 0 or y.min() == y.max():
        return (float(y.mean()),)
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = y[x[:, f] <= t]
            high = y[x[:, f] > t]
            impurity = sum(len(s) * s.mean() * (1 - s.mean()) for s in (low, high))
            best = min(best, (impurity, f, float(t)))
    if best[0] == np.inf:
        return (float(y.mean()),)
    _, f, t = best
    low = x[:, f] <= t
    return (f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


@cache
def default_tree(depth: int = 10) -> tuple:
    return grow(*labelled_table(), depth)


def classify(tree: tuple, x: np.ndarray) -> np.ndarray:
    """Share of content in the leaf of each row of `x`."""
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    f, t, low, high = tree
    out = np.empty(len(x))
    left = x[:, f] <= t
    out[left], out[~left] = classify(low, x[left]), classify(high, x[~left])
    return out


def main_texts(pages: list[str | None], tree: tuple | None = None) -> list[str]:
    """Content blocks of each page in page order, joined by single spaces; empty for null, empty and textless pages.

    All blocks of all the pages go down the tree together.
    """
    blocks = [text_blocks(page) if page else [] for page in pages]
    found = [features(own) for own in blocks if own]
    content = iter(classify(tree or default_tree(), np.concatenate(found)) > 0.5) if found else iter(())
    return [" ".join([b[0] for b in own if next(content)]) for own in blocks]


def main_text(page: str | None, tree: tuple | None = None) -> str:
    return main_texts([page], tree)[0]


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of `df`: page_id, url, text, n_chars (code points of text).

    A null, empty or textless page has the empty text.  Null ids and urls and repeated rows pass through; pages
    of any length are read whole; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            for at in range(0, batch.num_rows, PAGES):
                texts += main_texts(batch.column(2).slice(at, PAGES).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    chosen = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
