"""HTML extraction on pages whose main text is known, and on broken ones."""

import html
import random
import re
from collections import Counter

import pytest

from strandloom.llm.html_text import FEATURES, default_tree, extract_text, labelled_table, main_text

PAGES = [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("<!-- <p>x</p> -->", ""),
    ("<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One <b>wo</b>rd.<br>Two&nbsp;three</article><footer>&copy; me</footer>", "T & U One word. Two three"),
    ('<article><p>a b</p><div class="comments"><p>I like this article very much indeed</p></div><p>c</p></article>', "a b c"),
    ('<nav><ul><li><a href=1>x</a><article><p>Text goes on</p></article>', "Text goes on"),
    ('<header><h1>Site name</h1></header><main><header><h1>Title</h1></header><p>x &lt;y&gt; &#233;&#x4e;</main><aside>ad ad</aside>', "Title x <y> éN"),
    ('<article><script>var t="</p><p>no"</script><p>yes</p><form>Name <input></form><style>p{}</style>', "yes"),
    ('<article><p class="advert">Buy <p>Keep</p><ul class="share-links"><li>tweet</ul><p>this</p></article><div id="cookie-notice">ok?</div>', "Keep this"),
    ("<div>" + "long plain text of a page without any hint of structure " * 5 + "</div><ul>" + "<li><a href=u>one link</a>" * 5 + "</ul>", ("long plain text of a page without any hint of structure " * 5).strip()),
    ('<div id="main"><header><p>Site</header><div>crumbs</div><article><header><h2>Own</h2></header><p>Body</article><p>Read more here</div>', "Own Body"),
    ('<body class="page"><div class="content"><header>Name</header><p>' + "several words of running text in a block " * 4 + "</p></div><footer>x</footer>", ("several words of running text in a block " * 4).strip()),
    ("<div>" + "a long unmarked line of plain words outside " * 6 + "</div><div><article><p>In</article></div>", "In"),
    ("<article><p>cut in a tag <a hre", "cut in a tag"), ("<article><p>cut in a reference &am", "cut in a reference &am"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert main_text(page) == text


_PLAIN = ("plain words of a page inside one form " * 8).strip()
HOLDERS = [
    ('<div class="layout has-sidebar"><article><p>Body text</article><div class="sidebar">ad</div></div>', "Body text"),
    ('<nav>menu</nav><article class="post tag-cookies category-search"><p>Body text</article>', "Body text"),
    ('<div class="social widget"><article><p>Body</article></div>', "Body"),
    ("<form><div><header>Site</header><div><article><p>Body<p>Second</article></div></div></form>", "Body Second"),
    (f"<form><div><p>{_PLAIN}</div></form>", _PLAIN),
    ('<div class="has-sidebar"><article><p>The whole main text</article><div class="related"><article>other</article></div></div>', "The whole main text"),
    ('<article><p>The whole main text</article><div id="comments"><article class="comment"><p>me too</article></div>', "The whole main text"),
    ('<article><p>Text<div class="comments"><article class="comment"><p>me too</article></div></article>', "Text"),
    ('<div style="display:none"><article>no</article></div><p>x', ""),
]


@pytest.mark.parametrize(("page", "text"), HOLDERS)
def test_holder_in_marked_containers(page, text):
    assert main_text(page) == text


def test_words_and_links_take_part_in_every_place():
    links = "<ul>" + "".join(f"<li><a href=u>link {i}</a></li>" for i in range(6)) + "</ul>"
    text = ("running text of the page " * 12).strip()
    # A list of links is the article's where it stands in the article, else the page's menu.
    assert main_text(f"<article><p>{text}</p>{links}</article>") == text + " " + " ".join(f"link {i}" for i in range(6))
    assert main_text(f"<p>{text}</p>{links}") == text
    assert main_text("<article><h2><a href=u>Linked title</a></h2><p>Some text follows here</p><p><a href=u>Source</a></p></article>") == "Linked title Some text follows here Source"
    long = ("many words of running text " * 50).strip()
    assert long in main_text(f'<div class="social"><p>{long}</p><p>{long}</p><p>{long}</p></div>')
    x, y = labelled_table()
    assert all({0, 1} == set(y[(x[:, -2] == inside) & (x[:, -1] == marked)]) for inside, marked in ((0, 0), (0, 1)))
    assert set(y[(x[:, -2] == 1) & (x[:, -1] == 0)]) == {1}


def used(tree):
    return set() if len(tree) == 1 else {FEATURES[tree[0]]} | used(tree[2]) | used(tree[3])


def test_tree_asks_words_and_links_first():
    tree = default_tree()
    assert FEATURES[tree[0]] not in ("inside", "marked", "heading")
    assert {"words", "links", "words_1", "links_1", "words_3", "links_3"} <= used(tree)


def neutral(page):
    """The page with every container a div and no names."""
    page = re.sub(r"<(/?)(article|main|nav|footer|header|aside|section|form)\b", r"<\1div", page)
    return re.sub(r" (class|id|role)=(\"[^\"]*\"|\S+)", "", page)


def test_pages_without_hints(spark):
    """The pages of the test tables, whose articles are known, with all hints of the markup taken away."""
    right = taken = there = 0
    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", row.html, re.DOTALL).group(1)
        article = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", inner))).split())
        assert main_text(row.html) == article
        blank = neutral(row.html)
        assert "<article" not in blank and "class=" not in blank
        got, want = Counter(main_text(blank).split()), Counter(article.split())
        right, taken, there = right + (got & want).total(), taken + got.total(), there + want.total()
    assert right / taken >= 0.95 and right / there >= 0.95


PLAIN_FORMS = [
    ("<div><a href=a>News</a> <a href=b>Sport</a> <a href=c>Weather</a></div><h1>A title of five words</h1>" + "<p>{}</p>" * 4 + "<ul><li><a href=d>More on this</a><li><a href=e>Read next</a><li><a href=f>About us</a></ul>", "A title of five words"),
    ("<table><tr><td><a href=1>One</a></td><td><a href=2>Two</a></td></tr></table><div>{}</div><div>{}</div><div>{}</div><div>{}</div><div><a href=z>Next page</a></div>", ""),
    ("<h2>Heading</h2>" + "<div>{}</div>" * 4, "Heading"),
]


@pytest.mark.parametrize(("form", "title"), PLAIN_FORMS)
def test_plain_forms(form, title):
    texts = [" ".join(f"w{k}" for k in range(n)) for n in (34, 71, 52, 28)]
    assert main_text(form.format(*texts)) == " ".join([title, *texts]).strip()


SHORT = [
    ("<p>one two</p>", "one two"), ("<p>{10}</p>", "{10}"), ("<p>{30}</p>", "{30}"), ("<h1>Title</h1><p>{20}</p>", "Title {20}"), ("<h1>Title</h1><p>{20}</p><p>{20}</p><p>{20}</p>", "Title {20} {20} {20}"),
    ("<div><a href=1>Home</a> <a href=2>News</a></div><p>{18}</p><p>word</p><p>{17}</p>", "{18} word {17}"),
    ("<article><p>{50}</p><h2>References</h2><ol>" + "<li><a href=r>Source named</a></li>" * 5 + "</ol></article>", "{50} References" + " Source named" * 5),
    ("<article><h1>Links</h1><ul>" + "<li><a href=r>some page</a></li>" * 6 + "</ul></article>", "Links" + " some page" * 6),
]


def filled(form):
    return re.sub(r"\{(\d+)\}", lambda m: " ".join(f"w{k}" for k in range(int(m.group(1)))), form)


@pytest.mark.parametrize(("page", "text"), SHORT)
def test_short_pages_lose_nothing(page, text):
    assert main_text(filled(page)) == filled(text)


def menu(rng, n):
    return "".join(f"<li><a href=/{k}>{said(rng, rng.choice([1, 1, 2]), 'm')}</a></li>" for k in range(n))


def said(rng, n, kind="t"):
    return " ".join(f"{kind}{rng.randrange(10**6)}" for _ in range(n))


def layouts(rng):
    """Pages of layouts that aren't in the labelled table; content words begin with t, all others with m."""
    p = lambda low=8, high=90: f"<p>{said(rng, rng.randint(low, high))}</p>"
    many = lambda low=2, high=7: "".join(p() for _ in range(rng.randint(low, high)))
    h = lambda tag="h1": f"<{tag}>{said(rng, rng.randint(2, 9))}</{tag}>"
    m = lambda n: said(rng, n, "m")
    yield h() + many()
    yield p(1, 40)
    yield h() + p(5, 30)
    yield f"<div><ul>{menu(rng, 5)}</ul></div>" + h() + many(3) + f"<ul>{menu(rng, 4)}</ul>"
    yield f"<div class=nav>{menu(rng, 6)}</div><div id=content>" + h() + many() + f"<blockquote>{said(rng, 25)}</blockquote></div><div class=sidebar>{m(40)}</div><div id=footer>{m(12)}</div>"
    yield f"<header>{m(4)}<nav>{menu(rng, 5)}</nav></header><main>" + h() + many() + h("h2") + f"<ul>{''.join(f'<li>{said(rng, rng.randint(1, 12))}</li>' for _ in range(6))}</ul></main><aside>{m(60)}</aside><footer>{m(20)}</footer>"
    yield f"<nav>{menu(rng, 8)}</nav><article>" + h() + many() + f"<h2>{said(rng, 1)}</h2><ol>" + "".join(f"<li><a href=x>{said(rng, 4)}</a></li>" for _ in range(7)) + f"</ol></article><section class=comments><p>{m(30)}</p><p>{m(80)}</p></section>"
    yield f"<table><tr><td>{menu(rng, 4)}</td></tr><tr><td>" + h() + many(3) + f"</td></tr><tr><td>{menu(rng, 3)}</td></tr></table>"
    yield f"<article><header>{h()}</header>{p(3, 12)}{p(100, 300)}{p(2, 9)}<figure><figcaption>{said(rng, 9)}</figcaption></figure><table><tr><td>{said(rng, 1)}</td><td>{said(rng, 2)}</td></tr></table></article><div class='newsletter signup'>{m(25)}</div>"
    yield f"<div id=cookie-banner>{m(22)}</div><ul>{menu(rng, 5)}</ul><div class=post>" + h("h2") + many() + f"<div class=share>{m(3)}</div>" + p() + f"<div class=ad>{m(15)}</div>" + p() + "</div>"
    yield f"<div><a href=1>{m(1)}</a> | <a href=2>{m(1)}</a> | <a href=3>{m(1)}</a></div>" + h() + many(2, 4)
    yield f"<main><p>{said(rng, 12)} <a href=x>{said(rng, 14)}</a></p><p><a href=y>{said(rng, 6)}</a></p>{many(1, 3)}</main><nav>{menu(rng, 3)}</nav>"


def test_layouts_that_were_not_learnt():
    rng = random.Random(17)
    right = taken = there = 0
    for _ in range(40):
        for page in layouts(rng):
            got, want = Counter(main_text(page).split()), Counter(re.findall(r"\bt\d+", page))
            right, taken, there = right + (got & want).total(), taken + got.total(), there + want.total()
    assert right / taken >= 0.95 and right / there >= 0.95, (right / taken, right / there)


def test_extract_text(spark):
    rows = [(i, f"u{i}" if i % 2 else None, h, "clash") for i, (h, _) in enumerate(PAGES)] * 2 + [(None, None, "<article>" + "<p>w x</p>" * 20_000, "t")]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id, r.url or "", r.text) for r in got if r.page_id is not None) == sorted((i, f"u{i}" if i % 2 else "", t) for i, (_, t) in enumerate(PAGES) for _ in range(2))
    assert all(r.n_chars == len(r.text) for r in got)
    assert [r.n_chars for r in got if r.page_id is None] == [20_000 * 4 - 1]
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
