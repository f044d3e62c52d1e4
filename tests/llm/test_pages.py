import itertools
import random

import pytest

from sievelight.llm import pages as op

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class="site"><h1>Site</h1><p>Sub head.</p></header><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site. Accept them all, thank you very much indeed.</p></div>
<div id="page"><div class="sidebar"><h3>Popular</h3><p>Some long teaser text, which could be an article. It is not.</p></div>
<div class="post-content"><h1>My title &amp; more</h1><p>First  paragraph of&nbsp;text with <a href=z>a link</a> inside.</p>
<p>Short.</p><div class=ad>Buy now! Great offer only today, for you and all your friends.</div><p>Second
 paragraph<br>here<!-- not here -->.</p><form><label>Mail</label><button>Subscribe</button></form></div>
<section id="comments"><h2>Comments</h2><div><p>Nice article, I liked it a lot. Thanks for the work.</p></div></section>
</div><footer>&copy; 2020 by us. All rights are ours, and so on.</footer></body></html>"""


def test_article_without_its_surroundings():
    assert op.main_text(PAGE).split("\n\n") == [
        "My title & more", "First paragraph of text with a link inside.", "Short.", "Second paragraph here.",
    ]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<nav>a</nav>", ""), ("<article>x", "x"),
        ("<article><p>a<b>b</p><p>c</b>d</article>", "ab\n\ncd"),
        ("<article><p>1 &lt; 2 &#8364; &eacute;<p>x</article>", "1 < 2 € é\n\nx"),
        ("<html><head><title>T</title><meta name=x><body><article><p>x</p></article>", "x"),
        ("<head><title>T</title><p>A text without a body, but long enough. It counts.", "A text without a body, but long enough. It counts."),
        ("<title>T</title><article>x<header>y</header></article>", "x\n\ny"),
        ("<article><ul><li>a<li>b</ul></article>", "a\n\nb"),
        ('<article><p title="a > b">t</p><img alt="<p>"><p>u</p></article>', "t\n\nu"),
        ("<article><script>if (a < b) { '</p>' }</script><p>t</p><style>", "t"),
        ('<div class="post has-sidebar no-comments"><p>one</p></div><div class="CookieBanner">We use them.</div>', "one"),
        ('<main id="main"><div class="leftNav">a b</div><p>one</p><div role="complementary">two</div></main>', "one"),
        ("<article><header><h1>Head</h1></header><p>one</p><footer>by me</footer></article>", "Head\n\none"),
        ("<article><p>one</p><aside>two, and some more text here.</aside><p>three</p></article>", "one\n\nthree"),
    ],
)
def test_small_pages(page, text):
    assert op.main_text(page) == text


def test_plain_page_without_marks():
    body = "This is a plain page without any marks. It has only text, but quite a lot of it, so it counts."
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div><p>{body}</p><p>{body}</p><p>Ok.</p></div></body>"
    assert op.main_text(page) == f"{body}\n\n{body}\n\nOk."


LONG = "This is the article, and it has a sentence or two. It goes on for a while, so that it is most of the page. It ends."
NAV = "<nav><a href=1>Home</a></nav>"
FOOT = "<footer>&copy; by us. All rights are ours.</footer>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form id=aspnetForm>{NAV}<div><p>{LONG}</p><p>{LONG}</p></div>{FOOT}</form></body>",
        f"<body><form id=aspnetForm>{NAV}<div class=comments><p>Nice one, thanks.</p></div><div class=content><p>{LONG}</p><p>{LONG}</p></div>{FOOT}</form></body>",
        f'<div class="content-sidebar-wrap">{NAV}<article><p>{LONG}</p><p>{LONG}</p></article><aside>See also this. And that.</aside></div>{FOOT}',
        f'<div class="page layout-sidebar-right">{NAV}<div><p>{LONG}</p><p>{LONG}</p></div><div class=sidebar>Old posts. New posts.</div></div>{FOOT}',
        f'<div id="page" class="right-sidebar">{NAV}<main><p>{LONG}</p><p>{LONG}</p></main></div>{FOOT}',
        f'<div class="content-sidebar-wrap"><div class=entry><p>{LONG}</p><p>{LONG}</p></div></div><div class=comments>{f"<p>{LONG}</p>" * 9}</div>',
        f'<main><p>{LONG}</p><p>{LONG}</p></main><div class="related"><article><p>{LONG}</p></article></div>',
        f'<article><p>{LONG}</p><p>{LONG}</p></article><section id=comments>{f"<article><p>{LONG}</p></article>" * 9}</section>',
        f'<article><p>{LONG}</p><p>{LONG}</p><form><label>Your mail. We need it.</label></form></article>',
        f'<article><p>{LONG}</p><p>{LONG}</p></article><div class="cookie-consent-wrapper">We use cookies. Accept.</div>',
    ],
)
def test_marks_of_outer_elements_do_not_lose_the_article(page):
    assert op.main_text(page) == f"{LONG}\n\n{LONG}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<nav>One Two</nav><div><p>It rained today.</p></div><footer>x</footer>", "It rained today."),
        ("<nav>One Two</nav><div><h1>Rain</h1><p>It rained today.</p></div><footer>x</footer>", "Rain\n\nIt rained today."),
        ("<nav>首页</nav><div><p>今天下雨了。</p></div><footer>版权</footer>", "今天下雨了。"),
        ("<nav>Start</nav><div><p>Es regnete heute.</p></div><div class=fusszeile>Impressum</div><div class='kommentare'><p>Danke schön!</p></div>", "Es regnete heute."),
        ("<nav>a</nav><ul><li>Mix flour.<li>Add water.<li>Bake.</ul><footer>x</footer>", "Mix flour.\n\nAdd water.\n\nBake."),
        ("<nav>a</nav><table><tr><th>Town<th>Rain<tr><td>Ulm<td>3</table><footer>x</footer>", "Town\n\nRain\n\nUlm\n\n3"),
        (f"<p>{LONG}</p><div class=ad>Buy.</div><h2>Later</h2><div class=ad>Buy.</div><p>He left.</p><div class=ad>Buy.</div>", f"{LONG}\n\nLater\n\nHe left."),
        (f"<article><p>{LONG}</p></article><div class=ad>Buy.</div><footer>x</footer>", LONG),
        ("<article id='social-security-alert'><p>It came.</p></article><div>Short other.</div>", "It came.\n\nShort other."),  # joined by smoothness
        ("<p>He left.</p><div>" + "<p><a href=x>One more</a></p>" * 9 + "</div>", "He left."),
        ("<div><p>He left.</p></div><p>Copyright 2020 by us. All rights reserved.</p>", "He left."),
        ("<div><a href=x>Home</a></div>", ""),
    ],
)
def test_short_articles_without_marks(page, text):
    assert op.main_text(page) == text


def test_marks_after_a_misplaced_end_tag():
    page = f"<article><p>one</p><b class=ad><div class=text><p>two</p></b><p>three</p></div></article>{FOOT}"
    assert op.main_text(page) == "one\n\nthree"
    op.main_text("<div class=ad>a" * 9000 + "<b class=ad><i class=ad>" * 2000 + "</b>" * 2000)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p>one <svg class="i"/> two</p><p>three</p></article>', "one two\n\nthree"),
        ('<article><p>one <svg class="i"> two</p><p>three</p></article>', "one\n\nthree"),
        ('<article><p>a <svg aria-hidden="true"><use/><style/></svg> b<svg><title>x</title><text>y</text></svg></p></article>', "a b"),
        ("<article><p>one <math/> two<svg><path><p>three <math><mi>x<span>y</span></mi></math> four</article>", "one two\n\nthree four"),
        ("<article><ul><li>one <select><option>x<option>y<li>two</ul><p>three</article>", "one\n\ntwo\n\nthree"),
        ("<article><div>a <canvas> no</div><div>b <b><audio>no</b> c</div><div>d <video>no <p>no</p><a>no</video> e</div></article>", "a\n\nb c\n\nd e"),
        ("<article><p>one</p><object><div>no</div></object><p>two</p><template><p>no</p></template><title-bar>x</title-bar><video-box>y", "one\n\ntwo\n\nxy"),
        ("<article><p>one</p><iframe src=x>no <p>no</p><p>no", "one"),
    ],
)
def test_silent_elements_end(page, text):
    assert op.main_text(page) == text


def test_hostile_silent_elements_end():
    for page in ("<svg><g>" * 9000 + "</b>" * 9000, "<li><video>" * 9000 + "<li>" * 9000, "<svg/>x" * 30_000, "<b><canvas></b>" * 20_000):
        op.main_text(page)


def cost(found, labels):
    """What a labelling costs: terminal edges that are cut and smoothness edges between labels."""
    total = sum(max(0, op.leaning(b)) if not keep else max(0, -op.leaning(b)) for b, keep in zip(found, labels, strict=True))
    last = {}
    free = [j for j, b in enumerate(found) if not b.away]  # marked blocks have no smoothness edges
    for i, j in zip([None, *free], free, strict=False):
        b = found[j]
        if i is not None and labels[j] != labels[i]:
            total += op._SAME if found[i].owner == b.owner else op._STEP
        k = last.get(b.owner)
        if k not in (None, i) and labels[k] != labels[j]:
            total += op._NEAR
        last[b.owner] = j
    return total


def test_cut_is_the_cheapest_labelling():
    rng = random.Random(4)
    for _ in range(120):
        found = [
            op._Block(rng.choice(["x", "Some words.", "A b c. D e f. " * 9]), 0, rng.random() < 0.2, rng.random() < 0.2, False, rng.randint(0, 2))
            for _ in range(rng.randint(1, 9))
        ]
        for b in found:
            b.links = rng.choice([0, len(b.text)])
        best = min(cost(found, labels) for labels in itertools.product([True, False], repeat=len(found)))
        assert cost(found, op.content(found)) == pytest.approx(best)


def test_hostile_pages_end():
    for page in ("<p>x " * 30_000, "<div>a" * 9000 + "</b>" * 9000, '<a "' * 20_000, "<!--" * 9000, "<" * 50_000):
        op.main_text(page)


def test_extract(spark):
    rows = [(1, "u", "<article>a</article>"), (1, "u", "<article>a</article>"), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'k' as Text")
    got = op.extract(df)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted((r.page_id or 0, r.text) for r in got.collect()) == [(0, ""), (1, "a"), (1, "a")]
    assert op.extract(df.where("false")).count() == 0
