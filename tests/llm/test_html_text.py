import html
import re

import pytest

from exposurelab.llm import html_text
from exposurelab.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
FIRST = "The first paragraph of the article has a good number of words in it, so that it stands out."
SECOND = "A second one follows after that, with yet more words to read and a link in the middle."


def test_query_against_the_article_element(spark):
    """On the generated pages the article element holds nothing but the article."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op7_line_blocks"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S).group(1)
        blocks = [re.sub(r"<[^>]*>", "", b.replace("<br>", " ")) for b in re.split(r"</?(?:p|h1)>", article)]
        blocks = [" ".join(html.unescape(b).split()) for b in blocks]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain words only", "plain words only"),
        ("<nav><a href=x>Home</a></nav>", ""),
        (f"<body><div class=menu><a>One</a><a>Two</a></div><p>{FIRST}</p><p>{SECOND}</p><footer>Imprint</footer>", f"{FIRST}\n\n{SECOND}"),
        ("<article><header><h1>Title</h1></header><p>Short.</p></article>", "Title\n\nShort."),
        ("<header>Site name</header><main><p>a &lt; b &amp;amp; c&nbsp;d<br>e</main>", "a < b &amp; c d e"),
        ("<article><p>One<p>Two <b>bold</b>\n\n text<ul><li>x<li>y</ul></article>", "One\n\nTwo bold text\n\nx\n\ny"),
        ("<article><p>In.</p><aside>Not</aside><div class='ad-box'>Buy</div><p>Out.</p></article>", "In.\n\nOut."),
        ("<article><p>Text.</p><section id='comments'><p>First!</p></section></article><div class=comment>Me too</div>", "Text."),
        ("<article><p>Text.</p><form><label>Mail</label><input name=m><p>Join</p></form></article>", "Text."),
        ("<article><script>var a='</article><p>no</p>';</script><style>p{}</style><p>Yes</p><!-- <p>no</p> --></article>", "Yes"),
        ("<article><p>Loose <p title='a > b'>ends</article", "Loose\n\nends"),
        ("<div role=banner>Logo</div><article><h2>H</h2>loose text</article>", "H\n\nloose text"),
        ("<article><p>caf&eacute; &#8364;&#x1F600; &notanentity;</p></article>", "café €\U0001f600 ¬anentity;"),
        ("<head><title>T</title><body><article>x</article>", "x"),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page) == text


def test_surge_and_dive():
    lengths = [5, 0, 0, 0, 120, 40, 0, 60, 0, 0, 0, 9, 0, 0, 0]
    assert html_text.stretches(lengths, 3, 80) == [(4, 8)]
    assert html_text.stretches([0, 0], 3, 0) == []


def test_long_and_broken_pages():
    page = "<article>" + "<p>word word" * 50_000
    assert html_text.main_text(page).count("\n\n") == 49_999
    assert html_text.main_text("<div>" * 3000 + "deep text") == "deep text"
    html_text.main_text("<" * 20_000 + "a" + '<a b="' * 2_000)


def test_odd_pages(spark):
    rows = [(None, None, None, "t"), (1, "u", "<p>Hello there", "t"), (1, "u", "<p>Hello there", "t"), (2, "", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html_text.extract(pages).collect()
    assert sorted(r["text"] for r in found) == ["", "", "Hello there", "Hello there"]
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>One <svg class='i'/> two</p><p>Three</p></article>", "One two\n\nThree"),
        ("<article><p>One <svg/> two <svg><title>x</title></svg></p><p>Three</p></article>", "One two\n\nThree"),
        ("<article><button-bar>One</button-bar><title-card>two</title-card><select-box>three</select-box></article>", "Onetwothree"),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold</p></article>", "Let x=1 hold"),
        ("<article><p>One <button>go</button> two <canvas> three</p><p>Four</p></article>", "One two three\n\nFour"),
        ("<article><p>One</p><script>var a = '<p>no</p>'", "One"),
    ],
)
def test_dropped_elements(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div class=story><p>{FIRST}</p><p>{SECOND}</p></div><article><a href=x>Teaser</a></article>", f"{FIRST}\n\n{SECOND}"),
        *[(f"<nav>Menu</nav><div class='{c}'><p>{FIRST}</p><p>{SECOND}</p></div>", f"{FIRST}\n\n{SECOND}")
          for c in ("content has-sidebar", "no-sidebar", "with-menu", "search-result", "search")],
        *[(f"<{t}><nav>Menu</nav><article><p>{FIRST}</p></article></{t}>", FIRST) for t in ("form", "fieldset", "div class=widget")],
        (f"<main><form><div class=widget><article><p>{FIRST}</p></article></div></form></main>", FIRST),
        (f"<main><article><p>{FIRST}</p></article><div class=related><article>Teaser</article></div></main>", FIRST),
        (f"<article><p>{FIRST}</p></article><div class=comment-list><p>{SECOND}</p><p>{SECOND}</p></div>", FIRST),
        (f"<article><p>{FIRST}</p></article><div class=related><article>{SECOND}</article></div>", FIRST),
    ],
)
def test_whole_articles_are_kept(page, text):
    assert html_text.main_text(page) == text


def test_surge_and_dive_decide_inside_an_article():
    links = "<div><p><a href=x>Some other story to read</a></p></div>" * 4
    page = f"<article><section><p>{FIRST}</p><p>{SECOND}</p></section>{links}<div><p>Thanks!</p></div></article>"
    assert html_text.main_text(page) == f"{FIRST}\n\n{SECOND}"
    gap = "<aside>No text of the page</aside>" * 3
    page = f"<div><p>{FIRST}</p><p>{SECOND}</p>{gap}<p>A closing line.</p></div><div><p>Imprint</p></div>"
    assert html_text.main_text(page).startswith(f"{FIRST}\n\n{SECOND}\n\nA closing line.")


LONG_AD = "<p>Buy this now, it is cheap and good and you will like it.</p>" * 6


@pytest.mark.parametrize(
    "page, text",
    [
        *[(f"<div class='{c}'>{LONG_AD}</div><article><p>Short news.</p></article>", "Short news.")
          for c in ("ad", "banner", "sidebar", "widget", "newsletter", "related", "promo-box", "cookie")],
        (f"<article><h1>Title</h1><p>Short.</p></article><div class=ad>{LONG_AD}</div>", "Title\n\nShort."),
        (f"<div class=banner>{LONG_AD}</div><main><p>Short news.</p></main><form>{LONG_AD}</form>", "Short news."),
        (f"<form><div class=ad>{LONG_AD}</div><article><p>Short news.</p></article></form>", "Short news."),
        (f"<div class=ad>{LONG_AD}</div><p>{FIRST}</p><p>{SECOND}</p>", f"{FIRST}\n\n{SECOND}"),
        (f"<div class=widget><p>{FIRST}</p><p>{SECOND}</p></div><footer>Imprint</footer>", f"{FIRST}\n\n{SECOND}"),
    ],
)
def test_short_articles_beside_long_adverts(page, text):
    assert html_text.main_text(page) == text


def test_windows_decide_without_article_elements():
    """Scattered short lines before and after the text neither surge nor join it."""
    teasers = "".join(f"<div><span>Teaser {i}</span></div><nav>x</nav><nav>x</nav><nav>x</nav>" for i in range(5))
    page = f"<body>{teasers}<div><h2>Head</h2><p>{FIRST}</p><p>{SECOND}</p></div><nav>a</nav><nav>b</nav><nav>c</nav>{teasers}</body>"
    assert html_text.main_text(page) == f"Head\n\n{FIRST}\n\n{SECOND}"
    # A short line of the same container joins over a gap, one in a container of its own does not.
    page = f"<div><p>{FIRST}</p><nav>a</nav><nav>b</nav><nav>c</nav><p>The end.</p></div><nav>a</nav><nav>b</nav><nav>c</nav><div>Tags</div>"
    assert html_text.main_text(page) == f"{FIRST}\n\nThe end."
