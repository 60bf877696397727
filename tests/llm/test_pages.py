"""Places, names and broken markup of pages."""

import time

import pytest

from tidepanel.llm import html_text

SENTENCE = "The estuary fills twice a day and the marsh behind it drains slowly through narrow creeks that shift after each storm."
ARTICLE = " ".join([SENTENCE] * 6)
PAGES = {
    "layout": f'<div class="has-sidebar"><article><p>{ARTICLE}</p></article></div>',
    "page": f'<div id="page" class="no-sidebar"><article><p>{ARTICLE}</p></article></div>',
    "post": f'<article class="post comments-open"><p>{ARTICLE}</p></article>',
    "content": f'<div class="content with-sidebar"><p>{ARTICLE}</p></div>',
    "section": f'<article><section id="legal-history"><p>{ARTICLE}</p></section></article>',
    "heading": f'<article><h2 id="how-to-search">How to search</h2><p>{ARTICLE}</p></article>',
    "hint": f'<div class="search-engines-explained"><p>{ARTICLE}</p><p>{ARTICLE}</p></div>',
    "form": f'<form id="aspnetForm"><nav><a href="/">Home</a></nav><main><p>{ARTICLE}</p></main></form>',
    "header": f'<article><header class="entry-header"><h1>Tides</h1></header><p>{ARTICLE}</p></article>',
}
FURNITURE = (
    '<nav class="main-nav"><ul><li><a href="/">Home</a></li><li><a href="/b">News</a></li></ul></nav>',
    f'<div class="site-footer"><p>{SENTENCE}</p></div>',
    f'<div class="related-posts"><article><p>{SENTENCE}</p></article></div>',
    f'<div class="cookie-banner"><p>{SENTENCE}</p></div>',
    f'<section id="comments"><article class="comment-body"><p>{ARTICLE}</p></article></section>',
    '<div class="search-history"><a href="/q">one</a> <a href="/r">two</a></div>',
)


def test_articles_are_kept_whole(spark):
    titles = {"heading": "How to search ", "header": "Tides "}
    rows = [(k, name, f"<html><body>{FURNITURE[0]}{page}{''.join(FURNITURE[1:])}</body></html>") for k, (name, page) in enumerate(PAGES.items())]
    got = {r["url"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    for name in PAGES:
        assert got[name] == titles.get(name, "") + (f"{ARTICLE} {ARTICLE}" if name == "hint" else ARTICLE), name


def test_furniture_alone_is_dropped(spark):
    rows = [(None, None, f"<body>{page}</body>") for page in FURNITURE]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    assert [(r["text"], r["n_chars"]) for r in got] == [("", 0)] * len(FURNITURE)


@pytest.mark.parametrize("token, said", [("site-footer", "outside"), ("mainNav", "outside"), ("has-sidebar", None), ("comments-open", "hinted"), ("legal-history", "hinted"), ("entry-content", "inside"), ("article-header", None), ("hero", None)])
def test_names_speak_as_a_whole(token, said):
    assert html_text.says(token)[0] == said


@pytest.mark.parametrize("unit", ['<a title="x>', "<svg>", "<p class='", "<!--", "<", "</svg", "<script>", "<div>", "</b></x>", "<a b=\"'>", "&#1", "<p>word"])
def test_broken_pages_take_time_by_length(unit):
    page = unit * (1_000_000 // len(unit))
    start = time.time()
    list(html_text.blocks(page + "<div>" * 1000 + "</u>" * 1000))
    assert time.time() - start < 20


def test_a_quote_without_its_end_is_a_sign():
    assert [b[0] for b in html_text.blocks('<p title="x>One</p><p>Two')] == ["One", "Two"]
    assert [b[0] for b in html_text.blocks("<p title='a > b'>One</p><3 Two")] == ["One", "<3 Two"]
