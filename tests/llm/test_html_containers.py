"""Pages that the labelled ones don't hold: menus beside long paragraphs, and articles in containers with misleading names."""

from __future__ import annotations

import pytest

from assaylane.llm import html

LONG = " ".join(["The council met on Tuesday to hear what the engineers had found beneath the old bridge."] * 4)
MORE = " ".join(["Nobody had looked at the piers for thirty years, one of them said, and it showed."] * 3)
ARTICLE = f"<h1>Under the old bridge</h1><p>{LONG}</p><p>{MORE}</p>"
WANTED = f"Under the old bridge\n{LONG}\n{MORE}"
MENU = '<div class="menu"><a href=/>Home</a> <a href=/n>News</a></div>'

PAGES = {
    # what must not come in
    f"<nav><a>Home</a> <a>News</a></nav><article><p>{LONG}</p></article>": LONG,
    f'<div class="share"><a>Tweet</a> <a>Post</a></div><p>{LONG}</p><p>{MORE}</p>': f"{LONG}\n{MORE}",
    f'<article>{ARTICLE}</article><div class="comments"><p><a>Anna Reader</a></p><p>{MORE}</p><p><a>Ben Writer</a></p><p>{LONG}</p></div>': WANTED,
    f'<article>{ARTICLE}</article><aside class="related"><a>Another bridge entirely</a> <a>The last ferry</a></aside>': WANTED,
    # what must not be lost
    f'<form id="aspnetForm">{MENU}<div>{ARTICLE}</div></form>': WANTED,
    f'<div id="content-sidebar-wrap">{MENU}{ARTICLE}</div>': WANTED,
    f'<div class="layout right-sidebar">{MENU}<div>{ARTICLE}</div><div class="sidebar"><p>Write to us</p></div></div>': WANTED,
    f'<section class="news-social">{ARTICLE}</section>{MENU}': WANTED,
    f'<article class="reply-to-critics">{ARTICLE}</article><div class="comments"><p>{MORE}</p></div>': WANTED,
    f'<div id="page-with-nav-bar">{MENU}{ARTICLE}</div>': WANTED,
}


@pytest.fixture(scope="module")
def model(spark):
    return html.fit_tree(spark)


@pytest.mark.parametrize("page", PAGES)
def test_pages(spark, model, page):
    assert html.main_text(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"), model).first().text == PAGES[page]


def test_held_out_pages(spark):
    accuracy = html.held_out_accuracy(spark)
    print("share of held-out blocks judged right:", accuracy)
    assert len(html.PAGES) >= 30 and accuracy > 0.93


def test_shares_of_named_elements():
    page = f"<form><nav><a>a</a> <a>b</a></nav><div class=comments><p>{MORE}</p></div><article><p>{LONG}</p></article></form>"
    menu, comment, article = html.blocks(page)
    assert menu["apart"] == 1.0 and comment["apart"] == 1.0 and article["apart"] == 0.0 and menu["scope_links"] == 1.0


def test_many_nested_elements_take_linear_time():
    assert len(html.blocks("<form><nav>" * 20_000 + "text" + "<p class=ad>word" * 20_000)) == 20_001
