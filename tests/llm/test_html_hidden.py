"""Elements that hide their own content only."""

from __future__ import annotations

import time

import pytest

from assaylane.llm.html import FEATURES, blocks, fit_tree, main_text


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ('<p>one <svg viewBox="0 0 1 1" /> two</p><p>three</p>', ["one two", "three"]),
        ("<form><button>Send</form><article><p>the story</p></article>", ["the story"]),
        ("<body><button>Menu<article><p>the story</p><button>More</button></article>", ["the story"]),
        ("<div><select><option>a<option>b</div><p>after</p>", ["after"]),
        ("<video-js>caption of it</video-js><p>after</p><audio-player></audio-player><p>end</p>", ["caption of it", "after", "end"]),
        ("<p>x <button><div>go</div><b>on</b></button> y</p>", ["x y"]),
        ("<p>x <object><video>no</video> shown</object> y <math><mi>x</mi><mo>=</mo><mn>3</mn></math></p>", ["x shown y x=3"]),
        ("<p>x <svg><text>drawn</text></svg> y <canvas>fallback</canvas></p>", ["x y"]),
        ("<p>a</p><canvas>no end", ["a"]),
        ("<p>a</p><script>var b='<p>c</p>'", ["a"]),
    ],
)
def test_only_what_is_inside_is_hidden(html, expected):
    assert [b["text"] for b in blocks(html)] == expected


PAGE = """<body><div id="top"><a href=/>Home</a> <a href=/n>News</a></div>%s
<p>The first long paragraph of the story says what happened, to whom, and when it came to pass in the town.</p>
<p>Indeed.</p><p>The second long paragraph goes on with what was said about it by those who had seen it all.</p></%s>
<div class="post-comments"><p>A reader says that all of this was quite different, and that nobody asked.</p></div>
<div class="site-footer">All rights reserved by someone.</div></body>"""


@pytest.mark.parametrize(
    "opening",
    ['<main class="content no-sidebar">', '<div id="article-body" class="post ad-free">', '<article class="post comments-open tag-search">', '<div class="page sidebar-left"><main>', "<section>", '<div class="story">'],
)
def test_names_that_say_nothing_against_the_main_text(spark, opening):
    html = PAGE % (opening, opening.rsplit("<", 1)[1].split()[0].strip(">"))
    found = main_text(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).first().text
    assert found == "\n".join(
        (
            "The first long paragraph of the story says what happened, to whom, and when it came to pass in the town.",
            "Indeed.",
            "The second long paragraph goes on with what was said about it by those who had seen it all.",
        )
    )


@pytest.mark.parametrize("part", ["<a", "<a '", '<a "', "<!", "<script ", "<b></i>", "<svg><p>", "<i><div><b></i>", "<button>", "<table><tr><td>"])
def test_time_grows_with_the_page(part):
    began = time.perf_counter()
    blocks(part * (300_000 // len(part)))
    assert time.perf_counter() - began < 15


def test_neighbours_matter(spark):
    importance = dict(zip(FEATURES, fit_tree(spark).featureImportances.toArray(), strict=True))
    assert sum(importance[n] for n in ("words_before", "words_after", "links_before", "links_after")) > 0.03
