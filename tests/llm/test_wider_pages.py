"""Pages as common site builders write them: names around the article, and names replaced at random."""

import random
import re
import time
from collections import Counter

import pytest

from gneiss.llm.html_text import blocks_of, main_text, minimum_cut

PROSE = [f"This is paragraph number {i} of a long and ordinary article, which speaks about rivers, hills and roads. It has more than one sentence, as prose does." for i in range(3)]
ARTICLE = "".join(f"<p>{x}</p>" for x in PROSE)
NAV = "<nav class='menu'><a href=/a>Home</a> <a href=/b>News</a></nav>"
SIDE = "<div class='sidebar'><h3>Related</h3><ul><li><a href=x>Other story</a></li><li><a href=y>Yet another</a></li></ul></div>"
COMMENT = "<p>Great post, I liked it a lot. Thank you for writing it, really.</p>"
FOOTER = "<footer>© 2024 Site. All rights reserved.</footer>"
AROUND = [
    "<article class='post type-post category-social-media'>{}</article>",
    "<article class='post comments-open'>{}</article>",
    "<div class='content sidebar-right'>{}</div>",
    "<div class='layout-sidebar-right'><article>{}</article></div>",
    "<div class='modal-open'><article>{}</article></div>",
    "<main id='legal-news'>{}</main>",
    "<article id='search-engines-explained'>{}</article>",
    "<form id='aspnetForm'><div id='main'>{}</div></form>",
    "<div class='page-with-popup'><div class='cookie-news'>{}</div></div>",
    "<div id='searchResultsApp'>{}</div>",
]


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("comments", ["<div class='comments'>{}</div>", "<section id='commentList'><article class='comment'>{}</article></section>", "<div class='post-comments'><div class='comment-body'>{}</div></div>"])
def test_names_around_the_article(around, comments):
    for page in (around.format(ARTICLE), f"<html><body class='sidebar ad'>{NAV}{around.format(ARTICLE)}{SIDE}{comments.format(COMMENT)}{FOOTER}</body></html>"):
        assert main_text(page).split("\n") == PROSE


@pytest.mark.parametrize("name", ["comments", "comment-list", "commentlist", "post-comments", "commentsArea"])
def test_comments_longer_than_the_article(name):
    page = f"<main><article>{ARTICLE}</article><div class='{name}'>{COMMENT * 40}</div></main>"
    assert main_text(page).split("\n") == PROSE
    assert main_text(page.replace("article>", "div>")).split("\n") == PROSE


@pytest.mark.parametrize("furniture", ["<aside>{}</aside>", "<div class='ad'>{}</div>", "<div class='siteFooter'>{}</div>", "<div class='cookie-notice'>{}</div>", "<div class='newsletter-box'>{}</div>", "<form>{}</form>", "<div class='advert-top'>{}</div>", "<div hidden>{}</div>"])
def test_furniture_in_prose_goes(furniture):
    words = furniture.format("<p>These are whole sentences of another kind, which somebody wrote. They say nothing of rivers.</p>")
    assert main_text(f"<article>{ARTICLE}</article>{words}").split("\n") == PROSE
    assert main_text(f"<div>{words}{ARTICLE}{ARTICLE}</div>").split("\n") == PROSE + PROSE


def test_header_inside_an_article():
    assert main_text(f"<header><p>Site of things</p></header><article><header class='entry-header'><h1>The title of it all</h1></header>{ARTICLE}</article>").split("\n") == ["The title of it all", *PROSE]


def test_blocks_of_pages_with_names_at_random(spark, sf):
    """Articles of the table's pages in containers without telling names: nearly every block is labelled as before."""
    rng = random.Random(7)
    hits = kept = wanted = 0
    for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect():
        found = re.search(r"<article>(.*?)</article>", r["html"], re.S)
        if not found:
            continue
        name = "".join(rng.choices("abcdefghij", k=8))
        page = re.sub(r"<(/?)article>", lambda m, n=name: "</div>" if m[1] else f"<div class='{n}'>", r["html"])
        want, got = [b.text for b in blocks_of(found[0])], main_text(page).split("\n")
        wanted, kept = wanted + len(want), kept + len(got)
        hits += (Counter(want) & Counter(got)).total()
    assert wanted > 400
    assert hits >= 0.95 * wanted and hits >= 0.95 * kept


def test_cut_of_long_pages():
    n = 40_000
    value = [0.4 if i % 2 else -0.35 for i in range(n)]
    edges = {(i, i + 1): 0.5 + 0.001 * (i % 7) for i in range(n - 1)} | {(i, i + 2): 0.2 for i in range(n - 2)}
    began = time.monotonic()
    assert len(minimum_cut(value, edges)) == n
    page = "<article>" + "".join(f"<p>Short text {i}.</p><div class='x-widget-y'><p><a href=x>Click</a> and see</p></div>" for i in range(n // 2)) + "</article>"
    assert len(blocks_of(page)) == n and main_text(page)
    assert time.monotonic() - began < 30
