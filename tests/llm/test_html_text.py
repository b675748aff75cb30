"""HTML extraction: the cut against all labellings, hand-made pages, and held-out pages."""

import html
import random
import re
from itertools import product

import pytest

from gneiss.llm.html_text import main_text, minimum_cut
from gneiss.llm.queries import QUERIES


def total(unary, edges, labels):
    return sum(0 if k == (u > 0) else abs(u) for u, k in zip(unary, labels, strict=True)) + sum(w for (a, b), w in edges.items() if labels[a] != labels[b])


def test_cut_is_minimal():
    r = random.Random(8)
    for _ in range(300):
        n = r.randint(1, 9)
        unary = [r.uniform(-3, 3) for _ in range(n)]
        edges = {(a, b): r.uniform(0, 2.5) for a in range(n) for b in range(a + 1, n) if r.random() < 0.5}
        best = min(total(unary, edges, c) for c in product([False, True], repeat=n))
        assert total(unary, edges, minimum_cut(unary, edges)) == pytest.approx(best)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><div>Site name</div><form action=/s><input name=q><button>Search</button></form></header>
<nav><ul><li><a href=/>Home</a></li><li><a href=/b>Blog &amp; more</a></li></ul></nav>
<div id="cookie-notice">We use cookies. <a href=x>Accept</a></div>
<main><article><h1>A  title</h1><p>First &lt;para&gt;\n\n with <b>bold</b>, <a href=1>a link</a> and<br>more words here.
<p>Second one, unclosed, with enough words to look like prose.</p><ul><li>Point one.</li><li>Point two.</li></ul>
<div class="ad">Buy now!</div><blockquote>Quoted words of some length.</blockquote></article>
<aside>Related: <a href=2>other</a></aside>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I liked this article very much, thank you for it.</p></div></section></main>
<footer>&copy; 2024 Us. All rights reserved.</footer><!-- end --></body></html>"""


def test_hand_made_page():
    assert main_text(PAGE) == "\n".join(["A title", "First <para> with bold, a link and more words here.", "Second one, unclosed, with enough words to look like prose.", "Point one.", "Point two.", "Quoted words of some length."])


@pytest.mark.parametrize("page", ["", "<", "<p", "<p>", "</p></p>", "plain", "<!-- open", "<a href='x", "<script>x", "&amp;" * 3, "<div " * 2000, "<p>x" * 3000, "<b>" * 3000 + "y", "\x00<p>퟿</p>"])
def test_odd_pages(page):
    assert isinstance(main_text(page), str)


def expected(page):
    m = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)
    parts = re.split(r"<(?:/?p|/?h1)>", re.sub(r"<[^>]*$", "", m[1])) if m else []
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", p))).split()) for p in parts]
    return "\n".join(filter(None, texts))


def test_pages(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op10_html_text"](spark, sf).collect()
    assert len(got) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in got)
    right = sum(r["text"] == expected(pages[r["page_id"]]) for r in got)
    assert right >= 0.98 * len(got)


def test_null_repeated_and_extra_columns(spark, tmp_path):
    from gneiss.llm.html_text import extract_pages

    rows = spark.createDataFrame([(1, "u", None, "x"), (1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, "", None)], "page_id long, url string, html string, text string")
    got = sorted(extract_pages(rows).collect(), key=str)
    assert [r["n_chars"] for r in got].count(0) == 2 and got[0]["text"] == main_text(PAGE) or got[1]["text"] == main_text(PAGE)
    assert extract_pages(rows.limit(0)).count() == 0
