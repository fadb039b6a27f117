"""Main text of pages against hand-made pages and the article element of generated ones."""

import html
import re
from collections import Counter

import pytest

from tests.llm.fixtures import FOLDER
from tracemill.llm import extract
from tracemill.llm.queries import op7_line_blocks

LONG = "This is a paragraph of the article that is long enough to stand out from all that is around it."


def article_of(page):
    """Blocks of the one article element of a generated page."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", b)) for b in re.split(r"</?(?:p|h1)>", inside)]
    texts = [" ".join(html.unescape(b).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_generated_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    found = op7_line_blocks(spark, FOLDER).collect()
    assert len(found) == len(pages)
    for row in found:
        assert row.text == article_of(pages[row.page_id].html)
        assert row.n_chars == len(row.text) and row.url == pages[row.page_id].url


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("   ", ""), ("<html><body></body></html>", ""),
    (f"<nav><a href='/'>Home</a></nav><main><p>{LONG}<p>Short.</main><footer>&copy; 2024</footer>", f"{LONG}\nShort."),
    (f"<article><header><h1>Title</h1></header><p>{LONG}</p><aside>Ad</aside><p>End</p><footer>By me</footer></article>", f"Title\n{LONG}\nEnd"),
    (f"<header><p>Site name and its long, long line of words</p></header><article><p>{LONG}</p></article>", LONG),
    (f"<div class='cookie-notice'>{LONG}</div><div id='content'><p>{LONG} x</p></div><div class='comments'><p>{LONG} y</p></div>", f"{LONG} x"),
    (f"<div><a href='/'>Home</a></div><div><a href='/a'>About us and all others</a></div><div></div><div></div><p>{LONG}</p><p>Last.</p>", f"{LONG}\nLast."),
    (f"<article><p>a &amp;amp; b&nbsp;&#x41;\n\t c<br>d</p><script>var t='</p>{LONG}';</script><style>p{{}}</style><!-- {LONG} --><p>e<b>f</b>g</p></article>", "a &amp; b A c d\nefg"),
    (f"<ARTICLE><P TITLE='a>b'>{LONG}</P><form><p>Search</p><form></form></form><p>&lt;p&gt;</p>", f"{LONG}\n<p>"),
    ("<p>Only this.</p>", "Only this."), ("plain text", "plain text"), ("<article>unclosed <b>x", "unclosed x"),
    (f"<article><p>{LONG}</p><div class='comments'><div><p>first</p></div><p>second</p></div></article>", LONG),
])
def test_hand_made_pages(page, text):
    assert extract.main_text(page) == text


@pytest.mark.parametrize(("page", "text"), [
    (f"<div class='site has-sidebar'><div><p>{LONG}</p></div><div class='sidebar'>Half as long as all of the article is</div></div>", LONG),
    (f"<div class='content-with-sidebar'><p>{LONG}</p></div><div class='no-comments'><p>{LONG}</p></div>", f"{LONG}\n{LONG}"),
    (f"<div id='post-social-policy'><p>{LONG}</p></div><div><p>Other.</p></div>", f"{LONG}\nOther."),
    (f"<div data-id='share'><p>{LONG}</p></div><p>{LONG} {LONG}</p>", f"{LONG}\n{LONG} {LONG}"),
    (f"<div class='post-and-comments'><article><p>{LONG}</p></article></div><p>Other.</p>", LONG),
    (f"<form id='aspnetForm'><div><p>{LONG}</p></div></form>", LONG),
    (f"<div><p class=ad>Buy this<p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n{LONG}"),
    (f"<div><p class=ad>Buy this</div><p>{LONG}</p>", LONG),
    (f"<ul><li class=share>Share<li>{LONG}</ul><p>End</p>", f"{LONG}\nEnd"),
    (f"<ul><li class=share>Share<ul><li>all</ul>that</ul><p>{LONG}</p>", LONG),
    (f"<head><meta charset=utf-8><body><p>{LONG}</p>", LONG),
])
def test_elements_whose_names_mislead(page, text):
    assert extract.main_text(page) == text


@pytest.mark.parametrize(("page", "text"), [
    (f"<div><p>{LONG}</p><p>{LONG} {LONG}</p></div><article class='teaser'><p>Read on here.</p></article>", f"{LONG}\n{LONG} {LONG}\nRead on here."),
    (f"<div><p>{LONG} {LONG}</p></div><nav></nav><nav></nav><nav></nav><article class='teaser'><p>Read on here.</p></article>", f"{LONG} {LONG}"),
    (f"<div class='related'><article><p>{LONG}</p></article></div><p>{LONG} {LONG} y</p>", f"{LONG}\n{LONG} {LONG} y"),
    (f"<p>Site name</p><article><p>{LONG}</p><p>Read <a href='/'>all about it here</a></p></article><p>{LONG[:50]}</p>", f"{LONG}\nRead all about it here"),
    (f"<article><p>{LONG}</p><nav></nav><nav></nav><nav></nav><p>3 min read</p><nav></nav><nav></nav><nav></nav><p>A short last word of it.</p></article>", f"{LONG}\nA short last word of it."),
    ("<article><a href='/'>Only a link</a></article>", "Only a link"),
])
def test_the_window_decides(page, text):
    """Article elements with little of the text do not blank the rest, and lines of theirs that no surge holds are left out."""
    assert extract.main_text(page) == text


def unmarked(page):
    """Without article elements and without names."""
    return re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", re.sub(r"(</?)article\b", r"\1div", page))


def boxes(page):
    """With a ``div`` for every element that holds others."""
    return re.sub(r"(</?)(nav|footer|header|aside|main|section)\b", r"\1div", unmarked(page))


def word_f1(text, other):
    a, b = Counter(text.split()), Counter(other.split())
    return 2 * (a & b).total() / max(1, a.total() + b.total())


@pytest.mark.parametrize(("change", "least"), [(unmarked, 0.98), (boxes, 0.96)])
def test_lengths_and_paragraphs_tell_the_article_of_pages_without_marks(spark, change, least):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    found = [word_f1(article_of(p), extract.main_text(change(p))) for p in pages]
    every_line = [word_f1(article_of(p), "\n".join(b.text for b in extract.lines(change(p)))) for p in pages]
    mean, without = sum(found) / len(pages), sum(every_line) / len(pages)
    assert mean > least and mean > without + 0.02


@pytest.mark.parametrize(("page", "text"), [
    (f"<div><p>{LONG}</p><ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a><li><a href=d>Four</a></ul><p>Short end.</p></div>", f"{LONG}\nShort end."),
    (f"<div>Buy this now</div><div><h1>Title</h1><p>{LONG}</p><p>End</p></div><div>&copy; 2024 us</div>", f"Title\n{LONG}\nEnd"),
    (f"<div>Intro {LONG} {LONG}</div><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>", f"Intro {LONG} {LONG}\n{LONG}\n{LONG}\n{LONG}"),
    (f"<div>First {LONG}<div>Then short</div><div>{LONG}</div><div>Last</div></div>", f"First {LONG}\nThen short\n{LONG}\nLast"),
    (f"<div><p>{LONG}</p></div><ul><li><a href=a>A</a><li><a href=b>B</a><li><a href=c>C</a></ul><div><p>Other box.</p></div>", LONG),
])
def test_ends_of_unmarked_articles(page, text):
    """Bare short lines at the ends go; short paragraphs in the article's own element stay, those in another do not."""
    assert extract.main_text(page) == text


def test_deep_pages_end():
    assert extract.main_text("<div><table>" + "<b>" * 50_000 + "</div>" * 50_000 + f"<p>{LONG}") == LONG


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", f"<p>{LONG}</p>"), (1, None, None), (2, "", "<p>" + "word " * 100_000)], "page_id long, url string, html string").selectExpr("*", "'clash' AS text", "1 AS n_chars")
    found = sorted((r.page_id or 0, r.n_chars) for r in extract.extract(pages).collect())
    assert found == [(0, len(LONG)), (1, 0), (1, 0), (2, 499_999)]
    assert extract.extract(pages.limit(0)).count() == 0
