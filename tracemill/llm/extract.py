"""Main text of HTML pages by the distribution of text over their lines.

Mark-up is stripped so that each block is a line; lines of menus, adverts and the like, which their
elements tell, stay as empty lines. Over the lengths of the lines a window slides and adds up. A
surge is where its sum rises from nothing, a dive where it falls back; the text between is kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracemill.llm.common import per_text

#: Lines in the window, the sum that a surge must reach, and how often a character counts where the article is marked.
WINDOW = 3
LEAST_SURGE = 80
ARTICLE_WEIGHT = 4
#: Length of a line outside paragraphs that may start or end a span of paragraphs: what stands bare weighs half.
LEAST_BARE = 2 * LEAST_SURGE

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|object|svg|math|canvas|select|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: The slash after an unquoted value belongs to it and does not close the element.
_UNQUOTED = re.compile(r"=\s*[^\s\"'=]*/\s*\Z")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output progress q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
SPACED = frozenset(("br", "wbr", "img"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold the article's text; a header does if it stands inside the article.
SURE = frozenset("nav footer aside button head".split())
#: Elements that do not hold it, unless most of the page's text is in them.
ASIDE = frozenset("form menu dialog".split())
ARTICLE = frozenset(("article", "main"))
#: Words in the names of other elements that are not the article's text.
ASIDE_WORDS = frozenset(
    "ad ads adv adbox adslot adsbygoogle advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar widget widgets "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead copyright toolbar "
    "comment comments commentlist respond reply replies disqus cookie cookies consent gdpr notice notices alert "
    "newsletter subscribe subscription signup login popup modal overlay related recommended recommendations share "
    "sharing social complementary contentinfo search skip".split()
)
HEADER_WORDS = frozenset(("header", "head"))
#: In a name, what stands after one of these tells how the page is laid out, as in ``has-sidebar``.
LAYOUT_WORDS = frozenset("has have with no not non without hide hides hidden disable disabled".split())
#: Elements that end an open paragraph before them, by starting.
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
#: Elements that an element of the same kind ends, up to the element that holds both.
_SIBLINGS = {
    tag: (frozenset(ends), frozenset(bounds))
    for tags, ends, bounds in (
        (("li",), ("li",), ("ul", "ol", "menu")), (("dt", "dd"), ("dt", "dd"), ("dl",)), (("option", "optgroup"), ("option",), ("datalist",)),
        (("td", "th"), ("td", "th"), ("tr", "table")), (("tr",), ("tr", "td", "th"), ("table",)),
        (("tbody", "tfoot", "thead"), ("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), (("a",), ("a",), ()),
    )
    for tag in tags
}
#: An end tag inside one of these does not end what stands around it.
_CLOSED = frozenset("table td th caption".split())
_IN_HEAD = frozenset("base basefont bgsound link meta head".split())
_P = frozenset("p")
#: Elements whose text is a paragraph, heading, item or cell; text that stands in another is bare.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption summary".split())
_LISTS = frozenset("ul ol menu".split()) | _CLOSED
#: Elements inside each other; a deeper one stands beside the last.
_DEPTH = 512


@dataclass(slots=True)
class Line:
    text: str
    plain: int  # characters outside links
    article: bool
    paragraph: bool = False
    box: int = 0  # the element that holds the paragraph


@dataclass(slots=True)
class _Aside:
    """An element whose tag or names say that it is not the article's, or the page itself."""

    outer: _Aside | None
    sure: bool
    articles: int  # open article elements around it
    plain: int = 0
    marked: int = 0  # plain characters in article elements inside it
    dropped: bool = False


@dataclass(slots=True)
class _Block:
    text: str
    plain: int
    articles: int
    aside: _Aside
    opens: bool  # stands for the start of its aside
    paragraph: bool = False
    box: int = 0


def _named(attributes: str) -> set[str]:
    """Words of an element's names, without those that tell how the page is laid out."""
    found = set()
    for names in _NAMES.findall(attributes):
        for name in "".join(names).split():
            for w in _WORDS.findall(name):
                w = w.lower()
                if w in LAYOUT_WORDS:
                    break
                found.add(w)
    return found


def _aside(tag: str, attributes: str, article: bool) -> bool:
    if tag in SURE or tag in ASIDE or (tag == "header" and not article):
        return True
    if not attributes or tag in ("html", "body") or tag in ARTICLE:
        return False
    words = _named(attributes)
    return bool(words & ASIDE_WORDS) or (not article and bool(words & HEADER_WORDS))


def _judge(blocks: list[_Block], asides: list[_Aside]) -> None:
    """Tells which asides are dropped: all but those with most of the page's plain text, or most of that in articles."""
    page = asides[0]
    for block in blocks:
        within, sure = [], False
        a = block.aside
        while a is not None:
            within.append(a)
            sure |= a.sure
            a = a.outer
        for a in within if block.plain and not sure else ():
            a.plain += block.plain
            a.marked += block.plain * (block.articles > a.articles)
    for a in asides[1:]:
        held = 2 * a.plain > page.plain or 2 * a.marked > page.marked
        a.dropped = a.outer.dropped or a.sure or not held


def lines(page: str) -> list[Line]:
    """Blocks of a page in order; those of menus and the like are empty."""
    blocks: list[_Block] = []
    held: list[str] = []
    linked: list[str] = []
    asides = [_Aside(None, False, 0)]
    now = asides[0]  # the innermost that is open
    stack: list[tuple[str, _Aside | None, int]] = []
    opened = 0  # elements so far
    count: Counter[str] = Counter()  # open elements by tag
    articles = 0
    at = 0

    def end_block() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        links = " ".join(html.unescape("".join(linked)).split())
        around = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] not in INLINE), -1)
        paragraph = around >= 0 and stack[around][0] in PARAGRAPHS
        held_by = around - paragraph
        blocks.append(_Block(text, len(text) - len(links), articles, now, False, paragraph, stack[held_by][2] if held_by >= 0 else 0))
        held.clear()
        linked.clear()

    def take(text: str) -> None:
        if text:
            held.append(text)
            if count["a"]:
                linked.append(text)

    def pop_to(depth: int) -> None:
        nonlocal now, articles
        while len(stack) > depth:
            tag, aside, _ = stack[-1]
            if aside is not None:
                end_block()
                now = aside.outer
            stack.pop()
            count[tag] -= 1
            articles -= tag in ARTICLE

    def depth_of(tags: frozenset[str], bounds: frozenset[str] | None) -> int:
        """Place of the innermost open element of ``tags``, or the depth if a bound (None: any block) comes first."""
        if any(count[t] > 0 for t in tags):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in tags:
                    return k
                if stack[k][0] in bounds if bounds is not None else stack[k][0] not in INLINE:
                    break
        return len(stack)

    for token in _TOKEN.finditer(page):
        take(page[at : token.start()])
        at = token.end()
        closing, tag, attributes = token.group(2), (token.group(3) or "").lower(), token.group(4) or ""
        if not tag:
            continue
        inline = tag in INLINE
        if not inline:
            end_block()
        elif tag in SPACED:
            take(" ")
        if closing:
            if inline:  # ends nothing but what is open in the same block
                k = depth_of(frozenset((tag,)), None)
            else:
                k = depth_of(frozenset((tag,)), _LISTS if tag == "li" else frozenset() if tag in _CLOSED else _CLOSED)
            pop_to(k)
            continue
        if count["head"] and stack[-1][0] == "head" and tag not in _IN_HEAD:
            pop_to(len(stack) - 1)
        if tag in _ENDS_P:
            pop_to(depth_of(_P, None))
        if tag in _SIBLINGS:
            pop_to(depth_of(*_SIBLINGS[tag]))
        if tag in VOID or (attributes.rstrip().endswith("/") and not _UNQUOTED.search(attributes)):
            continue
        if len(stack) >= _DEPTH:
            pop_to(len(stack) - 1)
        aside = None
        if _aside(tag, attributes, articles > 0):
            end_block()
            aside = now = _Aside(now, tag in SURE, articles)
            asides.append(aside)
            blocks.append(_Block("", 0, articles, aside, True))
        opened += 1
        stack.append((tag, aside, opened))
        count[tag] += 1
        articles += tag in ARTICLE
    take(page[at:])
    end_block()
    _judge(blocks, asides)
    found: list[Line] = []
    for b in blocks:
        if b.opens:
            if b.aside.dropped and not b.aside.outer.dropped:
                found.append(Line("", 0, b.articles > 0))
        elif not b.aside.dropped and (b.text or (found and found[-1].text)):
            found.append(Line(b.text, b.plain, b.articles > 0, b.paragraph, b.box))
    return found


def _spans(lengths: list[int]) -> list[tuple[int, int, int]]:
    """Runs of windows that hold text, as first and last line with text and the largest sum."""
    sums = [sum(lengths[i : i + WINDOW]) for i in range(len(lengths))]
    spans: list[tuple[int, int, int]] = []
    i = 0
    while i < len(sums):
        if not sums[i]:
            i += 1
            continue
        j = i
        while j < len(sums) and sums[j]:
            j += 1
        text = [k for k in range(i, min(j + WINDOW, len(lengths))) if lengths[k]]
        if text:
            spans.append((text[0], text[-1], max(sums[i:j])))
        i = j
    return spans


def _at_paragraphs(blocks: list[Line], lengths: list[int], first: int, last: int) -> tuple[int, int]:
    """A span between its paragraphs: short bare lines at its ends, as of adverts and small print, are cut off."""
    text = [k for k in range(first, last + 1) if lengths[k]]
    if 2 * sum(lengths[k] for k in text if blocks[k].paragraph) < sum(lengths[k] for k in text):
        return first, last
    stay = [k for k in text if blocks[k].paragraph or lengths[k] >= LEAST_BARE]
    return stay[0], stay[-1]


def main_text(page: str | None) -> str:
    """The article of a page, one line per block; empty if there is none.

    A line that is mostly links counts as empty. Only text whose window reaches ``LEAST_SURGE``
    somewhere is kept, or, if none does, the longest. If article elements hold at least half of the
    text outside links, all other lines are empty, and their own count by ``ARTICLE_WEIGHT``, links included.

    Where no article is marked, a span with most of its text in paragraphs starts and ends with one, or with a long
    line, and paragraphs that stand in the same element as one of it are kept too, however short.
    """
    blocks = lines(page or "")
    inside = sum(b.plain for b in blocks if b.article)
    marked = any(b.article and b.text for b in blocks) and 2 * inside >= sum(b.plain for b in blocks)
    if marked:
        lengths = [ARTICLE_WEIGHT * len(b.text) if b.article else 0 for b in blocks]
    else:
        lengths = [len(b.text) if 2 * b.plain > len(b.text) else 0 for b in blocks]
    spans = _spans(lengths)
    if not spans:
        return ""
    surging = [s for s in spans if s[2] >= LEAST_SURGE]
    kept = [(first, last) for first, last, _ in surging or [max(spans, key=lambda s: s[2])]]
    if marked:
        return "\n".join(b.text for first, last in kept for b in blocks[first : last + 1] if b.text and b.article)
    kept = [_at_paragraphs(blocks, lengths, *span) for span in kept]
    within = {k for first, last in kept for k in range(first, last + 1) if blocks[k].text}
    boxes = {blocks[k].box for k in within if blocks[k].paragraph and lengths[k]}
    within |= {k for k, b in enumerate(blocks) if lengths[k] and b.paragraph and b.box in boxes}
    return "\n".join(blocks[k].text for k in sorted(within))


_KIND = pa.struct([("text", pa.string()), ("n_chars", pa.int64())])


def extracted(page: Column) -> Column:
    """Struct ``text, n_chars`` of a column of HTML."""
    body = per_text(lambda pages: [(t, len(t)) for t in map(main_text, pages)], _KIND)
    return F.arrow_udf(body, "text string, n_chars long")(page)


def extract(pages: DataFrame) -> DataFrame:
    """Per page ``page_id, url, text, n_chars``; null and empty pages have an empty text.

    Rows that repeat are extracted each, other columns are not read, nothing is shuffled.
    """
    return pages.select("page_id", "url", extracted(F.col("html")).alias("e")).select("page_id", "url", "e.*")
