"""Main text of web pages.

The standard library's parser streams its events into lines, one for each block of the page, with the text and the number of tags in
it. The text-to-tag ratios (text in links does not count) are smoothed with a Gaussian, and lines whose smoothed ratio reaches a threshold, a share of the ratios' standard deviation,
form the content cluster. The region is the smallest element that holds nearly all of the cluster's text; it is taken as a whole, short lines and lines of links included, so that
nothing of an article is lost.

Tags, roles and class words only vote. Elements that speak of menus, forms, adverts, comments and the like are left out before the clustering, unless they hold
the article or most of the page (a form or a wrapper around everything); words that an article's own sections use too count only where no line of the cluster stands.
An element that marks itself as the article is not looked into for a smaller region. Without such an element the region's edges
lose lines of links, and a region that is the page's body itself reaches from the first to the last line of the cluster, with the headings and paragraphs beside it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
HARD = frozenset("head script style noscript template svg math iframe object button select textarea canvas audio video".split())
SOFT = frozenset("nav footer aside form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words of a class or id that mark what is not the article; those of READERS mark what readers say; sections of articles use those of DOUBTFUL as well.
READERS = frozenset("comment comments reply replies disqus respond".split())
STRONG = READERS | frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar widget footer masthead sharing social newsletter subscribe pagination pager toolbar".split())
DOUBTFUL = frozenset("aside side notice notices notification alert discussion share related recommended subscription signup login search copyright legal promotion".split())
STATES = frozenset("with has no without have is".split())  # before a word, they speak of the page and not of the element
PARTS = frozenset("area bar block box container form item items inner links list panel popup section slot thread unit wrap wrapper".split())  # after a word, they name a part of it
PRE_MARKED, OUTER = frozenset(("article", "main")), frozenset(("page", "html", "body", "form"))
SIGMA, SHARE, LINKS, HOLDS, MOST = 1.0, 0.5, 0.6, 0.9, 0.5


def mark(value: str) -> int:
    """What a class or id says: 0 nothing, 1 doubtful, 2 not the article, 3 readers. Words count whole; of words with hyphens the last, or the first before a part's name."""
    out = 0
    for token in re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", value).lower().split():
        parts = re.split("[-_]+", token)
        words = {token} if parts[0] in STATES else {token, parts[-1]}
        if parts[-1] in PARTS:
            words.add(parts[0])
        out = max(out, 3 if words & READERS else 2 if words & STRONG else 1 if words & DOUBTFUL else 0)
    return out


class Element:
    __slots__ = ("article", "h1", "held", "parent", "size", "tag", "vote")

    def __init__(self, tag: str, parent: int, vote: int, article: bool) -> None:
        self.tag, self.parent, self.vote, self.article = tag, parent, vote, article
        self.size, self.held, self.h1 = 0, False, tag == "h1"


class Line:
    __slots__ = ("element", "linked", "parts", "tags", "text")

    def __init__(self, element: int) -> None:
        self.parts: list[str] = []
        self.tags, self.linked, self.element, self.text = 1, 0, element, ""


class Lines(HTMLParser):
    """Collects the lines and the elements of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements = [Element("page", -1, 0, False)]
        self.lines: list[Line] = []
        self.open: list[tuple[str, int, bool]] = []  # tag, element, never shown
        self.hard = 0
        self.line = Line(0)
        self.link: tuple[int, Line] | None = None  # elements open at the <a>, and its line
        self.later: list[tuple[Line, int]] = []  # text in later lines, which is linked only if the </a> comes

    def _new(self) -> None:
        if self.line.parts:
            self.lines.append(self.line)
        self.line = Line(self.open[-1][1] if self.open else 0)

    def _close(self, i: int) -> None:
        self.hard -= sum(hard for _, _, hard in self.open[i:])
        if self.link and self.link[0] > i:
            self._unlink(False)  # the element that opened the <a> closes
        del self.open[i:]

    def _unlink(self, closed: bool) -> None:
        for line, n in self.later if closed else ():
            line.linked += n
        self.link, self.later = None, []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.line.tags += 1
            if tag in ("br", "hr"):
                self.line.parts.append(" ")
            return
        values = {k: v or "" for k, v in attrs}
        hard = tag in HARD or "hidden" in values or values.get("aria-hidden") == "true"
        role, named = values.get("role", "").lower(), f"{values.get('class', '')} {values.get('id', '')}"
        vote = 0 if tag in ("html", "body") or named == " " else mark(named)
        if tag in SOFT or role in ROLES:
            vote = max(vote, 2)
        inside = self.elements[self.open[-1][1]] if self.open else None
        if tag == "header" and not self._in_article():
            vote = max(vote, 2)
        if tag in INLINE and not hard and vote < 2:
            self.line.tags += 1
            if tag == "a":
                self._unlink(False)
                self.link = (len(self.open), self.line) if "href" in values else None
            return
        if tag not in INLINE and inside and (inside.tag == "p" or inside.tag == tag and tag in ("li", "option", "tr", "td", "th", "dt", "dd")) and self.open[-1][0] == inside.tag:
            self._close(len(self.open) - 1)  # their end tags may be left out
        article = (tag in PRE_MARKED or role == "main") and vote < 2
        self.elements.append(Element(tag, self.open[-1][1] if self.open else 0, vote, article))
        self.open.append((tag, len(self.elements) - 1, hard))
        self.hard += hard
        self._new()

    def _in_article(self) -> bool:
        return any(self.elements[e].article for _, e, _ in self.open)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._close(i)
                self._new()
                return
        if tag == "a":
            self._unlink(True)

    def handle_data(self, data: str) -> None:
        if self.hard:
            return
        self.line.parts.append(data)
        if self.link and self.link[1] is self.line:
            self.line.linked += len(data)
        elif self.link:
            self.later.append((self.line, len(data)))

    def unknown_decl(self, data: str) -> None:
        """Conditional sections and the like have no text."""


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian weights over the neighbours within three sigma; at the ends the weights that are left are scaled up."""
    reach = math.ceil(3 * sigma)
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        span = range(max(0, i - reach), min(len(values), i + reach + 1))
        total = sum(weights[j - i + reach] for j in span)
        out.append(sum(values[j] * weights[j - i + reach] for j in span) / total)
    return out


def inside(elements: list[Element], chosen: set[int]) -> list[bool]:
    """Which elements are among the chosen ones or within one of them."""
    out: list[bool] = []
    for i, e in enumerate(elements):
        out.append(i in chosen or e.parent >= 0 and out[e.parent])
    return out


def weigh(elements: list[Element], sizes: list[tuple[int, int]]) -> None:
    """Set each element's size, the sum of these (element, characters) in it."""
    for e in elements:
        e.size = 0
    for i, n in sizes:
        elements[i].size += n
    for e in reversed(elements[1:]):
        elements[e.parent].size += e.size


def outvoted(elements: list[Element], lines: list[Line]) -> list[bool]:
    """Elements that are left out: votes stand, unless the element holds the article, or most of a page whose article is nowhere else."""
    weigh(elements, [(x.element, len(x.text)) for x in lines])
    for e in reversed(elements[1:]):
        up = elements[e.parent]
        up.held |= e.held or e.article and e.size > 0
        up.h1 |= e.h1
    marked, total = any(e.article and e.size for e in elements), elements[0].size
    chosen = set()
    for i, e in enumerate(elements):
        holds = e.h1 or e.held and e.vote < 3 or not marked and e.size > total * (HOLDS if e.vote == 3 else MOST)
        if e.vote >= 2 and not holds:
            chosen.add(i)
    return inside(elements, chosen)


def main_text(html: str | None) -> str:
    """The page's main text; empty for null and for pages without content."""
    if not html:
        return ""
    page = Lines()
    page.feed(re.sub(r"<!\[(?!CDATA\[)[^>]*>", "", html) if "<![" in html else html)
    if re.match(r"<[!/?a-zA-Z]", page.rawdata):  # a tag or comment that the page's end cuts off is no text
        page.rawdata = ""
    page.close()
    page._new()
    elements = page.elements
    for x in page.lines:
        x.text = " ".join("".join(x.parts).split())
    lines = [x for x in page.lines if x.text]
    out = outvoted(elements, lines)
    lines = [x for x in lines if not out[x.element]]
    ratios = smoothed([max(0, len(x.text) - x.linked) / x.tags for x in lines])
    if not ratios:
        return ""
    mean = sum(ratios) / len(ratios)
    threshold = min(SHARE * math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios)), max(ratios))
    cluster = [r >= threshold and (x.linked <= LINKS * len(x.text) or r == max(ratios)) for r, x in zip(ratios, lines, strict=True)]
    weigh(elements, [(x.element, len(x.text)) for x, c in zip(lines, cluster, strict=True) if c])
    # doubtful words count where the cluster has no line
    doubtful = inside(elements, {i for i, e in enumerate(elements) if e.vote == 1 and not e.size})
    kept = [(x, c) for x, c in zip(lines, cluster, strict=True) if not doubtful[x.element]]
    children: dict[int, list[int]] = {}
    for i, e in enumerate(elements[1:], 1):
        if e.size:
            children.setdefault(e.parent, []).append(i)
    region, heads = 0, set()
    while not elements[region].article:
        within = [i for i in children.get(region, ()) if elements[i].size >= HOLDS * elements[region].size]
        if not within or elements[within[0]].tag in ("p", "li", "blockquote", "pre", "td"):
            break
        if elements[region].tag not in OUTER and any(elements[x.element].tag == "p" and elements[x.element].parent == region and x.linked <= LINKS * len(x.text) for x, _ in kept):
            break  # its own paragraphs belong to it
        order = [i for i, (x, _) in enumerate(kept) if inside_of(elements, x.element, within[0])]
        before = order[0] - 1
        while before >= 0 and inside_of(elements, kept[before][0].element, region) and re.fullmatch("h[1-6]", elements[kept[before][0].element].tag):
            heads.add(before)  # a heading just above the smaller region
            before -= 1
        region = within[0]
    own = [i for i, (x, _) in enumerate(kept) if i in heads or inside_of(elements, x.element, region)]
    if not elements[region].article:
        articles = [i for i, e in enumerate(elements) if e.article and e.size and inside_of(elements, i, region)]
        marked = inside(elements, set(articles))
        if sum(len(x.text) for x, c in kept if c and marked[x.element]) >= HOLDS * elements[region].size:
            own = [i for i in own if marked[kept[i][0].element]]  # several elements mark themselves as articles
        else:
            own = trimmed(elements, kept, own, elements[region].tag in OUTER)
    return " ".join(kept[i][0].text for i in own)


def inside_of(elements: list[Element], i: int, outer: int) -> bool:
    while i > outer:
        i = elements[i].parent
    return i == outer


def trimmed(elements: list[Element], kept: list[tuple[Line, bool]], own: list[int], body: bool) -> list[int]:
    """`own` without the lines of links at its edges; of a page's body only what reaches from the first to the last line of the cluster, with the headings and paragraphs beside it."""
    hits = [k for k, i in enumerate(own) if kept[i][1]]
    if not hits:
        return own
    linked = lambda k: kept[own[k]][0].linked > LINKS * len(kept[own[k]][0].text)
    tag = lambda k: elements[kept[own[k]][0].element].tag
    beside = lambda k: not linked(k) and (not body or re.fullmatch("p|h[1-6]|blockquote|pre|li", tag(k)))
    first, last = hits[0], hits[-1]
    while first and beside(first - 1):
        first -= 1
    while last < len(own) - 1 and beside(last + 1):
        last += 1
    if not body:  # lines of links end the region only where nothing but such lines follows
        first = next(k for k in range(len(own)) if k >= first or not linked(k))
        last = next(k for k in range(len(own) - 1, -1, -1) if k <= last or not linked(k))
    return own[first : last + 1]


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """`pages` without the html, with text and n_chars (code points) for every row.

    Null or empty html: empty text. Pages are worked on one at a time, as wholes, where they are read: nothing is
    shuffled, and repeated rows are extracted again. Input columns text and n_chars are replaced.
    """
    kept = [f for f in pages.schema.fields if f.name not in (html_col, "text", "n_chars")]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, html = batch.columns
            texts = [main_text(x) for x in html.to_pylist()]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select(*(f.name for f in kept), html_col).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
