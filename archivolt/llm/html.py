"""Main text of web pages from a stream of parser events.

The standard library's parser turns a page into lines: a line is the text of one
block, with the number of tags seen while it was read, how much of it is links,
and the elements around it.  The ratios of text that is no link to tags are
smoothed with a Gaussian and cut at a threshold, which gives clusters of lines.  The
best cluster and those of like ratio are the content.  The innermost article or main
element around them is the region, and all of its lines are returned, short ones
included; without such an element only those parts of the nearest section are
that hold content, with the headings right before them, and no lists of links.

Lines inside menus, headers, footers, sidebars, notices, adverts, forms and comments
count as no text.  Some of that is told by its element alone, some only by names in
class and id.  A name doesn't count where its element holds most of a page's text and no
article is outside, so that a wrapper is never dropped for a word in its class; one
that may as well name a part of an article counts only where no cluster is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.common import small_batches

#: The width of the Gaussian, in lines, the threshold as a share of the ratios' standard deviation, and the ratio of a
#: cluster that is content too, as a share of the best one's.
SIGMA, THRESHOLD, ALIKE = 1.0, 0.5, 0.2
#: The share of the usual ratio below which a line at the edge of the content has to be a sentence.
FAINT = 0.5
#: Of a list of links: its lines at least, and how much of its text is links.
LINKS, LINKED = 3, 0.8
#: Characters that are fed to the parser at a time.
_STRIDE = 1 << 16

# Names of HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template svg math iframe object canvas audio video".split())
BOILERPLATE = frozenset("nav footer aside form dialog button select textarea menu".split())
FOREIGN = frozenset("svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
REGION = frozenset("article main section div td body html".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Elements that the next one of the same group ends.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
#: What ends the search for a sibling.
SCOPE = frozenset("ul ol dl table select article section div main body nav aside footer header".split())
#: Words of class and id that name what isn't the article, as a whole or as the first or last part of a hyphenated name.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion promotions banner banners "
    "cookie cookies consent notice notices gdpr popup modal nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer masthead "
    "share sharing social related recommended newsletter subscribe signup login search pagination pager toolbar".split()
)
#: Of those the ones that may name a part of an article as well.
LOOSE = frozenset("social share sharing related recommended signup login search pagination pager toolbar breadcrumb breadcrumbs".split())
ENDS = tuple(".!?…:;\"'”’»)")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: The same for what readers add; such elements may be longer than the article.
READERS = frozenset("comment comments disqus replies respond".split())
#: Names that count only as a whole, or as the first part.
WHOLE = frozenset("site-header page-header widget widgets".split())
#: Parts that turn a name into a remark on its element.
REMARKS = frozenset("has no is with without not".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog".split())
_PARTS = re.compile(r"[-_]+")
#: How an element is told as boilerplate.
CONTENT, BY_LOOSE, BY_NAME, BY_READERS, BY_ELEMENT = range(5)


def named(names: str) -> int:
    """What the words of a class or id say of their element."""
    found = CONTENT
    for name in names.lower().split():
        parts = _PARTS.split(name)
        if REMARKS.intersection(parts[:-1]):
            continue
        if READERS & {name, parts[0], parts[-1]}:
            return BY_READERS
        told = NAMES & {name, parts[0], parts[-1]}
        if told - LOOSE or WHOLE & {name, parts[0]}:
            found = BY_NAME
        elif told:
            found = max(found, BY_LOOSE)
    return found


@dataclass
class Line:
    text: str
    tags: int
    element: int  # the innermost around it
    linked: int  # characters of it in links

    @property
    def ratio(self) -> float:
        return max(0, len(self.text) - self.linked) / max(1, self.tags)


class Reader(HTMLParser):
    """Collects lines and elements; feed it a page in pieces and close it.

    Elements are numbered as they open, so an element's descendants are the
    numbers behind it up to its last one; 0 is the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.kinds, self.parents, self.told = [""], [0], [CONTENT]
        self.stack: list[int] = []  # of open elements
        self.hidden: list[bool] = []
        self.open: Counter[str] = Counter()
        self.held: list[str] = []
        self.tags = self.linked = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            self.lines.append(Line(text, self.tags, self.stack[-1] if self.stack else 0, min(self.linked, len(text))))
            self.tags = 0
        self.linked = 0
        self.held.clear()

    def _pop_to(self, depth: int) -> None:
        names = [self.kinds[e] for e in self.stack[depth:]]
        if any(n in BLOCK for n in names):
            self.end_line()
        self.open.subtract(names)
        del self.stack[depth:], self.hidden[depth:]

    def _close_nearest(self, names: set[str] | frozenset[str], scope: frozenset[str]) -> None:
        """Close the innermost open element of ``names``, if none of ``scope`` is within it."""
        if not any(self.open[n] for n in names):
            return
        for at in range(len(self.stack) - 1, -1, -1):
            kind = self.kinds[self.stack[at]]
            if kind in names:
                return self._pop_to(at)
            if kind in scope:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "hr":
                self.end_line()
            elif tag in ("br", "wbr"):
                self.held.append(" " if tag == "br" else "")
            return
        if tag in CLOSES_P:
            self._close_nearest({"p"}, SCOPE)
        if tag in SIBLINGS:
            self._close_nearest(SIBLINGS[tag], SCOPE)
        if tag == "body":
            self._close_nearest({"head"}, frozenset())
        if tag in BLOCK:
            self.end_line()
        given = {k: v or "" for k, v in attrs}
        inner = self.open["article"] or self.open["main"]
        told = CONTENT
        if tag in BOILERPLATE or tag == "header" and not inner or "hidden" in given or given.get("role", "").lower() in ROLES:
            told = BY_ELEMENT
        elif tag not in ("html", "body", "article", "main"):
            told = max(named(given.get("class", "")), named(given.get("id", "")))
        self.parents.append(self.stack[-1] if self.stack else 0)
        self.stack.append(len(self.kinds))
        self.kinds.append(tag)
        self.told.append(told)
        self.hidden.append(tag in HIDDEN or bool(self.hidden) and self.hidden[-1])
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in FOREIGN or any(self.open[f] for f in FOREIGN):
            self.tags += 1  # "/>" ends foreign elements, and means nothing on others that aren't void
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        self._close_nearest({tag}, frozenset())

    def handle_data(self, data: str) -> None:
        if not (self.hidden and self.hidden[-1]):
            self.held.append(data)
            if self.open["a"]:
                self.linked += len(" ".join(data.split()))

    def finish(self) -> None:
        """End the page; a tag or comment that it leaves open is markup, not text."""
        if re.match("<[!?/a-zA-Z]", self.rawdata):
            self.rawdata = ""
        self.close()
        self.end_line()


@dataclass
class Page:
    """Lines and elements of a page; ``last[e]`` is the last descendant of e."""

    lines: list[Line]
    kinds: list[str]
    parents: list[int]
    last: list[int]
    dropped: list[bool]  # elements that are boilerplate or within it

    def sums(self, of_lines: list[int]) -> list[int]:
        """For each element the sum over the lines in it."""
        return _sums(self.parents, self.lines, of_lines)


def _sums(parents: list[int], lines: list[Line], of_lines: list[int]) -> list[int]:
    out = [0] * len(parents)
    for line, n in zip(lines, of_lines, strict=True):
        out[line.element] += n
    for e in range(len(parents) - 1, 0, -1):
        out[parents[e]] += out[e]
    return out


def _inherit(parents: list[int], own: list[bool]) -> list[bool]:
    """Whether an element or one around it has the mark."""
    out = list(own)
    for e in range(1, len(parents)):
        out[e] = out[e] or out[parents[e]]
    return out


def read_page(html: str) -> Page:
    reader = Reader()
    for at in range(0, len(html), _STRIDE):
        reader.feed(html[at : at + _STRIDE])
    reader.finish()
    lines, kinds, parents = reader.lines, reader.kinds, reader.parents
    last = list(range(len(kinds)))
    holds_main = [k == "main" for k in kinds]
    for e in range(len(kinds) - 1, 0, -1):
        last[parents[e]] = max(last[parents[e]], last[e])
        holds_main[parents[e]] = holds_main[parents[e]] or holds_main[e]
    sure = _inherit(parents, [t == BY_ELEMENT for t in reader.told])
    size = _sums(parents, lines, [0 if sure[x.element] else len(x.text) for x in lines])
    # articles that have text; those in one another or among what readers add count for no more
    readers = _inherit(parents, [t == BY_READERS for t in reader.told])
    articles = [k in ("article", "main") and size[e] > 0 and not readers[e] and not sure[e] for e, k in enumerate(kinds)]
    within = list(map(int, articles))
    for e in range(len(kinds) - 1, 0, -1):
        within[parents[e]] += within[e]

    def dropped(e: int, told: int) -> bool:
        if told in (CONTENT, BY_ELEMENT):
            return told == BY_ELEMENT
        if told == BY_READERS:
            return not holds_main[e] and size[e] < size[0]
        return not holds_main[e] and (2 * size[e] <= size[0] or within[e] < within[0])

    own = [told != BY_LOOSE and dropped(e, told) for e, told in enumerate(reader.told)]
    loose = [e for e, told in enumerate(reader.told) if told == BY_LOOSE and dropped(e, told)]
    page = Page(lines, kinds, parents, last, _inherit(parents, own))
    if loose:
        held = page.sums(content_lines(page))
        inside = _inherit(parents, [k in ("article", "main") for k in kinds])
        for e in loose:  # a name that an article's part may have too decides only where no cluster is
            own[e] = not (inside[e] and held[e])
        page.dropped = _inherit(parents, own)
    return page


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the ends repeat."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def content_lines(page: Page) -> list[int]:
    """For each line 1 where it is of a content cluster: the one with most text, and those of like ratio."""
    ratios = np.array([0.0 if page.dropped[x.element] else x.ratio for x in page.lines])
    even = smooth(ratios)
    held = (even >= THRESHOLD * even.std()) & (ratios > 0)
    if not held.any():
        return [0] * len(ratios)
    starts = np.flatnonzero(held & ~np.concatenate([[False], held[:-1]]))
    ends = np.flatnonzero(held & ~np.concatenate([held[1:], [False]])) + 1
    text = np.array([len(x.text) - x.linked for x in page.lines])
    clusters = [(int(text[a:b].sum()), float(even[a:b].mean()), a, b) for a, b in zip(starts, ends)]
    best = max(clusters)
    out = np.zeros(len(ratios), int)
    for _, mean, a, b in clusters:
        if mean >= ALIKE * best[1]:
            out[a:b] = 1
    return (out * held).tolist()


def region(page: Page, content: list[int]) -> int:
    """The element around all content lines: an article or main element, else the nearest section; 0 for the whole page."""
    count = page.sums(content)
    if not count[0]:
        return 0
    shared = max(e for e in range(len(count)) if count[e] == count[0])  # of the nested elements that hold them all the innermost
    around = [shared]
    while around[-1]:
        around.append(page.parents[around[-1]])
    for names in (("article",), ("main",), REGION):
        for e in around:
            if page.kinds[e] in names:
                return e
    return 0


def _parts(page: Page, held: int, content: list[int]) -> list[bool]:
    """Of a region that no element names as the article: the lines of parts with content, of headings right before them, of no list of links."""
    count, links = page.sums(content), page.sums([x.linked for x in page.lines])
    size, rows = page.sums([len(x.text) for x in page.lines]), page.sums([1] * len(page.lines))
    menu = _inherit(page.parents, [e != held and not count[e] and rows[e] >= LINKS and links[e] >= LINKED * size[e] for e in range(len(count))])

    # the child of the region that a line is in, or the line itself; elements are numbered as they open, so one walk down does
    part = [0] * len(page.parents)
    for e in range(held + 1, page.last[held] + 1):
        part[e] = e if page.parents[e] == held else part[page.parents[e]]
    inner = [i for i, x in enumerate(page.lines) if held <= x.element <= page.last[held]]
    groups: list[list[int]] = []  # neighbouring lines of one part
    for i in inner:
        own = part[page.lines[i].element]
        if groups and own and part[page.lines[groups[-1][0]].element] == own:
            groups[-1].append(i)
        else:
            groups.append([i])
    good = [any(content[i] for i in g) for g in groups]
    first, last = good.index(True), len(good) - 1 - good[::-1].index(True)
    heading = lambda g: all(_under(page, page.lines[i].element, HEADINGS) for i in g)
    usual = float(np.mean([x.ratio for x, is_content in zip(page.lines, content) if is_content]))
    # the neighbours of content are smoothed into it; at the edges such a line stays only if it is a sentence
    faint = lambda g: all(page.lines[i].ratio < FAINT * usual and not page.lines[i].text.endswith(ENDS) for i in g)
    while last > first and faint(groups[last]):
        last -= 1
    while first < last and faint(groups[first]) and not heading(groups[first]):
        first += 1
    while first and heading(groups[first - 1]):
        first -= 1
    out = [False] * len(page.lines)
    for g in groups[first : last + 1]:
        for i in g:
            out[i] = not menu[page.lines[i].element]
    return out


def _under(page: Page, e: int, names: frozenset[str]) -> bool:
    while e:
        if page.kinds[e] in names:
            return True
        e = page.parents[e]
    return False


def main_text(html: str | None) -> str:
    """The content blocks of a page, one a line; empty if it has none."""
    if not html:
        return ""
    page = read_page(html)
    if not page.lines:
        return ""
    content = content_lines(page)
    held = region(page, content)
    kept = [held <= x.element <= page.last[held] for x in page.lines]
    if any(content) and page.kinds[held] not in ("article", "main"):
        kept = _parts(page, held, content)
    return "\n".join(x.text for x, keep in zip(page.lines, kept) if keep and not page.dropped[x.element])


def _texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pd.Series([main_text(p) for p in pages], index=pages.index, dtype=object)


def extract(pages: DataFrame, *, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with ``into``: the main text.

    Null, empty and textless pages give an empty text.  Every row is read whole
    and on its own; equal rows give equal texts.
    An empty table stays empty; a column that is already named like ``into`` is replaced.
    """
    return small_batches(pages).withColumn(into, F.pandas_udf(_texts, "string").asNondeterministic()(F.col(f"`{html}`")))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("page_id", "url", "text").withColumn("n_chars", F.length("text").cast("long"))
