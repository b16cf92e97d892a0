"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams a page's events into lines, one for each block of markup.
A line's ratio is its characters outside links by its tags, at most LONG, so that one very long line
does not hide the others. Ratios are smoothed along the page with a Gaussian; lines above the spread
of the smoothed ratios are content seeds. The main text is the article or main element with most of
the seeds' characters and all other articles beside it, else the innermost element around all
seeds. All lines of these come out whole, except those in parts that are never main text (menus,
adverts, notices, comments). Such parts are told by their element or by a class or id that says so and
nothing else; a form or a class word is no reason to leave out an element that holds most of the
characters of a page outside links. Without an article or main element, link lists, copyright notices and
the like at both ends of the region, outside the outermost seeds, go too.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section "
    "summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose text is never main text.
_NEVER = frozenset(
    "head title script style noscript template iframe object svg canvas math select option button textarea "
    "datalist audio video map nav footer aside menu dialog search".split())
_RAW = frozenset(("script", "style"))
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar "
                   "toolbar".split())
#: Words of class and id that mark such parts.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies disqus footer gdpr header masthead menu menubar modal nav navbar navigation "
    "newsletter notice notices notification overlay pager pagination paywall popup promo promos promotion recommended "
    "related reply respond share sharing sidebar sidenav signup social sponsor sponsored sponsors subscribe subscription "
    "teaser toolbar topbar widget widgets".split())
#: Words beside them that say nothing of the content; any other word makes it no mark: has-sidebar, ad-free.
_PLAIN = frozenset(
    "area bar block bottom box btn button center col column container content desktop fixed floating form global group "
    "holder inner item items layer left link links list main mobile outer page panel placeholder post posts primary "
    "right row secondary section site slot small sticky strip text title top unit user view wrap wrapper zone".split())
_REGIONS = frozenset(("article", "main"))
#: A start tag on the left ends an open element on the right.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
         "th": ("td", "th"), "option": ("option",), "p": ("p",)}
_ENDS_P = _BLOCK - {"body", "html", "head", "title", "li", "option"}
_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
SIGMA = 1.0
LONG = 200
_REACH = 3


def _hard(tag: str, attrs: list[tuple[str, str | None]], in_region: bool) -> bool:
    """Elements that are never main text whatever they hold."""
    if tag in _NEVER or tag == "header" and not in_region:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value and value.strip().lower() in _ROLES - {"form"}:
            return True
        if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _soft(tag: str, attrs: list[tuple[str, str | None]], in_region: bool) -> bool:
    """Forms, and elements with a class or id of marking words and plain ones alone: main text only if
    they hold most of the page."""
    if tag in ("html", "body", "article", "main"):
        return False
    if tag == "form":
        return True
    for name, value in attrs:
        if name == "role" and value and value.strip().lower() == "form":
            return True
        if name in ("class", "id") and value:
            for one in value.split():
                words = {word.lower() for word in _TOKEN.findall(one) if not word.isdigit()}
                # A header inside the article holds its headline.
                marks = words & _MARKS - ({"header"} if in_region else set())
                if marks and words <= _MARKS | _PLAIN:
                    return True
    return False


class Lines(HTMLParser):
    """Lines of a page: text, characters in links, tags, and the elements around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []  # the last is the innermost element, -1 for none
        self._open: list[tuple[str, int, bool]] = []  # tag, number, starts a part that is never main text
        self._count: dict[str, int] = {}  # open elements of each tag
        self.kinds: list[str] = []
        self.above: list[int] = []  # the element around each, -1 for none
        self.soft: list[bool] = []
        self.freed: set[int] = set()  # regions in a part that is left out, after another region
        self._parts: list[str] = []
        self._tags = self._linked = self._left_out = self._soft = self._links = self._regions = 0

    def _flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self._parts)).strip()
        if text:
            self.lines.append((text, min(self._linked, len(text)), max(1, self._tags),
                               self._open[-1][1] if self._open else -1))
            self._tags = 0
        self._parts, self._linked = [], 0

    def _close(self, index: int) -> None:
        for tag, number, starts in self._open[index:]:
            self._left_out -= starts
            self._soft -= self.soft[number]
            self._count[tag] -= 1
            self._links -= tag == "a"
            self._regions -= tag in _REGIONS
        del self._open[index:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag in _BLOCK:
            self._flush()
        if tag == "br":
            self._parts.append("\n")
        if tag in _VOID:
            return
        if tag in _REGIONS and (self._left_out or self._soft) and not self._regions:
            # An article never stands in a menu or advert: that part was not closed, or it is a comment.
            if any(kind in _REGIONS for kind in self.kinds):
                self.freed.add(len(self.kinds))
            self._close(next(i for i, (_, number, starts) in enumerate(self._open) if starts or self.soft[number]))
        ends = _ENDS.get(tag, ()) + (("p",) if tag in _ENDS_P else ())
        for i in range(len(self._open) - 1, -1, -1):
            kind = self._open[i][0]
            if kind in ends:
                self._close(i)
            elif kind in _BLOCK:
                break
        if tag == "a" and self._links:
            self._close(max(i for i, x in enumerate(self._open) if x[0] == "a"))
        starts = _hard(tag, attrs, self._regions > 0)
        soft = not starts and _soft(tag, attrs, self._regions > 0)
        self.above.append(self._open[-1][1] if self._open else -1)
        self.soft.append(soft)
        self._open.append((tag, len(self.kinds), starts))
        self._count[tag] = self._count.get(tag, 0) + 1
        self.kinds.append(tag)
        self._soft += soft
        self._left_out += starts
        self._links += tag == "a"
        self._regions += tag in _REGIONS

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag not in _RAW and tag in ("svg", "path", "circle", "rect", "use"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in _BLOCK:
            self._flush()
        if not self._count.get(tag):
            return
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] == tag:
                self._close(i)
                break

    def handle_data(self, data: str) -> None:
        if not self._left_out:
            self._parts.append(data)
            if self._links:
                self._linked += len(data)

    def finish(self) -> None:
        self.close()
        self._flush()
        # A soft part with most of the characters outside links wraps the page; lines of others go.
        held = self.sums([(number, len(text) - linked) for text, linked, _, number in self.lines])
        total = sum(len(text) - linked for text, linked, _, _ in self.lines)
        out = self.inside([soft and 2 * held[number] <= total for number, soft in enumerate(self.soft)])
        self.lines = [line for line in self.lines if line[3] < 0 or not out[line[3]]]

    def sums(self, weights: list[tuple[int, int]]) -> list[int]:
        """Of each element, the weights given to it and to all elements in it."""
        held = [0] * len(self.kinds)
        for number, weight in weights:
            if number >= 0:
                held[number] += weight
        for number in range(len(held) - 1, -1, -1):
            if self.above[number] >= 0:
                held[self.above[number]] += held[number]
        return held

    def inside(self, chosen: list[bool]) -> list[bool]:
        """Which elements are chosen or within a chosen one."""
        found = list(chosen)
        for number, above in enumerate(self.above):
            if above >= 0 and found[above]:
                found[number] = True
        return found


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Ratios blurred along the page with a Gaussian; the ends count their own lines only."""
    kernel = np.exp(-0.5 * (np.arange(-_REACH, _REACH + 1) / sigma) ** 2)
    wide = np.convolve(ratios, kernel)[_REACH:_REACH + len(ratios)]
    return wide / np.convolve(np.ones(len(ratios)), kernel)[_REACH:_REACH + len(ratios)]


_NOTICE = re.compile(r"©|\(c\)\s*\d|copyright|all rights reserved", re.I)


def _articles(page: Lines, mass: list[int], own: list[int]) -> list[bool]:
    """Which elements lie in the main or article element with most of the seeds, or in an outermost article
    beside it, of the same main element if there is one."""
    best = max(own, key=lambda number: (mass[number], number))
    chosen = [False] * len(page.kinds)
    chosen[best] = True
    if page.kinds[best] == "main":
        return page.inside(chosen)
    main, at = -1, page.above[best]
    while at >= 0 and main < 0:
        main, at = (at if page.kinds[at] == "main" else -1), page.above[at]
    within = page.inside([number == main for number in range(len(page.kinds))]) if main >= 0 else None
    outer = [False] * len(page.kinds)   # within an article already
    for number, kind in enumerate(page.kinds):
        above = page.above[number]
        outer[number] = above >= 0 and (outer[above] or page.kinds[above] == "article")
        if kind == "article" and not outer[number] and number not in page.freed and (within is None or within[number]):
            chosen[number] = True
    return page.inside(chosen)


def _main_lines(page: Lines) -> list[str]:
    """The lines of the main text."""
    ratios = smoothed(np.array([min((len(text) - linked) / tags, LONG) for text, linked, tags, _ in page.lines]))
    threshold = min(ratios.std(), ratios.max())
    weights = [len(text) - linked for text, linked, _, _ in page.lines]
    seeds = [bool(ratio >= threshold and ratio > 0 and weight) for ratio, weight in zip(ratios, weights)]
    mass = page.sums([(line[3], weight) for line, weight, seed in zip(page.lines, weights, seeds) if seed])
    own = [number for number, held in enumerate(mass) if held and page.kinds[number] in _REGIONS]
    if own:
        chosen = _articles(page, mass, own)
        return [text for text, _, _, number in page.lines if number >= 0 and chosen[number]]
    total = sum(weight for weight, seed in zip(weights, seeds) if seed)
    # The innermost element with all the mass, but not a single paragraph of several lines.
    around = [number for number, held in enumerate(mass) if total and held == total and page.kinds[number] in (
        "div", "section", "td", "body", "table", "tbody", "tr", "center", "blockquote", "details", "form")]
    innermost = max(around, default=-1)
    chosen = page.inside([number == innermost for number in range(len(page.kinds))]) if around else None
    rows = [(text, linked, seed) for (text, linked, _, number), seed in zip(page.lines, seeds)
            if chosen is None or number >= 0 and chosen[number]]

    def outlying(text: str, linked: int) -> bool:
        return 2 * linked > len(text) or len(text) <= LONG and _NOTICE.search(text) is not None

    # Seeds may be drawn in by their neighbours, so ends are judged by their own lines.
    while rows and outlying(*rows[0][:2]):
        rows = rows[1:]
    while rows and outlying(*rows[-1][:2]):
        rows = rows[:-1]
    return [text for text, _, _ in rows]


def main_text(html: str | None) -> str:
    """The main text of a page: lines joined by a newline, empty if there is none."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.finish()
    return "\n".join(_main_lines(page)) if page.lines else ""


def extracted(html: Column) -> Column:
    """The main text of each page as a column."""
    def run(column: pa.Array) -> pa.Array:
        return pa.array([main_text(value.as_py()) for value in column], pa.string())

    return F.arrow_udf(run, "string")(html)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """All rows and columns of ``pages`` with text and n_chars (its code points).

    A null or empty page has empty text. Rows are independent of each other, so repeated rows give
    equal results. Columns named like those added are replaced.
    """
    rows = pages.drop(*[name for name in ("text", "n_chars") if name in pages.columns])
    return rows.select("*", extracted(F.col("html").cast("string")).alias("text")).withColumn(
        "n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")
