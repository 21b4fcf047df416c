"""Main text of web pages by text-to-tag ratio.

Events of the standard library's parser turn a page into lines: one per block, each with the number of its characters,
of its characters inside links, and of the tags met since the line before. A line's ratio is the logarithm of its text
outside links per tag, smoothed with a Gaussian over neighbouring lines. What a line's elements say of themselves
(navigation, adverts, notices, reader comments, ...) only weighs on that ratio.

Lines over the page's threshold are content, and they choose the region: all ``article`` or ``main`` elements that hold
most of the content's text, or else the innermost container that holds nearly all of it, with the headings (without such
an element the paragraphs, too) that stand directly around it. The region weighs on the ratios in turn, and lines over
the threshold are the text: short lines go with their neighbours, and several lines of links in a row are a list that its
own ratio leaves out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.frames import beside

SIGMA, REACH = 1.0, 3
#: The threshold in standard deviations of the page's ratios, and the most it can be.
LEVEL, MOST = 0.5, 2.0
#: Weights in powers of two: of lines that declare themselves boilerplate, and of those inside and outside the region.
DECLARED, INSIDE, OUTSIDE = -20.0, 2.0, -10.0
#: Share of the content's text that the region must hold: as ``article`` or ``main``, and as any other container.
NAMED, REGION = 0.5, 0.9
#: So many lines in a row of which each is a link for so much of its text are a list of links.
LIST, LINKS = 3, 0.6

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg head title iframe object canvas audio video map button select textarea label datalist option".split())
BOILERPLATE = frozenset("nav footer aside form fieldset dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CONTAINERS = frozenset("html body main article section div td center".split())
BLOCKS = CONTAINERS | BOILERPLATE | frozenset("address blockquote caption dd details dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr legend li ol p pre summary table tbody tfoot th thead tr ul".split())
#: An element of the first kind ends an open one of the second kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of a class or id that name boilerplate.
HINTS = frozenset(
    "ad ads adv advert advertisement advertisements adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer header masthead topbar comment comments respond reply replies disqus discussion alert alerts disclaimer cookie cookies consent notice gdpr popup modal newsletter subscribe "
    "signup login share sharing social related recommended widget widgets toolbar pagination pager skip copyright".split()
)
#: With one of these beside it, a word says what a wrapper has or lacks, not what it is: ``has-sidebar``.
SAYS = frozenset("has have with no without hide show".split())
_WORD, _RUN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+"), re.compile(r"[a-z]+")
_GAUSS = np.exp(-(np.arange(-REACH, REACH + 1) ** 2) / (2 * SIGMA**2))


class Line(NamedTuple):
    text: str
    linked: int  # characters in links
    tags: int
    container: int
    weight: float
    block: str  # the innermost block's tag
    form: int  # number of the form around it; -1 without one


class _Open(NamedTuple):
    """An element of the stack, with what held around it."""

    tag: str
    container: int
    block: str
    form: int
    silent: bool
    declared: bool


class _Page(HTMLParser):
    """Collects lines and containers of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parents, self.kinds = [-1], ["root"]
        self.stack: list[_Open] = []
        self.container, self.block, self.form, self.forms = 0, "", -1, 0
        self.silent, self.declared, self.links, self.tags, self.linked = 0, 0, 0, 0, 0
        self.parts: list[str] = []

    def flush(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.lines.append(Line(text, self.linked, self.tags, self.container, DECLARED if self.declared else 0.0, self.block, self.form))
                self.tags = 0
            self.parts, self.linked = [], 0

    def declares(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        """Whether an element says that it's boilerplate. Words of a class or id count on blocks only: inside a block they
        stand on words of its prose."""
        if tag in BOILERPLATE and tag != "form":
            return True
        if tag == "header" and not self.within("article", "main"):
            return True
        if tag in ("html", "body", "main", "h1"):
            return False
        for name, value in attrs:
            if name == "role" and (value or "").lower() in ROLES:
                return True
            if name in ("class", "id") and value and tag in BLOCKS:
                for part in value.split():
                    words = {w.lower() for w in _WORD.findall(part)} | set(_RUN.findall(part.lower()))
                    if tag == "article":
                        words = {part.lower()}
                    if words & HINTS and not words & SAYS and not (words & {"header", "banner"} and self.within("article", "main")):
                        return True
        return False

    def within(self, *kinds: str) -> bool:
        at = self.container
        while at > 0:
            if self.kinds[at] in kinds:
                return True
            at = self.parents[at]
        return False

    def leave(self, to: int) -> None:
        """Closes the elements of the stack from number ``to`` on."""
        for e in reversed(self.stack[to:]):
            self.container, self.block, self.form = e.container, e.block, e.form
            self.silent -= e.silent
            self.declared -= e.declared
            self.links -= e.tag == "a"
        del self.stack[to:]

    def pop(self, to: int) -> None:
        self.flush()
        self.leave(to)

    def find(self, tags: set[str] | frozenset[str], stop: frozenset[str]) -> int | None:
        for i in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[i].tag
            if tag in tags:
                return i
            if tag in stop:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.handle_data(" ")
        if tag in BLOCKS:
            self.flush()
            if (at := self.find({"p"}, CONTAINERS | {"li", "th"})) is not None:
                self.pop(at)
        if tag in CLOSES and (at := self.find(CLOSES[tag], frozenset({"ul", "ol", "dl", "table", "select", "menu"}))) is not None:
            self.pop(at)
        if tag in VOID:
            return
        says = self.declares(tag, attrs)
        quiet = tag in SILENT or any(n == "hidden" or n == "aria-hidden" and v == "true" for n, v in attrs) or says and tag not in BLOCKS
        self.stack.append(_Open(tag, self.container, self.block, self.form, quiet, says))
        self.silent += quiet
        self.declared += says
        self.links += tag == "a"
        if tag in BLOCKS:
            self.block = tag
        if tag == "form":
            self.form, self.forms = self.forms, self.forms + 1
        if tag in CONTAINERS:
            self.parents.append(self.container)
            self.kinds.append(tag)
            self.container = len(self.parents) - 1

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in VOID:
            return
        ends = tag in BLOCKS or tag in SILENT
        if (at := self.find({tag}, frozenset() if ends else BLOCKS)) is not None:
            if tag in BLOCKS:
                self.flush()
            self.leave(at)  # with what an end tag leaves open inside

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash doesn't close elements that can have content

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def unknown_decl(self, data: str) -> None:
        pass


def ratios(lines: list[Line]) -> np.ndarray:
    """Weighed text-to-tag ratio of each line as a power of two: smoothed over its neighbours, text in links not counted."""
    raw = np.log2([1 + max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines])
    total = np.convolve(np.ones(len(raw)), _GAUSS, "full")[REACH:-REACH]
    return np.convolve(raw, _GAUSS, "full")[REACH:-REACH] / total + np.array([x.weight for x in lines])


def over(values: np.ndarray) -> np.ndarray:
    """Which ratios are over their threshold."""
    return values > min(LEVEL * values.std(), MOST, values.max() - 1e-9)


def _lists(lines: list[Line]) -> np.ndarray:
    """Which lines are in a list of links."""
    link = np.array([x.linked > LINKS * len(x.text) for x in lines])
    edge = np.flatnonzero(np.diff(np.concatenate(([0], link, [0]))))
    out = np.zeros(len(lines), bool)
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        out[a:b] = b - a >= LIST
    return out


def _region(page: _Page, content: np.ndarray) -> np.ndarray:
    """Whether each line belongs to the region that its content chooses."""
    n, lines = len(page.parents), page.lines
    own = np.zeros(n)
    for i in np.flatnonzero(content):
        own[lines[i].container] += len(lines[i].text)
    total = own.copy()
    for c in range(n - 1, 0, -1):
        total[page.parents[c]] += total[c]
    chosen: list[int] = []
    for kind, least in (("article", REGION), ("main", NAMED), ("article", NAMED)):
        named = [c for c in range(n) if page.kinds[c] == kind and total[c] > 0]
        outer = [c for c in named if not any(page.kinds[a] == kind for a in _above(page.parents, c))]
        if not chosen and total[0] and sum(total[c] for c in outer) >= least * total[0]:
            chosen = outer
    direct = HEADINGS
    if not chosen:
        direct = BLOCKS - CONTAINERS
        richest = np.zeros(n, np.int64)  # each container's child with most content
        for c in range(n - 1, 0, -1):
            if total[c] >= total[richest[page.parents[c]]] or not richest[page.parents[c]]:
                richest[page.parents[c]] = c
        at = 0
        while richest[at] and total[richest[at]] >= max(REGION * total[at], 1):
            at = richest[at]
        chosen = [at]
    inside, around = np.zeros(n, bool), np.zeros(n, bool)
    inside[chosen] = True
    for c in range(1, n):
        inside[c] |= inside[page.parents[c]]
    for c in chosen:
        around[list(_above(page.parents, c))] = True
    return np.array([inside[x.container] or around[x.container] and x.block in direct and c for x, c in zip(lines, content.tolist(), strict=True)])


def _above(parents: list[int], at: int) -> Iterator[int]:
    while (at := parents[at]) >= 0:
        yield at


def _weighed(page: _Page) -> list[Line]:
    """The page's lines; a form that holds no more than half of the text is boilerplate, a larger one is the page's."""
    size = np.zeros(page.forms + 1)
    for x in page.lines:
        size[x.form] += len(x.text)
    lost = size <= size.sum() / 2
    lost[-1] = False
    return [x._replace(weight=DECLARED) if lost[x.form] else x for x in page.lines]


def _parsed(html: str) -> _Page:
    try:
        (page := _Page()).feed(html)
        page.close()
    except AssertionError:  # the parser refuses some malformed declarations; as text they do no harm
        (page := _Page()).feed(html.replace("<![", "&lt;!["))
        page.close()
    page.flush()
    return page


def extract(html: str | None) -> str:
    """The main text of a page; empty if there is none."""
    if not html:
        return ""
    page = _parsed(html)
    if not page.lines:
        return ""
    page.lines = _weighed(page)
    listed = _lists(page.lines)
    if all(x.weight for x in page.lines):
        return ""
    inside = _region(page, over(ratios(page.lines)) & ~listed)
    smooth = ratios([x._replace(weight=x.weight + (INSIDE if i else OUTSIDE)) for x, i in zip(page.lines, inside.tolist(), strict=True)])
    return "\n".join(x.text for x, kept in zip(page.lines, (over(smooth) & ~listed).tolist(), strict=True) if kept)


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without the markup and with ``_main``, the main text. Null and empty pages, and those without text, have
    an empty one; rows that repeat have the same. An input column of that name goes on with an underscore more."""
    pages = beside(pages, "_main")
    keep = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.batches_of(batches, html):
            texts = [extract(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "_main"])

    K.bound_batches(pages.sparkSession)
    return pages.select(*keep, html).mapInArrow(run, pages.select(*keep).schema.add("_main", "string"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: main text of every page."""
    found = extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("_main").alias("text"), F.char_length("_main").cast("long").alias("n_chars"))
