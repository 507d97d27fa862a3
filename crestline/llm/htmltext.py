"""Main text of HTML pages by text-to-tag ratios.

The standard library's parser streams a page's events; every block-level tag ends a line, so a line is a
block's text with the tags that stand in it. Its ratio is text characters to tags. Ratios are smoothed by
a Gaussian, and lines over a threshold (the spread of the ratios) form the content cluster. The content region
is the deepest element that holds ``HOLDS`` of the cluster's characters; where that is a single block, list or
table, it is what contains it and the blocks beside it. An article or main element has no privilege there. All
blocks of the region are kept, short ones too, but for parts that their tag, role or class names as menu,
header, footer, sidebar, notice, advert, form or comments, and, outside an article or main element, blocks
that are links only and stand before or after all other lines of the cluster.

Cases: a null or empty html, or one without text, gives an empty text; a null page_id or url is carried;
unclosed and crossed tags close with what is around them; repeated rows give a row each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("aside button dialog footer form head iframe menu nav noscript object option script select style svg template textarea title canvas audio video".split())
#: Elements that are part of a text and do not contain a whole one.
PARTS = frozenset("address blockquote dd dir dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup legend li ol p pre summary table tbody tfoot thead tr ul".split())
HOMES = frozenset(("article", "main"))
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
DROPPED_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu footer masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice notices popup modal overlay share sharing social related recommended newsletter subscribe signup login comment comments disqus replies widget toolbar pagination pager copyright hidden".split())
CLOSED_BY = {"p": BLOCKS - {"html", "head", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_SPLIT = re.compile(r"[^a-z0-9]+")
SIGMA = 1.0
LINK_SHARE, HOLDS = 0.9, 0.8


class Lines(HTMLParser):
    """Collects blocks: text, tags, characters in links, element and whether it is dropped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[int] = []
        self.open: Counter = Counter()
        self.name, self.parent, self.dropped, self.home = [""], [0], [False], [0]
        self.blocks: list[tuple[str, int, int, int]] = []
        self.parts: list[str] = []
        self.tags = self.link_chars = self.at = 0

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((text, self.tags, self.link_chars, self.at))
        self.parts, self.tags, self.link_chars = [], 0, 0

    def _pop_to(self, name: str) -> None:
        while self.stack:
            last = self.name[self.stack.pop()]
            self.open[last] -= 1
            if last == name:
                break
        self.at = self.stack[-1] if self.stack else 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._end_line()
            if self.open["head"] and tag not in ("title", "head", "html"):
                self._pop_to("head")
            for inner, by in CLOSED_BY.items():
                if tag in by and self.open[inner] and self._nearest(inner, tag):
                    self._pop_to(inner)
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        got = {k: (v or "").lower() for k, v in attrs if k in ("class", "id", "role", "itemprop", "hidden")}
        home = self.home[self.at]
        named = set(_SPLIT.split(f"{got.get('class', '')} {got.get('id', '')}")) if tag not in ("html", "body") else set()
        drop = self.dropped[self.at] or tag in DROPPED or "hidden" in got or got.get("role", "") in DROPPED_ROLES
        if tag in HOMES or got.get("role") in ("main", "article") or got.get("itemprop") == "articlebody":
            drop = drop or bool(named & {"comment", "comments", "related"})
            home = home or len(self.name)
        else:
            drop = drop or bool(named & DROPPED_NAMES) or not home and (tag == "header" or "header" in named)
        self.name.append(tag)
        self.parent.append(self.at)
        self.dropped.append(drop)
        self.home.append(0 if drop else home)
        self.at = len(self.name) - 1
        self.stack.append(self.at)
        self.open[tag] += 1

    def _nearest(self, inner: str, tag: str) -> bool:
        """Whether ``inner`` is open in the same list or table, so that ``tag`` closes it."""
        stops = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}.get(inner, ("div", "section", "article", "main", "td", "th", "li", "button", "blockquote"))
        for k in reversed(self.stack):
            if self.name[k] == inner:
                return True
            if self.name[k] in stops:
                return False
        return False

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        if self.open[tag] > 0:
            self._pop_to(tag)

    def handle_data(self, data):
        if not self.dropped[self.at]:
            self.parts.append(data)
            if self.open["a"] > 0:
                self.link_chars += len("".join(data.split()))

    def finish(self) -> None:
        self.close()
        self._end_line()


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing whose weights at the ends are those of the lines that exist."""
    radius = max(1, int(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    same = lambda x: np.convolve(x, kernel)[radius : radius + len(x)]
    return same(ratios) / same(np.ones(len(ratios)))


def container(page: Lines, region: int) -> int:
    """The nearest element at or above ``region`` that contains a text and not only a part of it."""
    count = np.bincount([e for _, _, _, e in page.blocks], minlength=len(page.name))
    beside = count > 0  # elements with text of their own, or of a part that is their child
    for e in range(len(count) - 1, 0, -1):
        up = page.parent[e]
        beside[up] |= beside[e] and page.name[e] in PARTS
        count[up] += count[e]
    while region and (page.name[region] in PARTS or count[region] == 1 or beside[page.parent[region]] and page.name[page.parent[region]] not in ("", "body", "html")):
        region = page.parent[region]
    return region


def content_lines(blocks: list[tuple[str, int, int, int]]) -> np.ndarray:
    """Which lines form the content cluster: their smoothed text-to-tag ratio is over the ratios' spread."""
    ratios = np.array([len(t) / max(1, tags) for t, tags, _, _ in blocks])
    smoothed = smooth(ratios)
    return smoothed >= min(smoothed.std(), smoothed.max())


def region_of(page: Lines, content: np.ndarray) -> int:
    """The element that holds the content cluster: the deepest with ``HOLDS`` of its characters, no mere part of a text."""
    held = np.zeros(len(page.name))
    for line, (text, _, _, e) in zip(content, page.blocks, strict=True):
        held[e] += len(text) if line else 0
    for e in range(len(held) - 1, 0, -1):
        held[page.parent[e]] += held[e]
    return container(page, int(max(np.flatnonzero(held >= HOLDS * held[0]))))


def extract(html: str) -> str:
    """The main text of a page: blocks in page order, joined by line feeds."""
    page = Lines()
    page.feed(html)
    page.finish()
    if not page.blocks:
        return ""
    content = content_lines(page.blocks)
    region = region_of(page, content)
    within = [False] * len(page.name)
    for e in range(len(within)):
        within[e] = e == region or e > 0 and within[page.parent[e]]
    # blocks of links alone before or after all content are a menu, unless an article element holds them
    links = [n >= LINK_SHARE * len(t.replace(" ", "")) and not page.home[e] for t, _, n, e in page.blocks]
    lines = [i for i, (_, _, _, e) in enumerate(page.blocks) if content[i] and within[e] and not links[i]]
    first, last = (lines[0], lines[-1]) if lines else (0, len(links))
    out = [text for i, (text, _, _, e) in enumerate(page.blocks) if within[e] and (first <= i <= last or not links[i])]
    return "\n".join(out)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
