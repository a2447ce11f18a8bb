"""Main-text extraction from HTML: parser events, text-to-tag ratios, smoothing and threshold clustering.

The standard library's parser streams a page as events. Block tags cut it into lines; a line has its text, the number of
tags seen since the last line and the elements that hold it. Elements that are never article text (menus, forms, scripts,
adverts, comments and the like, by tag, role, class or id) are left out as the events come. The ratios of text to tags of the other lines are
smoothed by a Gaussian and split by a threshold of their mean into content and other lines. The content regions are all article elements
with content lines, if these hold most content characters, else likewise all main elements, else the innermost container that holds most
content and the containers beside it that are mostly content: every line in a region is kept, short ones too, and in the last case single content
lines outside as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import prepare_python

SIGMA = 1.0
#: Share of the mean smoothed ratio from which a line counts as content.
THRESHOLD = 0.5
#: Share of all content characters from which article (or main) elements, or a container, are the regions, and share of a further
#: container's characters that must be content.
MOST = 0.5

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form button select option textarea input iframe object embed svg math "
    "canvas audio video map menu dialog noframes frameset applet".split()
)
CONTAINERS = frozenset("html body main article section div center table td".split())
#: Elements that a start tag of the same set closes, up to the elements that bound them.
CLOSES = (
    (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    (frozenset(["dt", "dd"]), frozenset(["dl"])),
    (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    (frozenset(["tr"]), frozenset(["tbody", "thead", "tfoot", "table"])),
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of class and id names of elements that hold no article text.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars sidenav aside menu "
    "menus nav navbar navigation breadcrumb breadcrumbs masthead topbar footer footers header cookie cookies consent gdpr notice notices notification "
    "notifications alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations comment comments commentlist respond disqus replies widget widgets toolbar pagination pager skip".split()
)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _is_boilerplate(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> bool:
    """inside: whether an article or main element is open."""
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attrs:
        if name in ("class", "id"):
            if value and not NAMES.isdisjoint(_SPLIT.split(_CAMEL.sub("-", value).lower())):
                return True
        elif name == "role":
            if value and value.lower() in ROLES:
                return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        elif name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class Lines(HTMLParser):
    """Collects (text, tags, path) lines of a page; path: tags and numbers of the open containers, outermost first."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, tuple[tuple[str, int], ...]]] = []
        self.open: list[tuple[str, int, bool]] = []
        self.text: list[str] = []
        self.tags = 0
        self.count = 0
        self.off = 0  # open elements that are left out

    def flush(self) -> None:
        line = " ".join("".join(self.text).split())
        self.text.clear()
        if line:
            self.lines.append((line, self.tags, tuple((t, n) for t, n, _ in self.open if t in CONTAINERS)))
            self.tags = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if not self.off:
                self.tags += 1
                if tag in ("br", "hr"):
                    self.text.append(" ")
                if tag == "hr":
                    self.flush()
            return
        if tag not in INLINE:
            self.flush()
            self._close_before(tag)
        off = bool(self.off) or _is_boilerplate(tag, attrs, any(t in ("article", "main") for t, _, _ in self.open))
        if not off:
            self.tags += 1
        self.count += 1
        self.open.append((tag, self.count, off))
        self.off += off

    def _close_before(self, tag: str) -> None:
        """Close the paragraph, list item or table cell that the start of this block ends."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] not in INLINE:
                if self.open[i][0] == "p":
                    self._close(i)
                break
        for same, bounds in CLOSES:
            if tag in same:
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i][0] in bounds:
                        break
                    if self.open[i][0] in same:
                        self._close(i)
                        break

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "path", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.text.append(" ")
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        if tag in INLINE and any(t not in INLINE for t, _, _ in self.open[at + 1 :]):
            return  # a misnested inline end tag closes no blocks
        if not self.off:
            self.tags += 1
        if tag not in INLINE:
            self.flush()
        self._close(at)

    def _close(self, at: int) -> None:
        self.off -= sum(x[2] for x in self.open[at:])
        del self.open[at:]

    def handle_data(self, data: str) -> None:
        if not self.off:
            self.text.append(data)


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """x under a Gaussian window of three sigmas each way; ends are weighted by what there is."""
    r = max(1, int(3 * sigma))
    g = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(x, g, "full")[r : r + len(x)] / np.convolve(np.ones(len(x)), g, "full")[r : r + len(x)]


def main_text(html: str | None) -> str:
    """The article text of a page: blocks in page order joined by one space, white space in blocks as one space."""
    if not html:
        return ""
    tail = html.rfind("<")
    if tail >= 0 and html.find(">", tail) < 0 and re.match(r"</?[a-zA-Z!]", html[tail:]):
        html = html[:tail]  # a tag that the page's end cuts off
    p = Lines()
    p.feed(html)
    p.close()
    p.flush()
    lines = p.lines
    if not lines:
        return ""
    size = np.array([len(t) for t, _, _ in lines], dtype=float)
    ratio = smooth(size / np.maximum(1, [n for _, n, _ in lines]))
    content = ratio >= THRESHOLD * ratio.mean()
    held: dict[int, float] = {}
    inside = {"article": 0.0, "main": 0.0}
    for (_, _, path), n, yes in zip(lines, size, content, strict=True):
        if yes:
            for _, e in path:
                held[e] = held.get(e, 0) + n
            for name in inside.keys() & {t for t, _ in path}:
                inside[name] += n
    total = size[content].sum()
    for name in ("article", "main"):
        if inside[name] >= MOST * total:
            named = {e for _, _, path in lines for t, e in path if t == name}
            regions = named & held.keys()
            return " ".join(t for t, _, path in lines if any(e in regions for _, e in path))
    region = max((e for e, n in held.items() if n >= MOST * total), default=None)  # elements are numbered as they open
    if region is None:
        return " ".join(t for t, _, _ in lines)
    size_of: dict[int, float] = {}
    around: set[int] = set()
    for (_, _, path), n in zip(lines, size, strict=True):
        for _, e in path:
            size_of[e] = size_of.get(e, 0) + n
        at = [e for _, e in path]
        if region in at:
            around.update(at[: at.index(region)])
    regions = {e for e, n in held.items() if e == region or (e not in around and n >= MOST * size_of[e])}
    return " ".join(t for (t, _, path), yes in zip(lines, content, strict=True) if yes or any(e in regions for _, e in path))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    A null or empty page, or one without article text, gives an empty text. Tags left open or cut off at the end, and
    unknown character references, do no harm. Repeated rows are extracted each by itself; an empty table gives no rows.
    """
    prepare_python(pages.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h) for h in batch.column(2).to_pylist()]
            size = pa.array([len(t) for t in text], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), size], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long"
    )
