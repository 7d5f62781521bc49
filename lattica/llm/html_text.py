"""HTML extraction: parser events to lines, text-to-tag ratio, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lattica.llm.common import small_batches, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose whole content is never article text.
SKIP = frozenset("script style noscript template head title nav footer aside form button select option textarea label fieldset iframe object svg canvas audio video map dialog menu".split())
#: Elements that start and end a line of text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
MAIN = frozenset(("article", "main"))
#: Elements that hold blocks: neighbouring blocks of one of them make a region.
CONTAINERS = frozenset("html body div section article main center".split())
#: Words of class or id values, and roles, that mark page furniture.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus "
    "footer header menu menubar masthead modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promotion related "
    "replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Elements that hold prose: in these, only a whole class name counts as a word of FURNITURE, and an id does not.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption b strong i em a span code".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: An open p ends where one of these starts.
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
SPACE = re.compile(r"\s+")
SUBSET_END = re.compile(r"\]\s*>")


def _furniture(tag: str, attrs: list, in_main: bool) -> bool:
    if tag in SKIP or tag == "header" and not in_main:
        return True
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and (value or "").lower() == "true":
            return True
        if not value:
            continue
        if name == "role" and value.lower() in ROLES:
            return True
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if tag in PROSE:
            if name == "class" and FURNITURE.intersection(value.lower().split()):
                return True
        elif name in ("class", "id") and tag not in ("html", "body", "article", "main") and FURNITURE.intersection(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower())):
            return True
    return False


class _Lines(HTMLParser):
    """Collects lines: [place, text pieces, tags, characters inside links]; see place()."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # element, whether its content is skipped, its number
        self.skipped = self.links = self.main = self.elements = 0
        self.count: Counter[str] = Counter()  # open elements by name
        self.blocks: list[tuple[int, str, int]] = []  # of the open ones: place in open, name, number
        self.holders: list[int] = []  # numbers of the open CONTAINERS
        self.lines: list[list] = []
        self.now: list = [None, [], 0, 0]

    def flush(self) -> None:
        if self.now[1]:
            self.lines.append(self.now)
        self.now = [None, [], 0, 0]

    def place(self) -> tuple[int, str, bool]:
        """The container whose block the text is in, the kind of the block, and whether an article or main element is open.

        Blocks that hold text alone are of one kind, but for containers, which are of their own name's.
        """
        kind, holders = "text", self.holders
        if self.blocks and self.blocks[-1][1] in ("div", "section", "center"):
            kind, holders = self.blocks[-1][1], holders[:-1] if len(holders) < 2 else holders[-2:-1]
        return holders[-1] if holders else 0, kind, self.main > 0

    def pop(self) -> str:
        tag, skipped, _ = self.open.pop()
        self.skipped -= skipped
        self.links -= tag == "a"
        self.count[tag] -= 1
        if tag in BLOCK:
            self.blocks.pop()
            if tag in CONTAINERS:
                self.holders.pop()
            self.flush()
        self.main -= tag in MAIN
        return tag

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS_P and self.blocks and self.blocks[-1][1] == "p":
            at = self.blocks[-1][0]
            while len(self.open) > at:
                self.pop()
        if tag in BLOCK:
            self.flush()
        elif tag == "br":
            self.now[1].append(" ") if self.now[1] else None
        self.now[2] += 1
        if tag in VOID:
            return
        skip = _furniture(tag, attrs, self.main > 0)
        self.main += tag in MAIN
        self.elements += 1
        self.count[tag] += 1
        if tag in BLOCK:
            self.blocks.append((len(self.open), tag, self.elements))
            if tag in CONTAINERS:
                self.holders.append(self.elements)
        self.open.append((tag, skip, self.elements))
        self.skipped += skip
        self.links += tag == "a"

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """The end of a marked section: a CDATA section's own, any other's next >; -1 for none."""
        end = "]]>" if self.rawdata.startswith("<![CDATA[", i) else ">"
        at = self.rawdata.find(end, i)
        return at + len(end) if at >= 0 else -1

    def parse_html_declaration(self, i: int) -> int:
        """As usual, but a document type may have declarations of its own in brackets."""
        inner, end = self.rawdata.find("[", i), self.rawdata.find(">", i)
        if self.rawdata[i : i + 9].lower() == "<!doctype" and 0 <= inner < end and (m := SUBSET_END.search(self.rawdata, inner)):
            return m.end()
        return super().parse_html_declaration(i)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.now[2] += 1
        if self.count[tag]:
            while self.pop() != tag:
                pass
        elif tag in BLOCK:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.now[1].append(data)
            if self.now[0] is None and not data.isspace():
                self.now[0] = self.place()
            if self.links:
                self.now[3] += len(data)


def smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing with a window of three sigmas to each side, edge values repeated."""
    reach = max(1, int(round(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def extract(html: str | None, sigma: float = 1.0, share: float = 0.5) -> str:
    """The main text of one page; empty for null, empty or text-free pages.  Malformed markup is passed over, never an error.

    Lines are the blocks that the parser's events mark off.  A line's ratio is its characters outside
    links over its tags.  Ratios are smoothed along the page; a line is strong when its smoothed ratio reaches
    share x the page's standard deviation, half of that inside an article or main element.  A region, which is
    neighbouring blocks of one kind in one container, is content when strong lines have half of its text
    or more and links less than half.  All lines of content regions are kept.
    """
    if not html:
        return ""
    p = _Lines()
    p.feed(html)
    p.close()
    p.flush()
    lines = [(at, text, tags, linked) for at, pieces, tags, linked in p.lines if (text := SPACE.sub(" ", "".join(pieces)).strip())]
    if not lines:
        return ""
    regions = np.cumsum([0, *(a[0] != b[0] for a, b in zip(lines, lines[1:], strict=False))])
    ratio = smoothed(np.array([max(0, len(x[1]) - x[3]) / max(1, x[2]) for x in lines], dtype=float), sigma)
    least = share * ratio.std() * np.array([0.5 if x[0] and x[0][2] else 1.0 for x in lines])
    size = np.array([len(x[1]) for x in lines])
    whole, strong, linked = (np.bincount(regions, x) for x in (size, size * ((ratio > 0) & (ratio >= least)), [x[3] for x in lines]))
    keep = (2 * strong >= whole) & (2 * linked < whole)
    return "\n".join(x[1] for x, r in zip(lines, regions, strict=True) if keep[r])


def _pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        text = [extract(x) for x in b["html"]]
        yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(x) for x in text]})


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text of each row of pages(page_id, url, html): page_id, url, text, n_chars (code points).

    One row out for each row in, repeated or null ids too; null html gives an empty text.  Other columns are left out; an
    empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInPandas(_pages, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
