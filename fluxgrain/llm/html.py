"""Main-text extraction by line-block distribution.

Markup is stripped to lines, one for each block element. A line has a text length: its code points outside links
(in headings, links count too); 0 for what
markup itself names as no article (menus, headers, footers, sidebars, notices, adverts, forms, reader comments) and, in a page
with text in an article or main element, for all lines outside it. Lengths are summed over sliding windows of WINDOW lines. Where
the sums rise from nothing to the threshold a surge begins, where they fall to nothing again it dives; the lines between the two
points are the text, from the first to the last one that has a length. A stretch whose sums stay under the threshold is no
article, inside an article element too. The threshold is SURGE code points, or half of the page's largest sum where that is less,
so that a page of a few words keeps them.

Elements are matched by their exact names, roles and whole class or id names; attributes are parsed, so that words in other
attributes or inside longer names say nothing.

Defined cases: null and empty html give an empty text; very long html is read once from left to right, in memory for one page;
unclosed elements end with their parents; unclosed comments, scripts and tags are dropped to the end of the page; character
references are decoded once; white space inside a block becomes one space, a line break element too; repeated rows are extracted
each; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrain.llm.common import slices, small_batches

WINDOW = 3
SURGE = 80

# fixed values: element names, roles and whole class or id names
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|title|select|canvas|audio|video"
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROP = frozenset("nav aside footer form button dialog menu head".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comment-list commentlist cookie cookies cookie-banner cookie-notice disqus footer masthead menu navbar navigation newsletter notice notices pagination popup promo reader-comments related-links share-buttons sidebar site-footer site-header skip-link social-links sponsored subscribe toolbar".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
CLOSES = {"head": BLOCKS - {"head", "html"}, "p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option"}}

_ATTRIBUTES = r"(?:[^>\"'=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[=\"'])*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")


def _marked(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether the element's name or role says that it is no part of an article, and whether its class or id says so."""
    if name in DROP or name == "header" and not inside:
        return True, False
    if not attributes or name in ("html", "body", "main"):
        return False, False
    named = False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value.strip() in ROLES:
            return True, False
        if key in ("class", "id") and not NAMES.isdisjoint(value.split()):
            named = True
    return False, named


class Line(NamedTuple):
    text: str
    marked: bool  # no article, by an element's name or role
    named: bool  # no article, by a class or id
    inside: bool  # in an article or main element
    linked: int  # code points in links


def lines(page: str) -> list[Line]:
    """The blocks with text."""
    out: list[Line] = []
    stack: list[tuple[str, tuple[bool, bool]]] = []
    open_: dict[str, int] = {}  # how many elements of each name are open
    marked = named = inside = links = heads = 0
    text: list[str] = []
    linked = 0

    def add(node: str) -> None:
        nonlocal linked
        text.append(node)
        if links and not heads:
            linked += len("".join(node.split()))

    def flush() -> None:
        nonlocal linked
        if text:
            if joined := " ".join("".join(text).split()):
                out.append(Line(joined, marked > 0, named > 0, inside > 0, linked))
            text.clear()
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal marked, named, inside, links, heads
        while len(stack) > k:
            name, flags = stack.pop()
            open_[name] -= 1
            marked -= flags[0]
            named -= flags[1]
            inside -= name in ("article", "main")
            links -= name == "a"
            heads -= name in HEADS

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if m[2]:
            if open_.get(name):
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                pop_to(k)
        elif name not in VOID:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES and name in CLOSES[stack[k][0]]:
                    pop_to(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
            flags = _marked(name, m[4], inside > 0)
            if m[4].endswith("/") and name not in BLOCKS:
                continue
            stack.append((name, flags))
            open_[name] = open_.get(name, 0) + 1
            marked += flags[0]
            named += flags[1]
            inside += name in ("article", "main")
            links += name == "a"
            heads += name in HEADS
    if at < len(page):
        add(html.unescape(page[at:]))
    flush()
    return out


def lengths(found: list[Line]) -> list[int]:
    """The text length of each line."""
    size = [0 if x.marked or x.named else max(0, len("".join(x.text.split())) - x.linked) for x in found]
    if any(n and x.inside for n, x in zip(size, found, strict=True)):
        size = [n if x.inside else 0 for n, x in zip(size, found, strict=True)]
    return size


def stretches(size: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """First and last line of each stretch between a surge and its dive."""
    n = len(size)
    upto = [0] * (n + window)
    for i in range(n + window - 1):
        upto[i + 1] = upto[i] + (size[i] if i < n else 0)
    sums = [upto[i + window] - upto[i] for i in range(n)]
    least = min(surge, max(sums, default=0) / 2)
    out, i = [], 0
    while i < n:
        if not sums[i]:
            i += 1
            continue
        first = i
        while i < n and sums[i]:
            i += 1
        if max(sums[first:i]) >= least:  # the window of the surge's first line may begin before the text, that of its last ends with it
            while not size[first]:
                first += 1
            out.append((first, i - 1))
    return out


def extract(page: str) -> str:
    """The main text of a page, its blocks joined by line feeds."""
    found = lines(page)
    return "\n".join(x.text for a, b in stretches(lengths(found)) for x in found[a : b + 1] if not x.marked and not x.named)


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "html"):
            out = [extract(x or "") for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(out, pa.string()), "n_chars": pa.array(map(len, out), pa.int64())})


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    small_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.col("html")).mapInArrow(_kernel, f"page_id {kind}, url string, text string, n_chars long")
