"""Main text of HTML pages.

The standard library's streaming parser turns a page into lines, one per block of text, each with its
number of tags. The text-to-tag ratio of the lines, smoothed by a Gaussian, is split into two clusters;
the lines of the upper cluster locate the content regions: the innermost container that holds most of
their text, and the containers beside it that are mostly such lines. All blocks of these regions are kept, short ones too, but for those that the markup itself
calls something else (menus, adverts, forms, comments).

A class, id or role that names such a part drops an element only if the article is elsewhere: not if it
encloses an article or main element, nor if next to no text is outside it.

Defined results: null and empty pages give an empty text; rows with equal keys are each extracted;
unclosed and stray tags are closed as the next block demands; marked sections and other malformed
declarations are comments; time is linear in the page, however deep its elements are nested; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of HTML: elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that neither begin nor end a block of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements whose content is never text of the article.
DROPPED = frozenset("nav aside footer button select option textarea input script style noscript template head title iframe object embed svg canvas audio video map dialog menu".split())
#: Elements that are dropped as named parts are: unless they enclose the article.
SUSPECT = frozenset(["form"])
#: Containers that can be the content region.
REGIONS = frozenset("html body main article section div td center".split())
#: Words in class, id or role that name parts which are not the article.
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form gdpr login masthead menu modal nav navbar navigation "
    "newsletter notice notices pager pagination popup promo promotion recommended related replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Before such a word, these say that something else is meant (a page with a sidebar).
MODIFIERS = frozenset("with without has have no not hide show".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the key ends an open element of the values that lies above the nearest container.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("html body main article section div td th table ul ol dl nav aside header footer form blockquote".split())
_TOKENS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Block:
    """A line: text, tags met in it, characters inside links, and the innermost node around it."""

    __slots__ = ("linked", "node", "tags", "text")

    def __init__(self, text: str, tags: int, linked: int, node: int):
        self.text, self.tags, self.linked, self.node = text, tags, linked, node

    @property
    def plain(self) -> int:
        """Characters outside links."""
        return max(0, len(self.text) - self.linked)


class Node:
    """A container or a part that is suspected not to be the article. Nodes are numbered in page order, so those below node k are k + 1 to its last."""

    __slots__ = ("last", "suspect", "tag", "up")

    def __init__(self, tag: str, up: int, suspect: bool, last: int):
        self.tag, self.up, self.suspect, self.last = tag, up, suspect, last


def _names_part(value: str) -> tuple[bool, bool]:
    """(whether a class, id or role names a part that is not the article; whether it names a header)."""
    part = header = False
    for name in value.lower().split():
        words = _TOKENS.findall(name)
        for before, word in zip(["", *words], words, strict=False):
            if before not in MODIFIERS:
                part = part or word in PARTS
                header = header or word == "header"
    return part, header


class PageLines(HTMLParser):
    """Streams a page into blocks; open elements are (tag, dropped, node)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.nodes: list[Node] = [Node("", -1, False, 0)]
        self._open: list[tuple[str, int, int]] = []
        #: places in _open of the open elements of a tag, and of those that bound what a start tag may close
        self._places: dict[str, list[int]] = {}
        self._scopes: list[int] = []
        self._node = 0
        self._dropped = 0
        self._heading_only = 0
        self._parts: list[str] = []
        self._tags = self._linked = 0

    def _end_block(self) -> None:
        if self._parts:
            text = _SPACE.sub(" ", "".join(self._parts)).strip()
            if text:
                self.blocks.append(Block(text, self._tags, self._linked, self._node))
                self._tags = 0
            self._parts.clear()
            self._linked = 0

    def _in_article(self) -> bool:
        return bool(self._places.get("article") or self._places.get("main"))

    def _kind(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        """0: kept, 1: dropped, 2: headings are kept (the header of an article), 3: suspect."""
        if tag in ("html", "body", "main"):
            return 0
        if tag == "header":
            return 2 if self._in_article() else 1
        if tag in DROPPED:
            return 1
        if tag in INLINE or tag in HEADINGS:
            return 0
        found = 3 if tag in SUSPECT else 0
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return 1
            if value and name in ("class", "id", "role"):
                part, header = _names_part(value)
                if part or header and not self._in_article():
                    found = 3
                elif header and tag != "article":
                    found = found or 2
        return found

    def _close(self) -> None:
        tag, kind, node = self._open.pop()
        self._places[tag].pop()
        if tag in _SCOPE:
            self._scopes.pop()
        if kind == 1:
            self._dropped -= 1
        elif kind == 2:
            self._heading_only -= 1
        if node >= 0:
            self.nodes[node].last = len(self.nodes) - 1
            self._node = self.nodes[node].up

    def _close_to(self, tags: set[str] | frozenset[str]) -> None:
        """Ends the innermost open element of tags, and what is open in it, unless a container lies between."""
        at = max((self._places[t][-1] for t in tags if self._places.get(t)), default=-1)
        if at >= 0 and at >= (self._scopes[-1] if self._scopes else 0):
            while len(self._open) > at:
                self._close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += not self._dropped
        if tag in VOID:
            if tag not in INLINE:
                if tag == "br":
                    self._parts.append(" ")
                else:
                    self._end_block()
            return
        if tag not in INLINE:
            self._end_block()
            self._close_to({"p"})
            if tag in _CLOSES:
                self._close_to(_CLOSES[tag])
        kind = self._kind(tag, attrs)
        node = -1
        if tag in REGIONS or kind == 3:
            node = len(self.nodes)
            self.nodes.append(Node(tag, self._node, kind == 3, node))
            self._node = node
            self._tags = 1  # what stands before a container says nothing of its first line
        if tag in _SCOPE:
            self._scopes.append(len(self._open))
        self._places.setdefault(tag, []).append(len(self._open))
        self._open.append((tag, kind, node))
        if kind == 1:
            self._dropped += 1
        elif kind == 2:
            self._heading_only += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._tags += not self._dropped
        if tag not in INLINE:
            self._end_block()
        if self._places.get(tag):
            at = self._places[tag][-1]
            if tag in INLINE and self._scopes and at < self._scopes[-1]:
                return
            while len(self._open) > at:
                self._close()

    def handle_data(self, data: str) -> None:
        if self._dropped or self._heading_only and not any(self._places.get(h) for h in HEADINGS):
            return
        self._parts.append(data)
        if self._places.get("a"):
            self._linked += len(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Marked sections are no part of HTML: a comment up to the next end of a tag."""
        return self.parse_bogus_comment(i, report)

    def finish(self) -> list[Block]:
        self.close()
        self._end_block()
        while self._open:
            self._close()
        self.nodes[0].last = len(self.nodes) - 1
        return self.blocks


def smoothed(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing; at the ends the kernel is renormalised."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    total, out = len(values), []
    for i in range(total):
        lo, hi = max(0, i - reach), min(total, i + reach + 1)
        weights = [kernel[abs(j - i)] for j in range(lo, hi)]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi], strict=True)) / sum(weights))
    return out


def two_means(values: list[float]) -> float:
    """The threshold between two clusters on the line (Lloyd's iteration from the extremes); at equal values everything is above."""
    low, high = min(values), max(values)
    cut = (low + high) / 2
    for _ in range(30):
        below, above = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not below or not above:
            return low
        new = (sum(below) / len(below) + sum(above) / len(above)) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def _sums(values: list[tuple[int, int]], nodes: list[Node]) -> list[int]:
    """Sum of the values (node, amount) at and below each node."""
    out = [0] * len(nodes)
    for node, amount in values:
        out[node] += amount
    for k in range(len(nodes) - 1, 0, -1):
        out[nodes[k].up] += out[k]
    return out


def _dropped_parts(blocks: list[Block], nodes: list[Node], least: int, most_outside: float) -> list[bool]:
    """Of each node whether it lies in a suspect part that is not the article."""
    inner = [0] * len(nodes)  # innermost suspect at or above, 0 for none
    for k, node in enumerate(nodes[1:], 1):
        inner[k] = k if node.suspect else inner[node.up]
    size = _sums([(b.node, b.plain) for b in blocks], nodes)
    own = [0] * len(nodes)
    for b in blocks:
        own[inner[b.node]] += b.plain
    articles = [k for k, n in enumerate(nodes) if n.tag in ("article", "main") and not n.suspect]
    holds = [False] * len(nodes)
    for k in articles:
        while k > 0 and not holds[k]:
            holds[k] = True
            k = nodes[k].up
    outside, gone = own[0], [False] * len(nodes)
    kept: set[int] = set()
    for k in sorted((k for k, n in enumerate(nodes) if n.suspect), key=lambda k: (-size[k], k)):  # what encloses comes first
        above = inner[nodes[k].up]
        if above and above not in kept:
            continue
        if holds[k] or not articles and size[k] >= least and outside <= most_outside * size[k]:
            kept.add(k)
            outside += own[k]
    for k, node in enumerate(nodes[1:], 1):
        gone[k] = gone[node.up] or node.suspect and k not in kept
    return gone


def _outermost(found: list[int], nodes: list[Node]) -> list[int]:
    """Those of the ascending nodes that lie in no other of them."""
    out: list[int] = []
    for k in found:
        if not out or k > nodes[out[-1]].last:
            out.append(k)
    return out


def _regions(blocks: list[Block], nodes: list[Node], content: list[bool], share: float) -> tuple[set[int], set[int]] | None:
    """(nodes whose blocks are all kept; single blocks kept beside them), None where only the page as a whole holds the content."""
    weight = _sums([(b.node, b.plain) for b, c in zip(blocks, content, strict=True) if c], nodes)
    text = _sums([(b.node, b.plain) for b in blocks], nodes)
    whole = weight[0]
    chars = _sums([(b.node, len(b.text)) for b in blocks], nodes)
    worth = [c > 0 and (w > 0 or 2 * t >= c) for w, t, c in zip(weight, text, chars, strict=True)]  # more than links
    named = _outermost([k for k, n in enumerate(nodes) if n.tag in ("article", "main") and worth[k]], nodes)
    if whole and sum(weight[k] for k in named) >= share * whole:
        chosen, scopes = [], []
        for k in named:
            inside = [j for j in range(k + 1, nodes[k].last + 1) if nodes[j].tag == "article" and worth[j]] if nodes[k].tag == "main" else []
            inside = _outermost(inside, nodes)
            if inside and sum(weight[j] for j in inside) >= share * weight[k]:
                chosen += inside
                scopes.append(k)
            else:
                chosen.append(k)
    else:
        fit = [k for k in range(1, len(nodes)) if whole and weight[k] >= share * whole]
        if not fit or nodes[fit[-1]].tag in ("html", "body"):
            return None
        chosen, scopes = [fit[-1]], [0]
    held = [False] * len(nodes)  # nodes that enclose a chosen one
    covered = [False] * len(nodes)
    for k in chosen:
        covered[k] = True
        at = nodes[k].up
        while at >= 0 and not held[at]:
            held[at] = True
            at = nodes[at].up
    beside: set[int] = set()
    for k, node in enumerate(nodes[1:], 1):
        if covered[node.up]:
            covered[k] = True
        elif not covered[k] and not held[k] and held[node.up] and any(s < k <= nodes[s].last for s in scopes):
            covered[k] = weight[k] > 0 and 2 * weight[k] >= text[k]  # a container beside the region
    for i, (block, is_content) in enumerate(zip(blocks, content, strict=True)):
        if is_content and held[block.node] and any(s <= block.node <= nodes[s].last for s in scopes):
            beside.add(i)
    return {k for k in range(len(nodes)) if covered[k]}, beside


def main_text(page: str, sigma: float = 1.0, share: float = 0.6, least: int = 250, most_outside: float = 0.1) -> str:
    """The article of one page, a block a line.

    share: of the content's text that the innermost container has to hold, before containers beside it join. least,
    most_outside: a named part of so many characters is the article if no more than that share of it is outside.
    """
    parser = PageLines()
    parser.feed(page)
    blocks, nodes = parser.finish(), parser.nodes
    gone = _dropped_parts(blocks, nodes, least, most_outside)
    blocks = [b for b in blocks if not gone[b.node]]
    if not blocks:
        return ""
    ratios = smoothed([math.log1p(b.plain / (1 + b.tags)) for b in blocks], sigma)
    threshold = two_means(ratios)
    content = [r >= threshold for r in ratios]
    found = _regions(blocks, nodes, content, share)
    if found is None:
        inside = [i for i, c in enumerate(content) if c]
        first, last = inside[0], inside[-1]
        # what stands beside the first and the last in the same container, a title for one, belongs to them
        while first and blocks[first - 1].node == blocks[first].node and 2 * blocks[first - 1].linked <= len(blocks[first - 1].text):
            first -= 1
        while last + 1 < len(blocks) and blocks[last + 1].node == blocks[last].node and 2 * blocks[last + 1].linked <= len(blocks[last + 1].text):
            last += 1
        return "\n".join(b.text for i, b in enumerate(blocks) if first <= i <= last and (content[i] or 2 * b.linked <= len(b.text)))
    kept, beside = found
    return "\n".join(b.text for i, b in enumerate(blocks) if b.node in kept or i in beside)


def extract_main_text(pages: DataFrame, sigma: float = 1.0, share: float = 0.6, keys: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """keys, text and n_chars (its code points) of every row of pages."""
    schema = T.StructType([pages.schema[k] for k in keys] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, sigma, share) if page else "" for page in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keys, "text", "n_chars"])

    return pages.select(*keys, F.col(html_col).alias("_html")).mapInArrow(run, schema)
