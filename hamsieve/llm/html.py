"""Main text of web pages by tag-path ratios.

Every block of text has a path of tags from the root to where it stands. Text length and punctuation
are summed per path and divided by the path's blocks, smoothed over the page's order, multiplied,
and cut at their standard deviation: the paths above it are content. The main text is what stands in
the articles that reach the cut, or else in the smallest container around the content, apart from the
parts that are something else: by their element (menus, footers, forms), or by a name (sidebars, notices,
adverts, comments) that is not just a word in a longer one, unless the ratio is low there and no article around.

A page is read once from left to right, in time proportional to its length however broken it is.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas textarea select title audio video".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp
    small span strike strong sub sup time tt u var wbr""".split()
)
CONTAINERS = frozenset(("article", "main"))
NOT_CONTENT = frozenset("nav footer aside form button dialog menu head fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promoted promotion
    sidebar side rail menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies
    consent notice notices gdpr privacy popup modal overlay banner banners alert share sharing social related recommended
    newsletter subscribe signup subscription login search widget widgets toolbar pagination pager skip disclaimer paywall""".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Words that say nothing beside a name.
PLAIN = frozenset(
    """site page main global left right top bottom upper lower primary secondary first last box list block wrap wrapper container
    inner outer area section item items content bar col column row unit slot text user thread form js""".split()
)
#: Elements that a name can make something else.
NAMED = frozenset("div section ul ol dl table header figure center details article span".split())
#: Start tags that close an open element of the same group.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "p": ("p",),
}
#: Elements that such a closing never reaches across.
SCOPES = frozenset("table ul ol dl body article main section div td th select".split())

_TAG_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_UNQUOTED = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"[\x20\x09-\x0D\xa0]+")
_SIGNS = re.compile(r"[.,;:!?…。，、！？]")
_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


class _Tags:
    """The page's text runs, tags and what stands in neither, in order."""

    def __init__(self, page: str):
        self.page = page
        self.at = 0
        self.ends: dict[str, tuple[int, int]] = {}
        # Opening quotes from which no tag ends.
        self.dead: set[int] = set()
        self.last = page.rfind(">")

    def _end(self, at: int) -> int:
        """Place of the sign that ends a tag whose name ends at ``at``; a quote that never closes is a sign like others."""
        if at > self.last:
            return -1
        seen = []
        place = at
        while True:
            place = _UNQUOTED.match(self.page, place).end()
            if place >= len(self.page):
                break
            if self.page[place] == ">":
                return place
            if place in self.dead:
                break
            seen.append(place)
            place = self.page.find(self.page[place], place + 1) + 1
            if not place:
                break
        self.dead.update(seen)
        return self.page.find(">", at)

    def __iter__(self) -> Iterator[tuple[str, bool, str, str]]:
        """Text before, is it an end tag, name, attributes; the name is empty where there is no tag."""
        page, start, place = self.page, 0, 0
        while True:
            place = page.find("<", place)
            if place < 0:
                break
            end = -1
            name = closing = attributes = ""
            if page.startswith(("<!", "<?"), place):
                close = {"<!--": "-->", "<![CDATA[": "]]>"}
                mark = next((m for m in close if page.startswith(m, place)), "")
                end = page.find(close.get(mark, ">"), place + max(len(mark), 2))
                end = len(page) if end < 0 else end + len(close.get(mark, ">"))
            else:
                closing = page[place + 1 : place + 2] == "/"
                m = _TAG_NAME.match(page, place + 1 + closing)
                if m:
                    last = self._end(m.end())
                    if last >= 0:
                        name, attributes, end = m[0].lower(), page[m.end() : last], last + 1
            if end < 0:
                place += 1
                continue
            self.at = end
            yield page[start:place], bool(closing), name, attributes
            start = place = self.at
        yield page[start:], False, "", ""

    def _next_end(self, tag: str) -> tuple[int, int]:
        """Start and end of the next end tag; beyond the page if there is none. What was found serves until it is passed."""
        found = self.ends.get(tag)
        if found is None or found[0] < self.at:
            m = _END[tag].search(self.page, self.at)
            found = self.ends[tag] = m.span() if m else (len(self.page) + 1,) * 2
        return found

    def has_end(self, tag: str) -> bool:
        return self._next_end(tag)[0] <= len(self.page)

    def skip_past(self, tag: str) -> bool:
        """Go on behind the next end tag; False if there is none."""
        if self.has_end(tag):
            self.at = self._next_end(tag)[1]
            return True
        return False


@dataclass
class _Node:
    """A block element: parents are pointers, paths are shared."""

    parent: _Node | None
    path: int
    tag: str
    #: What its name says it is ("", "part", "comments"), and is that all that it says?
    other: str
    sure: bool
    in_article: bool
    blocks: int = 0
    weight: float = 0.0


@dataclass
class _Block:
    text: str
    node: _Node
    linked: int

    @property
    def path(self) -> int:
        return self.node.path

    @property
    def ratio(self) -> float:
        own = len(self.text) - min(self.linked, len(self.text))
        return own * (1.0 + (len(_SIGNS.findall(self.text)) if own else 0))


def _named(attributes: str) -> tuple[str, bool, bool]:
    """What an element's role, class or id says it is, if not main text; is that all that it says; is it its class?"""
    found = ("", False, False)
    for kind, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        kind = kind.lower()
        if kind == "role":
            if value.strip().lower() in ROLES:
                return "role", True, True
            continue
        for name in value.split():
            words = {w.lower() for w in _WORD.findall(name) if not w.isdigit()}
            what = "comments" if words & COMMENTS else "part" if words & NAMES else ""
            if what:
                sure = words <= NAMES | COMMENTS | PLAIN
                found = max(found, (what, sure, kind == "class"), key=lambda f: (f[1], f[2], f[0] == "part"))
    return found


class _Page:
    """Blocks of text in order, read from the tags with a stack of open elements."""

    def __init__(self, page: str):
        self.blocks: list[_Block] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.stack: list[tuple[str, _Node, bool]] = []
        # Places in the stack, per tag, of blocks, and of scopes.
        self.places: dict[str, list[int]] = {}
        self.outer: list[int] = []
        self.scopes: list[int] = []
        self.hidden = self.inside = self.links = 0
        self.parts: list[str] = []
        self.linked = 0
        self.root = _Node(None, 0, "", "", False, False)
        tags = _Tags(page)
        for text, closing, tag, attributes in tags:
            if text:
                value = html.unescape(text) if "&" in text else text
                self.parts.append(value)
                if self.links:
                    self.linked += len(value.strip())
            if tag == "br":
                self.parts.append(" ")
            elif tag and closing:
                self.end(tag)
            elif tag:
                self.begin(tags, tag, attributes)
        self.flush()

    def node(self) -> _Node:
        return self.stack[self.outer[-1]][1] if self.outer else self.root

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip(" ")
            if text and not self.hidden:
                self.blocks.append(_Block(text, self.node(), self.linked))
        self.parts, self.linked = [], 0

    def close(self, k: int) -> None:
        """Close the elements from place ``k`` on."""
        if self.outer and self.outer[-1] >= k:
            self.flush()
        while len(self.stack) > k:
            tag, _, hides = self.stack.pop()
            self.places[tag].pop()
            for of, places in ((self.outer, tag not in INLINE), (self.scopes, tag in SCOPES)):
                if places:
                    of.pop()
            self.hidden -= hides
            self.inside -= tag in CONTAINERS
            self.links -= tag == "a"

    def end(self, tag: str) -> None:
        places = self.places.get(tag)
        # An inline end tag does not close blocks.
        if places and (tag not in INLINE or not self.outer or places[-1] > self.outer[-1]):
            self.close(places[-1])

    def begin(self, tags: _Tags, tag: str, attributes: str) -> None:
        empty = attributes.endswith("/")
        if tag in ("script", "style"):
            if not empty and not tags.skip_past(tag):
                tags.at = len(tags.page)
            return
        if tag in RAW:
            # One that never ends is empty; one that holds no elements is passed over.
            if empty or not tags.has_end(tag):
                return
            if tag in ("title", "textarea", "iframe", "noscript"):
                tags.skip_past(tag)
                return
        block = tag not in INLINE
        if block:
            self.flush()
            # A block start closes an open paragraph, and a list item or cell the one before it.
            for closed in (CLOSES.get(tag, ()), () if tag == "p" else ("p",)):
                place = max((self.places[c][-1] for c in closed if self.places.get(c)), default=-1)
                if place >= 0 and (not self.scopes or place >= self.scopes[-1]):
                    self.close(place)
        if tag in VOID or empty:
            return
        above = self.node()
        node = above
        hides = tag in RAW or tag in NOT_CONTENT or (tag == "header" and not self.inside)
        if block:
            path = self.paths.setdefault((above.path, tag), len(self.paths) + 1)
            other, sure = "", False
            if tag in NAMED and attributes:
                other, sure, by_class = _named(attributes)
                hides = hides or other == "role"
                # Ids inside an article are those of its headings and sections.
                if self.inside and not by_class:
                    other, sure = "", False
            node = _Node(above, path, tag, other, sure, self.inside > 0)
        k = len(self.stack)
        self.stack.append((tag, node, hides))
        self.places.setdefault(tag, []).append(k)
        if block:
            self.outer.append(k)
        if tag in SCOPES:
            self.scopes.append(k)
        self.hidden += hides
        self.inside += tag in CONTAINERS
        self.links += tag == "a"


def blocks_of(page: str) -> list[_Block]:
    """The page's blocks of text in order, without those of elements that are not content."""
    return _Page(page).blocks


def _smooth(values: np.ndarray) -> np.ndarray:
    """Weighted mean over two blocks on each side, by a Gaussian of width one."""
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    padded = np.pad(values, 2)
    weight = np.convolve(np.pad(np.ones(len(values)), 2), kernel, "valid")
    return np.convolve(padded, kernel, "valid") / weight


def content_paths(blocks: list[_Block]) -> tuple[set[int], float]:
    """The paths whose fused ratio reaches the standard deviation of all blocks' ratios, and that deviation."""
    length: dict[int, float] = {}
    signs: dict[int, float] = {}
    number: dict[int, int] = {}
    for b in blocks:
        # What is a link is no running text.
        own = len(b.text) - min(b.linked, len(b.text))
        length[b.path] = length.get(b.path, 0) + own
        signs[b.path] = signs.get(b.path, 0) + (len(_SIGNS.findall(b.text)) if own else 0)
        number[b.path] = number.get(b.path, 0) + 1
    text = _smooth(np.array([length[b.path] / number[b.path] for b in blocks]))
    mark = _smooth(np.array([signs[b.path] / number[b.path] for b in blocks]))
    fused = text * (1 + mark)
    mean: dict[int, list[float]] = {}
    for b, f in zip(blocks, fused, strict=True):
        mean.setdefault(b.path, []).append(f)
    score = {p: sum(v) / len(v) for p, v in mean.items()}
    cut = min(float(fused.std()), max(score.values()))
    return {p for p, v in score.items() if v >= cut and length[p] > 0}, cut


def _summed(blocks: list[_Block]) -> list[_Node]:
    """All elements around the blocks, inner ones first, each with its number of blocks and the sum of their ratios."""
    seen: dict[int, _Node] = {}
    for b in blocks:
        b.node.blocks += 1
        b.node.weight += b.ratio
        node = b.node
        while node is not None and id(node) not in seen:
            seen[id(node)] = node
            node = node.parent
    depth: dict[int, int] = {}
    for node in seen.values():
        chain = []
        while node is not None and id(node) not in depth:
            chain.append(node)
            node = node.parent
        d = depth[id(node)] if node is not None else -1
        for n in reversed(chain):
            d += 1
            depth[id(n)] = d
    order = sorted(seen.values(), key=lambda n: -depth[id(n)])
    for node in order:
        if node.parent is not None:
            node.parent.blocks += node.blocks
            node.parent.weight += node.weight
    return order


def _without_others(blocks: list[_Block]) -> list[_Block]:
    """The blocks that stand in no part that is named as something else."""
    if not blocks:
        return blocks
    _, cut = content_paths(blocks)
    dropped: set[int] = set()
    for node in reversed(_summed(blocks)):
        low = node.weight < cut * node.blocks
        # A name must be all that is said; beside an article a low ratio makes up for other words.
        named = node.other and (node.sure or (low and not node.in_article))
        if named or (node.parent is not None and id(node.parent) in dropped):
            dropped.add(id(node))
    return [b for b in blocks if id(b.node) not in dropped]


def _tops(blocks: list[_Block]) -> dict[int, _Node | None]:
    """Per element: the outermost article around it."""
    top: dict[int, _Node | None] = {}
    for b in blocks:
        chain = []
        node: _Node | None = b.node
        while node is not None and id(node) not in top:
            chain.append(node)
            node = node.parent
        above = top[id(node)] if node is not None else None
        for n in reversed(chain):
            above = above or (n if n.tag in CONTAINERS else None)
            top[id(n)] = above
    return top


def _around(nodes: list[_Node]) -> _Node:
    """The smallest element that holds all ``nodes``; of one node alone its parent."""
    shared: list[_Node] = []
    node: _Node | None = nodes[0]
    while node is not None:
        shared.append(node)
        node = node.parent
    place = {id(n): k for k, n in enumerate(shared)}
    low = 0
    seen: set[int] = set()
    for node in nodes[1:]:
        while id(node) not in place and id(node) not in seen:
            seen.add(id(node))
            node = node.parent
        low = max(low, place.get(id(node), 0))
    return shared[1] if low == 0 and len({id(n) for n in nodes}) == 1 and len(shared) > 2 else shared[low]


def _within(blocks: list[_Block], container: _Node) -> list[_Block]:
    known = {id(container): True}
    for b in blocks:
        chain = []
        node: _Node | None = b.node
        while node is not None and id(node) not in known:
            chain.append(node)
            node = node.parent
        for n in chain:
            known[id(n)] = node is not None and known[id(node)]
    return [b for b in blocks if known[id(b.node)]]


def main_text(page: str) -> str:
    """Main text of one page; its blocks are joined by two line ends. Empty if there is none."""
    blocks = _without_others(blocks_of(page))
    if not blocks:
        return ""
    paths, cut = content_paths(blocks)
    content = [b for b in blocks if b.path in paths]
    if not content:
        return ""
    top = _tops(blocks)
    length = sum(len(b.text) for b in content)
    if 2 * sum(len(b.text) for b in content if top[id(b.node)] is not None) > length:
        # Content in articles: all of them that reach the cut.
        ratio: dict[int, list[float]] = {}
        for b in blocks:
            if top[id(b.node)] is not None:
                ratio.setdefault(id(top[id(b.node)]), []).append(b.ratio)
        best = max(sum(r) / len(r) for r in ratio.values())
        kept = {k for k, r in ratio.items() if sum(r) / len(r) >= min(cut, best)}
        return "\n\n".join(b.text for b in blocks if top[id(b.node)] is not None and id(top[id(b.node)]) in kept)
    # No article: the container of the content, without its lists of links.
    container = _around([b.node for b in content])
    return "\n\n".join(b.text for b in _within(blocks, container) if b.path in paths or 2 * b.linked <= len(b.text))


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``df``: id, url, ``text`` and ``n_chars`` (its code points).

    A null or empty page, or one without text, has an empty text. Pages are read whole, however
    broken: unclosed elements reach to where their container ends, stray end tags are ignored. Nulls in
    id and url are kept; repeated rows are extracted each; an empty table gives no rows; further
    columns are ignored. No rows are shuffled.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[id_col, url_col, "text", "n_chars"],
            )

    rows = df.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias(url_col), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("_html"))
    return rows.mapInArrow(extract, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")
