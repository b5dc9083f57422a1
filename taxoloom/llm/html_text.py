"""Main text of web pages by composite text density.

A page becomes a tree of its elements. Menus, forms, scripts and other parts that are never
article text are cut off. Every remaining node gets its link-adjusted number of characters per tag,
and the sum of its children's densities. The node with the largest sum leads to the threshold: the
smallest density on the way from it to the body. Subtrees that reach the threshold each give their
node with the largest sum; their texts, with the headings that open them, are the page's text.

Pages are independent, so the work is one pass over the table without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import prepare

# Element names of the HTML standard, and words that name parts of a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CUT = set(
    "head script style noscript template nav footer aside form button select textarea option iframe object svg canvas "
    "audio video dialog menu title".split()
)
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
    "tfoot": {"thead", "tbody", "tr", "td", "th"},
}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
SCOPES = set("html body table ul ol dl div section article aside main nav header footer form".split())
PARTS = set(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo "
    "promotion related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
_BLANK = re.compile("[ \t\n\x0b\x0c\r]+")


class _Node:
    __slots__ = (
        "tag", "parent", "children", "cut", "chars", "tags", "link_chars", "link_tags", "blocks", "density", "sum", "best"
    )

    def __init__(self, tag: str, parent: _Node | None, cut: bool = False):
        self.tag, self.parent, self.cut, self.children = tag, parent, cut, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.blocks, self.density, self.sum, self.best = False, 0.0, 0.0, self


def _is_part(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> bool:
    """Is an element a part of the page that is not the article?"""
    if tag in CUT or tag == "header" and not inside:
        return True
    if tag in ("html", "body", "main"):
        return False
    for key, value in attrs:
        value = (value or "").lower()
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id"):
            for name in value.split():
                words = re.split("[-_]+", name)
                if words[0] not in ("has", "with", "no", "without") and (words[0] in PARTS or words[-1] in PARTS):
                    return True
    return False


_DOCTYPE = re.compile(r"<!doctype[^>\[]*\[[^\]]*\]\s*>", re.I)


class _Tree(HTMLParser):
    """Elements and texts of a page, with the end tags that HTML lets authors leave out.

    ``open`` are the elements that are not closed yet, ``where`` the places of each tag among them and
    ``guards`` those of parts of the page, so no tag walks up the tree.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#page", None)
        self.open: list[_Node] = [self.root]
        self.where: dict[str, list[int]] = {}
        self.guards: list[int] = []
        self.top: set[str] = set()

    def parse_html_declaration(self, i):
        """Comments are read as such; any other declaration ends with the next ``>``, a document type after its subset."""
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        subset = _DOCTYPE.match(self.rawdata, i)
        if subset:
            return subset.end()
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def _last(self, names: set[str]) -> int:
        """The innermost open element of these names; 0, the page, without one."""
        return max((self.where[n][-1] for n in names if self.where.get(n)), default=0)

    def _leave(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        while len(self.open) > place:
            node = self.open.pop()
            self.where[node.tag].pop()
            if self.guards and self.guards[-1] == len(self.open):
                self.guards.pop()

    def _close(self, names: set[str], within: set[str]) -> None:
        place = self._last(names)
        if place and place > self._last(within - names):
            self._leave(place)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and tag in self.top:
            return
        if tag in CLOSES_P:
            self._close({"p"}, SCOPES | {"td", "th", "li"})
        if tag in SIBLINGS:
            for _ in SIBLINGS[tag]:
                self._close(SIBLINGS[tag], {"table", "ul", "ol", "dl", "select"})
        at = self.open[-1]
        child = _Node(tag, at, _is_part(tag, attrs, bool(self.where.get("article") or self.where.get("main"))))
        at.children.append(child)
        if at is self.root:
            self.top.add(tag)
        if tag not in VOID:
            self.where.setdefault(tag, []).append(len(self.open))
            if child.cut and tag not in INLINE:
                self.guards.append(len(self.open))
            self.open.append(child)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        place = self._last({tag})
        # A stray end tag does not leave a part of the page.
        if place and (tag in SCOPES or not self.guards or self.guards[-1] <= place):
            self._leave(place)

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _in_order(top: _Node) -> list[_Node]:
    """Nodes below and including ``top`` that are not cut off, parents first."""
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, _Node) and not c.cut]
    return out


def _ratio(a: float, b: float) -> float:
    return a / (b or 1)


def _count(node: _Node, link: bool) -> None:
    """Set a node's counts from those of its children."""
    own = sum(len(_BLANK.sub("", c)) for c in node.children if isinstance(c, str))
    below = [c for c in node.children if isinstance(c, _Node) and not c.cut]
    node.chars = own + sum(c.chars for c in below)
    node.tags = sum(c.tags + 1 for c in below)
    node.link_tags = sum(c.link_tags + (c.tag == "a") for c in below)
    node.link_chars = node.chars if link else sum(c.link_chars for c in below)
    node.blocks = any(c.tag not in INLINE or c.blocks for c in below)


def _weigh(node: _Node, share: float) -> None:
    """Set a node's density; ``share`` of the page's characters are in links."""
    plain = _ratio(node.chars, node.tags)
    base = math.log(_ratio(node.chars, node.chars - node.link_chars) * node.link_chars + share * node.chars + math.e)
    if base > 1 and node.chars:
        # Characters and tags per link character and link tag; the more links a page has, the less they count for.
        weight = math.log(_ratio(node.chars, node.link_chars) * max(_ratio(node.tags, node.link_tags), 1)) / math.log(base)
        plain *= max(weight, 0.0)
    node.density = plain


def _measure(body: _Node) -> None:
    """Set every node's counts, density, sum of densities, and the node with the largest sum in its subtree."""
    nodes = _in_order(body)
    for node in reversed(nodes):
        _count(node, node.tag == "a")
    share = _ratio(body.link_chars, body.chars)
    for node in reversed(nodes):
        _weigh(node, share)
        below = [c for c in node.children if isinstance(c, _Node) and not c.cut]
        # Formatting inside a line is no part of the page's layout: it counts as tags, not as a subtree.
        node.sum = sum(c.density for c in below if c.tag not in INLINE)
        node.best = max([node, *(c.best for c in below)], key=lambda n: n.sum)


def _parts(node: _Node, share: float) -> list[_Node]:
    """A node's children that are not cut off; texts and formatting between them stand together as one subtree."""
    if not node.blocks:
        return []
    out: list[_Node] = []
    run: list = []

    def end():
        if run:
            loose = _Node("#run", node)
            loose.children = list(run)
            _count(loose, False)
            _weigh(loose, share)
            if loose.chars:
                out.append(loose)
        run.clear()

    for child in node.children:
        if isinstance(child, str) or child.tag in INLINE and not child.blocks:
            run.append(child)
        else:
            end()
            if not child.cut:
                out.append(child)
    end()
    return out


def _opened(part: _Node) -> list[_Node]:
    """Headings that open a section for what follows a node beside it."""
    among = part.children if part.tag in ("header", "hgroup") else [part]
    return [n for n in among if isinstance(n, _Node) and n.tag in HEADINGS and n.chars and not n.cut]


def _starts_with(node: _Node) -> str:
    """The tag of the heading that a subtree starts with; a tag behind all headings without one."""
    while node.tag not in HEADINGS:
        first = next((c for c in node.children if (c.strip() if isinstance(c, str) else c.chars and not c.cut)), "")
        if isinstance(first, str):
            return "h7"
        node = first
    return node.tag


def _chosen(body: _Node) -> list[_Node]:
    """The subtrees whose text is the article, in page order.

    Each subtree that reaches the threshold gives its node with the largest sum, and so do those
    beside and below it that are not inside such a node. A heading goes with the subtrees whose
    section it opens: those after it inside its parent, up to a heading of its rank.
    """
    _measure(body)
    threshold, node = body.best.density, body.best
    while node is not body:
        node = node.parent
        threshold = min(threshold, node.density)
    share = _ratio(body.link_chars, body.chars)
    marked: set[int] = set()
    order: dict[_Node, int] = {}
    found: dict[_Node, None] = {}
    stack: list[tuple[_Node, tuple[_Node, ...]]] = [(body, ())]
    while stack:
        node, opened = stack.pop()
        order[node] = len(order)
        if node.density >= threshold and node.chars:
            marked.add(id(node.best))
        if id(node) in marked:
            first = _starts_with(node)
            found.update(dict.fromkeys([*(h for h in opened if h.tag < first), node]))
            continue
        below = []
        for part in _parts(node, share):
            below.append((part, opened))
            for heading in _opened(part):
                opened = (*(h for h in opened if h.tag < heading.tag), heading)
        stack += reversed(below)
    return sorted(found, key=order.__getitem__)


def _blocks(top: _Node) -> list[str]:
    out: list[str] = []
    parts: list[str] = []

    def end():
        if text := _BLANK.sub(" ", "".join(parts)).strip(" "):
            out.append(text)
        parts.clear()

    stack: list = [top]
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            parts.append(item)
        elif item.tag == "br":
            parts.append(" ")
        elif not item.cut or item is top:
            if item.tag not in INLINE:
                end()
                stack.append(None)
            stack += reversed(item.children)
    end()
    return out


def main_text(html: str | None) -> str:
    """The article of one page: its blocks, joined by an empty line."""
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    nodes = _in_order(tree.root)
    body = next((n for n in nodes if n.tag == "body"), tree.root)
    return "\n\n".join(block for node in _chosen(body) for block in _blocks(node))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Character references are decoded; white space inside a block becomes one blank; blocks are
    trimmed and joined in page order by two line feeds. A null or empty page, and one without any
    article text, gives an empty text. Broken markup is read as far as it goes. Null ids and
    urls stay as they are, repeated rows are extracted each, other columns are not read, and
    an empty table gives an empty result.
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string").withColumn(
        "n_chars", F.char_length("text").cast("long")
    )
