"""HTML extraction by scoring the element tree.

A page is read into a tree of elements. Elements that never hold an article
(navigation, forms, scripts and the like, or with such a class, id or role) are
left out. Some parts of a class, id or role tell so wherever they stand in the name
(comments, ads, sidebars and the like), others only if the whole name consists of
such parts. What a class, id, role, style or form leaves out is kept all the same if
it holds most of the page's paragraph points, and over ``SPARED_LEAST`` (comments: all
of them), or, left out by one part of its name, the page's only h1. Every paragraph scores for its length
and commas and passes the points
up: all of them to its parent, half to the grandparent, a third and a quarter
further up. A container's points are discounted by the share of its text that is
links. The best container is kept, with those siblings that score enough or read
like a paragraph of the text. Its blocks, in page order, are the text.

Defined results: null or empty html gives an empty text; so does a page without
text outside the left-out elements; a page without paragraphs gives the best
container's plain text; unclosed and cut-off markup is read as browsers do for
the cases that occur (implied ends of paragraphs and list items); repeated rows
give equal rows; an empty table stays empty; extra columns are kept, but one named
``text`` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Elements of the HTML standard by how they are treated here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title noembed noframes xmp svg math".split())
LEFT_OUT = frozenset(
    "nav header footer aside form button select option dialog menu head canvas object audio video map label fieldset".split()
)
BLOCKS = frozenset(
    "p div article section main body html h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table thead tbody tfoot tr td th "
    "caption figure figcaption hr address details summary center".split()
)
PARAGRAPHS = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS | {"nav", "header", "footer", "aside", "form"}
#: An opening tag ends an open element of these kinds, up to the nearest of the boundary kinds.
IMPLIED_END = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
}
#: Left out unless most of the page is inside; scripts of some sites wrap whole pages in one form.
WRAPPERS = frozenset("form fieldset label".split())
#: Parts of class, id or role names that tell what is not the article wherever they stand in a name.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist disqus replies "
    "cookie cookies nav navbar navigation sidebar footer related recommended newsletter promo promoted sponsor sponsored "
    "sponsors".split()
)
#: Those of them that tell of what readers wrote, which may be longer than the article.
OF_READERS = frozenset("comment comments commentlist disqus replies".split())
#: Such names that tell so only as a whole, since an article has headers, tags or forms of its own.
WEAK = frozenset(
    "banner reply respond consent gdpr notice notices alert warning popup modal overlay side rail widget widgets menu pager "
    "pagination toolbar topbar masthead header foot copyright legal share sharing social follow subscribe subscription "
    "signup login register recommendations promotion teaser tags search form skip hidden feedback complementary "
    "contentinfo".split()
)
#: Parts that a weak name may have besides: "header-links" is as boilerplate as "header".
NEUTRAL = frozenset("site global box bar block wrapper container inner list links buttons area".split())
#: A name with one of these tells what its element has or lacks, not what it is.
HEDGES = frozenset("has with no not without".split())
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.DOTALL,
)
#: One attribute with its value, so that no name is looked for inside the values of others.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
PARAGRAPH_LEAST = 25
LEVEL_SHARES = (1.0, 0.5, 1 / 3, 0.25)
SIBLING_SHARE, SIBLING_LEAST = 0.2, 10.0
#: More points than a paragraph without commas has at 200 characters: an ad is not the text of a page that has few words.
SPARED_LEAST = 3.0


class Node:
    __slots__ = ("kind", "parent", "children", "out", "doubtful", "by_part", "of_readers", "score", "size", "linked")

    def __init__(self, kind: str, parent: Node | None, out: bool, doubtful: bool = False):
        self.kind, self.parent, self.out, self.doubtful = kind, parent, out, doubtful
        self.by_part = self.of_readers = False
        self.children: list[Node | str] = []
        self.score = 0.0
        self.size = self.linked = 0


#: Whether an element is left out: not, by a strong part of a longer name, or plainly.
KEPT, LEFT_BY_PART, LEFT = 0, 1, 2


def _named(token: str) -> int:
    parts = [part.lower() for part in _PART.findall(token) if not part.isdigit()]
    if any(part in STRONG or part in WEAK for part in parts) and all(
        part in STRONG or part in WEAK or part in NEUTRAL for part in parts
    ):
        return LEFT
    return LEFT_BY_PART if not STRONG.isdisjoint(parts) and HEDGES.isdisjoint(parts) else KEPT


def _boilerplate(kind: str, attributes: str) -> tuple[int, bool]:
    """Whether the element is left out, and whether as readers' comments."""
    found, of_readers = KEPT, False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return LEFT, False
        if name == "style":
            if re.search(r"display\s*:\s*none", value, re.IGNORECASE):
                return LEFT, False
        elif name in ("class", "id", "role") and kind != "h1":
            for token in value.split():
                named = _named(token)
                found = max(found, named)
                of_readers = of_readers or named > KEPT and not OF_READERS.isdisjoint(p.lower() for p in _PART.findall(token))
    return found, of_readers


def tree(html: str) -> Node:
    root = node = Node("#root", None, False)
    at = 0
    for_raw: str | None = None
    while at < len(html):
        if for_raw:
            end = re.compile(rf"</{re.escape(for_raw)}\s*>", re.IGNORECASE).search(html, at)
            at, for_raw = (end.end() if end else len(html)), None
            continue
        match = _MARKUP.search(html, at)
        stop = match.start() if match else len(html)
        if stop > at:
            node.children.append(html[at:stop])
        if not match:
            break
        at = match.end()
        if not match[2]:
            continue
        kind, attributes = match[2].lower(), match[3]
        if match[1]:
            open_node: Node | None = node
            while open_node is not None and open_node.kind != kind:
                # An end tag doesn't reach out of a block of another kind, except from inline elements and paragraphs.
                if open_node.kind in BLOCKS | LEFT_OUT and kind not in BLOCKS | LEFT_OUT:
                    open_node = None
                    break
                open_node = open_node.parent
            if open_node is not None and open_node.parent is not None:
                node = open_node.parent
            continue
        if kind in RAW:
            for_raw = None if attributes.rstrip().endswith("/") and kind in ("svg", "math") else kind
            continue
        if kind in CLOSES_P:
            open_node = node
            while open_node is not None and open_node.kind not in (BLOCKS | LEFT_OUT) - {"p"} and open_node.kind != "p":
                open_node = open_node.parent
            if open_node is not None and open_node.kind == "p":
                node = open_node.parent or root
        if kind in IMPLIED_END:
            ended, within = IMPLIED_END[kind]
            open_node = node
            while open_node is not None and open_node.kind not in within:
                if open_node.kind in ended:
                    node = open_node.parent or root
                open_node = open_node.parent
        named, of_readers = (KEPT, False) if kind in ("html", "body", "article", "main") else _boilerplate(kind, attributes)
        child = Node(kind, node, kind in LEFT_OUT or named > KEPT, kind not in LEFT_OUT - WRAPPERS)
        child.by_part, child.of_readers = named == LEFT_BY_PART and kind not in LEFT_OUT, of_readers
        node.children.append(child)
        if kind not in VOID:
            node = child
    _leave_out(root)
    return root


def _leave_out(root: Node) -> None:
    """Passes ``out`` down, except from doubtful elements that hold most of the page's paragraph points.

    An element left out by a part of its name alone also stays if it holds the page's only h1.
    """
    found, todo, doubts = [], [root], False
    while todo:
        node = todo.pop()
        if node.out and not node.doubtful:
            continue
        found.append(node)
        doubts = doubts or node.out
        todo.extend(c for c in node.children if isinstance(c, Node))
    if doubts:
        points: dict[Node, float] = {}
        for node in reversed(found):
            inside = [c for c in node.children if isinstance(c, Node)]
            node.size = sum(c.size if isinstance(c, Node) else len(c.strip()) for c in node.children)
            node.linked = node.size if node.kind == "a" else sum(c.linked for c in inside)
            points[node] = sum(points.get(c, 0.0) for c in inside)
            if _is_paragraph(node):
                points[node] += (1 + _commas(node) + min(node.size / 100, 3)) * (1 - _link_density(node))
        titles = [node for node in found if node.kind == "h1"]
        above: Node | None = titles[0] if len(titles) == 1 else None
        while above is not None:
            above.out = above.out and not above.by_part
            above = above.parent
        for node in found:
            # Comments may outgrow the article, so they stay only where the page has no other paragraph.
            most = points[node] >= points[root] if node.of_readers else points[node] > points[root] / 2
            if node.out and most and points[node] > SPARED_LEAST:
                node.out = False
                if node.of_readers:  # the page has nothing else, so the comments inside are its text too
                    for other in found:
                        other.out = other.out and not other.of_readers
        for node in found:
            node.size = node.linked = 0
    todo = [root]
    while todo:
        node = todo.pop()
        for child in node.children:
            if isinstance(child, Node):
                child.out = child.out or node.out
                todo.append(child)


def _is_paragraph(node: Node) -> bool:
    own = node.kind in PARAGRAPHS or (
        node.kind in ("div", "section", "article") and not any(isinstance(c, Node) and c.kind in BLOCKS for c in node.children)
    )
    return own and node.kind not in HEADINGS and node.size >= PARAGRAPH_LEAST


def _ordered(root: Node) -> list[Node]:
    """All elements not left out, parents first; without recursion, since pages may nest deeply."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.out:
            found.append(node)
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return found


def _measure(nodes: list[Node]) -> None:
    """Characters of text and of linked text in every element."""
    for node in reversed(nodes):
        for child in node.children:
            if isinstance(child, str):
                node.size += len(child.strip())
            elif not child.out:
                node.size += child.size
                node.linked += child.linked
        if node.kind == "a":
            node.linked = node.size


def _link_density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def _commas(node: Node) -> int:
    total, todo = 0, [node]
    while todo:
        for child in todo.pop().children:
            if isinstance(child, str):
                total += child.count(",") + child.count("،") + child.count("、") + child.count("，")
            elif not child.out and child.kind not in PARAGRAPHS:
                todo.append(child)
    return total


def best_container(nodes: list[Node]) -> Node:
    for node in nodes:
        if not _is_paragraph(node):
            continue
        points = 1 + _commas(node) + min(node.size / 100, 3)
        parent = node.parent
        for share in LEVEL_SHARES:
            if parent is None or parent.out:
                break
            parent.score += points * share
            parent = parent.parent
    # Inline elements and single paragraphs are never the container.
    able = [n for n in nodes if n.kind in BLOCKS - PARAGRAPHS | {"#root", "td", "blockquote"} and n.kind != "html"]
    best = max(able, key=lambda n: n.score * (1 - _link_density(n)))
    if best.score > 0:
        return best
    # No paragraph: the innermost article, main or body that has text, else the page.
    for kind in ("article", "main", "body"):
        named = [n for n in nodes if n.kind == kind and n.size]
        if named:
            return max(named, key=lambda n: n.size)
    return nodes[0]


def _kept_siblings(best: Node) -> list[Node | str]:
    if best.parent is None or best.kind in ("body", "article", "main"):
        return [best]
    least = max(SIBLING_LEAST, best.score * (1 - _link_density(best)) * SIBLING_SHARE)
    kept: list[Node | str] = []
    for other in best.parent.children:
        if other is best:
            kept.append(other)
        elif isinstance(other, Node) and not other.out:
            density = _link_density(other)
            reads = other.kind in PARAGRAPHS and other.size and density < (0.25 if other.size > 80 else 0.01)
            if other.score * (1 - density) >= least or reads or other.kind in ("section", "article") and density < 0.5:
                kept.append(other)
    return kept


def blocks(kept: list[Node | str]) -> list[str]:
    """Texts of the blocks in page order, white space made plain."""
    found: list[str] = []
    text: list[str] = []

    def end_block() -> None:
        plain = _SPACE.sub(" ", unescape("".join(text))).strip()
        if plain:
            found.append(plain)
        text.clear()

    todo: list[Node | str | None] = list(reversed(kept))
    while todo:
        item = todo.pop()
        if item is None:
            end_block()
        elif isinstance(item, str):
            text.append(item)
        elif not item.out:
            if item.kind in BLOCKS:
                end_block()
                todo.append(None)
            elif item.kind == "br":
                text.append(" ")
            todo.extend(reversed(item.children))
    end_block()
    return found


def main_text(html: str) -> str:
    nodes = _ordered(tree(html))
    _measure(nodes)
    best = best_container(nodes)
    # A container inside an article stands for that article, which has the heading too.
    node: Node | None = best
    while node is not None:
        if node.kind in ("article", "main"):
            best = node
        node = node.parent
    return "\n\n".join(blocks(_kept_siblings(best)))


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text``."""

    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) if isinstance(x, str) else "" for x in batch], dtype=object)

    return pages.withColumn("text", F.pandas_udf(extract, "string")(F.col(html)))


def op6_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extracted(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
