"""Main text of web pages by composite text density (Sun, Song and Liao 2011).

Every node of a page's tree gets its characters C, tags T, link characters LC and link tags LT; its density is C / T
times a logarithm that falls with the share of links and whose base is adjusted by the page's own share. A node's sum is
that of its children's densities. The subtree of the greatest sum is the content; the least density on its path to the
body is the threshold above which its ancestors' other subtrees are content, too, unless they are mostly links. Scripts, styles, forms, navigation, headers, footers, asides and elements that name themselves adverts,
notices, menus, comments and the like by class, id or role are cut out first; if nothing is left without them, only
scripts, styles and form controls are.

The parser is lenient: unclosed and stray tags, unclosed comments and cut-off pages are read as far as they go. A
block's white space becomes one space, character references are decoded, <br> is white space, blocks are joined by a
line feed. Time and memory are linear in the page; nothing recurses.

Nulls: a null page is empty and gives ''; so do pages without text. Repeated rows stay, extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag.
TEXT = frozenset("script style textarea title".split())
#: Elements whose content goes if their own end tag closes them; all but the first two could show text, but none is the article's.
RAW = TEXT | frozenset("noscript template iframe svg math object canvas audio video select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags that only format their block's text are no nodes of their own in the densities.
FORMAT = INLINE | {"br"}
CONTROLS = frozenset("button input option optgroup datalist meter progress head".split())
ASIDE = frozenset("nav footer aside header form dialog menu address".split())
#: What an opening tag closes first: tag to (closed tags, tags that stop the search).
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|banner\w*|breadcrumbs?|comments?|commentlist|disqus|cookies?|consent|footer|masthead|menu|nav|navbar|navigation|newsletter|notices?|alert|popup|modal|promo\w*|recommend\w*|related|share|sharing|sidebar|side|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?(?:false|until))|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


class Node:
    __slots__ = ("tag", "parent", "parts", "aside", "closed")

    def __init__(self, tag: str, parent: Node | None, aside: bool = False):
        self.tag, self.parent, self.aside = tag, parent, aside
        self.closed = False  # by its own end tag
        self.parts: list[Node | str] = []


def _names_itself(tag: str, attributes: str) -> bool:
    if tag in ASIDE:
        return True
    if tag in ("html", "body", "article", "main") or "=" not in attributes and "hidden" not in attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        value = m[1] or m[2] or m[3] or ""
        if NAMED.search(value) or value.lower() in ROLES:
            return True
    return bool(HIDDEN.search(attributes))


def parse(html: str) -> tuple[Node, list[Node]]:
    """The root and all nodes, parents before children."""
    root = Node("#root", None)
    nodes, stack, at, open_tags = [root], [root], 0, {"#root": 1}
    endless: set[str] = set()  # text elements that have no end tag any more

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            open_tags[stack.pop().tag] -= 1

    for m in iter(lambda: TAG.search(html, at), None):
        if m.start() > at:
            stack[-1].parts.append(html[at : m.start()])
        at = max(m.end(), m.start() + 1)
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if open_tags.get(tag):
                depth = max(i for i in range(len(stack)) if stack[i].tag == tag)
                stack[depth].closed = True
                close_to(depth)
            elif tag == "p":
                stack[-1].parts.append(Node("p", stack[-1]))
                nodes.append(stack[-1].parts[-1])
            continue
        if tag not in INLINE and open_tags.get("p"):
            close_to(max(i for i in range(len(stack)) if stack[i].tag == "p"))
        if tag in CLOSES:
            closed, stop = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stop or stack[i].tag in RAW:
                    break
                if stack[i].tag in closed:
                    close_to(i)
                    break
        if tag == "body" and open_tags.get("head"):
            close_to(max(i for i in range(len(stack)) if stack[i].tag == "head"))
        attributes = m[3] or m[6] or ""
        node = Node(tag, stack[-1], _names_itself(tag, attributes))
        stack[-1].parts.append(node)
        nodes.append(node)
        if tag in TEXT and not attributes.endswith("/"):
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            if end:
                node.closed, at = True, end.end()
            else:
                endless.add(tag)
                if tag in ("script", "style"):  # cut off: code to the page's end
                    node.closed, at = True, len(html)
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    if at < len(html):
        stack[-1].parts.append(html[at:])
    return root, nodes


def _measure(nodes: list[Node], skip: set[int]) -> dict[int, list[int]]:
    """Characters, tags, link characters, link tags of each node that is not skipped."""
    counts: dict[int, list[int]] = {}
    in_link: set[int] = set()
    for n in nodes:
        if id(n) in skip:
            continue
        chars = sum(len("".join(p.split())) for p in n.parts if isinstance(p, str))
        if n.tag == "a" or n.parent is not None and id(n.parent) in in_link:
            in_link.add(id(n))
        counts[id(n)] = [chars, 0, chars if id(n) in in_link else 0, 0]
    for n in reversed(nodes):
        if id(n) in skip or n.parent is None:
            continue
        own, up = counts[id(n)], counts[id(n.parent)]
        up[0] += own[0]
        up[1] += own[1] + (n.tag == "a" or n.tag not in FORMAT)
        up[2] += own[2]
        up[3] += own[3] + (n.tag == "a")
    return counts


def _density(c: list[int], share: float) -> float:
    chars, tags, link_chars, link_tags = c[0], max(1, c[1]), max(1, c[2]), max(1, c[3])
    if not chars:
        return 0.0
    base = math.log(chars / max(1, chars - c[2]) * c[2] + share * chars + math.e)
    value = chars / link_chars * tags / link_tags
    return chars / tags * max(0.0, math.log(value)) / math.log(max(base, 1.0 + 1e-9)) if base > 1 else chars / tags * max(0.0, math.log(value))


def _skipped(nodes: list[Node], asides: bool) -> set[int]:
    out: set[int] = set()
    for n in nodes:
        if n.tag in RAW and n.closed or n.tag in CONTROLS or asides and n.aside or n.parent is not None and id(n.parent) in out:
            out.add(id(n))
    return out


def _content(nodes: list[Node], skip: set[int]) -> list[Node]:
    """Roots of the content, in any order."""
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    if id(body) in skip:
        return []
    counts = _measure(nodes, skip)
    whole = counts[id(body)]
    share = whole[2] / max(1, whole[0])
    density = {id(n): _density(counts[id(n)], share) for n in nodes if id(n) in counts}
    sums = dict.fromkeys(density, 0.0)
    inside = {id(body)}
    best = body
    for n in nodes:
        if id(n) in density and n.parent is not None:
            if n.tag not in FORMAT:
                sums[id(n.parent)] += density[id(n)]
            if id(n.parent) in inside:
                inside.add(id(n))
    for n in nodes:  # parents come first, so the outermost of equals stays
        if id(n) in inside and id(n) in sums and n.tag not in FORMAT and sums[id(n)] > sums[id(best)] * (1 + 1e-9):
            best = n
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(density[id(n)] for n in path)
    out = [best]
    for below, above in zip(path, path[1:]):
        for p in above.parts:
            if isinstance(p, Node) and p is not below and id(p) in density and density[id(p)] >= threshold and 2 * counts[id(p)][2] < max(1, counts[id(p)][0]):
                out.append(p)
    return out


def _blocks(roots: list[Node], nodes: list[Node], skip: set[int]) -> list[str]:
    """Text of the roots' blocks in page order."""
    chosen = {id(r) for r in roots}
    out: list[str] = []
    now: list[str] = []

    def end() -> None:
        text = " ".join(unescape("".join(now)).split())
        if text:
            out.append(text)
        now.clear()

    # an explicit stack of (node, next part, inside the content)
    stack: list[list] = [[nodes[0], 0, id(nodes[0]) in chosen]]
    while stack:
        node, k, inside = stack[-1]
        if k == len(node.parts):
            stack.pop()
            if node.tag not in INLINE:
                end()
            continue
        stack[-1][1] += 1
        part = node.parts[k]
        if isinstance(part, str):
            if inside:
                now.append(part)
        elif id(part) not in skip:
            if part.tag == "br":
                now.append(" ")
            elif part.tag not in INLINE:
                end()
            stack.append([part, 0, inside or id(part) in chosen])
        elif part.tag not in INLINE:
            end()
    end()
    return out


def extract(html: str) -> str:
    """The main text of a page."""
    _, nodes = parse(html)
    for asides in (True, False):
        skip = _skipped(nodes, asides)
        text = "\n".join(_blocks(_content(nodes, skip), nodes, skip))
        if text:
            return text
    return ""


def extracted(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) to page_id, url, text, n_chars."""
    ship(pages.sparkSession)
    source = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h) if h else "" for h in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, source.drop("html").schema.add("text", "string").add("n_chars", "long"))
