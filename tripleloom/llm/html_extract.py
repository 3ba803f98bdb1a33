"""Main text of HTML pages by composite text density.

Each node of the page's tree has a density, its characters per tag, weighed
down by the share of its characters and tags that are links.  The density sum
of a node adds up the densities of its children; the node with the largest sum
sets a threshold, the least density on its path to the body, and of every
subtree at or above the threshold the node with the largest sum is content.
A node
grows to the one around it as long as that is denser than the threshold and adds
no more linked than other characters, so titles and other short blocks of a text
stay with it.
The base of the density's logarithm is kept at two or more, so that pages
without links have a finite density.
Elements that never hold an article (scripts, menus and the like) are taken out
of the tree before; forms and what only its class or id calls noise too, unless
that holds most of the page.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that are turned into Python objects at a time.
FEW_PAGES = 32

#: Elements without an end tag, and elements that stand on lines of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What never holds an article: by element, by role, and by words of class and id.
NEVER = frozenset("script style noscript template head title nav footer aside button select option textarea input iframe object embed svg canvas dialog menu audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer gdpr masthead menu menus modal nav navbar navigation newsletter notice notices overlay pagination pager popup privacy promo promos promotion related recommended recommendations "
    "replies reply respond share sharing sidebar sidebars sidenav skip social sponsor sponsored sponsors subscribe subscription teaser toolbar topbar widget widgets".split()
)
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Unlinked characters that something to read has at least.
PARAGRAPH = 200
#: What a word of a class says about its state, not what it is.
STATE_FIRST, STATE_LAST = frozenset("has no not with without".split()), frozenset("enabled disabled".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Start tags that end an open paragraph, and elements that end one of their own kind.
_CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "summary", "figcaption"}
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
_STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "option": ("select",)}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_BLANKS = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "parts", "noise", "doubtful", "comments", "first", "last", "hidden", "plain", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, noise: bool = False, doubtful: bool = False, comments: bool = False):
        self.tag, self.parent, self.noise, self.doubtful, self.comments, self.parts = tag, parent, noise, doubtful, comments, []
        self.first, self.last, self.hidden = 0, 0, False  # places in page order of the node and of its last descendant; inside of noise
        self.plain = self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0

    def children(self):
        return (x for x in self.parts if isinstance(x, Node))


def _is_noise(tag: str, attributes: str, inside_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element is noise, whether that is in doubt, and whether it is comments."""
    if tag in NEVER or tag == "header" and not inside_article:
        return True, False, False
    form = tag == "form"
    if not attributes.strip(" /") or tag in ("html", "body", "article", "main"):
        return form, form, False
    given = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attributes)}
    role = given.get("role", "").lower()
    if "hidden" in given or given.get("aria-hidden") == "true" or _HIDDEN.search(given.get("style", "")) or role in ROLES:
        return True, False, False
    words: set[str] = set()
    for name in f"{given.get('class', '')} {given.get('id', '')}".lower().split():
        parts = [w for w in _SPLIT.split(name) if w]
        if parts and parts[0] not in STATE_FIRST and parts[-1] not in STATE_LAST:
            words.update(parts)
    doubtful = form or role == "form" or not NOISE.isdisjoint(words)
    return doubtful, doubtful, not COMMENTS.isdisjoint(words)


def _number(root: Node) -> None:
    """Number all nodes in page order; a node's descendants are the numbers up to its last."""
    n, todo = 0, [(root, False)]
    while todo:
        node, done = todo.pop()
        if done:
            node.last = n
            continue
        n += 1
        node.first = n
        todo.append((node, True))
        todo.extend((c, False) for c in reversed(list(node.children())))


def _settle(root: Node) -> None:
    """Keep doubtful nodes that hold most of the page's unlinked characters, so
    that densities decide.  They stay noise if an article or main element has a
    paragraph elsewhere, comments if the page has; but they don't empty a page."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.noise or node.doubtful:
            nodes.append(node)
            todo.extend(node.children())
    if not any(n.doubtful for n in nodes):
        return
    for node in reversed(nodes):
        if node.tag != "a":
            node.plain += sum(len(_BLANKS.sub("", x)) for x in node.parts if isinstance(x, str))
            if node.parent is not None:
                node.parent.plain += node.plain
    articles = [n for n in nodes if n.tag in ("article", "main") and n.plain >= PARAGRAPH]
    _hide(nodes)
    settled = True
    for node in nodes:  # parents first; those that hold most of the page hold one another
        if node.doubtful and node.plain >= PARAGRAPH and 2 * node.plain > root.plain:
            rest = root.plain - node.plain if node.comments else 0
            if articles and not settled:
                _hide(nodes)
                settled = True
            for other in articles:
                if other is not node and not _within(other, node) and not other.hidden:
                    rest = max(rest, other.plain - (node.plain if _within(node, other) else 0))
            node.noise = rest >= PARAGRAPH
            settled = settled and node.noise
    _hide(nodes)
    doubtful = [n for n in nodes if n.noise and not (n.parent is not None and n.parent.hidden)]
    if root.plain and sum(n.plain for n in doubtful) == root.plain:
        for node in doubtful:
            node.noise = False


def _hide(nodes: list[Node]) -> None:
    """Mark the nodes, parents first, that are noise or inside of it."""
    for node in nodes:
        node.hidden = node.noise or node.parent is not None and node.parent.hidden


def parsed(page: str) -> Node:
    """The tree of a page, as browsers would read it in the main: open elements
    are closed where their parents end, an unfinished tag at the end is dropped."""
    root = Node("html", None)
    stack, at, raw = [root], 0, ""
    open_ = Counter(["html"])

    def close(k: int) -> None:
        for node in stack[k:]:
            open_[node.tag] -= 1
        del stack[k:]

    while at < len(page):
        if raw:  # text up to the end tag, whatever stands in it
            end = re.compile(rf"</{raw}(?=[\s/>]|\Z)", re.I).search(page, at)
            at, raw = (end.start() if end else len(page)), ""
            continue
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            stack[-1].parts.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name or not m[0].endswith(">"):
            continue
        tag, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            for k in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
            continue
        if tag in _CLOSES_P and open_["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in _SIBLINGS and any(open_[x] for x in _SIBLINGS[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _SIBLINGS[tag]:
                    close(k)
                    break
                if stack[k].tag in _STOPS[tag]:
                    break
        if tag in ("html", "body") and open_[tag]:
            continue
        node = Node(tag, stack[-1], *_is_noise(tag, attributes, bool(open_["article"] or open_["main"])))
        stack[-1].parts.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
            open_[tag] += 1
            raw = tag if tag in RAW else ""
    return root


def _ordered(root: Node) -> list[Node]:
    """Nodes outside of noise, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.noise:
            out.append(node)
            todo.extend(reversed(list(node.children())))
    return out


def _weigh(root: Node, nodes: list[Node]) -> None:
    for node in reversed(nodes):
        node.chars += sum(len(_BLANKS.sub("", x)) for x in node.parts if isinstance(x, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags + (node.tag == "a")
    base = root.link_chars / max(root.chars, 1)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        plain = max(c - node.link_chars, 1)
        node.density = c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(math.log(c / plain * node.link_chars + base * c + math.e**2)) if c else 0.0
        if node.parent is not None:
            node.parent.total += node.density


def content_nodes(root: Node) -> list[Node]:
    """The nodes that hold the page's content, in page order."""
    _number(root)
    _settle(root)
    nodes = _ordered(root)
    _weigh(root, nodes)
    body = next((n for n in nodes if n.tag == "body"), root)
    inside = [n for n in nodes if n.chars and (n is body or _within(n, body))]
    if not inside:
        return []
    places = [n.first for n in inside]
    best = max(inside, key=lambda n: n.total)
    threshold, node = best.density, best
    while node is not body and node.parent is not None:
        node = node.parent
        threshold = min(threshold, node.density)
    if best is body:
        return [body]
    chosen, path = [_grown(best, body, threshold)], []
    up = chosen[0]
    while up is not body and up.parent is not None:
        path.append(up)
        up = up.parent
    path.append(up)
    for below, node in zip(path, path[1:]):  # what stands beside the path
        for top in node.children():
            if top is not below and not top.noise and top.chars and top.density >= threshold:
                members = inside[bisect_left(places, top.first) : bisect_right(places, top.last)]
                chosen.append(_grown(max(members, key=lambda n: n.total), node, threshold))
    return sorted(chosen, key=lambda n: n.first)


def _grown(node: Node, end: Node, threshold: float) -> Node:
    """The node, or the outermost node around it (below ``end``) such that each step
    outwards stays above the threshold and adds no more linked characters than others.

    Short blocks that lead a text, like its title, have low densities of their own; the node that
    holds them and the text is as dense as the text.
    """
    while node.parent is not None and node.parent is not end:
        up = node.parent
        if up.density <= threshold or 2 * (up.link_chars - node.link_chars) > up.chars - node.chars:
            break
        node = up
    return node


def _within(node: Node, other: Node) -> bool:
    return other.first < node.first <= other.last


def blocks_of(node: Node) -> list[str]:
    """The texts of a node's blocks in page order."""
    out, line = [], []

    def end():
        text = _BLANKS.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            out.append(text)

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        elif not x.noise:
            if x.tag == "br":
                line.append(" ")
            elif x.tag in BLOCK:
                end()
                todo.append(None)
            todo.extend(reversed(x.parts))
    end()
    return out


def main_text(page: str) -> str:
    root = parsed(page)
    return "\n".join(b for n in content_nodes(root) for b in blocks_of(n))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """One row per input row: id, url, ``text`` (blocks joined by line feeds,
    empty if there is none), ``n_chars``.

    Null and empty pages have no text.  Text outside of any element counts as
    the body's.  Very long and deeply nested pages are read whole, in time
    linear in their length.  Repeated rows are treated alike, other columns are
    ignored, no rows give no rows.
    """
    kept = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string"))
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, FEW_PAGES):
                part = batch.slice(start, FEW_PAGES)
                texts = [main_text(p or "") for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return kept.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
