"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|</?[a-zA-Z][^>]*\Z|</[^a-zA-Z>][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Fixed values of HTML: elements without content, of raw text, that start a block, and that an opening tag closes
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - frozenset("body caption html legend li dd dt option tbody td tfoot th thead tr summary".split()) | {"li", "dd", "dt"}
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
_DROPPED = frozenset("head script style noscript template svg math iframe object embed canvas audio video form button select textarea input label dialog menu title xmp noembed noframes".split())
_FURNITURE = frozenset("nav footer aside".split())
_PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre ul ol dl table figure".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())
_BOXES = frozenset("div section ul ol span center table".split())
# Class names and ids of boxes that are furniture: made of such words, and of words that only say where or which
_NOISE = frozenset("ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager share sharing social related recommended footer masthead copyright login comment comments disqus respond replies reply".split())
_NEUTRAL = frozenset("box bar block wrapper wrap container content inner outer list item items area section left right top bottom header banner slot unit links icons buttons form message site page thread".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
_CONTENT = frozenset(("html", "body", "article", "main"))
# What a box beside the chosen one must hold of that one's characters to belong to it
SHARE = 0.1


class _Node:
    __slots__ = ("tag", "parent", "children", "dropped", "aside", "away", "chars", "tags", "link_chars", "link_tags", "holds", "density", "total")

    def __init__(self, tag: str, parent: _Node | None):
        self.tag, self.parent, self.children, self.dropped, self.aside, self.away = tag, parent, [], False, False, False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.holds, self.density, self.total = tag in ("article", "main"), 0.0, 0.0


def _noise(tag: str, attributes: str) -> bool:
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id") and tag in _BOXES:
            for each in value.split():
                words = [w for w in re.split(r"[^a-z]+", each) if w]
                if not _NOISE.isdisjoint(words) and all(w in _NOISE or w in _NEUTRAL for w in words):
                    return True
        if name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def parse(page: str) -> _Node:
    """A tree of elements and strings. Missing end tags are supplied; raw text of dropped elements is left out."""
    root = _Node("#document", None)
    stack, at, n = [root], 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at:
            stack[-1].children.append(html.unescape(page[at:stop]))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            depth = len(stack) - 1
            while depth and stack[depth].tag != tag:
                if tag not in _BLOCK and stack[depth].tag in _BLOCK:
                    depth = 0  # the end of an inline element does not close the block around it
                    break
                depth -= 1
            if depth:
                del stack[depth:]
            elif tag == "p":
                stack[-1].children.append(_Node("p", stack[-1]))
            continue
        if tag in _CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    del stack[depth:]
                    break
                if stack[depth].tag in _BLOCK:
                    break
        if tag in _IMPLIED:
            closes, until = _IMPLIED[tag]
            lowest = 0
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in until:
                    break
                if stack[depth].tag in closes:
                    lowest = depth
            if lowest:
                del stack[lowest:]
        attributes = m[3]
        node = _Node(tag, stack[-1])
        node.dropped = tag in _DROPPED
        node.aside = tag in _FURNITURE or tag == "header" and not any(s.tag in ("article", "main") for s in stack)
        if not node.dropped and attributes and tag not in _CONTENT and _noise(tag, attributes):
            node.dropped = None  # unless the article is in it
        stack[-1].children.append(node)
        if node.holds:
            for s in stack:
                s.holds = True
        if tag in _VOID or attributes.endswith("/") and tag in ("svg", "math"):
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|</{re.escape(tag)}\Z", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack.append(node)
    return root


def _measure(root: _Node) -> list[_Node]:
    """Counts, composite densities and sums of child densities of all kept elements, children before parents.

    With C characters and T tags below an element, LC and LT of them in links, the density is C / T times the logarithm of
    (C / LC) (T / LT) to the base ln(C / (C - LC) * LC + LCb / Cb * C + e), where Cb and LCb are those of the whole page: the more
    of a text is links, the less dense it is. Furniture by its tag adds to no sum.
    """
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.dropped is None:
            node.dropped = not node.holds
        if node.dropped:
            continue
        node.away = node.aside or node.parent is not None and node.parent.away
        order.append(node)
        todo += [c for c in node.children if not isinstance(c, str)]
    order.reverse()
    for node in order:
        for c in node.children:
            if isinstance(c, str):
                node.chars += len("".join(c.split()))
            elif not c.dropped:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    for node in order:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, root.chars, root.link_chars)
        for c in node.children:
            if not isinstance(c, str) and not c.dropped and not c.aside:
                node.total += c.density
    return order


def density(chars: int, tags: int, link_chars: int, link_tags: int, all_chars: int, all_links: int) -> float:
    """Composite text density; counts of 0 count as 1 where they divide."""
    if not chars:
        return 0.0
    base = math.log(chars / max(1, chars - link_chars) * link_chars + all_links / max(1, all_chars) * chars + math.e)
    ratio = chars / max(1, link_chars) * max(1, tags) / max(1, link_tags)
    return chars / max(1, tags) * math.log(max(ratio, 1.0)) / math.log(max(base, math.e))


def _choose(root: _Node) -> _Node:
    """The element whose text is the page's; what lies within it and does not belong to it is marked as dropped.

    The element of the highest sum of child densities is taken, or the box in it that holds all but SHARE of its characters, and
    the least density on its path from the body is the threshold. From there the choice is widened upwards: an ancestor is taken
    if it holds, beside the choice, elements that belong to it, and what else it holds beside is dropped. Headings belong to it
    unless they are links for the greater part, and so does prose (paragraphs, lists, tables, sections, articles) that lies deeper
    than the body; of other elements those that are as dense as the threshold and have SHARE of the choice's characters. The
    choice reaches at least to the article element that it lies in, of which everything belongs to it.
    """
    order = _measure(root)
    best = max([x for x in order if not x.away] or [root], key=lambda x: (x.total, x.chars, -x.tags))
    if not best.total:
        return root
    while True:
        # what is nearly all of the choice is the choice
        inner = max((x for x in best.children if not isinstance(x, str) and not x.dropped and not x.aside), key=lambda x: x.chars)
        if inner.tag in _PROSE or not inner.total or inner.chars < (1 - SHARE) * best.chars:
            break
        best = inner
    path = [best]
    while path[-1].parent is not None and path[-1].tag != "body":
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)

    def belongs(x, node, parent) -> bool:
        if x.aside:
            return False
        links = x.link_chars / max(1, x.chars)
        if parent.tag != "body" and (x.tag in _PROSE or x.tag in ("article", "section")) or x.tag in _HEADINGS:
            return links <= 0.5
        return links <= 0.5 and x.density >= threshold and x.chars >= SHARE * node.chars

    article = max((i for i, x in enumerate(path) if x.tag == "article"), default=0)
    chosen, pending = path[article], []
    for node, parent in zip(path[article:], path[article + 1 :]):
        beside = [x for x in parent.children if not isinstance(x, str) and x is not node and not x.dropped and x.chars]
        gain = [x for x in beside if belongs(x, node, parent)]
        pending += [x for x in beside if x not in gain]
        if gain or parent.tag == "main":
            for x in pending:
                x.dropped = True
            chosen, pending = parent, []
    return chosen


def main_text(page: str | None) -> str:
    """The blocks of the chosen element, one to a line, white space within a block being one space."""
    if not page:
        return ""
    return _text(_choose(parse(page)))


def _text(node: _Node) -> str:
    blocks, words = [], []

    def flush():
        text = " ".join("".join(words).split())
        if text:
            blocks.append(text)
        words.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            words.append(x)
        elif x is None:
            flush()
        elif not x.dropped and (x is node or not x.aside):
            if x.tag == "br":
                words.append(" ")
            if x.tag in _BLOCK:
                flush()
                todo.append(None)
            todo += reversed(x.children)
    flush()
    return "\n".join(blocks)


def extract_text(column: Column | str = "html") -> Column:
    """Main text of a column of whole pages; empty for null, for empty pages, and where there is no text."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    return run(column)
