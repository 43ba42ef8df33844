"""A small tolerant HTML reader: block elements as a flat tree, with the text blocks between their tags."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

#: A tag after its "<": every part is possessive, so that no input makes it look at a character twice; a ">" within a
#: quoted value does not end it.  The plain form, for what follows a tag that never ends, ends at the first ">".
_TAG = re.compile(r"(/?)([A-Za-z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?+|[\"'])*+)>")
_PLAIN = re.compile(r"(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_HREF = re.compile(r"(?:^|[\s\"'/])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*))", re.I)
_ATTR = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Elements whose content is no text of the page: code, labels of controls, and what stands in where a browser shows something else.
SILENT = frozenset("script style noscript template iframe svg annotation annotation-xml head title textarea select option button object video audio canvas datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: Elements that leave an open head open, as its end tag may be left out.
IN_HEAD = frozenset("base basefont bgsound link meta noframes script style template title noscript head html".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var ruby rt rp picture".split()) | frozenset(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics".split()
)
#: Elements that an opening tag of a name closes, as their end tags may be left out.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody"}}
_STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}}


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    tokens: list[str]
    children: list[int] = field(default_factory=list)
    own: int = 0  # characters of text directly in it
    linked: int = 0  # of these, in links
    marks: int = 0  # of these, sentence punctuation
    inline: int = 0  # inline tags directly in it


@dataclass(slots=True)
class Page:
    nodes: list[Node]
    blocks: list[tuple[int, str]]  # (node, text), in page order
    links: list[str] = field(default_factory=list)  # targets of its links as written, in page order


def attribute_tokens(raw: str) -> list[str]:
    if "=" not in raw:
        return []
    return [t.lower() for m in _ATTR.finditer(raw) for t in _PART.findall(m[2] or m[3] or m[4] or "")]


class _Scanner:
    """Tags by position.  Whatever the input, its characters are read a bounded number of times."""

    def __init__(self, html: str):
        self.html, self.last, self.plain = html, html.rfind(">"), False
        self.unended: set[str] = set()

    def tag(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, name, attributes) of the next tag; a comment or declaration has no name."""
        html = self.html
        while (at := html.find("<", at)) >= 0:
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(html), False, "", ""
            if at > self.last:
                at = html.find("<!--", at)
                return (at, len(html), False, "", "") if at >= 0 else None
            c = html[at + 1 : at + 2]
            if c == "!" or c == "?":
                return at, html.find(">", at) + 1, False, "", ""
            if c == "/" or c.isascii() and c.isalpha():
                m = (_PLAIN if self.plain else _TAG).match(html, at + 1)
                if m is None and not self.plain and (m := _PLAIN.match(html, at + 1)):
                    self.plain = True
                if m:
                    return at, m.end(), bool(m[1]), m[2].lower(), m[3]
            at += 1
        return None

    def raw_end(self, tag: str, at: int) -> int:
        """Where the raw text element ends that began before ``at``; -1 without its end tag."""
        if tag in self.unended:
            return -1
        stop = _raw_stop(tag).search(self.html, at)
        end = self.html.find(">", stop.end()) if stop else -1
        if end < 0:
            self.unended.add(tag)
            return -1
        return end + 1


@lru_cache(maxsize=64)
def _raw_stop(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?![\w-])", re.I)


class _Open:
    """Open elements in order, with the places of each name, so that none has to be looked for."""

    def __init__(self) -> None:
        self.items: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, what: int) -> None:
        self.places.setdefault(tag, []).append(len(self.items))
        self.items.append((tag, what))

    def last(self, tag: str) -> int:
        """The place of the last open element of a name, or -1."""
        own = self.places.get(tag)
        return own[-1] if own else -1

    def cut(self, k: int) -> None:
        """Close all from place ``k`` on."""
        while len(self.items) > k:
            self.places[self.items.pop()[0]].pop()


def _ended(html: str) -> set[int]:
    """Where the silent elements begin that have their end tag before that of an element around them."""
    ended: set[int] = set()
    scan, stack, at = _Scanner(html), _Open(), 0
    while found := scan.tag(at):
        start, at, closing, tag, attributes = found
        if not tag:
            continue
        if closing:
            k = stack.last(tag)
            if k >= 0:
                if tag in SILENT:
                    ended.add(stack.items[k][1])
                stack.cut(k)
        elif tag in RAW and not attributes.endswith("/"):
            at = max(at, scan.raw_end(tag, at))
        elif tag not in VOID and tag not in INLINE and tag != "head" and not attributes.endswith("/"):
            stack.push(tag, start)
    return ended


def parse(html: str) -> Page:
    """Nodes are the elements that are neither inline nor silent, in order of their opening tags; node 0 is the page.

    A silent element without its end tag silences nothing, but for raw text; a head ends where something begins that
    it cannot hold.  A tag that never ends is text.  The time is linear in the length of ``html``.
    """
    page = _read(html, None)
    return page if page is not None else _read(html, _ended(html))


def _read(html: str, ended: set[int] | None) -> Page | None:
    """The page, where of the silent elements those that begin at ``ended`` count; all if None, and None if one lacks its end tag."""
    nodes = [Node("#page", -1, 0, [])]
    blocks: list[tuple[int, str]] = []
    targets: list[str] = []
    scan, stack, silent = _Scanner(html), _Open(), _Open()
    stack.push("#page", 0)
    links = 0
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(unescape("".join(text)).split())
            text.clear()
            if joined:
                at = stack.items[-1][1]
                node = nodes[at]
                node.own += len(joined)
                node.linked += min(linked, len(joined))
                node.marks += sum(map(joined.count, ".,;!?"))
                blocks.append((at, joined))
        linked = 0

    def in_head() -> bool:
        return len(silent.items) == 1 and silent.items[0][0] == "head"

    at, n = 0, len(html)
    while at < n:
        found = scan.tag(at)
        end = found[0] if found else n
        if end > at:
            if in_head() and html[at:end].strip():
                silent.cut(0)
            if not silent.items:
                piece = html[at:end]
                text.append(piece)
                if links:
                    linked += len(piece)
        if found is None:
            break
        start, at, closing, tag, attributes = found
        if not tag:
            continue
        empty = attributes.endswith("/")
        if tag == "a" and not closing and (m := _HREF.search(attributes)):
            targets.append(unescape(m[1] or m[2] or m[3] or "").strip())
        if not closing and tag not in IN_HEAD and in_head():
            silent.cut(0)
        if silent.items:
            if closing:
                k = silent.last(tag)
                if k >= 0:
                    silent.cut(k)
                    continue
                if tag not in ("body", "html") and stack.last(tag) < 0:
                    continue
                if not in_head() and ended is None:
                    return None
                silent.cut(0)  # the end of an element around it
            else:
                if tag in RAW and not empty and (stop := scan.raw_end(tag, at)) >= 0:
                    at = stop
                elif tag not in VOID and tag not in INLINE and not empty and tag not in ("html", "head"):
                    silent.push(tag, start)
                continue
        if tag in SILENT:
            if not closing and not empty:
                if tag in RAW:
                    stop = scan.raw_end(tag, at)
                    at = stop if stop >= 0 else n
                elif ended is None or tag == "head" or start in ended:
                    silent.push(tag, start)
                text.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                text.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if closing else links + 1
            if not closing:
                nodes[stack.items[-1][1]].inline += 1
            continue
        flush()
        links = 0
        if closing:
            if (k := stack.last(tag)) > 0:
                stack.cut(k)
            continue
        if tag == "body" or tag == "html":
            nodes[0].tokens += attribute_tokens(attributes)
            continue
        if stack.items[-1][0] == "p":  # an open paragraph ends at any block
            stack.cut(len(stack.items) - 1)
        if tag in _CLOSES:
            # the nearest element that this one closes, unless one that holds its likes is nearer
            k = max(map(stack.last, _CLOSES[tag]))
            if k > max(map(stack.last, _STOPS.get(tag, ("#page",)))) and k > 0:
                stack.cut(k)
        parent = stack.items[-1][1]
        nodes[parent].children.append(len(nodes))
        nodes.append(Node(tag, parent, len(stack.items), attribute_tokens(attributes)))
        if not empty:
            stack.push(tag, len(nodes) - 1)
    if ended is None and silent.items and not in_head():
        return None
    flush()
    return Page(nodes, blocks, targets)
