"""HTML pages as fragments, and pages rewritten with translated fragments.

The tree keeps unclosed elements open, as a plain parser does, so text under an
unclosed paragraph belongs to that paragraph's group.  Trees live inside one
Python call a page; rows go in and out by Arrow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import SEPARATOR

ROOTS = frozenset(["p", "h1", "h2", "h3", "h4", "h5", "h6"])
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
FRAGMENTS = "page_id long, frag_index long, root_tag string, n_parts int, text string"


class FragmentMismatch(ValueError):
    """A translation has another number of parts than its group."""

    def __init__(self, original: list[str], translated: list[str]):
        super().__init__(f"expected {len(original)} fragments, got {len(translated)}")
        self.original, self.translated = original, translated


class Element:
    def __init__(self, tag: str, attrs: list[tuple[str, str | None]], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, dict(attrs), parent
        self.children: list[Element | str | tuple[str]] = []

    def html(self) -> str:
        inner = "".join(c.html() if isinstance(c, Element) else c[0] if isinstance(c, tuple) else c if self.tag in ("script", "style") else escape(c, quote=False) for c in self.children)
        if self.tag == "#page":
            return inner
        attrs = "".join(f" {k}" if v is None else f' {k}="{escape(v)}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" + ("" if self.tag in _VOID else f"{inner}</{self.tag}>")


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = self.at = Element("#page", [], None)

    def handle_starttag(self, tag, attrs):
        node = Element(tag, attrs, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)

    def handle_comment(self, data):
        self.at.children.append((f"<!--{data}-->",))

    def handle_decl(self, decl):
        self.at.children.append((f"<!{decl}>",))


def tree(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.page


def _texts(node: Element) -> Iterator[tuple[Element, int]]:
    for i, child in enumerate(node.children):
        if isinstance(child, Element):
            yield from _texts(child)
        elif isinstance(child, str):
            yield node, i


def squeeze(text: str) -> str:
    """White-space runs to one space."""
    return re.sub(r"\s+", " ", text)


def groups(page: Element) -> list[tuple[int, str, list[tuple[Element, int]]]]:
    """(index, root tag, text places) of consecutive texts under one root.

    A text joins the open group if the group's root is among its ancestors; text under no root takes an index and
    is dropped; blank text and text directly in scripts and styles does not count.
    """
    out, index, root, places = [], 0, None, []
    body = next((n for n in _elements(page) if n.tag == "body"), page)
    for node, i in _texts(body):
        if not node.children[i].strip() or node.tag in ("script", "style"):
            continue
        above = []
        up: Element | None = node
        while up is not None:
            above.append(up)
            up = up.parent
        if root is not None and any(a is root for a in above):
            places.append((node, i))
            continue
        if places:
            out.append((index, root.tag, places))
        root, places = next((a for a in above if a.tag in ROOTS), None), []
        index += 1
        if root is not None:
            places = [(node, i)]
    if places:
        out.append((index, root.tag, places))
    return out


def _elements(node: Element) -> Iterator[Element]:
    yield node
    for child in node.children:
        if isinstance(child, Element):
            yield from _elements(child)


def page_fragments(html: str | None, references: Sequence[str] | None = None) -> list[tuple[int, str, int, str]]:
    if html and references is not None:
        html = re.sub(f"&(?!(?:{'|'.join(references)});)", "&amp;", html)
    found = groups(tree(html or ""))
    return [(index, tag, len(places), SEPARATOR.join(squeeze(n.children[i]) for n, i in places)) for index, tag, places in found]


def fragments(pages: DataFrame, references: Sequence[str] | None = None) -> DataFrame:
    """FRAGMENTS of pages (page_id, html), in page order by frag_index; null and empty pages have none.

    Character references are decoded as browsers do, cut ones (``&amp`` at the end of a text) too; with ``references``
    only those of these names that end in a semicolon, and others stay as they are written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *f) for p, h in zip(*(c.to_pylist() for c in batch.columns)) for f in page_fragments(h, references)]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in FRAGMENTS.split(", ")])

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, FRAGMENTS)


def with_edges(original: str, translated: str) -> str:
    """F2 for one text."""
    if not original or not translated:
        return translated
    head = " " if original[0].isspace() and not translated[0].isspace() else ""
    return head + translated + (" " if original[-1].isspace() and not translated[-1].isspace() else "")


def _mark(node: Element) -> None:
    node.attrs["class"] = " ".join([*(w for w in (node.attrs.get("class") or "").split() if w != "original"), "original"])
    node.attrs["style"] = "color: #9ca3af;"


def _copy(node: Element, parts: Iterator[str], parent: Element) -> Element:
    """The same structure with its texts replaced in order; blank texts go."""
    twin = Element(node.tag, list(node.attrs.items()), parent)
    for child in node.children:
        if isinstance(child, Element):
            twin.children.append(_copy(child, parts, twin))
        elif isinstance(child, str) and child.strip():
            twin.children.append(with_edges(child, next(parts)))
    return twin


def rewrite(html: str, translations: dict[int, str], mode: str = "replace") -> tuple[str, int]:
    """The page with translated groups, and how many were replaced.

    ``replace`` puts a translation in the original's place, ``inline`` after it, ``separate`` into a sibling element
    of the same structure behind the grayed original.  Groups without translation stay.  Parts that do not match
    raise FragmentMismatch.
    """
    page = tree(html)
    done = 0
    for index, _, places in groups(page):
        if not translations.get(index):
            continue
        parts = translations[index].split(SEPARATOR)
        texts = [n.children[i] for n, i in places]
        if len(parts) != len(texts):
            raise FragmentMismatch(texts, parts)
        if mode == "separate":
            node = places[0][0]
            while node.tag not in ROOTS:
                node = node.parent
            twin = _copy(node, iter(parts), node.parent)
            twin.attrs |= {"class": "translation", "lang": "translated"}
            _mark(node)
            node.parent.children.insert(next(k for k, c in enumerate(node.parent.children) if c is node) + 1, twin)
        else:
            for (node, i), text, part in zip(places, texts, parts):
                new = with_edges(text, part.strip()) if part.strip() else part
                node.children[i] = f"{text.rstrip()} | {new.lstrip()}" if mode == "inline" else new
        done += 1
    return page.html(), done


def document(html: str) -> tuple[bytes, dict[str, str | None] | None]:
    """(content, link) of a page as a book item (S11): its body alone, or all of it without one, and rel, href and type of
    its first link."""
    page = tree(html)
    body = next((n for n in _elements(page) if n.tag == "body"), page)
    link = next((n for n in _elements(page) if n.tag == "link"), None)
    return body.html().encode("utf-8", "replace"), None if link is None else {k: link.attrs.get(k) for k in ("rel", "href", "type")}


REWRITTEN = "page_id long, n_groups int, html string, error string"
ITEMS = "page_id long, content binary, link struct<rel:string,href:string,type:string>"


def rewrite_pages(pages: DataFrame, translated: DataFrame, mode: str = "replace") -> DataFrame:
    """REWRITTEN pages; ``translated`` has page_id, frag_index, text, gathered per page before they meet the page; of several
    texts of one group the greatest is taken.

    A page with a translation that has another number of parts than its group stays as it is, with the mismatch in
    ``error`` (D3, D7).
    """
    per = translated.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("frag_index", "text"))).alias("t"))
    rows = pages.select("page_id", F.col("html").cast("string")).join(per, "page_id", "left")

    def one(page_id, html: str, texts: dict) -> tuple:
        try:
            done, n = rewrite(html, texts, mode)
        except FragmentMismatch as e:
            return page_id, 0, html, str(e)
        return page_id, n, done, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            out = [one(p, h or "", {x["frag_index"]: x["text"] for x in t or []}) for p, h, t in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [x.split()[0] for x in REWRITTEN.split(", ")])

    return rows.mapInArrow(run, REWRITTEN)


def items(pages: DataFrame) -> DataFrame:
    """ITEMS of pages (page_id, html) (S11); a null page is empty, and a page without a link has a null one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link = pa.struct([(k, pa.string()) for k in ("rel", "href", "type")])
        for batch in batches:
            made = [document(h or "") for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in made], pa.binary()), pa.array([x for _, x in made], link)], ["page_id", "content", "link"])

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, ITEMS)
