"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every block element has features: its tag and attribute tokens and those of its
ancestors, densities of its subtree, depth, and its place among its siblings.
The trees give each node the odds that it is content.  Hierarchical decoding
then picks the labelling of best total likelihood among the consistent ones: a
node that is content or boilerplate as a whole decides for all below it, and
only a node that is split leaves its children to decide.

The trees are in ``html_trees.json``, which ``python -m docflow.llm.html_extract``
writes: it trains them on invented pages (``page_maker``) and is deterministic.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, boost
from .dom import Page, parse
from .page_maker import PageMaker

TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "ul", "li", "table", "nav", "header", "footer", "aside", "form", "quote")
_TAG_OF = {"h3": "h2", "h4": "h2", "h5": "h2", "h6": "h2", "ol": "ul", "dl": "ul", "menu": "nav", "dt": "li", "dd": "li", "tr": "table", "td": "table", "th": "table", "tbody": "table", "thead": "table", "blockquote": "quote", "pre": "quote", "figure": "quote", "figcaption": "quote", "fieldset": "form", "dialog": "aside"}
#: Attribute tokens that are features; a token of four letters or more also counts where it begins one.
STEMS = (
    "nav", "menu", "breadcrumb", "pag", "toc", "head", "masthead", "logo", "topbar", "foot", "copyright", "legal", "side", "widget", "related", "recommend", "trending", "popular", "ad", "ads",
    "advert", "sponsor", "promo", "banner", "cookie", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "form", "login", "search", "comment", "reply", "disqus", "share", "social",
    "content", "article", "post", "entry", "story", "body", "text", "main",
)
_BIT = {t: 1 << i for i, t in enumerate(TAGS)} | {s: 1 << (len(TAGS) + i) for i, s in enumerate(STEMS)}
_LONG = [s for s in STEMS if len(s) >= 3 and s not in ("ad", "ads", "pag", "toc", "nav")] + ["pag", "nav"]
BITS = len(TAGS) + len(STEMS)
N_STATS = 14
TREES = Path(__file__).with_name("html_trees.json")
#: Nodes that are judged at once.
NODES = 1 << 15


@lru_cache(maxsize=100_000)
def token_bits(token: str) -> int:
    found = _BIT[token] if token in STEMS else 0
    for s in _LONG:
        if token.startswith(s):
            found |= _BIT[s]
    if token in ("discussion", "responses", "replies"):
        found |= _BIT["comment"]
    return found


def node_table(page: Page) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Own bits, the parent's, those of the ancestors beyond it, and statistics of each node."""
    nodes = page.nodes
    n = len(nodes)
    size, linked, marks, count, inline = ([getattr(x, k) for x in nodes] for k in ("own", "linked", "marks", "depth", "inline"))
    count = [1] * n
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        size[p] += size[i]
        linked[p] += linked[i]
        marks[p] += marks[i]
        count[p] += count[i]
        inline[p] += inline[i]
    own_bits, parent_bits, up_bits = [0] * n, [0] * n, [0] * n
    stats = np.zeros((n, N_STATS))
    total = max(1, size[0])
    tags: dict[int, Counter[str]] = {}  # of the children of each parent
    for i, x in enumerate(nodes):
        bits = _BIT.get(_TAG_OF.get(x.tag, x.tag), 0) if x.tag in TAGS or x.tag in _TAG_OF else 0
        for t in x.tokens:
            bits |= token_bits(t)
        own_bits[i] = bits
        if i:
            parent_bits[i] = own_bits[x.parent]
            up_bits[i] = up_bits[x.parent] | parent_bits[x.parent]
            mates = nodes[x.parent].children
            k = len(mates)
            if x.parent not in tags:
                tags[x.parent] = Counter(nodes[j].tag for j in mates)
            same = tags[x.parent][x.tag]
        else:
            k, same = 1, 1
        parent = x.parent if i else 0
        stats[i] = (
            x.depth, size[i], x.own, linked[i] / max(1, size[i]), count[i], size[i] / count[i], marks[i] / max(1, size[i]), inline[i] / max(1, count[i]),
            k, same / k, size[i] / max(1, size[parent]), size[i] / total, len(x.children), linked[parent] / max(1, size[parent]),
        )
    return np.array(own_bits, np.uint64), np.array(parent_bits, np.uint64), np.array(up_bits, np.uint64), stats


def matrix(tables: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    *flags, stats = (np.concatenate(c) for c in zip(*tables))
    shifts = np.arange(BITS, dtype=np.uint64)
    bits = [((b[:, None] >> shifts) & np.uint64(1)).astype(np.float32) for b in flags]
    stats = stats.astype(np.float32)
    for k in (1, 2, 4, 5, 8, 12):
        stats[:, k] = np.log1p(stats[:, k])
    return np.concatenate([*bits, stats], axis=1)


@dataclass(frozen=True)
class Judges:
    """``content``: odds that a node's text is content; ``uniform``: odds that all text below a node is of one kind."""

    content: Trees
    uniform: Trees

    def odds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.content.log_odds(x), self.uniform.log_odds(x)


def truth(page: Page, marked: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of each node: 1 content, 0 boilerplate, -1 both or no text below; and whether text of one kind only lies below."""
    n = len(page.nodes)
    kind = list(marked)
    for i, x in enumerate(page.nodes):
        if kind[i] < 0 and i:
            kind[i] = kind[x.parent]
    seen = [0] * n
    for i, _ in page.blocks:
        seen[i] |= 1 << max(0, kind[i])
    for i in range(n - 1, 0, -1):
        seen[page.nodes[i].parent] |= seen[i]
    seen = np.array(seen)
    return np.select([seen == 2, seen == 1], [1, 0], -1), seen != 3


@lru_cache(maxsize=4)
def train(n_pages: int = 800, seed: int = 11) -> Judges:
    """Fit on ``n_pages`` invented pages; deterministic, so that every run builds the same trees."""
    maker, tables, kinds, uniform = PageMaker(seed), [], [], []
    for _ in range(n_pages):
        html = maker.page()
        page, marks = parse(html), parse(html.replace('data-y="', 'role="truth'))
        tables.append(node_table(page))
        marked = [next((int(t) for w, t in zip(x.tokens, x.tokens[1:]) if w == "truth"), -1) for x in marks.nodes]
        kind, one = truth(page, marked)
        kinds.append(kind)
        uniform.append(one)
    x, y, one = matrix(tables), np.concatenate(kinds), np.concatenate(uniform)
    # nodes without children are uniform by nature
    parents = np.concatenate([t[3][:, 12] > 0 for t in tables])
    return Judges(boost(x[y >= 0], y[y >= 0].astype(float), np.ones(int((y >= 0).sum()))), boost(x[parents], one[parents].astype(float), np.ones(int(parents.sum())), trees=40))


def save(judges: Judges, path: Path = TREES) -> None:
    """Write the trees as text, a tree a line; numbers read back as they were."""
    out = {}
    for name in ("content", "uniform"):
        t: Trees = getattr(judges, name)
        rows = [{"feature": f.tolist(), "threshold": [None if np.isinf(x) else x for x in h.tolist()], "leaf": v.tolist()} for f, h, v in zip(t.feature, t.threshold, t.leaf)]
        out[name] = f'{{"start": {t.start!r}, "trees": [\n' + ",\n".join(map(json.dumps, rows)) + "]}"
    path.write_text("{" + ",\n".join(f'"{k}": {v}' for k, v in out.items()) + "}\n")


@lru_cache(maxsize=4)
def load(path: Path = TREES) -> Judges:
    def trees(x: dict) -> Trees:
        feature, threshold, leaf = ([t[k] for t in x["trees"]] for k in ("feature", "threshold", "leaf"))
        return Trees(np.array(feature), np.array([[np.inf if h is None else h for h in t] for t in threshold]), np.array(leaf), x["start"])

    return Judges(**{k: trees(x) for k, x in json.loads(path.read_text()).items()})


def odds_of(judges: Judges, tables: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """The odds of all nodes of ``tables``, NODES of them at a time."""
    out, held, size = [], [], 0
    for table in tables:
        for i in range(0, len(table[0]), NODES):
            part = tuple(a[i : i + NODES] for a in table)
            if held and size + len(part[0]) > NODES:
                out.append(judges.odds(matrix(held)))
                held, size = [], 0
            held.append(part)
            size += len(part[0])
    out.append(judges.odds(matrix(held)))
    return tuple(np.concatenate(c) for c in zip(*out))


def decode(page: Page, odds: np.ndarray, one: np.ndarray) -> list[bool]:
    """Whether each node's own text is content: the consistent labelling of greatest likelihood, weighed by text.

    Bottom up, a node is worth its text's log-likelihood as content or as boilerplate throughout, or that of its own
    text and its children's best, each with that of being uniform or not; top down, the first uniform node on a path
    decides for its subtree.
    """
    nodes = page.nodes
    n = len(nodes)
    likely = np.maximum(-np.logaddexp(0, -odds), -np.logaddexp(0, odds)).tolist()
    whole_odds, split_odds = (-np.logaddexp(0, -one)).tolist(), (-np.logaddexp(0, one)).tolist()
    size = [x.own for x in nodes]
    for i in range(n - 1, 0, -1):
        size[nodes[i].parent] += size[i]
    split = [x.own * a for x, a in zip(nodes, likely)]
    state = [0] * n  # 1 content, 0 boilerplate, -1 split
    for i in range(n - 1, -1, -1):
        best = size[i] * likely[i]
        state[i] = int(odds[i] > 0)
        if nodes[i].children:
            best += size[i] * whole_odds[i]
            if (apart := split[i] + size[i] * split_odds[i]) > best:
                state[i], best = -1, apart
        if i:
            split[nodes[i].parent] += best
    out = [False] * n
    fixed = [-1] * n
    for i, x in enumerate(nodes):
        fixed[i] = fixed[x.parent] if i and fixed[x.parent] >= 0 else state[i]
        out[i] = bool(fixed[i]) if fixed[i] >= 0 else bool(odds[i] > 0)
    return out


def extract_texts(htmls: list[str | None], judges: Judges) -> list[str]:
    """The main text of each page; null and empty pages give an empty text."""
    pages = [parse(h) for h in htmls if h]
    if not pages:
        return ["" for _ in htmls]
    odds, one = odds_of(judges, [node_table(p) for p in pages])
    found, at = iter(pages), 0
    out = []
    for h in htmls:
        if not h:
            out.append("")
            continue
        page = next(found)
        own = slice(at, at + len(page.nodes))
        keep = decode(page, odds[own], one[own])
        at += len(page.nodes)
        out.append("\n".join(t for i, t in page.blocks if keep[i]))
    return out


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, judges: Judges | None = None) -> DataFrame:
    """EXTRACTED, a row for each row of ``pages``: blocks of the article in page order, joined by \\n.

    Null, empty and markup-only pages give an empty text; repeated rows are extracted each; other columns, null or
    not, play no part beyond page_id and url, which pass through; an empty table gives no rows.  Pages of any length
    are read whole, in time linear in it.  What stands in where a browser shows something else (``noscript``, the
    inside of ``object``, ``video`` and the like) is no text of the page.
    """
    held = pages.sparkSession.sparkContext.broadcast(judges or load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = extract_texts(part.column(2).to_pylist(), held.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, EXTRACTED)


if __name__ == "__main__":
    save(train())
