"""Labelled training pages for the node classifier: invented pages whose boilerplate is known.

Pages vary in tags, attribute names, nesting and the size of every part, so that
the trees learn from attribute tokens, densities and neighbours together rather
than from one template.
"""

from __future__ import annotations

import random

_LETTERS = "etaoinshrdlucmfwypvbgk"
#: Attribute tokens by the part of a page that they name.
NAMES = {
    "nav": ["nav", "navbar", "menu", "topnav", "breadcrumb", "breadcrumbs", "navigation", "pagination", "pager", "toc"],
    "header": ["header", "masthead", "site-header", "topbar", "logo", "branding"],
    "footer": ["footer", "site-footer", "foot", "copyright", "colophon", "legal"],
    "aside": ["sidebar", "side", "widget", "related", "recommended", "trending", "rail", "popular", "author-box"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner-ad", "adsbox", "promotion"],
    "notice": ["cookie", "cookie-banner", "consent", "notice", "gdpr", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "paywall", "disclaimer"],
    "form": ["form", "login", "signup", "search", "search-box", "contact-form", "subscribe-form"],
    "comments": ["comments", "comment", "comment-list", "disqus", "replies", "reply", "discussion", "responses"],
    "share": ["share", "social", "sharing", "tags", "meta", "byline", "follow"],
    "main": ["content", "main", "article", "post", "entry", "entry-content", "post-body", "story", "article-body", "text", "page-content", ""],
    "wrap": ["wrap", "wrapper", "container", "row", "col", "grid", "page", "outer", "inner", "layout", "section", ""],
}
_TAG = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}


class PageMaker:
    """``page()`` gives html whose every block element that is wholly content or boilerplate carries ``data-y``."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(_LETTERS, k=self.r.randint(1, 11)))

    def words(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        out = [self.word() + self.r.choice(["", "", "", "", "", "", ",", ".", ".", "!", " |", "%"]) for _ in range(n)]
        return " ".join(out).capitalize() + self.r.choice([".", ".", ""])

    def length(self) -> tuple[int, int]:
        return self.r.choice([(1, 3), (2, 8), (8, 40), (20, 80), (60, 250)] * 6 + [(300, 1500)])

    def attribute(self, part: str) -> str:
        name = self.r.choice(NAMES[part])
        if not name or self.r.random() < (0.06 if part != "wrap" else 0.5):
            return ""
        return f' {self.r.choice(["class", "class", "class", "id", "role"])}="{name}{self.r.choice(["", "", "-1", " x" + self.word()])}"'

    def link(self) -> str:
        return f'<a href="/{self.word()}">{self.words(1, 4)}</a>'

    def open(self, part: str, y: int, semantic: bool) -> tuple[str, str]:
        tag = _TAG.get(part, "div") if semantic else self.r.choice(["div", "div", "section", "ul" if part == "nav" else "div"])
        named = semantic and tag != "div" and tag != "section" and self.r.random() < 0.5
        return f'<{tag}{"" if named else self.attribute(part)} data-y="{y}">', f"</{tag}>"

    def block(self, y: int, tag: str, body: str) -> str:
        return f'<{tag} data-y="{y}">{body}</{tag}>' if self.r.random() < 0.9 or tag != "p" else f'<{tag} data-y="{y}">{body}'

    def content(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            out.append(self.block(1, "h1", self.words(2, 14)))
        for _ in range(r.choice([1, 2, 3, 5, 8, 14, 25])):
            kind = r.random()
            text = self.words(*self.length())
            if kind < 0.68:
                if r.random() < 0.15:
                    out.append(f'<p data-y="1"><b>{text}<br>')
                    continue
                if r.random() < 0.2:
                    text += f" {self.link()} " + self.words(2, 20)
                out.append(self.block(1, "p", text))
            elif kind < 0.76:
                out.append(self.block(1, r.choice(["h2", "h3"]), self.words(1, 9)))
            elif kind < 0.84:
                items = "".join(self.block(1, "li", self.words(1, 20)) for _ in range(r.randint(2, 8)))
                out.append(self.block(1, r.choice(["ul", "ol"]), items))
            elif kind < 0.89:
                out.append(self.block(1, "blockquote", self.block(1, "p", text)))
            elif kind < 0.93:
                rows = "".join(self.block(1, "tr", self.block(1, "td", self.words(1, 5)) * 2) for _ in range(r.randint(1, 5)))
                out.append(self.block(1, "table", rows))
            elif kind < 0.96:
                out.append(self.block(1, r.choice(["pre", "div", "figure"]), text))
            else:
                out.append(self.boiler(r.choice(["ad", "ad", "aside", "share", "notice"])))
        return "".join(out)

    def boiler(self, part: str) -> str:
        r = self.r
        a, b = self.open(part, 0, r.random() < 0.6)
        links = "".join(self.block(0, "li", self.link()) for _ in range(r.randint(1, 10)))
        prose = [self.block(0, "p", self.words(*r.choice([(2, 8), (5, 30), (20, 60)]))) for _ in range(r.randint(1, 4))]
        if part == "nav":
            body = links if "<ul" in a else self.block(0, "ul", links) if r.random() < 0.8 else " ".join(self.link() for _ in range(5))
        elif part == "footer":
            body = r.choice(["&copy; 2020 ", "&copy; ", "Copyright ", ""]) + self.words(2, 40) + r.choice(["", self.block(0, "ul", links), " &middot; " + self.link()])
        elif part == "form":
            body = f"<label>{self.words(1, 4)}</label><input><button>{self.words(1, 2)}</button>" + r.choice(["", prose[0]])
        elif part == "comments":
            one = lambda: f'<div{self.attribute("comments")} data-y="0">{self.block(0, r.choice(["h4", "div", "span"]), self.words(1, 3))}{self.block(0, "p", self.words(*self.length()))}</div>'
            body = r.choice(["", self.block(0, "h3", self.words(1, 3))]) + "".join(one() for _ in range(r.randint(1, 8)))
        elif part == "aside":
            body = r.choice(["", self.block(0, "h3", self.words(1, 4))]) + r.choice([self.block(0, "ul", links), "".join(prose)])
        elif part == "share":
            body = " ".join(self.link() for _ in range(r.randint(1, 6))) if r.random() < 0.7 else self.words(1, 6)
        else:
            body = r.choice([self.words(2, 30), "".join(prose), prose[0] + self.link(), self.words(2, 60)])
        return a + body + b

    def wrapped(self, html: str) -> str:
        for _ in range(self.r.choice([0, 0, 1, 2])):
            html = f"<div{self.attribute('wrap')}>{html}</div>"
        return html

    def page(self) -> str:
        r = self.r
        before = [p for p, chance in (("notice", 0.3), ("header", 0.5), ("nav", 0.8), ("ad", 0.5), ("form", 0.2)) if r.random() < chance]
        after = [p for p, chance in (("share", 0.3), ("comments", 0.45), ("aside", 0.5), ("ad", 0.3), ("nav", 0.2), ("form", 0.15), ("footer", 0.85), ("notice", 0.2)) if r.random() < chance]
        r.shuffle(before)
        tag = r.choice(["article", "article", "main", "div", "div", "section", "body"])
        main = self.content()
        # comments, adverts and forms also stand inside the element that holds the article
        for part in [p for p in after if p in ("comments", "share", "ad", "aside", "form") and r.random() < 0.4]:
            after.remove(part)
            main += self.boiler(part)
        if tag != "body":
            main = f"<{tag}{self.attribute('main') if tag not in ('article', 'main') or r.random() < 0.3 else ''}>{main}</{tag}>"
        body = "".join(self.wrapped(self.boiler(p)) for p in before) + self.wrapped(main) + "".join(self.wrapped(self.boiler(p)) for p in after)
        return f"<html><head><title>{self.words(2, 9)}</title><style>p{{}}</style></head><body>{body}</body></html>"
