"""Marked pages that the classifier of ``html_text`` is fitted on, generated by a rule from a seed.

The text of a block begins with ``CONTENT`` or ``OTHER``. Pages vary in what holds the main part (semantic tags, names,
tables, or nothing that tells), in the names around it, in which kinds of boilerplate there are and where, and in the
lengths of all blocks. What the words say doesn't matter.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

CONTENT, OTHER = "+", "-"
SEED, PAGES = 7, 400
#: Names around a page's main part that say something else than what is in them.
WRAPPERS = ("no-sidebar", "sidebar-layout", "page-with-side-nav", "header-fixed", "has-menu", "page", "site", "widget-area-wrap", "promo-page", "container", "js notice-theme", "row", "")
MAINS = ("content", "post", "entry-content", "main-content", "article-body", "story", "text", "post-content")
NEUTRAL = ("c1", "box", "blk", "m-4", "x7", "grid", "")
SIDE = {
    "menu": ("menu", "navbar", "main-nav", "breadcrumb"), "ad": ("ad", "advert", "ad-slot", "sponsored", "banner"), "notice": ("cookie-notice", "alert", "consent", "notice"),
    "sidebar": ("sidebar", "side", "rail", "widget"), "related": ("related", "recommended", "popular"), "share": ("share", "social"), "comments": ("comments", "discussion", "replies"),
    "newsletter": ("newsletter", "signup", "subscribe"), "footer": ("footer", "copyright", "legal"), "header": ("header", "masthead", "topbar"),
}


class Maker:
    """Parts of one page."""

    def __init__(self, rng: random.Random):
        self.rng, self.named = rng, rng.random() < 0.75
        self.tag = "p" if rng.random() < 0.75 else "div"  # of a paragraph

    def words(self, n: int) -> str:
        return " ".join("".join(self.rng.choices("abcdeilnorst", k=self.rng.randrange(2, 9))) for _ in range(n))

    def sentence(self, n: int | None = None) -> str:
        return self.words(n or self.rng.randrange(4, 25)).capitalize() + self.rng.choice("....!?:")

    def prose(self, mark: str) -> str:
        return mark + " ".join(self.sentence() for _ in range(self.rng.choice((1, 1, 2, 4, 8))))

    def attribute(self, names: tuple[str, ...]) -> str:
        if not names or not (name := self.rng.choice(names)):
            return ""
        return f' {self.rng.choice(("class", "class", "id"))}="{name}"'

    def links(self, n: int) -> str:
        items = [f"<a href=/>{OTHER}{self.words(self.rng.randrange(1, 6))}</a>" for _ in range(n)]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if self.rng.random() < 0.7 else "".join(f"<div>{i}</div>" for i in items)

    def paragraph(self) -> str:
        text = self.prose(CONTENT)
        if self.rng.random() < 0.2:
            words = text.split(" ")
            k = self.rng.randrange(len(words))
            words[k] = f"<a href=/>{words[k]}</a>" if k else words[k]
            text = " ".join(words)
        return f"<{self.tag}>{text}</{self.tag}>"

    def heading(self, level: int) -> str:
        return f"<h{level}>{CONTENT}{self.words(self.rng.randrange(1, 10)) if self.rng.random() < 0.6 else self.sentence(self.rng.randrange(1, 9))}</h{level}>"

    def body(self) -> str:
        kinds = [self.heading(1)] if self.rng.random() < 0.8 else []
        if kinds and self.rng.random() < 0.3:
            kinds = [f'<{(t := self.rng.choice(("header", "div")))}{self.attribute(("post-header", "entry-header", "header"))}>{kinds[0]}</{t}>']
        for _ in range(self.rng.choice((1, 2, 3, 5, 9))):
            kinds.append(self.paragraph())
            r = self.rng.random()
            if r < 0.1:
                kinds.append(self.heading(2))
            elif r < 0.2:
                kinds.append("<ul>" + "".join(f"<li>{CONTENT}{self.words(self.rng.randrange(1, 12))}</li>" for _ in range(self.rng.randrange(1, 6))) + "</ul>")
            elif r < 0.25:
                kinds.append(f"<table><tr><td>{CONTENT}{self.words(1)}</td><td>{CONTENT}{self.rng.randrange(99)}</td></tr></table>")
            elif r < 0.3:
                kinds.append(f"<blockquote>{self.prose(CONTENT)}</blockquote>")
            elif r < 0.35:
                kinds.append(f"<figure><img><figcaption>{CONTENT}{self.sentence(6)}</figcaption></figure>")
            elif r < 0.45:
                kinds.append(f"<{self.tag}>{CONTENT}{self.words(self.rng.randrange(1, 4))}</{self.tag}>")
            elif r < 0.5:
                kinds.append(f'<{self.tag}{self.rng.choice((" hidden", ' style="display:none"'))}>{self.prose(OTHER)}</{self.tag}>')
        return "".join(kinds)

    def side(self, kind: str) -> str:
        r, names = self.rng, SIDE[kind] if self.named else NEUTRAL
        if kind in ("menu", "related"):
            inner = (f"<h3>{OTHER}{self.words(2)}</h3>" if r.random() < 0.5 else "") + self.links(r.randrange(3, 10))
        elif kind == "comments":
            tag = r.choice(("article", "div", "li"))
            inner = f"<h3>{OTHER}{self.words(2)}</h3>" + "".join(f"<{tag}><p>{self.prose(OTHER)}</p></{tag}>" for _ in range(r.randrange(1, 6)))
        elif kind == "share":
            inner = "".join(f"<a href=/>{OTHER}{self.words(1)}</a> " for _ in range(3))
        elif kind == "footer":
            inner = f"{OTHER}{self.words(r.randrange(1, 12))}"
            inner = (f"<p>{inner}.</p>" if r.random() < 0.5 else inner) + (self.links(3) if r.random() < 0.4 else "")
        else:
            inner = "".join(f"<p>{self.prose(OTHER)}</p>" for _ in range(r.randrange(1, 3))) if r.random() < 0.7 else self.prose(OTHER)
        if kind == "newsletter" and r.random() < 0.6:
            inner = f"<form>{inner}<label>{OTHER}{self.words(3)}</label></form>"
        tag = {"menu": "nav", "footer": "footer", "sidebar": "aside", "related": "aside", "header": "header", "comments": "section"}.get(kind, "div") if r.random() < (0.5 if self.named else 0.9) else "div"
        shown = " hidden" if kind == "notice" and r.random() < 0.3 else ""
        return f"<{tag}{self.attribute(names)}{shown}>{inner}</{tag}>"

    def page(self) -> str:
        r, inner = self.rng, self.body()
        held = r.random()
        if held < 0.35:
            tag = r.choice(("article", "article", "main"))
            own = self.attribute(("social-history", "alert-article", "post", "menu-item", "", "")) if self.named else ""
            tail = "".join(self.side(k) for k in ("share", "comments", "related", "ad", "newsletter") if r.random() < 0.2)
            inner = f"<{tag}{own}>{inner}{tail}</{tag}>"
        elif held < 0.7:
            inner = f"<div{self.attribute(MAINS if self.named else NEUTRAL)}>{inner}</div>"
            if r.random() < 0.2:
                inner = f"<table><tr><td>{self.side('menu')}</td><td>{inner}</td></tr></table>"
        elif held < 0.85:
            inner = f"<div>{inner}</div>"
        for _ in range(r.randrange(3)):
            inner = f"<div{self.attribute(WRAPPERS)}>{inner}</div>"
        before = "".join(self.side(k) for k in ("header", "menu", "notice", "ad") if r.random() < 0.45)
        after = "".join(self.side(k) for k in ("sidebar", "related", "comments", "newsletter", "ad", "notice", "footer") if r.random() < 0.35)
        out = f"{before}{inner}{after}"
        if r.random() < 0.3:
            out = f"<div{self.attribute(WRAPPERS)}>{out}</div>"
        return f"<html><body{self.attribute(WRAPPERS)}>{out}</body></html>"


def pages(seed: int = SEED, n: int = PAGES) -> Iterator[str]:
    rng = random.Random(seed)
    return (Maker(rng).page() for _ in range(n))
