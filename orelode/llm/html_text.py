"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A logistic classifier gives each block the cost of calling it content or boilerplate;
these are the capacities of its terminal edges. Neighbours in page order, and siblings in the tree, are joined by
smoothness edges that weaken with their distance in the tree. The minimum cut between the terminals, found by max-flow,
is the labelling of least cost; blocks on the content side are the text. Blocks whose own costs outweigh all their edges
are settled first, which leaves the cut the same and the flow small.

What a block's elements are called is evidence, never a veto: the names of an element that holds the page's main part
are set aside, names that are negated (``no-sidebar``, ``has-menu``) say nothing, and the classifier weighs the rest
against tags, links and lengths. It is fitted on pages that ``page_samples`` generates.

Parsing takes time in proportion to the page, whatever is left open in it.
"""

from __future__ import annotations

import html
import re
from collections import deque
from functools import cache, lru_cache
from math import exp, log1p
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm import page_samples
from orelode.llm.runtime import Sink, task, values

TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
NAME = re.compile(r"[A-Za-z][^\s/>]*")
STOP = re.compile(r"""[>"']""")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the page: its head, scripts, styles, and the controls of forms.
SILENT = frozenset("head title script style template iframe select option datalist textarea button".split())
RAW = frozenset("script style textarea title iframe".split())
IN_HEAD = frozenset("title base link meta style script noscript template".split())
#: What a start tag closes: the open element of these names, up to the nearest of the boundary.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
P_LIMITS = frozenset("article section div td th li table body button aside main".split())
CLOSE_LIMITS = frozenset("td th li article section table".split())
MAIN, ASIDE, FORMS = {"article", "main"}, {"nav", "menu", "footer", "aside", "dialog", "search"}, {"form", "fieldset"}
HEADINGS, PROSE = {"h1", "h2", "h3", "h4", "h5", "h6"}, {"p", "blockquote", "pre", "figcaption"}
#: Names of boilerplate, of readers' comments, of content, and of heads (boilerplate outside the main part only).
BAD = frozenset("ad ads advert advertisement advertising adverts banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar side rail footer foot topbar toolbar cookie cookies notice notices consent gdpr alert newsletter subscribe subscription share sharing social related recommended popular trending popup modal overlay login signup register widget widgets pagination pager tags copyright legal skip".split())
READERS = frozenset("comment comments commentlist reply replies respond disqus discussion reactions reviews".split())
GOOD = frozenset("article content post entry story main maincontent body text prose articlebody".split())
HEADS = frozenset("header masthead".split())
#: Parts that turn a name into a remark about the layout.
SETS_ASIDE = frozenset("no not non without has have with is layout wrapper wrap container outer".split())
ROLES = {"navigation": 1, "complementary": 1, "contentinfo": 1, "dialog": 1, "alert": 1, "search": 1, "main": 4, "article": 4, "banner": 8}
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
SENTENCE = re.compile(r"[.!?;…:]")
HOLDS_ALL = {"html", "body"}
#: Weight of the smoothness edges between neighbours, and between siblings that others part.
ADJACENT, SIBLING = 0.8, 0.4
#: No block is surer than this log-odds.
SURE = 9.0
#: Share of a page's prose from which an element is its main part, if nothing is marked as such.
MOST = 0.6


class Element:
    """An open or closed element; ``prose`` and ``linked`` count the characters below it, outside and inside links."""

    __slots__ = ("block", "dead", "flags", "hint", "level", "linked", "parent", "prose", "tag")

    def __init__(self, tag: str, parent: Element | None, hint: int):
        self.tag, self.parent, self.hint, self.prose, self.linked, self.flags, self.dead = tag, parent, hint, 0, 0, None, False
        own = tag in BLOCK_TAGS or parent is None
        self.level = (parent.level if parent else 0) + own
        self.block: Element = self if own else parent.block


class Block:
    """A block's text, the element it lies in, its characters in links, and its distance from the block before."""

    __slots__ = ("away", "element", "linked", "size", "text")

    def __init__(self, text: str, element: Element, linked: int, size: int, away: int):
        self.text, self.element, self.linked, self.size, self.away = text, element, linked, size, away


@lru_cache(1 << 16)
def name_hint(name: str) -> int:
    """1 boilerplate, 2 readers, 4 content, 8 a head; 0 if it says nothing of that or is set aside."""
    parts = [p.lower() for p in PART.findall(name)]
    if not SETS_ASIDE.isdisjoint(parts):
        return 0
    parts.append(re.sub(r"[^a-z]", "", name.lower()))
    return (not BAD.isdisjoint(parts)) | 2 * (not READERS.isdisjoint(parts)) | 4 * (not GOOD.isdisjoint(parts)) | 8 * (not HEADS.isdisjoint(parts))


def hints(tag: str, attributes: str) -> int:
    """What an element's names and roles say; 16 if it isn't shown."""
    out = 0
    if tag in HOLDS_ALL or "=" not in attributes and "hidden" not in attributes:
        return out
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name in ("class", "id", "itemprop"):
            value = m[2] or m[3] or m[4] or ""
            for word in (html.unescape(value) if "&" in value else value).split():
                out |= name_hint(word)
        elif name == "role":
            out |= ROLES.get((m[2] or m[3] or m[4] or "").strip().lower(), 0)
        elif name == "hidden" or name == "style" and UNSHOWN.search(m[2] or m[3] or m[4] or ""):
            out |= 16
    return out


class Page:
    """Splits a page into blocks."""

    def __init__(self, page: str):
        self.root = Element("", None, 0)
        self.stack, self.blocks, self.parts, self.anchors = [self.root], [], [], []
        self.open_at: dict[str, list[int]] = {}
        self.linked, self.silent, self.links, self.low = 0, 0, 0, 0
        self.last, self.lost = page.rfind(">"), set()
        at, end = 0, len(page)
        while at < end:
            lt = page.find("<", at)
            if lt < 0:
                self.data(page[at:])
                break
            to, name, closing, attributes = self.tag(page, lt)
            if to < 0:  # no markup
                self.data(page[at : lt + 1])
                at = lt + 1
                continue
            self.data(page[at:lt])
            at = to
            if not name:
                continue
            if closing:
                self.close(name)
            else:
                self.open(name, attributes)
                if name in RAW:
                    stop = raw_end(name).search(page, at)
                    at = stop.start() if stop else end
        self.flush()
        self.pop(1)
        self.root.prose = max(1, self.root.prose)

    def tag(self, page: str, lt: int) -> tuple[int, str, bool, str]:
        """Where the markup at ``lt`` ends (-1: it is none), its tag's name, whether that closes, its attributes."""
        c = page[lt + 1 : lt + 2]
        if c == "!" or c == "?":
            if page.startswith("<!--", lt):
                if page.startswith(">", lt + 4) or page.startswith("->", lt + 4):
                    return page.index(">", lt) + 1, "", False, ""
                stop = COMMENT_END.search(page, lt + 4)
                return stop.end() if stop else len(page), "", False, ""
            stop = page.find(">", lt)
            return stop + 1 if stop >= 0 else len(page), "", False, ""
        closing = c == "/"
        m = NAME.match(page, lt + 1 + closing) if lt < self.last else None
        if m is None:
            return (page.index(">", lt) + 1 if closing and lt < self.last else -1), "", False, ""
        at, quotes = m.end(), []
        while (stop := STOP.search(page, at)) is not None:
            p = stop.start()
            if page[p] == ">":
                return p + 1, m[0].lower(), closing, page[m.end() : p]
            to = -1 if p in self.lost else page.find(page[p], p + 1)
            quotes.append(p)
            if to < 0:
                break
            at = to + 1
        self.lost.update(quotes)  # from here no quote comes out of its tag: it ends at the next >
        p = page.index(">", m.end())
        return p + 1, m[0].lower(), closing, page[m.end() : p]

    def data(self, raw: str) -> None:
        if raw and not self.silent:
            text = html.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.links:
                self.linked += len("".join(text.split()))

    def flush(self) -> None:
        if self.parts:
            words = "".join(self.parts).split()
            if words:
                e, size = self.stack[-1], sum(map(len, words))
                away = e.level + (self.blocks[-1].element.level if self.blocks else 0) - 2 * min(self.low, e.level)
                self.blocks.append(Block(" ".join(words), e, self.linked, size, away))
                e.linked += self.linked
                e.prose += size - self.linked
                self.low = e.level
            self.parts, self.linked = [], 0

    def pop(self, k: int) -> None:
        """Closes the open elements from the k-th on."""
        for e in reversed(self.stack[k:]):
            self.silent -= e.tag in SILENT
            self.links -= e.tag == "a"
            e.parent.prose += e.prose
            e.parent.linked += e.linked
            self.open_at[e.tag].pop()
        del self.stack[k:]
        self.low = min(self.low, self.stack[-1].level)

    def at(self, names) -> int:
        """The place in the stack of the innermost open element of these names; -1 if none is open."""
        return max((own[-1] for n in names if (own := self.open_at.get(n))), default=-1)

    def inside(self, names, limits) -> int | None:
        k = self.at(names)
        return k if k >= 0 and k > self.at(limits) else None

    def open(self, name: str, attributes: str) -> None:
        if name not in IN_HEAD and (k := self.at(("head",))) >= 0:
            self.pop(k)
        if name == "br":
            self.parts.append("\n")
        if name in BLOCK_TAGS:
            self.flush()
            if (k := self.inside(("p",), P_LIMITS)) is not None:
                self.pop(k)
        if name in CLOSES and (k := self.inside(*CLOSES[name])) is not None:
            self.pop(k)
        if name == "a" and (k := self.inside(("a",), BLOCK_TAGS)) is not None:
            self.pop(k)
        if name in VOID:
            return
        e = Element(name, self.stack[-1], hints(name, attributes) if attributes else 0)
        if name in MAIN or e.hint & 4 and not e.hint & 3:
            self.anchors.append(e)
        self.open_at.setdefault(name, []).append(len(self.stack))
        self.stack.append(e)
        self.silent += name in SILENT
        self.links += name == "a"

    def close(self, name: str) -> None:
        if name in BLOCK_TAGS:
            self.flush()
        k = self.at((name,)) if name in BLOCK_TAGS else self.inside((name,), CLOSE_LIMITS)
        if k is not None and k > 0 and name not in HOLDS_ALL:
            self.pop(k)

    def resolve(self) -> Element | None:
        """Finds the main part, and gives each element with text what it inherits; returns the main part."""
        main = self.main()
        inner = max((e for e in self.anchors if e.tag == "article" and main is not None and 5 * e.prose > main.prose and not beside(e)), key=lambda e: e.prose, default=None)
        for path in (main, inner):  # names of what holds the main part are set aside
            while path is not None and not path.dead:
                path.dead = True
                path = path.parent
        most = MOST * self.root.prose if main is None else float("inf")
        for b in self.blocks:
            inherit(b.element, main, most)
        return main

    def main(self) -> Element | None:
        """The marked element with most prose; ``main`` goes before others, readers' and side parts don't count."""
        best, score = None, (False, 0)
        for e in self.anchors:
            if e.prose and (e.tag == "main", e.prose) > score and not (e.hint & 2 and e.tag not in MAIN) and not beside(e):
                best, score = e, (e.tag == "main", e.prose)
        return best


@cache
def raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE)


IN_MAIN, BESIDE, IN_FORM, IS_BAD, IS_READERS, IS_GOOD, IS_HIDDEN, NESTED, IN_ARTICLE = (1 << k for k in range(9))
SIDEWAYS = BESIDE | IN_FORM | IS_BAD | IS_READERS | NESTED


def beside(e: Element) -> bool:
    """Whether the element lies in one whose tag says that it isn't the main part."""
    return bool(lineage(e) & 1)


def lineage(e: Element) -> int:
    """Bit 1 if an element above (or this one) is a side tag, a form, or readers'; kept in ``flags`` as a negative."""
    up = []
    while e is not None and e.flags is None:
        up.append(e)
        e = e.parent
    bits = -e.flags - 1 if e is not None else 0
    for x in reversed(up):
        bits |= x.tag in ASIDE or x.tag in FORMS or bool(x.hint & 2)
        x.flags = -bits - 1
    return bits


def inherit(e: Element, main: Element | None, most: float) -> None:
    """Sets what the block's element and those above it say; those with ``most`` of the prose have no say."""
    up = []
    while e is not None and (e.flags is None or e.flags < 0):
        up.append(e)
        e = e.parent
    flags = e.flags if e is not None else 0
    for x in reversed(up):
        tag, hint = x.tag, 0 if x.dead or x.prose >= most else x.hint
        if x is main:
            flags |= IN_MAIN
        if tag == "article" and flags & IN_MAIN:
            flags |= NESTED if flags & IN_ARTICLE else IN_ARTICLE
        if tag in ASIDE or tag == "header" and not flags & IN_MAIN and not x.dead:
            flags |= BESIDE
        if tag in FORMS:
            flags |= IN_FORM
        if hint & 1 or hint & 8 and not flags & IN_MAIN:
            flags |= IS_BAD
        if hint & 2:
            flags |= IS_READERS
        if x.hint & 4:
            flags |= IS_GOOD
        if hint & 16:
            flags |= IS_HIDDEN
        x.flags = flags


FEATURES = 18


def features(block: Block, has_main: bool, prose: int) -> list[float]:
    e, f = block.element, block.element.flags
    own = e.block
    in_main = bool(f & IN_MAIN)
    around = own.parent or own
    return [
        1.0, in_main, has_main and not in_main, bool(f & BESIDE), bool(f & IN_FORM), bool(f & IS_BAD), bool(f & IS_READERS), bool(f & NESTED),
        bool(f & IS_GOOD) and not f & (IS_BAD | IS_READERS), bool(f & IS_HIDDEN), block.linked / block.size, log1p(block.size) / 6, bool(SENTENCE.search(block.text)),
        own.tag in HEADINGS, own.tag in PROSE, own.tag == "li", around.linked / max(1, around.linked + around.prose), 0.0 if f & SIDEWAYS else around.prose / prose * (1 - block.linked / block.size),
    ]


@cache
def fitted() -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Weights for pages without and with a marked main part: logistic regressions with a ridge, by Newton's method."""
    x, y = ([], []), ([], [])
    for source in page_samples.pages():
        made, has_main = whole(source)
        for b in made.blocks:
            y[has_main].append(b.text[0] == page_samples.CONTENT)
            x[has_main].append(features(b, has_main, made.root.prose))
    return tuple(regression(np.array(a, float), np.array(b, float)) for a, b in zip(x, y, strict=True))


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> tuple[float, ...]:
    w = np.zeros(FEATURES)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(FEATURES), x.T @ (y - p) - ridge * w)
    return tuple(w.tolist())


def whole(source: str) -> tuple[Page, bool]:
    """The page, and whether it has a marked main part."""
    made = Page(source)
    return made, made.resolve() is not None


def odds(block: Block, has_main: bool, prose: int, weights: tuple[float, ...]) -> float:
    """Log-odds that a block is content."""
    return max(-SURE, min(SURE, sum(map(mul, weights, features(block, has_main, prose)))))


def costs(log_odds: float) -> tuple[float, float]:
    """Costs of calling it boilerplate, and of calling it content."""
    return log1p(exp(log_odds)), log1p(exp(-log_odds))


def edges(blocks: list[Block]) -> dict[tuple[int, int], float]:
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            out[i - 1, i] = ADJACENT / max(1, b.away - 1)
        parent = id(b.element.block.parent)
        if (j := last.get(parent)) is not None and j < i - 1:
            out[j, i] = out.get((j, i), 0) + SIBLING
        last[parent] = i
    return out


def minimum_cut(source: list[float], sink: list[float], links: dict[tuple[int, int], float]) -> list[bool]:
    """For each node whether it is on the source's side of a minimum cut (with ties, on the sink's)."""
    n = len(source)
    gain = [a - b for a, b in zip(source, sink, strict=True)]  # what is left when each node's own path is full
    if all(g > 0 for g in gain) or all(g <= 0 for g in gain):
        return [g > 0 for g in gain]  # no edge is cut
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in links.items():
        near[i][j] = near[i].get(j, 0) + w
        near[j][i] = near[j].get(i, 0) + w
    side: list[bool | None] = [None] * n
    work = deque(range(n))
    while work:  # nodes that no edges can turn
        i = work.popleft()
        if side[i] is None and abs(gain[i]) > sum(near[i].values()) + 1e-12:
            side[i] = gain[i] > 0
            for j, w in near[i].items():
                gain[j] += w if side[i] else -w
                del near[j][i]
                work.append(j)
            near[i] = {}
    for i in range(n):
        if side[i] is None:
            part, at = [i], 0
            side[i] = False
            while at < len(part):
                for j in near[part[at]]:
                    if side[j] is None:
                        side[j] = False
                        part.append(j)
                at += 1
            for j in reached(part, gain, near):
                side[j] = True
    return [bool(s) for s in side]


def reached(part: list[int], gain: list[float], left: list[dict[int, float]]) -> dict[int, int]:
    """Nodes of a connected part on the source's side once the flow in it is greatest: by levels and blocking flows."""
    while True:
        level = {i: 0 for i in part if gain[i] > 1e-12}
        queue, ends = deque(level), False
        while queue:
            i = queue.popleft()
            ends = ends or gain[i] < -1e-12
            for j, w in left[i].items():
                if w > 1e-12 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not ends:
            return level
        ways = {i: list(left[i]) for i in level}
        for start in [i for i in level if level[i] == 0]:
            path = [start]
            while path and gain[start] > 1e-12:
                i = path[-1]
                if gain[i] < -1e-12:
                    flow = min(gain[start], -gain[i], *(left[a][b] for a, b in zip(path, path[1:], strict=False)))
                    gain[start] -= flow
                    gain[i] += flow
                    for a, b in zip(path, path[1:], strict=False):
                        left[a][b] -= flow
                        left[b][a] = left[b].get(a, 0) + flow
                    path = [start]
                    continue
                while ways[i]:
                    j = ways[i][-1]
                    if left[i][j] > 1e-12 and level.get(j) == level[i] + 1:
                        path.append(j)
                        break
                    ways[i].pop()
                else:
                    path.pop()
                    if path:
                        ways[path[-1]].pop()


def labelled(source: str, weights: tuple[tuple[float, ...], ...] | None = None) -> list[tuple[str, bool]]:
    """The blocks of a page, and whether each is content."""
    made, has_main = whole(source)
    if not made.blocks:
        return []
    own = (weights or fitted())[has_main]
    cost = [costs(odds(b, has_main, made.root.prose, own)) for b in made.blocks]
    content = minimum_cut([a for a, _ in cost], [b for _, b in cost], edges(made.blocks))
    return [(b.text, keep) for b, keep in zip(made.blocks, content, strict=True)]


def main_text(source: str, weights: tuple[tuple[float, ...], ...] | None = None) -> str:
    return "\n".join(text for text, keep in labelled(source, weights) if keep)


def text_batches(batches, weights: tuple[tuple[float, ...], ...]):
    sink = Sink(TEXTS)
    for batch in batches:
        for page, url, source in zip(*(values(batch, c) for c in ("page_id", "url", "html")), strict=True):
            if sink.add((page, url, text := main_text(source or "", weights)), len(text) + 100):
                yield from sink.flush()
    yield from sink.flush()


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``page_id, url, text`` for each row, blocks joined by line ends; an empty text if there is no main text.

    A tag whose quote is never closed ends at the next ``>``. A null page counts as empty. Repeated rows, null keys and
    null URLs stay; other columns go; an empty table gives an empty one.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(source), F.lit("")).alias("html"))
    return rows.mapInArrow(task(__name__, "text_batches", weights=fitted()), "page_id long, url string, text string")
