"""Operator 3: main text of web pages by tag-path ratios.

Each page is read once into text blocks with their root-to-leaf tag path (block elements and their
first class). Text length and punctuation are added up per path and divided by the path's number
of blocks; both ratios are smoothed along the order in which paths appear, scaled, fused, lowered
by the share of text in links and of blocks in elements that by class or id are menus, notices,
adverts, comments and the like, and cut at the page's mean. The article is the smallest element that
holds all blocks of the chosen paths, or the <article> or <main> around it. Its chosen blocks are the
result, with the others beside them that are neither mostly links nor so named, and with headings
and paragraphs that stand right beside the article or the elements around it, below <body>.
Menus, footers, forms and hidden elements are left out by their tags and roles.

Defined results: null, empty and text-free pages give an empty text; broken markup is closed the
way browsers do for paragraphs, list items and table cells; very long pages take one linear pass;
repeated rows each get a result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rfmspark.llm.common import setup

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CLEAN = re.compile(r"[^a-z0-9]+")
_MARKS = re.compile(r"[.,;:!?…。，、；：！？¿¡]")

# HTML's element kinds.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
          "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
            "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
PEERS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
         "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# What marks an element as no part of the article.
OUTSIDE_TAGS = {"head", "nav", "footer", "aside", "form", "button", "select", "object", "svg", "canvas", "audio", "video", "dialog", "menu",
                "fieldset", "input", "label", "map", "math"} | RAW
OUTSIDE_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment",
                 "comments", "consent", "cookie", "cookies", "copyright", "disqus", "discussion", "footer", "gdpr", "login", "masthead", "menu",
                 "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pager", "pagination", "paywall", "popup", "promo",
                 "promotion", "recommended", "related", "replies", "respond", "rss", "search", "share", "sharing", "sidebar", "signup", "skip",
                 "social", "sponsor", "sponsored", "subscribe", "subscription", "tags", "toolbar", "topbar", "widget", "widgets", "header"}
OUTSIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
KEEP_TAGS = {"html", "body", "article", "main"}
BESIDE = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre", "figcaption"}
#: What is left of the score of a path whose blocks all are in elements named as no part of the article.
NAMED = 0.1


class Element:
    __slots__ = ("name", "path", "outside", "named", "block", "article")

    def __init__(self, name, parent, number, attrs, page):
        self.name = name
        first, outside, named = "", parent.outside if parent else False, parent.named if parent else False
        self.article = (parent.article if parent else False) or name in ("article", "main")
        if name in OUTSIDE_TAGS or name == "header" and not self.article:
            outside = True
        if attrs and name not in ("html", "body"):
            known = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
            first = known.get("class", "").split(" ")[0]
            names = set(_CLEAN.split(f"{known.get('class', '')} {known.get('id', '')}".lower()))
            if self.article:
                names.discard("header")  # an article's own
            named |= name not in KEEP_TAGS and bool(names & OUTSIDE_NAMES)
            if name not in KEEP_TAGS and known.get("role", "").lower() in OUTSIDE_ROLES or "hidden" in known \
                    or known.get("aria-hidden") == "true" or "display:none" in known.get("style", "").replace(" ", "").lower():
                outside = True
        self.outside, self.named = outside, named
        if name in INLINE and parent:
            self.path, self.block = parent.path, parent.block
        else:
            self.path = page.path(parent.path if parent else -1, f"{name}.{first}" if first else name)
            self.block = number
            page.parents.append(parent.block if parent else -1)
            page.names.append(name)


class Page:
    """Text blocks in page order, the parent of every block element (numbered in page order) and the paths met."""

    def __init__(self):
        self.found: list[tuple[int, int, bool, str, int, bool]] = []  # path, element, outside, text, characters in links, named
        self.parents: list[int] = []
        self.names: list[str] = []
        self.paths: dict[tuple[int, str], int] = {}

    def path(self, above: int, step: str) -> int:
        return self.paths.setdefault((above, step), len(self.paths))

    def held(self, weight: dict[int, int]) -> list[int]:
        """Weight of every element with all it holds."""
        total = [0] * len(self.parents)
        for e, w in weight.items():
            total[e] += w
        for e in range(len(total) - 1, 0, -1):
            total[self.parents[e]] += total[e]
        return total

    def within(self, top: int) -> list[bool]:
        """Which elements lie in ``top``, itself included."""
        out = [e == top for e in range(len(self.parents))]
        for e in range(top + 1, len(out)):
            out[e] = out[self.parents[e]]
        return out


def blocks(page: str) -> Page:
    """The page's text blocks and their elements."""
    out = Page()
    stack = [Element("#root", None, 0, "", out)]
    parts: list[str] = []
    linked = links = 0
    at, last = 0, page.rfind(">")

    def flush():
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            top = stack[-1]
            out.found.append((top.path, top.block, top.outside, text, min(linked, len(text)), top.named))
        parts.clear()
        linked = 0

    def say(raw):
        nonlocal linked
        if raw:
            t = entities.unescape(raw) if "&" in raw else raw
            if stack[-1].name in INLINE and (stack[-1].outside and not stack[-2].outside or stack[-1].named and not stack[-2].named):
                return  # a hidden or marked inline element inside a kept block
            parts.append(t)
            if links:
                linked += len(t.strip())

    def pop_to(depth):
        nonlocal links
        if any(e.name not in INLINE for e in stack[depth:]):
            flush()
        links -= sum(e.name == "a" for e in stack[depth:])
        del stack[depth:]

    find = _TOKEN.search
    while at <= last and (m := find(page, at)):
        say(page[at:m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].name == name:
                    pop_to(d)
                    break
                if name in INLINE and stack[d].name not in INLINE:
                    break  # an inline end tag doesn't close a block
            continue
        if name in VOID:
            if name == "hr":
                flush()
            else:
                parts.append(" ") if name == "br" else None
            continue
        if name in CLOSES_P:
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].name == "p":
                    pop_to(d)
                    break
                if stack[d].name not in INLINE:
                    break
        if name in PEERS:
            peers, bounds = PEERS[name]
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].name in bounds:
                    break
                if stack[d].name in peers:
                    pop_to(d)
                    break
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name not in INLINE:
            flush()
        if not attrs.rstrip().endswith("/") or name in INLINE or name in CLOSES_P:
            stack.append(Element(name, stack[-1], len(out.parents), attrs, out))
            links += name == "a"
    say(page[at:])
    flush()
    return out


def path_scores(found: list[tuple[int, int, bool, str, int, bool]]) -> dict[int, float]:
    """Fused score of every path: smoothed text and punctuation per block, lowered by the shares of link text and of named blocks."""
    stats: dict[int, list[int]] = {}
    for path, _, outside, text, linked, named in found:
        s = stats.setdefault(path, [0, 0, 0, 0, 0, 0])
        s[0] += 1
        s[1] += len(text)
        s[2] += len(_MARKS.findall(text))
        s[3] += linked
        s[4] |= not outside
        s[5] += named
    if not stats:
        return {}
    v = np.array(list(stats.values()), float)
    fused = np.zeros(len(v))
    for k in (1, 2):
        ratio = np.pad(v[:, k] / v[:, 0], 1, mode="edge")
        smooth = 0.25 * ratio[:-2] + 0.5 * ratio[1:-1] + 0.25 * ratio[2:]
        own = v[:, k] / v[:, 0]
        smooth = np.minimum(smooth, 2 * own + 1)  # a rich neighbour lifts a path, but doesn't make it rich
        fused += smooth / max(smooth.max(), 1e-9) / 2
    fused *= (1 - v[:, 3] / np.maximum(v[:, 1], 1)) * v[:, 4] * (1 - (1 - NAMED) * v[:, 5] / v[:, 0])
    return dict(zip(stats, fused))


def main_text(page: str) -> str:
    tree = blocks(page)
    inner = [b for b in tree.found if not b[2]]
    if not inner:
        return ""
    scores = path_scores(tree.found)
    cut = np.mean([scores[p] for p in {b[0] for b in inner}])
    chosen = [b for b in inner if scores[b[0]] >= cut]
    weight: dict[int, int] = {}
    for b in chosen:
        weight[b[1]] = weight.get(b[1], 0) + 1
    held = tree.held(weight)
    best = max(e for e, w in enumerate(held) if w == held[0])  # they lie in each other, so the last is the deepest
    if best in weight and tree.parents[best] >= 0:
        best = tree.parents[best]  # a single block outweighs all: what stands beside it belongs to the article too
    above, e = [], best
    while e >= 0:
        above.append(e)
        e = tree.parents[e]
    best = max((e for e in above if tree.names[e] in ("article", "main")), key=lambda e: -e, default=best)
    inside = tree.within(best)
    around = {e for e in above if e <= best and tree.names[e] not in ("#root", "html", "body")}
    cut_ids = {id(b) for b in chosen}

    def stays(b) -> bool:
        _, e, _, text, linked, named = b
        name, up = tree.names[e], tree.parents[e]
        if inside[e]:
            return id(b) in cut_ids or name == "h1" or not named and (2 * linked <= len(text) or name in BESIDE)
        if name == "h1":
            return up in around or up >= 0 and tree.parents[up] in around
        return name in BESIDE and up in around and not named and 2 * linked <= len(text)
    return "\n".join([b[3] for b in inner if stays(b)])


def _extract(batches):
    for batch in batches:
        text = [main_text(h or "") for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(text, pa.string()),
                                          "n_chars": pa.array([len(t) for t in text], pa.int64())})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    setup(pages.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
