"""Main text of web pages by composite text density.

Each page becomes a tree of elements. Parts that state what they are (menus, adverts, forms,
comments of readers and so on, by element, role or class) are cut off. Of every element that is
left, the characters per tag are worked out, adjusted by the share of characters and tags in links;
the element with the largest sum of its children's densities holds the main text. The smallest
density on the path from it to the body is the threshold: within every element that reaches it, the
subtree of the largest sum is main text, too.

A page is one row and its tree never leaves it, so the table is scanned once without any exchange;
Python gets small Arrow batches. The work is linear in the page's length, nested or broken as it may be.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

# Fixed values of HTML: elements without content, elements whose content is no markup, elements that make blocks.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: What a start tag closes first if it is open, and what shields it.
_CELL = ("table", "td", "th", "caption", "button", "object")
CLOSES = {
    **{t: (("p", "head"), _CELL) for t in BLOCK - {"title"}},
    "li": (("li", "p"), ("ul", "ol", "menu", "dir", *_CELL)),
    **{t: (("dd", "dt", "p"), ("dl", *_CELL)) for t in ("dd", "dt")},
    **{t: (("td", "th"), ("tr", "table")) for t in ("td", "th")},
    "tr": (("tr", "td", "th"), ("table",)),
    **{t: (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)) for t in ("thead", "tbody", "tfoot")},
    **{t: (("option",), ("select",)) for t in ("option", "optgroup")},
}
#: Elements, roles and words of class or id that mark what is not main text.
CUT_ELEMENTS = frozenset("head title script style noscript template nav footer aside form button select textarea input iframe object embed canvas svg menu dialog audio video datalist search noembed noframes".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead toolbar share sharing social related recommended widget skip login signup paywall".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Words of class or id that say of the word behind them that it is elsewhere or absent.
ELSEWHERE = frozenset("has with no without is hide".split())

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


def _tag_end(s: str, at: int, last: dict[str, int]) -> int:
    """Where the tag ends: the first > outside of a quoted value; a quote that never closes is an ordinary sign."""
    while m := _STOP.search(s, at):
        at, sign = m.start(), m.group()
        if sign == ">":
            return at
        at = s.index(sign, at + 1) + 1 if at < last[sign] and s[max(0, at - 8) : at].rstrip().endswith("=") else at + 1
    return len(s)


def tokens(s: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) with kind one of text, open, close; comments and declarations are left out."""
    at, last = 0, {q: s.rfind(q) for q in "\"'"}
    while at < len(s):
        lt = s.find("<", at)
        if lt < 0:
            yield "text", s[at:], ""
            return
        if lt > at:
            yield "text", s[at:lt], ""
        if s.startswith("<!--", lt):
            end = s.find("-->", lt + 2)
            at = len(s) if end < 0 else end + 3
        elif s[lt + 1 : lt + 2] in ("!", "?"):
            end = s.find(">", lt)
            at = len(s) if end < 0 else end + 1
        else:
            closing = s.startswith("</", lt)
            m = _NAME.match(s, lt + 1 + closing)
            if not m:
                yield "text", "<", ""
                at = lt + 1
                continue
            name, end = m.group().lower(), _tag_end(s, m.end(), last)
            at = end + 1
            yield ("close" if closing else "open"), name, s[m.end() : end]
            if not closing and name in RAW:
                stop = re.compile(f"</{name}(?=[\\s/>])", re.I).search(s, at)
                body = stop.start() if stop else len(s)
                yield "text", s[at:body], ""
                at = body


class Page:
    """The elements of a page in page order: parent, tag, attributes and own texts (with their place in the order)."""

    def __init__(self, s: str) -> None:
        self.tag, self.parent, self.attrs, self.items = ["#page"], [-1], [""], []
        stack: list[int] = [0]
        open_at: dict[str, list[int]] = {}
        blocks = [0]

        def close_to(depth: int) -> None:
            while len(stack) > depth:
                node = stack.pop()
                open_at[self.tag[node]].pop()
                if blocks[-1] == len(stack):
                    blocks.pop()
                self.items.append((node, None))

        for kind, x, attrs in tokens(s):
            if kind == "text":
                self.items.append((stack[-1], x))
            elif kind == "open":
                closed, shields = CLOSES.get(x, ((), ()))
                shield = max((open_at[t][-1] for t in shields if open_at.get(t)), default=0)
                depth = min((d for d in (open_at[t][-1] for t in closed if open_at.get(t)) if d > shield), default=0)
                if depth:
                    close_to(depth)
                self.tag.append(x)
                self.parent.append(stack[-1])
                self.attrs.append(attrs)
                node = len(self.tag) - 1
                self.items.append((node, None))
                if x not in VOID and not attrs.endswith("/"):
                    open_at.setdefault(x, []).append(len(stack))
                    if x in BLOCK:
                        blocks.append(len(stack))
                    stack.append(node)
            elif open_at.get(x):
                depth = open_at[x][-1]
                # what is no block never closes a block around which it was left open
                if x in BLOCK or blocks[-1] < depth:
                    close_to(depth)

    def cut(self) -> list[bool]:
        """Whether an element is no main text by what it or an element around it states.

        Classes, ids and roles of what holds a main element or an outermost article say nothing, but those of an article of comments do.
        """
        n = len(self.tag)
        said = [_said(a) if a else frozenset() for a in self.attrs]
        holds, within, gone = [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            within[i] = within[self.parent[i]] or self.tag[i] in ("article", "main")
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            holds[i] = holds[i] or self.tag[i] == "main" or (self.tag[i] == "article" and not within[p] and not said[i] & COMMENT_WORDS)
            holds[p] = holds[p] or holds[i]
        for i in range(1, n):
            tag, words = self.tag[i], said[i]
            stated = words and not holds[i] and tag not in ("html", "body") and (words & CUT_WORDS or words & COMMENT_WORDS or ("header" in words and not within[i]))
            gone[i] = bool(gone[self.parent[i]] or tag in CUT_ELEMENTS or (tag == "header" and not within[i]) or HIDDEN in words or stated)
        return gone


#: Stands for a hidden element among the words of class and id; roles stand as words that are cut.
HIDDEN, ROLE = "#hidden", "ads"


@lru_cache(maxsize=4096)
def _said(attrs: str) -> frozenset[str]:
    """The words of class and id that hold of the element itself, and what its role and visibility say."""
    a: dict[str, str] = {}
    for name, *values in _ATTR.findall(attrs):
        a.setdefault(name.lower(), "".join(values))
    words = [w.lower() for w in _WORDS.findall(html.unescape(f"{a.get('class', '')} {a.get('id', '')}"))]
    said = {w for before, w in zip(["", *words], words, strict=False) if before not in ELSEWHERE}
    if a.get("role", "").lower() in CUT_ROLES:
        said.add(ROLE)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        said.add(HIDDEN)
    return frozenset(said)


def densities(parent: list[int], chars: list[int], link_chars: list[int], links: list[bool], body: int) -> tuple[list[float], list[float]]:
    """(density, sum of the children's densities) of each element; own texts and whether it is a link are given.

    With C characters and T tags of a subtree, LC and LT those of links (all at least 1), the density
    is C / T * log(C / LC * T / LT) to the base log(C / (C - LC) * LC + LC of the body / C of the body * C + e).
    A text beside an element's children counts as a child of its own.
    """
    n = len(parent)
    c, lc, tags, lt, own = chars[:], link_chars[:], [0] * n, [0] * n, chars
    for i in range(n - 1, 0, -1):
        p = parent[i]
        c[p] += c[i]
        lc[p] += lc[i]
        tags[p] += tags[i] + 1
        lt[p] += lt[i] + links[i]
    share = lc[body] / max(c[body], 1)

    def density(c: int, lc: int, tags: int, lt: int) -> float:
        if c == 0:
            return 0.0
        tags, lt, linked = max(tags, 1), max(lt, 1), max(lc, 1)
        base = log(c / max(c - lc, 1) * linked + share * c + e)
        return c / tags * log(max(c / linked * tags / lt, 1.0)) / log(base)

    d = [density(*x) for x in zip(c, lc, tags, lt, strict=True)]
    total = [density(o, 0, 1, 0) if o and k else 0.0 for o, k in zip(own, tags, strict=True)]
    total = [d[i] if not tags[i] else t for i, t in enumerate(total)]
    for i in range(1, n):
        total[parent[i]] += d[i]
    return d, total


def main_text(s: str) -> str:
    """The main text: blocks in page order, one a line, white space within them as one space."""
    page = Page(s)
    n, gone, parent, tag = len(page.tag), page.cut(), page.parent, page.tag
    # the tree without what was cut off, renumbered in page order
    new, kept = [-1] * n, []
    for i in range(n):
        if not gone[i]:
            new[i] = len(kept)
            kept.append(i)
    up = [new[parent[i]] if i else -1 for i in kept]
    in_link = [False] * len(kept)
    for k in range(1, len(kept)):
        in_link[k] = in_link[up[k]] or tag[kept[k]] == "a"
    chars, link_chars = [0] * len(kept), [0] * len(kept)
    texts = [(node, None if x is None else html.unescape(x) if "&" in x else x) for node, x in page.items if not gone[node]]
    for node, x in texts:
        if x is not None:
            k, size = new[node], len("".join(x.split()))
            chars[k] += size
            link_chars[k] += size * in_link[k]
    body = next((k for k, i in enumerate(kept) if tag[i] == "body"), 0)
    density, total = densities(up, chars, link_chars, [tag[i] == "a" for i in kept], body)
    # the subtree of the largest sum within each element, the outermost of equal ones
    best = list(range(len(kept)))
    for k in range(len(kept) - 1, 0, -1):
        if total[best[k]] >= total[best[up[k]]] and best[up[k]] != up[k] or total[best[k]] > total[best[up[k]]]:
            best[up[k]] = best[k]
    k = best[0]
    path = [k]
    while path[-1] not in (body, 0):
        path.append(up[path[-1]])
    threshold = min(density[j] for j in path)
    reached, chosen = [False] * len(kept), _widened(k, up, [tag[i] for i in kept])
    for j in range(len(kept)):
        if (j == path[-1] or (j and reached[up[j]])) and density[j] >= threshold:
            reached[j] = True
            chosen.add(best[j])
    taken = [False] * len(kept)
    for j in range(len(kept)):
        taken[j] = j in chosen or (j > 0 and taken[up[j]])
    return _blocks(texts, tag, new, taken)


def _widened(k: int, up: list[int], tags: list[str]) -> set[int]:
    """The article or main element around ``k``; where there is none, ``k`` and the page's first h1."""
    j = k
    while j > 0:
        if tags[j] in ("article", "main"):
            return {j}
        j = up[j]
    return {k, tags.index("h1")} if "h1" in tags else {k}


def _blocks(texts: list[tuple[int, str | None]], tag: list[str], new: list[int], taken: list[bool]) -> str:
    out, block = [], []
    for node, x in [*texts, (0, None)]:
        if x is None:
            if tag[node] == "br":
                block.append(" ")
            elif (tag[node] in BLOCK or node == 0) and block:
                if line := " ".join("".join(block).split()):
                    out.append(line)
                block = []
        elif taken[new[node]]:
            block.append(x)
    return "\n".join(out)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``: the main text (empty if none) and its code points.

    A null page counts as empty; null keys and URLs stay; rows that repeat a key are extracted each.
    Other columns are left out; an empty table gives an empty one.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(markup).cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [main_text(s) for s in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return in_arrow(rows, run, "page_id long, url string, text string, n_chars long")
