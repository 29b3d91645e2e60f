"""Main text of web pages by tree scoring.

A page is read once into blocks of text that know their ancestors. Each block
passes points for length and commas to its ancestors, less with distance; an
ancestor's points are discounted by its share of link text. The best container
is kept with those siblings that score like text, and without what is
boilerplate by element, role or class. What may be boilerplate but holds most of
the page, as a form around all of it does, is no boilerplate.

Time is linear in the page: what a node inherits is kept on it, and the sums of
its subtree are added up once, children before parents.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

# Elements of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
DROP = frozenset("script style noscript template iframe object embed applet head title nav aside footer button select option textarea input dialog menu svg math canvas audio video map noembed noframes".split())
MAYBE = frozenset(["form"])
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
# Words of class and id names that mark boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox banner banners sponsor sponsored promo promos promotion popup modal overlay "
    "cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations sidebar sidenav rail menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments "
    "commentlist disqus replies respond toolbar pagination pager skip widget widgets hidden".split()
)
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
CLOSES_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = frozenset("table ul ol dl select article section div main body html td th".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"""=\s*(["'])|>""")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


class Node:
    """drop, inside (an article) and block (the innermost block element) hold for all below; open counts what is open right within this scope or block."""

    __slots__ = ("tag", "parent", "drop", "maybe", "inside", "block", "scope", "open", "chars", "linked", "depth", "flag")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, maybe: bool = False):
        self.tag, self.parent, self.maybe = tag, parent, maybe
        self.drop = drop or (parent is not None and parent.drop)
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        self.block = parent.block if parent is not None and tag in INLINE else self
        self.scope = self if parent is None or tag in SCOPE else parent.scope
        self.open: dict[str, int] = {}
        self.chars, self.linked, self.flag = 0, 0, False
        self.depth = parent.depth + 1 if parent else 0


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


def _verdict(tag: str, raw: str, parent: Node) -> tuple[bool, bool]:
    """(dropped for sure, dropped unless it holds most of the page)."""
    if tag in DROP:
        return True, False
    inside = parent.inside
    maybe = (tag == "header" and not inside) or tag in MAYBE
    if raw.strip(" /"):
        a = _attributes(raw)
        if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I) or a.get("role", "").lower() in ROLES:
            return True, False
        if tag not in ("html", "body"):
            names = _WORD.findall(_CAMEL.sub(" ", f"{a.get('class', '')} {a.get('id', '')}").lower())
            maybe = maybe or not MARKS.isdisjoint(names) or ("header" in names and not inside)
    return False, maybe


def _up(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _skip_raw(page: str, tag: str, at: int) -> int:
    """Where the raw text of an element ends: its end tag, or the end of the page."""
    m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
    return m.start() if m else len(page)


def _tag_end(page: str, at: int) -> int:
    """Where the tag's ">" is, quoted values skipped; -1 if there is none."""
    while m := _STOP.search(page, at):
        if not m[1]:
            return m.start()
        close = page.find(m[1], m.end())
        if close < 0:
            return -1
        at = close + 1
    return -1


def read(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """The nodes, parents before children, and the blocks in page order: their innermost block element, text, and characters within links."""
    root = Node("#", None)
    stack, nodes = [root], [root]
    blocks: list[tuple[Node, str, int]] = []
    parts: list[tuple[str, bool]] = []
    links, loose = 0, False
    count: dict[str, int] = {}

    def flush() -> None:
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                blocks.append((stack[-1].block, text, sum(len(" ".join(p.split())) for p, inside in parts if inside)))
            parts.clear()

    def home(x: Node) -> dict[str, int]:
        """Where an open node is counted besides `count`: an inline one in its block, others in their scope."""
        return x.parent.block.open if x.tag in INLINE else x.parent.scope.open

    def pop(n: int) -> None:
        nonlocal links
        while len(stack) > n:
            x = stack.pop()
            count[x.tag] -= 1
            home(x)[x.tag] -= 1
            if x.tag == "a":
                links -= 1

    def say(raw: str) -> None:
        if raw and not stack[-1].drop:
            parts.append((html.unescape(raw) if "&" in raw else raw, links > 0))

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        m = _NAME.match(page, lt)
        end = -1 if not m or loose else _tag_end(page, m.end())
        if m and end < 0:
            loose = True  # a quote without end: from here on, tags end at the next ">"
            end = page.find(">", m.end())
        if not m or end < 0:
            say("<")
            at = lt + 1
            continue
        at, rest = end + 1, page[m.end() : end]
        tag = m[2].lower()
        if m[1]:
            # an inline end tag does not close blocks
            if (stack[-1].block.open if tag in INLINE else count).get(tag):
                if tag not in INLINE:
                    flush()
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                pop(i)
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
            shut = ("p",) if tag in CLOSES_P else CLOSES_SAME.get(tag, ())
            opened = stack[-1].scope.open if shut == ("p",) else count
            for i in range(len(stack) - 1 if any(opened.get(t) for t in shut) else 0, 0, -1):
                if stack[i].tag in shut:
                    pop(i)
                    if tag == "p" or tag not in CLOSES_SAME:
                        break
                elif stack[i].tag in SCOPE and stack[i].tag not in shut:
                    break
        drop, maybe = _verdict(tag, rest, stack[-1])
        if tag in RAW:
            at = _skip_raw(page, tag, at)
            end = page.find(">", at)
            at = size if end < 0 else end + 1
            continue
        if rest.endswith("/") and tag in ("svg", "math"):
            continue
        x = Node(tag, stack[-1], drop, maybe)
        stack.append(x)
        nodes.append(x)
        count[tag] = count.get(tag, 0) + 1
        home(x)[tag] = home(x).get(tag, 0) + 1
        links += tag == "a"
    flush()
    return nodes, blocks


_START = {"article": 25.0, "main": 25.0, "section": 3.0, "div": 5.0, "blockquote": 3.0, "td": 3.0, "pre": 3.0}


def main_text(page: str | None) -> str:
    """The article's blocks, one a line; empty if there is none."""
    if not page:
        return ""
    nodes, blocks = read(page)
    for node, text, linked in blocks:
        node.chars += len(text)
        node.linked += min(linked, len(text))
    for n in reversed(nodes[1:]):
        n.parent.chars += n.chars
        n.parent.linked += n.linked
    whole = max(1, nodes[0].chars - nodes[0].linked)
    for n in nodes:
        n.flag = n.drop or (n.maybe and n.chars - n.linked < 0.6 * whole) or (n.parent is not None and n.parent.flag)
    kept = [(n, t, k) for n, t, k in blocks if not n.flag]
    if not kept:
        return ""
    scored: dict[Node, float] = {}
    for node, text, linked in kept:
        prose = len(text) - linked
        points = (1 + text.count(",") + min(prose / 100, 3)) * (1 - min(1.0, linked / len(text)))
        if prose < 25:
            points *= prose / 25
        own = node.parent if node.tag in ("p", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "figcaption", "dt", "dd", "td", "th") and node.parent else node
        share = 1.0
        for i, n in enumerate(_up(own)):
            scored[n] = scored.get(n, 0.0) + points * share
            share = 0.5 if i == 0 else share * 2 / 3
            if i >= 4 or n.tag == "body":
                break
    density = lambda n: n.linked / n.chars if n.chars else 0.0
    rank = {n: (s + _START.get(n.tag, 0.0) * (s > 0)) * (1 - density(n)) for n, s in scored.items()}
    best = max(rank, key=lambda n: (rank[n], n.depth))
    for n in _up(best):  # the article around the best part of it
        if n.tag in ("article", "main") and n.chars:
            best = n
    keep = {best}
    if best.parent is not None and best.tag not in ("body", "html", "#"):
        bar = max(10.0, 0.2 * rank.get(best, 0.0))
        # siblings: containers that score by themselves, and plain paragraphs of prose beside the container
        for n, s in rank.items():
            if n.parent is best.parent and s >= bar and density(n) < 0.3:
                keep.add(n)
        for node, text, linked in kept:
            if node.tag == "p" and node.parent is best.parent and linked < 0.25 * len(text) and (len(text) > 80 or (linked == 0 and text.endswith((".", "!", "?")))):
                keep.add(node)
    for n in nodes:
        n.flag = n in keep or (n.parent is not None and n.parent.flag)
    return "\n".join(t for n, t, _ in kept if n.flag)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*batch.schema.names[:-1], "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html).

    A null or empty page, or one without text outside boilerplate, has an empty
    text. Repeated rows are kept, other columns ignored; no rows, no result.
    """
    C.small_batches(pages.sparkSession)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return p.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
