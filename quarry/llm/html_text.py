"""Main text of web pages by composite text density.

A page becomes a tree of elements. Elements that are never main text by their tag (menus, footers, asides, scripts,
controls) are set aside. A role, a name (class or id) or the tag of a form or page header is a hint only: what has one is
set aside unless it holds the page's core, that is an article or main element, else a first heading, else the element of
most plain text that readers did not write, and more text than what no hint touches. For every other element the density is its
characters per tag, adjusted by how much of them is linked; an element's density sum adds up the densities of its
children. The element of the largest sum is the article's core; the least density on its path from the body is the
threshold by which its siblings join it, and an article or main element around it is taken whole. Its text is emitted by
blocks, in page order.

Nulls: null html gives the empty text and 0 characters; a null page_id or url is kept. Repeated rows are extracted each on
their own; nothing is capped, a page of any length is parsed whole. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import slices

#: Fixed values of HTML: elements without an end tag, of unparsed content, of block layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: A start tag ends an open element of these tags, up to the nearest stop.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Never main text.
NOISE_TAGS = frozenset("nav footer aside button select input textarea label script style noscript iframe object embed svg canvas template dialog head menu audio video map search title option".split())
HINT_TAGS = frozenset("form fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar tablist".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adbox adsbygoogle banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs pagination pager sidebar sidebars aside rail footer footers foot masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall share sharing social related recommended recommendations teaser teasers trending popular comment comments commentlist disqus respond reply replies discussion reader-comments search widget widgets tags tagcloud skip skiplink print hidden copyright legal disclaimer outbrain taboola".split()
)
READERS = frozenset("comment comments commentlist disqus respond reply replies discussion reader-comments".split())
NOISE_ARTICLES = frozenset("ad advert comment reply promo sponsored teaser related recommended".split())
#: Names of a page's layout, not of what an element holds.
LAYOUT = ("has-", "with-", "no-", "without-")
KEPT_INSIDE = frozenset(("article", "main"))
HEADS = ("h1", "h2", "h3", "h4", "h5", "h6")
ATTRS = frozenset("class id role hidden aria-hidden style".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s/>=\"'][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")  # one after another, names whole, values never searched
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")  # a slash that ends an unquoted value belongs to it
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


#: What is known of an element before the page is weighed: nothing, a hint that it is noise, one that readers wrote it, noise.
PLAIN, HINT, READER, NOISE = range(4)


class Node:
    __slots__ = ("tag", "parent", "parts", "kind", "noise", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: "Node | None", kind: int):
        self.tag, self.parent, self.kind, self.noise = tag, parent, kind, kind != PLAIN
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def noise_kind(tag: str, attrs: str, inside: bool) -> int:
    """By tag, visibility, role or name. inside: of an article or main element, whose header is its own."""
    if tag in NOISE_TAGS:
        return NOISE
    kind, seen = HINT if tag in HINT_TAGS or (tag == "header" and not inside) else PLAIN, set()
    for m in _ATTR.finditer(attrs) if attrs else ():
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key not in ATTRS or key in seen:  # of a repeated attribute the first counts
            continue
        seen.add(key)
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return NOISE
        if key == "role" and value in NOISE_ROLES:
            kind = max(kind, HINT)
        if key in ("class", "id") and tag not in ("body", "html", "main"):
            names = [w for w in (m[2] or "").strip("\"'").split() if not w.lower().startswith(LAYOUT)]
            words = {x for w in names for x in (w.lower(), *(y.lower() for y in _NAME.findall(w)))}
            if words & (NOISE_NAMES if tag != "article" else NOISE_ARTICLES):
                kind = max(kind, READER if words & READERS else HINT)
    return kind


def text_size(x: Node | str) -> int:
    """Characters of a text, or of an element outside its children."""
    return len(x.strip()) if isinstance(x, str) else sum(len(p.strip()) for p in x.parts if isinstance(p, str))


def settle(root: Node) -> None:
    """Overrule hints on elements that hold the page's core."""
    order: list[tuple[Node, bool]] = []
    todo = [(root, False)]
    while todo:
        x, readers = todo.pop()
        if x.kind == NOISE:
            continue
        readers = readers or x.kind == READER
        order.append((x, readers))
        todo += [(p, readers) for p in reversed(x.parts) if isinstance(p, Node)]
    if not any(x.kind for x, _ in order):
        return
    signs: set[int] = set()
    for among in ([x for x, readers in order if not readers], [x for x, _ in order]):
        own = [(sum(0 if isinstance(p, Node) and (p.tag == "a" or p.noise) else text_size(p) for p in x.parts), id(x)) for x in among if x.tag != "a"]
        largest = max(own, key=lambda y: y[0], default=(0, 0))
        signs = {id(x) for x in among if x.tag in KEPT_INSIDE and x.kind == PLAIN} or {id(x) for x in among if x.tag == "h1"} or {i for n, i in [largest] if n}
        if signs:
            break
    strong, net = set(signs), dict.fromkeys((id(x) for x, _ in order), 0)
    for x, _ in reversed(order):
        net[id(x)] += text_size(x)
        if (up := x.parent) is not None:
            if id(x) in strong:
                strong.add(id(up))
            if x.kind == PLAIN or id(x) in strong:
                net[id(up)] += net[id(x)]
    free, open_ = 0, {id(root)}
    for x, _ in order:
        if x.parent is None or id(x.parent) in open_:
            if x.kind == PLAIN:
                open_.add(id(x))
                free += text_size(x)
    counted: set[int] = set()  # elements whose text a hint overruled further out has brought in
    for x, _ in order:  # outer elements first
        if x.parent is not None and id(x.parent) in counted and (x.kind == PLAIN or id(x) in strong):
            counted.add(id(x))
        if x.kind == PLAIN:
            continue
        inside = net[id(x)]
        outside = free - inside if id(x) in counted else free
        if id(x) in strong and inside > outside:
            x.noise = False
            free = outside + inside
            counted.add(id(x))


def parse(html: str) -> Node:
    root = Node("html", None, PLAIN)
    stack, at, n = [root], 0, len(html)
    inside = 0

    def pop() -> None:
        nonlocal inside
        inside -= stack.pop().tag in KEPT_INSIDE

    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            stack[-1].parts.append(html[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(html[at : m.start()])
        at = m.end()
        end, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag or not m[0].endswith(">"):
            continue
        tag = tag.lower()
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i].tag in ("table", "td", "th", "article", "main") and tag not in ("table", "tr", "tbody", "body", "html", "article", "main", "div", "section"):
                    break
            continue
        if tag in ("html", "body") and tag in (x.tag for x in stack[1:]):
            continue
        if tag == "body":
            while len(stack) > 1:
                pop()
        close, stops = ENDS.get(tag, (None, None))
        if close is None and tag in BLOCK:
            close, stops = {"p"}, {"td", "th", "table", "button", "article", "section", "div"}
        if close:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in close:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i].tag in stops:
                    break
        top = stack[-1]
        node = Node(tag, top, noise_kind(tag, attrs, inside > 0))
        top.parts.append(node)
        if tag in VOID or _CLOSED.search(attrs) and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}[\s/>][^>]*>?|</{tag}>|\Z", re.I).search(html, at)
            node.parts.append(html[at : stop.start()])
            at = stop.end()
            continue
        stack.append(node)
        inside += tag in KEPT_INSIDE
    settle(root)
    return root


def weigh(root: Node) -> Node:
    """Fill in counts, densities and sums; returns the body."""
    order, todo, body = [], [root], root
    while todo:
        x = todo.pop()
        if x.noise:
            continue
        order.append(x)
        if x.tag == "body" and body is root:
            body = x
        todo += [p for p in x.parts if isinstance(p, Node)]
    for x in reversed(order):
        x.chars += sum(len(p.strip()) for p in x.parts if isinstance(p, str))
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, x.tags + 1
        if up := x.parent:
            up.chars += x.chars
            up.tags += x.tags + 1
            up.link_chars += x.link_chars
            up.link_tags += x.link_tags
    whole = body.link_chars / max(body.chars, 1)
    for x in order:
        if not x.chars:
            continue
        tags, links, linked = max(x.tags, 1), max(x.link_tags, 1), max(x.link_chars, 1)
        plain = max(x.chars - x.link_chars, 1)
        base = log(x.chars / plain * x.link_chars + whole * x.chars + e)
        x.density = x.chars / tags * max(log(x.chars / linked * tags / links), 0.0) / log(max(base, 1.0) + e - 1)
        if x.parent:
            x.parent.total += x.density
    return body


def core(body: Node) -> list[Node]:
    """The chosen subtrees in page order."""
    best, todo = body, [body]
    while todo:
        x = todo.pop()
        if x.total > best.total or x.total == best.total and x.chars > best.chars:
            best = x
        todo += [p for p in reversed(x.parts) if isinstance(p, Node) and not p.noise and p.chars]
    path = [best]
    while path[-1] is not body and path[-1].parent:
        path.append(path[-1].parent)
    for x in reversed(path):
        if x.tag in KEPT_INSIDE:
            return [x]
    if best is body or best.parent is None:
        return [best]
    least = min(x.density for x in path)
    chosen: list[Node] = []
    for i in range(len(path) - 1, 0, -1):  # from the body down: what stands beside the path and is as dense as the path's least
        beside = [p for p in path[i].parts if isinstance(p, Node) and not p.noise and p.chars]
        at = beside.index(path[i - 1]) if path[i - 1] in beside else 0
        dense = [p for p in beside if p is not path[i - 1] and p.link_chars * 2 < p.chars and (p.density >= least or i == 1 and p.tag in HEADS)]
        before = [largest(p) if i > 1 else p for p in dense if beside.index(p) < at]
        after = [largest(p) if i > 1 else p for p in dense if beside.index(p) > at]
        chosen = [*before, None, *after] if not chosen else [*chosen[: chosen.index(None)], *before, None, *after, *chosen[chosen.index(None) + 1 :]]
    chosen[chosen.index(None)] = best
    return chosen


def largest(x: Node) -> Node:
    """The element of the largest sum in a subtree, itself if none has one."""
    best, todo = x, [x]
    while todo:
        y = todo.pop()
        if y.total > best.total:
            best = y
        todo += [p for p in reversed(y.parts) if isinstance(p, Node) and not p.noise and p.chars]
    return best


def blocks(nodes: list[Node]) -> Iterator[str]:
    held: list[str] = []
    todo: list[Node | str | None] = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            held.append(x)
        elif x is None:
            yield "".join(held)
            held = []
        elif x.noise and x not in nodes:
            continue
        elif x.tag == "br":
            held.append(" ")
        elif x.tag in BLOCK:
            yield "".join(held)
            held = []
            todo.append(None)
            todo += reversed(x.parts)
        else:
            todo += reversed(x.parts)
    yield "".join(held)


def extract(html: str | None) -> str:
    if not html:
        return ""
    body = weigh(parse(html))
    return "\n\n".join(x for x in (" ".join(unescape(b).split()) for b in blocks(core(body))) if x)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for b in slices(batch, "html"):
                made = [extract(h) for h in b.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), b.column("url"), pa.array(made, pa.string()), pa.array([len(x) for x in made], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
