"""Main text of web pages by tag-path ratios.

A page is read into text leaves with their root-to-leaf tag paths. What is never shown as running text
(scripts, styles, controls) is out. For the rest, text length and punctuation are aggregated per tag path,
as ratios to the number of its leaves; both are smoothed over neighbouring leaves and fused by their
geometric mean; paths above a share of the best one hold content. Tags and names are one more signal: an
element whose tag (nav, form, footer ...) or whose class, id or role says that it is not the article is out
unless it holds most of the content. Where the page has one article or main element, only its text counts as
content. The smallest sectioning element around the content's leaves is the
article. Of the leaves in it, those on content paths stay, and so do headings, lists, tables, quotes and
single short blocks between them; a box (div, section ...) of several blocks of which none is on a path
that is dense by itself is out: an unnamed menu, a list of links, a box of short comments.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.2     # of the best path's fused ratio
SMOOTHING = (1, 2, 4, 2, 1)

# What the elements of HTML are.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
_OUT = frozenset("head script style noscript template title svg math canvas iframe object audio video button select option "
                 "datalist textarea label input map xmp noembed noframes".split())
# tags that mark what is not the article, unless most of the content is in them
_TAGGED_OUT = frozenset("nav aside footer form fieldset menu dialog header".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                   "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
                   "ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
_SECTION = frozenset("article main section div body td center form".split())
_BOX = frozenset("div section center aside form fieldset".split())
_SOLID, _LIST = frozenset("table pre figure blockquote dl".split()), frozenset("ul ol".split())
_SPACE = " \t\n\r\f"
# an opening tag closes these open elements, up to the barrier
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
           "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_CLOSES_P = _BLOCK - {"body", "html", "head", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
# Words of class, id and role that mark what is not the article.
_NAMED_OUT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar "
    "navigation menu menus breadcrumb breadcrumbs sidebar aside rail footer masthead topbar header comment comments "
    "commentlist reply replies respond disqus discussion cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "widget pagination pager search complementary contentinfo dialog hidden".split())
# Words that say nothing beside one of those: a name counts when all its parts are of the two lists.
_NAMED_NEUTRAL = frozenset(
    "area bar block body bottom box boxes button buttons container content form global group holder icon icons inner item "
    "items left link links list main message outer page panel popup post posts primary right row secondary section sections "
    "site slot small stories story tab tabs text thread top unit wrap wrapper".split())

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>"
                    r"|<[!?/][^>]*(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
_UNFINISHED = re.compile(r"<(?:[A-Za-z/!?][^<>]*)?\Z")
_SPACES = re.compile(r"[ \t\n\r\f\v   -     　\x85]+")


@dataclass
class Node:
    name: str
    path: int  # number of its tag path
    parent: Node | None
    out: bool
    in_article: bool  # it or an element around it is an article
    named: bool = False  # its class, id or role says that it is not the article
    inside: int = 0  # content elements in it, itself included
    held: int = 0  # characters of content in it


@dataclass
class Leaf:
    node: Node
    text: str
    block: int


def _says_out(word: str, name: str) -> bool:
    """Whether a class, id or role names what is not the article; of compound names, every part must say so."""
    if word in _NAMED_OUT:
        return True
    parts = [p for p in re.split(r"[-_0-9]+", word) if p]
    return (name not in ("article", "main", "body") and not _NAMED_OUT.isdisjoint(parts)
            and all(p in _NAMED_OUT or p in _NAMED_NEUTRAL for p in parts))


def _marked_out(name: str, attrs: str, inside: Node) -> tuple[bool, bool]:
    """Whether an element is out, and whether its tag or its name only says so."""
    if name in _OUT:
        return True, False
    in_article = inside.in_article
    named = name in _TAGGED_OUT and not (name == "header" and in_article)  # an article's own header has its title
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True, False
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return True, False
        if key in ("class", "id", "role") and not named:
            named = any(_says_out(word, name) and not (in_article and "header" in re.split(r"[-_0-9]+", word))
                        for word in value.split())
    return False, named


def leaves(page: str) -> tuple[list[Leaf], list[Node]]:
    """Text leaves of a page in order, each with its element and the number of its block, and all elements.

    Elements come after those around them. Tag paths are numbered, so that deep pages stay small.
    """
    root = Node("", 0, None, False, False)
    stack, found, block = [root], [], 0
    nodes, paths, open_names = [root], {}, Counter()
    at, size = 0, len(page)

    def text(raw: str) -> None:
        value = html.unescape(raw)
        if value:
            found.append(Leaf(stack[-1], value, block))

    def close(k: int) -> None:
        open_names.subtract(n.name for n in stack[k:])
        del stack[k:]

    def close_until(names: set[str], barrier: set[str] | frozenset[str]) -> None:
        if not any(open_names[n] for n in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                close(k)
                return
            if stack[k].name in barrier:
                return

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            text(_UNFINISHED.sub("", page[at:]))
            break
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        name, attrs = m["name"].lower(), m["attrs"]
        if m["close"]:
            if name in _BLOCK:
                block += 1
            for k in range(len(stack) - 1, 0, -1) if open_names[name] else ():
                if stack[k].name == name:
                    close(k)
                    break
                if name not in _BLOCK and stack[k].name in _BLOCK:
                    break  # an inline end tag closes nothing beyond its block
            continue
        if name in _BLOCK:
            block += 1
        if name in _CLOSES_P:
            close_until({"p"}, {"table", "td", "th", "article", "section", "div", "li", "body", "main", "blockquote"})
        if name in _CLOSES:
            close_until(*_CLOSES[name])
        if name in _VOID:
            if name == "br" or name == "hr":
                found.append(Leaf(stack[-1], " ", block))
            continue
        parent = stack[-1]
        path = paths.setdefault((parent.path, name), len(paths) + 1)
        out, named = (True, False) if parent.out else _marked_out(name, attrs, parent)
        node = Node(name, path, parent, out, parent.in_article or name in ("article", "main"), named)
        nodes.append(node)
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            stop = size if end is None else end.start()
            at = stop if end is None else (page.find(">", stop) + 1 or size)
            continue
        if not attrs.rstrip().endswith("/") or name in _BLOCK:
            stack.append(node)
            open_names[name] += 1
    return found, nodes


def content_paths(kept: list[Leaf]) -> set[int]:
    """Tag paths whose smoothed, fused ratios of text and punctuation to leaves pass the threshold."""
    totals: dict[int, list[float]] = {}
    for leaf in kept:
        t = totals.setdefault(leaf.node.path, [0, 0, 0])
        t[0] += len(leaf.text.strip())
        t[1] += sum(1 for c in leaf.text if not (c.isalnum() or c.isspace()))
        t[2] += 1
    ratios = [(totals[x.node.path][0] / totals[x.node.path][2], (1 + totals[x.node.path][1]) / totals[x.node.path][2])
              for x in kept]
    half = len(SMOOTHING) // 2
    fused: dict[int, list[float]] = {}
    for i, leaf in enumerate(kept):
        weight = text = marks = 0.0
        for k, w in enumerate(SMOOTHING):
            j = i + k - half
            if 0 <= j < len(kept):
                weight, text, marks = weight + w, text + w * ratios[j][0], marks + w * ratios[j][1]
        f = fused.setdefault(leaf.node.path, [0.0, 0])
        f[0] += math.sqrt(text / weight * marks / weight) * totals[leaf.node.path][0]
        f[1] += totals[leaf.node.path][0]
    score = {p: f[0] / f[1] for p, f in fused.items() if f[1]}
    best = max(score.values(), default=0)
    return {p for p, s in score.items() if s >= THRESHOLD * best}


def told(kept: list[Leaf], nodes: list[Node]) -> list[Leaf]:
    """The leaves of the page's article where it tells which one it is: its only outermost article or main element
    that is not in a named one and has text. Else all leaves."""
    named: set[int] = set()
    outermost: dict[int, Node] = {}  # of the nodes in it
    for node in nodes[1:]:
        up = id(node.parent)
        if node.named or node.out or up in named:
            named.add(id(node))
        elif up in outermost:
            outermost[id(node)] = outermost[up]
        elif node.name in ("article", "main"):
            outermost[id(node)] = node
    inside = [x for x in kept if id(x.node) in outermost]
    return inside if len({id(outermost[id(x.node)]) for x in inside}) == 1 else kept


def drop_named(kept: list[Leaf], nodes: list[Node]) -> None:
    """Named elements are out with all in them, but for those that hold most of the content."""
    paths = content_paths(kept)
    for x in kept:
        if x.node.path in paths:
            x.node.held += len(x.text.strip())
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.held += node.held
    for node in nodes[1:]:
        node.out = node.out or node.parent.out or (node.named and 2 * node.held <= nodes[0].held)


def article_of(nodes: list[Node], content: list[Node]) -> Node:
    """The outermost article around all content elements, or else the innermost section around them."""
    for node in content:
        node.inside = 1
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.inside += node.inside
    around = [n for n in nodes if n.inside == len(content)]  # one line, from the root inwards
    named = next((n for n in around if n.name in ("article", "main")), None)
    return named or next((n for n in reversed(around) if n.name in _SECTION), around[0])


def main_text(page: str) -> str:
    """The article of a page: its blocks in order, joined by newlines."""
    found, nodes = leaves(page)
    if any(n.named for n in nodes):
        drop_named(told([x for x in found if not x.node.out and x.text.strip()], nodes), nodes)
    every = [x for x in found if not x.node.out]
    kept = told([x for x in every if x.text.strip()], nodes)
    if not kept:
        return ""
    paths = content_paths(kept)
    article = article_of(nodes, list({id(x.node): x.node for x in kept if x.node.path in paths}.values()))
    within = {id(article)}
    for node in nodes:
        if id(node.parent) in within:
            within.add(id(node))
    every = [x for x in every if id(x.node) in within]
    mark_boxes(article, nodes, every, kept)
    blocks: dict[int, list[str]] = {}
    for x in every:
        if not x.node.out:
            blocks.setdefault(x.block, []).append(x.text)
    lines = (_SPACES.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(s for s in lines if s)


def mark_boxes(article: Node, nodes: list[Node], found: list[Leaf], kept: list[Leaf]) -> None:
    """Boxes of several blocks in the article without a dense path in them are out, with all in them.

    A path is dense when its own fused ratio, not smoothed, passes the threshold. Boxes with a table, a quote,
    a figure or code stay, and so do boxes with lists unless most of their text is in links.
    """
    own: dict[int, list[float]] = {}
    for x in kept:
        t = own.setdefault(x.node.path, [0, 0, 0])
        t[0] += len(x.text.strip())
        t[1] += sum(1 for c in x.text if not (c.isalnum() or c.isspace()))
        t[2] += 1
    score = {p: math.sqrt(t[0] * (1 + t[1])) / t[2] for p, t in own.items()}
    best = max(score.values(), default=0)
    spans: dict[int, list] = {}  # of a node: first block, last block, dense, tags in it, characters, of them in links
    for x in found:
        if not x.text.strip():
            continue
        s = spans.setdefault(id(x.node), [x.block, x.block, False, set(), 0, 0])
        s[0], s[1] = min(s[0], x.block), max(s[1], x.block)
        s[2] = s[2] or score.get(x.node.path, 0) >= THRESHOLD * best
        s[4] += len(x.text.strip())
    for node in reversed(nodes):  # elements come after those around them
        s = spans.get(id(node))
        if s is None or node is article:
            continue
        if node.name == "a":
            s[5] = s[4]
        up = spans.setdefault(id(node.parent), [s[0], s[1], False, set(), 0, 0])
        up[0], up[1], up[2] = min(up[0], s[0]), max(up[1], s[1]), up[2] or s[2]
        up[3] |= s[3] | ({node.name} & (_SOLID | _LIST))
        up[4], up[5] = up[4] + s[4], up[5] + s[5]
    for node in nodes:
        s = spans.get(id(node))
        if node.parent is not None and node is not article and s is not None and not node.out:
            node.out = node.parent.out or (node.name in _BOX and s[0] < s[1] and not s[2] and not s[3] & _SOLID
                                           and (not s[3] & _LIST or 2 * s[5] > s[4]))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points of text) for each row of ``pages``.

    Character references are decoded; white space inside a block becomes one space; blocks are joined
    by one newline. A headline in a header outside the article is the site's and stays out. A null or empty page, or one without content, has the empty text. Unfinished tags
    at the end of a cut page are dropped. Null and repeated ids and urls are kept, row by row; an
    empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py() or "") for h in b.column("html")]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                                   pa.array([len(t) for t in texts], pa.int64())],
                                  names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                        F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
