"""Main text of web pages by composite text density.

A page is parsed into a tree (end tags that HTML lets out are implied, and unclosed elements end with the page).
Elements that are no text of the article by their tag, role, class or id are dropped: menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments; but by class or id alone none that holds an
article or main, or most of the text. Of every node the composite density is
computed: characters per tag, lowered by the share of characters and tags in links. The node with the largest sum
of its children's densities is the core; the least density on its path to the body is the threshold. From the core
the selection climbs as long as a sibling has text that reaches the threshold. Tags are a prior only: an `article` or
`main` is never climbed out of, and one of which the selection holds a third of the text is taken whole. What the
selection covers is returned whole.

Defined results: null or empty html, and pages without any text left, give an empty text. Character references are
decoded; white space inside a block becomes one space; blocks are joined by two newlines. Pages are read whole, in
time linear in their length. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import html
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabtrust.llm.scratch import light, quoted, trimmed

START = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
#: A quote that no other one closes before a space, slash or the end of the tag is a character like others.
TOKEN = re.compile(r"""<(?:!--(?:.*?-->|.*)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>])|["'])*+)>)""", re.S)
#: After a tag that doesn't end so, quotes are characters like others for the rest of the page.
LOOSE = re.compile(r"<(?:!--(?:.*?-->|.*)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>)", re.S)
#: An attribute, whatever its name, so that no part of another one's name or value is read as one.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
TELLING = re.compile(r"class|hidden|id|role|style", re.I)
#: What HTML itself reads as text up to the end tag.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Dropped where their own end tag comes; without it they end with what is around them, and hide nothing.
CLOSED = frozenset("svg noscript template".split())
OPTIONS = frozenset("select option optgroup".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Tags of no article text; a header is kept where it holds the article's own heading.
DROPPED = frozenset("head nav footer aside form button input label fieldset menu dialog search canvas audio video select option optgroup datalist annotation annotation-xml".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs footer foot masthead topbar toolbar comment comments disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup login pagination pager widget widgets skip copyright disclaimer tags search header".split()
)
#: A class or id that starts with one of these names a thing beside the article, however long, and no layout.
BESIDE = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion comment comments disqus reply replies respond related recommended recommendations newsletter".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
KEPT = frozenset("html body article main".split())
WHOLE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3".split())
#: A heading's own class may call it a header; that is no header of the page.
TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element that the start of another one ends, and where the search for it stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("beside", "chars", "density", "dropped", "heading", "kids", "link_chars", "link_tags", "named", "parent", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, dropped: bool | None):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.kids: list[Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.heading = self.named = self.beside = False


def _named(attributes: str, names: frozenset[str] = NAMES) -> tuple[bool, bool, bool]:
    """Whether an element is hidden or dropped by its role, whether a word of its class or id is in names, and whether a first one is in BESIDE."""
    named = beside = False
    for m in ATTRIBUTE.finditer(attributes) if TELLING.search(attributes) else ():
        name, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
        if name == "role":
            if value.lower() in ROLES:
                return True, named, beside
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True, named, beside
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, named, beside
        elif name in ("class", "id"):
            for token in value.split():
                words = [p.lower() for p in PART.findall(token)]
                named |= any(w in names for w in words)
                beside |= words[:1] != [] and words[0] in BESIDE
    return False, named, beside


def _drop(nodes: list[Node], items: list[tuple[Node, str | None]]) -> None:
    """Pass on what is dropped by tag, role or style, and drop what is named, but holds no article or main and not most of the text."""
    size, holds = dict.fromkeys(map(id, nodes), 0), dict.fromkeys(map(id, nodes), False)
    for node, text in items:
        if text is not None:
            size[id(node)] += len(" ".join(text.split()))
    for n in reversed(nodes[1:]):
        if not n.dropped:
            size[id(n.parent)] += size[id(n)]
            holds[id(n.parent)] |= holds[id(n)] or n.tag == "main" or (n.tag == "article" and not n.beside)
    for n in nodes[1:]:
        if n.parent.dropped:
            n.dropped, n.heading = True, False
        elif n.named and not holds[id(n)] and (n.beside or 2 * size[id(n)] <= size[id(nodes[0])]):
            n.dropped = True


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str | None]]]:
    """All nodes, parents first, and the texts in page order; None marks the border of a block."""
    root = Node("html", None, None)
    nodes, items, stack = [root], [], [root]
    at, size = 0, len(page)
    # places in the stack by tag and by group of tags, each ascending: no search walks over the stack
    where: dict[str, list[int]] = {}
    blocks, options, closed, kept = [0], [-1], [-1], [0]
    groups = ((BLOCK, blocks), (OPTIONS, options), (CLOSED, closed), (KEPT, kept))
    lists: dict[str, list[list[int]]] = {}

    def place(tag: str) -> int:
        own = where.get(tag)
        return own[-1] if own else -1

    def opened(node: Node) -> None:
        own = lists.get(node.tag)
        if own is None:
            own = lists[node.tag] = [where.setdefault(node.tag, []), *(places for tags, places in groups if node.tag in tags)]
        for places in own:
            places.append(len(stack))
        stack.append(node)

    def close(to: int) -> None:
        if to >= len(stack):
            return
        if blocks[-1] >= to and not (stack[to].dropped and stack[to].tag in CLOSED):
            items.append((stack[to].parent, None))
        while len(stack) > to:
            for places in lists[stack.pop().tag]:
                places.pop()

    token = TOKEN
    while at < size:
        start = START.search(page, at)
        stop = start.start() if start else size
        if stop > at:
            items.append((stack[-1], page[at:stop]))
        if not start:
            break
        m = token.match(page, stop)
        if not m:
            token = LOOSE
            m = token.match(page, stop)
        if not m:  # the page ends within a tag
            break
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            i = place(tag)
            if i > 0 and (tag in BLOCK or i > (kept if tag in CLOSED else blocks)[-1]):
                stack[i].dropped = stack[i].dropped or tag in CLOSED or None
                close(i)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in ("html", "body"):
            continue
        if tag == "br":
            items.append((stack[-1], " "))
            continue
        if tag in BLOCK:
            if tag != "hr":
                close(options[bisect.bisect(options, blocks[-1])] if options[-1] > blocks[-1] else len(stack))
            if tag in ENDS:
                mine, border = ENDS[tag]
                i = max(place("p"), *map(place, mine))
                if i > max(closed[-1], *map(place, border)):
                    close(i)
            else:
                while place("p") > 0 and place("p") == blocks[-1] > closed[-1]:
                    close(blocks[-1])
            items.append((stack[-1], None))
        if tag in VOID:
            continue
        parent = stack[-1]
        node = Node(tag, parent, None)
        hidden, named, node.beside = _named(m.group(3), NAMES - {"header"} if tag in TITLES else NAMES)
        nested = tag == "article" and place("article") > 0
        node.named = named and (tag not in KEPT or nested)
        if tag in DROPPED or tag == "header" or (hidden and (tag not in KEPT or nested)):
            node.dropped = True
        if tag not in DROPPED and (node.dropped or node.named):
            node.heading = tag == "header" or "header" in m.group(3).lower()
        parent.kids.append(node)
        nodes.append(node)
        if not m.group(3).endswith("/") or tag in BLOCK:
            opened(node)
    _drop(nodes, items)
    return nodes, items


def _keep_headings(nodes: list[Node]) -> None:
    """A header inside an article that holds a heading belongs to the text."""
    for n in nodes:
        if n.tag in HEADINGS and n.dropped:
            chain, top = [], n
            while top is not None and top.tag not in ("article", "main"):
                chain.append(top)
                top = top.parent
            heads = [x for x in chain if x.heading]
            if top is not None and not top.dropped and heads and all(x.heading or x.tag not in DROPPED for x in chain):
                for x in chain:
                    x.dropped = None


def densities(nodes: list[Node], items: list[tuple[Node, str | None]]) -> None:
    for node, text in items:
        if text is not None and not node.dropped:
            node.chars += len(" ".join(text.split()))
    for n in reversed(nodes):
        if n.dropped:
            continue
        if n.tag == "a":
            n.link_chars = n.chars
            n.link_tags += 1
        if p := n.parent:
            p.chars += n.chars
            p.link_chars += n.link_chars
            p.tags += n.tags + 1
            p.link_tags += n.link_tags
    body = nodes[0]
    share = body.link_chars / max(1, body.chars)
    for n in nodes:
        if n.dropped or not n.chars:
            continue
        c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
        base = math.log(c / max(1, c - n.link_chars) * n.link_chars + share * c + math.e)
        n.density = c / t * math.log(max(1.0, c / lc * t / lt) + 1) / base
    for n in nodes:
        n.sum = sum(k.density for k in n.kids if not k.dropped)


def select(nodes: list[Node]) -> Node:
    body = nodes[0]
    core = max((n for n in nodes if not n.dropped), key=lambda n: n.sum)
    path, top = [], core
    while top is not None:
        path.append(top)
        top = top.parent
    threshold = min(n.density for n in path)
    at = core
    while at is not body and at.tag not in WHOLE:
        others = [k for k in at.parent.kids if k is not at and not k.dropped and k.chars]
        if (others or at.parent is body) and not any(k.density >= threshold for k in others):
            break
        at = at.parent
    around = [n for n in path if n.tag in WHOLE and 3 * at.chars >= n.chars]
    if around and at.chars <= around[-1].chars:
        return around[-1]
    inside = [n for n in nodes if n.tag in WHOLE and not n.dropped and 2 * n.chars > body.chars]
    return inside[0] if at is body and inside else at


def main_text(page: str) -> str:
    nodes, items = parse(page)
    _keep_headings(nodes)
    densities(nodes, items)
    root = select(nodes)
    inside: dict[int, bool] = {}
    for n in nodes:  # parents come first
        inside[id(n)] = not n.dropped and (n is root or (n.parent is not None and inside[id(n.parent)]))
    blocks, now = [], []
    for node, text in items:
        if text is None:
            if now and not node.dropped:
                blocks.append("".join(now))
                now = []
        elif inside[id(node)]:
            now.append(text)
        elif now and text.strip() and not node.dropped:
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    cleaned = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in cleaned if b)


RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


@F.pandas_udf(RESULT)
@trimmed
def _extract(pages: pd.Series) -> pd.DataFrame:
    texts = [main_text(p or "") for p in pages]
    return pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and its number of code points, of every page."""
    return light(pages).select(quoted(id_col).alias("page_id"), quoted(url_col).alias("url"), _extract(quoted(html_col)).alias("x")).select("page_id", "url", "x.*")
