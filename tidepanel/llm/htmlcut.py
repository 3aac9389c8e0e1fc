"""Main text of HTML pages by minimum-cut labelling.

:func:`blocks` turns a page into its text blocks, each with the elements that hold it. A linear classifier
(:data:`WEIGHTS` over :func:`evidence`) gives each block a cost of being called content or boilerplate;
these are the capacities from and to the terminals. Blocks that follow each other, and blocks under the
same container, are joined by smoothness edges, the stronger the nearer they are in the tree. The minimum
cut (:func:`min_cut`, by augmenting paths of least length) separates content from boilerplate.

Blocks within elements that never hold article text (:data:`NEVER`: scripts, styles, forms and the like)
are cut off from the start. A page may lack end tags, have them crossed or break off anywhere; tags close
what HTML says they close. Character references are decoded, with or without their semicolon, white space
within a block becomes one space, and blocks are joined by one space in page order. A null or empty page
has the text ''. A tag ends as HTML says: at a ">" outside quoted values, or at the page's end. Rows that share an id are pages of their own. Nothing is cut short: work is in proportion
to a page's length, and each block has a bounded number of edges.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A quote means something only right after "="; elsewhere it is a character of a name or value. A value whose quote nothing closes
# ends at a blank or ">". Possessive throughout, so nothing is looked at twice.
VALUE = r"\"[^\"]*+\"|'[^']*+'|[^\s>]*+"
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|</>|<(?:[!?]|/[^a-zA-Z])[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:{VALUE}))?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
BLANK = re.compile(r"\s+")
# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img ruby rb rp rt label".split())
NEVER = frozenset("script style noscript template iframe head title form button select option input textarea svg math canvas audio video object embed nav menu dialog datalist".split())
PARTS = frozenset("header footer aside".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tbody"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPES = frozenset("table ul ol dl select body html".split())
# Names at the beginning or the end of a word of class or id. Those of _LAYOUT also name what holds a whole page.
_STRONG = r"ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|breadcrumb\w*|comments?|comment\w*|disqus|replies|reply|respond|cookie\w*|consent|notice\w*|gdpr|popup|modal|overlay|subscribe|newsletter|signup|login|related|recommend\w*|trending|popular|pager|pagination|copyright|legal|disclaimer|skip"
_LAYOUT = r"banner|nav\w*|menu\w*|header|masthead|topbar|footer|colophon|side|sidebar|rail|widget\w*|toolbar|search\w*|share|sharing|social|alert|tags?"
_NAMED = r"(?:^|\s)(?:(?:{0})(?=$|[\s_-])|\S*?[_-](?:{0})(?=$|\s))"
STRONG, LAYOUT = (re.compile(_NAMED.format(x), re.I) for x in (_STRONG, _LAYOUT))
ASIDE = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|comment\w*|reply|replies|related)(?=$|[\s_])", re.I)
POSITIVE = re.compile(r"(?:^|[\s_-])(?:article\w*|body|content|entry|main|post|story|text|page)(?=$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# Evidence for content, in units of log odds.
WEIGHTS = {"bias": -0.6, "log_chars": 0.45, "sentences": 0.8, "links": -4.0, "in_article": 2.5, "heading": 0.6, "paragraph": 0.9, "list_item": -0.4, "negative": -7.0, "layout": -3.5, "part": -5.5, "positive": 0.8, "hidden": -7.0, "marks": -1.5, "elsewhere": -3.0, "before_title": -1.5}
NEAR, SAME = 0.6, 0.25
MOST = 0.6  # an element with this share of the page's text is its frame, whatever its layout is called


@dataclass
class Node:
    name: str
    parent: int
    depth: int
    never: bool = False
    negative: int = 0
    layout: int = 0
    named: int = 0  # of ``layout``, what is this element's own
    positive: bool = False
    part: bool = False
    article: bool = False
    hidden: bool = False
    base: int = 0  # the nearest element that is not inline: itself, or one above


@dataclass
class Block:
    text: str
    node: int
    link_chars: int


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): references.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def blocks(page: str) -> tuple[list[Block], list[Node]]:
    """Text blocks in page order, and the elements."""
    nodes = [Node("#root", -1, 0)]
    stack, out = [0], []
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack elements of a name are open
    solid = [0]  # where elements that are not inline are
    parts: list[str] = []
    linked = 0
    in_link = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = BLANK.sub(" ", references.unescape("".join(parts))).strip()
            if text:
                k = nodes[stack[-1]].base
                out.append(Block(text, k, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal in_link
        while len(stack) > k:
            name = nodes[stack.pop()].name
            places[name].pop()
            in_link -= name == "a"
        while solid[-1] >= k:
            solid.pop()

    def last(names: Iterable[str]) -> int:
        """The place of the nearest open element of one of the names; 0 if there is none."""
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def opened(name: str, raw: str) -> None:
        nonlocal in_link
        up = nodes[stack[-1]]
        n = Node(name, stack[-1], up.depth + 1, up.never or name in NEVER, up.negative, 0, 0, up.positive, up.part, up.article or name == "article" or name == "main", up.hidden)
        if raw.strip():
            a = _attributes(raw)
            named = f"{a.get('class', '')} {a.get('id', '')}"
            if name not in ("html", "body", "main"):
                n.negative += bool((ASIDE if name == "article" else STRONG).search(named))
                n.named = int(name != "article" and bool(LAYOUT.search(named)))
                n.negative += a.get("role", "").lower() in ROLES
            n.positive |= bool(POSITIVE.search(named)) or a.get("itemprop", "") == "articleBody"
            n.article |= a.get("role", "").lower() in ("main", "article") or a.get("itemprop", "") == "articleBody"
            n.hidden |= "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
        n.part |= name in PARTS and not (name == "header" and up.article)
        n.base = up.base if name in INLINE else len(nodes)
        places[name].append(len(stack))
        if name not in INLINE:
            solid.append(len(stack))
        nodes.append(n)
        stack.append(len(nodes) - 1)
        in_link += name == "a"

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        piece = page[at : m.start() if m else n]
        if piece:
            parts.append(piece)
            if in_link:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                parts.append(references.escape(m[0][9:].removesuffix("]]>")))
            continue
        if m[1]:
            k = last((name,))
            if name not in INLINE:
                flush()
            if k:
                pop_to(k)
            continue
        if name not in INLINE:
            if name != "br":
                flush()
            else:
                parts.append(" ")
                if "\n" not in m[0] and nodes[stack[-1]].name in INLINE:
                    flush()
        if name in VOID:
            continue
        if name in ENDS_P:
            k = last(("p",))
            if k and solid[-1] <= k:
                pop_to(k)
        if name in CLOSES:
            k = last(CLOSES[name])
            if k > last(SCOPES):
                pop_to(k)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        opened(name, m[3] or "")
        if m[3] and m[3].rstrip().endswith("/") and nodes[stack[-1]].name in ("svg", "path"):
            pop_to(len(stack) - 1)
    flush()
    _inherit(out, nodes)
    return out, nodes


def _inherit(found: list[Block], nodes: list[Node]) -> None:
    """Layout names hold for all that is within an element, unless it holds most of the page's text."""
    held = [0] * len(nodes)
    for b in found:
        held[b.node] += 0 if nodes[b.node].never else len(b.text)
    for k in range(len(nodes) - 1, 0, -1):
        held[nodes[k].parent] += held[k]
    for k in range(1, len(nodes)):
        nodes[k].layout = nodes[nodes[k].parent].layout + (nodes[k].named and held[k] < MOST * held[0])


def evidence(b: Block, node: Node, framed: bool = False, before: bool = False) -> dict[str, float]:
    """``framed``: some element of the page says that it is the article; ``before``: a title is still to come."""
    n = len(b.text)
    return {
        "bias": 1.0,
        "log_chars": math.log1p(n) - 2.5 if not node.article else max(0.0, math.log1p(n) - 2.5),
        "sentences": float(b.text[-1] in ".!?…\"”»'"),
        "links": b.link_chars / n,
        "in_article": float(node.article),
        "heading": float(node.name in HEADINGS),
        "paragraph": float(node.name in ("p", "blockquote", "pre")),
        "list_item": float(node.name in ("li", "td")),
        "negative": float(min(node.negative, 2)),
        "layout": float(min(node.layout, 2)),
        "part": float(node.part),
        "positive": float(node.positive),
        "hidden": float(node.hidden),
        "marks": float(b.text[0] in "©®" and not node.article),
        "elsewhere": float(framed and not node.article),
        "before_title": float(before and not node.article),
    }


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The side of each item: True where it is best called content.

    ``gain`` is the log odds of content; a cut edge costs its weight. Max-flow by shortest augmenting paths
    found level by level.
    """
    n = len(gain)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, forth: float, back: float) -> None:
        at[a].append(len(to))
        at[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for i, g in enumerate(gain):
        if g > 0:
            edge(source, i, g, 0.0)
        elif g < 0:
            edge(i, sink, -g, 0.0)
    for a, b, w in edges:
        edge(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in at[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        place = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                k = next(i for i, e in enumerate(path) if room[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while place[a] < len(at[a]):
                e = at[a][place[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                place[a] += 1
            else:
                if a == source:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]
                continue
            path.append(e)
            a = to[e]


def labelled(page: str) -> list[tuple[str, bool]]:
    """The page's blocks in order, each with whether it is content."""
    found, nodes = blocks(page)
    found = [b for b in found if not nodes[b.node].never]
    framed = any(nodes[b.node].article and not nodes[b.node].negative for b in found)
    title = next((i for i, b in enumerate(found) if nodes[b.node].name == "h1"), 0)
    gains, last = [], defaultdict(lambda: -1)
    edges: list[tuple[int, int, float]] = []
    for i, b in enumerate(found):
        node = nodes[b.node]
        x = evidence(b, node, framed, i < title)
        gains.append(sum(WEIGHTS[k] * v for k, v in x.items()))
        group = node.parent if node.parent >= 0 else b.node
        if i:
            before = nodes[found[i - 1].node]
            apart = abs(before.depth - node.depth) + (before.parent != node.parent) * 2
            alike = before.negative == node.negative and before.layout == node.layout and before.part == node.part and before.article == node.article
            edges.append((i - 1, i, NEAR * (1.0 if alike else 0.15) / (1 + apart)))
        if last[group] >= 0 and last[group] != i - 1:
            edges.append((last[group], i, SAME))
        last[group] = i
    return list(zip((b.text for b in found), min_cut(gains, edges), strict=True))


def main_text(page: str | None) -> str:
    return " ".join(text for text, content in labelled(page or "") if content)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
