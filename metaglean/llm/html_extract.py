"""Main-text extraction by minimum-cut labelling.

A page becomes a sequence of text blocks (runs of text between block-level
tags).  A classifier gives each block a cost for either label: from its text
length, link density, stop punctuation, and from the names, roles and classes
of its ancestors.  The costs are the capacities of the edges to the two
terminals; smoothness edges join neighbours in page order, stronger the closer
they are in the tree (a shared parent most), and blocks of one container in
order.  A maximum flow separates content from boilerplate at the least total
cost; the content blocks in page order are the text.

Scripts, styles, forms, hidden parts and comments of the markup are never text.
The classifier's weights and lists are public conventions of page markup, set
by hand; nothing is cut or capped.

A page is read once from start to end: a quote opens a value only after "=" and
only if it is closed somewhere; open elements are counted by name, so a stray
end tag costs no search.

Defined results: null or empty html gives an empty text; unclosed and stray
tags are tolerated; a truncated tag at the end is dropped; repeated rows get
equal rows; an empty table gives an empty result; extra columns stay, and the
result column wins a clash of names.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile("[>\"']")
#: What starts so ends with this.
MARKED = {"<!--": "-->", "<![CDATA[": "]]>", "<!": ">", "<?": ">"}
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not text for a reader.
RAW = frozenset("script style iframe title textarea noembed noframes xmp".split())
SILENT = frozenset("form select button datalist dialog option noscript template svg canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li legend main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of the key closes open tags of the value without an end tag of theirs.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = BLOCK - {"br"}
GOOD_TAGS, BAD_TAGS = frozenset(("article", "main")), frozenset(("nav", "aside", "footer", "menu", "address"))
BAD_NAMES = re.compile(
    r"(?:^|[^a-z])(?:ads?|adv|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|side-?bar|aside|foot(?:er)?|head(?:er)?|masthead|cookies?|consent|notices?|gdpr|comments?|disqus|repl(?:y|ies)|respond|"
    r"discussion|related|recommend\w*|share|sharing|social|follow|subscribe|newsletter|signup|login|popup|modal|overlay|toolbar|widget|pagination|pager|copyright|legal|disclaimer|alert|toc|tags|skip)(?:$|[^a-z])"
)
HEAD_NAMES = re.compile(r"(?:^|[^a-z])head(?:er)?(?=$|[^a-z])")
GOOD_NAMES = re.compile(r"(?:^|[^a-z])(?:article|content|entry|post|story|main|body|text|page)(?:$|[^a-z])")
BAD_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())
GOOD_ROLES = frozenset(("main", "article"))
LINKS = frozenset(("a",))
SPACE = re.compile(r"\s+")
SCALE = 10
#: Under what length, ending and element of a block are worth at most (6), so that these and its neighbours can outweigh it.
NAME_COST = 5


class Node:
    """An element; ``good``, ``bad`` and ``named`` are of use after ``settle``."""

    __slots__ = ("articles", "bad", "depth", "good", "home", "inside", "link", "named", "own", "parent", "silent", "tag", "within")

    def __init__(self, tag: str, parent: Node | None, attributes: str):
        self.tag, self.parent = tag, parent
        self.home = self if parent is None or tag in BLOCK else parent.home
        self.good = self.bad = self.depth = self.articles = 0
        self.named = self.within = self.inside = self.silent = self.link = False
        self.own = (False, False, False)
        if parent is None:
            return
        self.depth = parent.depth + 1
        self.silent, self.link = parent.silent or tag in SILENT, parent.link or tag in LINKS
        good, bad, named = tag in GOOD_TAGS, tag in BAD_TAGS and not (tag == "address" and parent.inside), False
        main = tag == "main"
        if attributes and ("=" in attributes or "hidden" in attributes):
            for m in ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if key in ("class", "id") and tag not in ("html", "body"):
                    named |= BAD_NAMES.search(HEAD_NAMES.sub("", value) if parent.inside else value) is not None
                    good |= GOOD_NAMES.search(value) is not None
                elif key == "role":
                    bad, good, main = bad or value in BAD_ROLES, good or value in GOOD_ROLES, main or value == "main"
                elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                    self.silent = True
        self.own = good, bad, named
        self.inside = parent.inside or main or tag == "article"
        # Elements around the page's main part are its frame; several articles may be a list of teasers or comments.
        if main or (tag == "article" and not parent.inside):
            up = parent
            while up is not None and 0 <= up.articles < 2:
                up.articles += 1
                up = up.parent
            while main and parent is not None and parent.articles >= 0:
                parent.articles, parent = -1, parent.parent

    def settle(self) -> None:
        """Sums up what ancestors, settled before, and the element itself say of its blocks.

        A bad name says nothing on an element around main or a single article, and a good element inside offsets it.
        """
        up, (good, bad, named) = self.parent, self.own
        self.good, self.bad, self.named, self.within = up.good, up.bad, up.named, up.within
        if bad or (self.tag == "header" and not up.good):
            self.bad += 1
        elif named and self.articles != 1 and self.articles >= 0:
            self.named = self.within = True
        elif good:
            self.good += 1
            self.named = False


class Block:
    __slots__ = ("linked", "node", "parts", "text")

    def __init__(self, node: Node):
        self.node, self.parts, self.linked, self.text = node, [], 0, ""


def blocks(page: str) -> list[Block]:
    """The non-empty text blocks of a page, in order, with their innermost element."""
    out: list[Block] = []
    top = node = Node("#", None, "")
    nodes: list[Node] = []
    current = Block(top)
    at, n = 0, len(page)
    opened: dict[str, int] = {}
    last = {c: page.rfind(c) for c in "\"'"}

    def flush(next_node: Node) -> None:
        nonlocal current
        text = SPACE.sub(" ", entities.unescape("".join(current.parts))).strip()
        if text:
            current.text = text
            out.append(current)
        current = Block(next_node)

    def add(text: str) -> None:
        if text and not node.silent:
            if not current.parts:
                current.node = node.home
            current.parts.append(text)
            if node.link:
                current.linked += len(text.strip())

    def close(to: Node) -> None:
        """Makes ``to`` the innermost open element."""
        nonlocal node
        while node is not to:
            opened[node.tag] -= 1
            node = node.parent

    def tag_end(at: int) -> int:
        """Where the tag whose name ends at ``at`` closes."""
        while m := STOP.search(page, at):
            i, c = m.start(), m[0]
            if c == ">":
                return i
            at = i + 1
            if i < last[c] and (page[i - 1] == "=" or page[max(0, i - 9) : i].rstrip().endswith("=")):
                at = page.index(c, at) + 1
        return n

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        m = NAME.match(page, lt)
        if m is None:
            mark = next((k for k in MARKED if page.startswith(k, lt)), None)
            if mark is None:
                add("<")
                at = lt + 1
            else:
                end = page.find(MARKED[mark], lt + len(mark))
                at = n if end < 0 else end + len(MARKED[mark])
            continue
        end = tag_end(m.end())
        rest, at = page[m.end() : end], end + 1
        tag = m[2].lower()
        if m[1]:  # an end tag closes its element and those left open in it
            if tag in BLOCK:
                flush(node)
            if opened.get(tag):
                up = node
                while up.tag != tag:
                    up = up.parent
                close(up.parent)
            continue
        empty = rest.rstrip().endswith("/")
        if tag in RAW:
            if not empty:
                found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = found.end() if found else n
            continue
        if tag in BLOCK:
            flush(node)
            if tag in ENDS_P and node.home.tag == "p":
                close(node.home.parent)
            for c in CLOSES.get(tag, ()):
                if node.tag == c:
                    close(node.parent)
        if tag not in VOID and not empty:
            node = Node(tag, node, rest)
            opened[tag] = opened.get(tag, 0) + 1
            nodes.append(node)
    flush(top)
    for x in nodes:
        x.settle()
    return out


def costs(b: Block) -> tuple[int, int]:
    """Cost of calling a block boilerplate, and of calling it content."""
    node, n = b.node, len(b.text)
    content = boiler = 1.0
    words = b.text.count(" ") + 1
    content += min(words, 60) / 12
    if b.text[-1] in ".!?:;…\"'»”)":
        content += 0.5
    if node.tag in ("p", "pre", "blockquote", "h1", "h2", "h3"):
        content += 0.5
    boiler += 4 * min(1.0, b.linked / n)
    if words < 4 and node.tag not in ("p", "pre", "h1", "h2", "h3", "h4", "h5", "h6"):
        boiler += 1
    if node.bad:
        boiler += 60
    elif node.named:
        boiler += NAME_COST
    elif node.good and not node.within:
        content += 40
    if b.text[0] in "©®" or b.text.lower().startswith("copyright"):
        boiler += 8
    return round(content * SCALE), round(boiler * SCALE)


def proximity(a: Node, b: Node) -> int:
    """Steps between two elements in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def min_cut(n: int, source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Of n nodes with terminal capacities and undirected edges, the source side.

    Dinic's algorithm.  Opposite terminal capacities cancel before the flow starts.
    """
    s, t = n, n + 1
    to, cap, of = [], [], [[] for _ in range(n + 2)]

    def edge(a: int, b: int, c: int, back: int) -> None:
        of[a].append(len(to))
        to.append(b)
        cap.append(c)
        of[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        c = source[i] - sink[i]
        if c > 0:
            edge(s, i, c, 0)
        elif c < 0:
            edge(i, t, -c, 0)
    for a, b, c in edges:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque((s,))
        while queue:
            a = queue.popleft()
            for e in of[a]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        place, path, a = [0] * (n + 2), [], s
        while True:
            if a == t:
                f = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= f
                    cap[e ^ 1] += f
                k = next(i for i, e in enumerate(path) if not cap[e])
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while place[a] < len(of[a]):
                e = of[a][place[a]]
                if cap[e] and level[to[e]] == level[a] + 1:
                    break
                place[a] += 1
            else:
                if a == s:
                    break
                e = path.pop()
                a = to[e ^ 1]
                place[a] += 1
                continue
            path.append(e)
            a = to[e]


def extract(page: str | None) -> str:
    """The main text of a page."""
    found = blocks(page or "")
    if not found:
        return ""
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, round(SCALE * 2 / (1 + proximity(found[i - 1].node, b.node)))))
        home = id(b.node.parent)
        if home in last and last[home] != i - 1:  # the one before in the same container
            edges.append((last[home], i, SCALE))
        last[home] = i
    pairs = [costs(b) for b in found]
    side = min_cut(len(found), [c for c, _ in pairs], [b for _, b in pairs], edges)
    return " ".join(b.text for b, keep in zip(found, side) if keep)


def main_text(df: DataFrame, html_col: str = "html", into: str = "text") -> DataFrame:
    """``df`` without ``html_col``, with the main text of each page."""
    ship(df.sparkSession)
    kept = [c for c in df.columns if c not in (html_col, into)]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), f"`{into}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([extract(x) for x in batch.column(len(kept)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*kept, into])

    return df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{html_col}`")).mapInArrow(run, schema)
