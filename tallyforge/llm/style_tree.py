"""HTML extraction with a site style tree.

The pages of a host are merged into one tree. An element node is a path of tags, classes and places; under it every
sequence of child tags that pages have is a style. A node's importance is the entropy of its styles over its pages, a
leaf's that of its contents, relative to the entropy of pages that all differ. Every node is counted with one page more,
of a style of its own, so that few pages say little. In a page the composite importance of a branch mixes its own with
that of its children, weighed by GAMMA per style. A branch below the threshold throughout is noise: menus, headers,
footers or notices that a site repeats, inside articles as outside them, whatever they are called. The threshold is
THRESHOLD; beside an article, where text is rarely wanted, it is BESIDE: what is not almost always new goes.

Entropy cannot tell noise that differs on every page: comments, related links, adverts, or the menu of a site with one
page. There names decide, of elements, classes and roles; scripts, forms and the like are never content. Of an article,
blocks that the site repeats go unless they hold most of its text: then the story was published more than once and stays
whole. Inside articles equal neighbours count as one in styles, so articles of any length share their nodes.

The tree is only counts: each task counts nodes and styles of its pages, and sums per node go through one shuffle, so
a host of any size is fine. Only nodes of low importance are told to the extracting tasks; beyond TOLD of them each page
is joined with those of its own nodes instead.

Defined results: null or empty html gives empty text; a null or odd url counts as a host of its own name; repeated
rows are pages of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import checkpointed

GAMMA, THRESHOLD, BESIDE = 0.9, 0.35, 0.95
#: Nodes of low importance that are told to all tasks.
TOLD = 200_000

# Kinds of HTML elements and the words by which sites name their parts.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
HIDDEN = RAW | frozenset("head form button select option input label svg canvas object embed audio video map".split())
NOISE = frozenset("nav footer aside menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body html dd dt li tbody td tfoot th thead tr summary figcaption".split())
CONTENT = frozenset("article main".split())
CONTENT_NAMES = frozenset("article content story entry post main body articlebody".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer "
    "disqus footer gdpr masthead menu menus modal nav navbar navigation newsletter notice notices notification outbrain pager pagination "
    "page-header popup promo promos promoted promotion related recommended replies reply respond share sharing sidebar sidenav signup site-header skip social sponsor sponsored "
    "subscribe subscription taboola teaser toolbar toc topbar widget widgets".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}}
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}}

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)|<!--|<[!?]")
_EDGE = re.compile(r">|=[ \t\n\r\f]*[\"']")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>\"']|\Z)", re.I)
_NAME = re.compile(r"[a-z]+")


class Node:
    """An element. noise: no part of the text; hidden: nor meant to be seen; named: its name speaks against it."""

    __slots__ = ("tag", "names", "children", "noise", "named", "content", "hidden")

    def __init__(self, tag: str, names: str = "", noise: bool = False, named: bool = False, content: bool = False, hidden: bool = False):
        self.tag, self.names, self.noise, self.named, self.content, self.hidden = tag, names, noise, named, content, hidden
        self.children: list = []


def _element(tag: str, rest: str) -> Node:
    noise, named, content, names, hidden = tag in HIDDEN, tag in NOISE, tag in CONTENT, "", False
    if rest.strip(" /"):
        found = {m[0].lower(): entities.unescape(m[1] or m[2] or m[3] or "").lower() for m in _ATTRIBUTE.findall(rest)}
        names = f"{found.get('id', '')} {found.get('class', '')}".strip()
        tokens = [t for n in names.split() for t in ([n] if n.isalpha() else [n, *_NAME.findall(n)])]
        role = found.get("role", "")
        content |= role in ("main", "article") or found.get("itemprop") == "articlebody" or any(t in CONTENT_NAMES for t in tokens)
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        named |= role in NOISE_ROLES
        # The page's outermost elements are named for layouts; a named part of an article is still a part.
        if tag not in ("html", "body", "article", "main", "p", "h1") and any(t in NOISE_NAMES for t in tokens):
            named = True
    return Node(tag, names, noise or hidden, named, content, hidden)


class _Open:
    """Elements that are open, with the places of each tag among them: closing one looks at no other."""

    def __init__(self, root: Node):
        self.stack, self.places, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, k: int) -> None:
        """Close the k-th element and all in it."""
        while len(self.stack) > k:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def last(self, *tags: str) -> int:
        """Place of the innermost open element of some tags; 0: none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tag: str) -> None:
        k = self.last(tag)
        # An inline element is not closed from inside a later block.
        if k and (tag in BLOCKS or tag == "a" or not self.blocks or self.blocks[-1] < k):
            self.cut(k)

    def make_room(self, tag: str) -> None:
        """Close what ends where `tag` begins."""
        if tag in CLOSES_P:
            if self.blocks and self.stack[self.blocks[-1]].tag == "p":
                self.cut(self.blocks[-1])
        elif tag in SIBLINGS:
            k = self.last(*SIBLINGS[tag])
            if k and k > self.last(*WALLS[tag]):
                self.cut(k)


def parse(page: str) -> Node:
    """The tree of a page: Node for elements and str for text, with references decoded. Open ends are closed.

    Each character is looked at a fixed number of times, whatever a page is like: a quote opens a value only after an
    equals sign, and once one is never closed, quotes mean nothing from there on.
    """
    root = Node("#root")
    opened, at, n, quotes, forms = _Open(root), 0, len(page), True, False

    def tag_end(k: int) -> int:
        nonlocal quotes
        begin = k
        while quotes and (m := _EDGE.search(page, k)):
            if m[0] == ">":
                return m.end()
            k = page.find(m[0][-1], m.end()) + 1
            quotes = k > 0
        k = page.find(">", begin)
        return k + 1 if k >= 0 else n

    while at < n:
        m = _OPEN.search(page, at)
        begin = m.start() if m else n
        if begin > at:
            opened.stack[-1].children.append(entities.unescape(page[at:begin]))
        if not m:
            break
        if not m[2]:
            if m[0] == "<!--":
                short = 1 if page.startswith(">", m.end()) else 2 if page.startswith("->", m.end()) else 0
                end = None if short else _COMMENT_END.search(page, m.end())
                at = m.end() + short if short else end.end() if end else n
            else:
                at = page.find(">", m.end()) + 1 or n
            continue
        tag, at = m[2].lower(), tag_end(m.end())
        if m[1]:
            opened.close(tag)
            continue
        opened.make_room(tag)
        node = _element(tag, page[m.end() : at].removesuffix(">"))
        opened.stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID:
            opened.push(node)
            forms = forms or tag == "form"
    if forms:
        _look_into_forms(root)
    return root


def _look_into_forms(root: Node) -> None:
    """A form that holds an article, or most of the text of its page, is a layout and no form to be filled in."""
    order, at = [(root, -1)], 0
    while at < len(order):
        order += [(c, at) for c in order[at][0].children if isinstance(c, Node) and (not c.noise or c.tag == "form")]
        at += 1
    chars, holds = [0] * len(order), [False] * len(order)
    for at in range(len(order) - 1, -1, -1):
        node, parent = order[at]
        chars[at] += sum(len(w) for w in _own_words(node))
        holds[at] = holds[at] or _is_article(node)
        if parent >= 0:
            chars[parent] += chars[at]
            holds[parent] = holds[parent] or holds[at]
    for at, (node, _) in enumerate(order):
        if node.tag == "form" and not node.hidden and (holds[at] or 2 * chars[at] > chars[0]):
            node.noise = False


def _hash(*parts) -> int:
    return int.from_bytes(blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", url or "")
    return (m[1] if m else url or "").lower()


def _is_article(node: Node) -> bool:
    return node.content and node.tag not in ("html", "body")


def _inner(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node) and c.tag not in VOID and c.tag not in RAW]


def _own_words(node: Node) -> list[str]:
    return " ".join(c for c in node.children if isinstance(c, str)).split()


def _style(inner: list[Node], inside: bool) -> tuple[int, list]:
    """Hash of a sequence of child tags, and the place of each; inside articles of runs of equal tags and names."""
    if not inside:
        return _hash(*[c.tag for c in inner]), list(range(len(inner)))
    runs: list[list[Node]] = []
    for c in inner:
        if runs and (runs[-1][0].tag, runs[-1][0].names) == (c.tag, c.names):
            runs[-1].append(c)
        else:
            runs.append([c])
    places = [(r, k if k + 1 < len(run) else -1) for r, run in enumerate(runs) for k in range(len(run))]
    return _hash("runs", *[run[0].tag for run in runs]), places


def style_rows(root: Node, host: str) -> Iterator[tuple[int, int]]:
    """(node, style or content) of each node of a page outside what is never content."""
    todo = [(root, _hash("host", host), False)]
    while todo:
        node, key, inside = todo.pop()
        inner, words = _inner(node), _own_words(node)
        if inner:
            shape, places = _style(inner, inside)
            yield key, _hash(shape, *words) if words else shape
            for c, k in zip(inner, places, strict=True):
                if not c.noise:
                    todo.append((c, _hash(key, shape, k, c.tag, c.names), inside or _is_article(c)))
        else:
            yield key, _hash("text", *words)


def _overrule(order: list[tuple[Node, int, int, int]], low, beside: float) -> None:
    """Names are not believed where they speak against most of what changes from page to page, and no article is left
    beside: sites also call a page's frame after the sidebar or banner it has."""
    mass, articles = [0] * len(order), [0] * len(order)
    for at in range(len(order) - 1, -1, -1):
        node, key, parent, article = order[at]
        articles[at] += article == at
        if not (at and node.noise) and (low(key) or (1.0, 1))[0] >= (beside if article < 0 else THRESHOLD):
            mass[at] += sum(map(len, _own_words(node)))
        if parent >= 0 and not node.noise:
            mass[parent] += mass[at]
            articles[parent] += articles[at]
    for at, (node, _, _, article) in enumerate(order):
        if node.named and article < 0 and articles[at] == articles[0] and 2 * mass[at] > mass[0]:
            node.named = False


def mark_noise(root: Node, key: int, low, names: bool = True) -> None:
    """Mark branches whose composite importance is below THRESHOLD as noise, and those whose names say so.

    low(key) gives a node's importance and number of styles, or None if it is high. A branch with an important part
    stays; otherwise its importance mixes its own with the mean of its children's. Works from the leaves up. An article
    is never noise itself, and its blocks are only if most of its text remains. names: False leaves it to the tree.
    """
    order: list[tuple[Node, int, int, int]] = [(root, key, -1, -1)]
    at = 0
    while at < len(order):
        node, own_key, _, article = order[at]
        # A header met outside articles is the page's, while one inside holds the headline.
        if article in (-1, at):
            node.named = node.named or node.tag == "header" or "header" in node.names.replace("-", " ").replace("_", " ").split()
        inner = _inner(node)
        if inner and not (at and node.noise):
            shape, places = _style(inner, article >= 0)
            for c, k in zip(inner, places, strict=True):
                order.append((c, _hash(own_key, shape, k, c.tag, c.names), at, len(order) if article < 0 and _is_article(c) else article))
        at += 1
    beside = BESIDE if any(article >= 0 for _, _, _, article in order) else THRESHOLD
    if names:
        _overrule(order, low, beside)
    parts: list[list[float]] = [[] for _ in order]
    repeated: dict[int, list[Node]] = {}
    loose = [bool(_own_words(node)) for node, _, _, _ in order]
    for at in range(len(order) - 1, -1, -1):
        node, own_key, parent, article = order[at]
        own, styles = low(own_key) or (1.0, 1)
        limit = beside if article < 0 else THRESHOLD
        if at and node.noise:
            own = 0.0
        elif article == at:
            own = 1.0
        elif parts[at]:
            weight = GAMMA ** max(1, styles)
            top = max(parts[at] + [own] * loose[at])
            own = top if top >= limit else (1 - weight) * own + weight * sum(parts[at]) / len(parts[at])
        if parent >= 0:
            # What its name speaks against is no reason to keep the branch it is in.
            parts[parent].append(0.0 if names and node.named else own)
            if own < limit and article < 0:
                # Part of a sentence goes only with it.
                node.noise = node.noise or node.tag in BLOCKS or not loose[parent]
            elif own < limit and article >= 0 and not node.noise and not (names and node.named) and node.tag in BLOCKS:
                repeated.setdefault(article, []).append(node)
            node.noise = node.noise or (names and node.named)
    for article, nodes in repeated.items():
        whole = sum(map(len, blocks(order[article][0])))
        for node in nodes:
            node.noise = True
        if 2 * sum(map(len, blocks(order[article][0]))) < whole:
            for node in nodes:
                node.noise = False


def blocks(root: Node, bare: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """Texts of the blocks that are no noise, in page order; nodes whose id() is in bare give no text of their own."""
    out, line = [], []

    def end() -> None:
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    todo: list = [(root, False)]
    while todo:
        node, closing = todo.pop()
        if isinstance(node, str):
            line.append(node)
            continue
        if closing:
            end()
            continue
        if node.tag in ("br", "hr"):
            line.append(" ")
            if node.tag == "br":
                continue
        if node.noise:
            continue
        if node.tag in BLOCKS:
            end()
            todo.append((node, True))
        todo += [(c, False) for c in reversed(node.children) if id(node) not in bare or isinstance(c, Node)]
    end()
    return out


def extract_page(page: str | None, url: str | None, low, names: bool = True) -> str:
    """The main text of a page: what is no noise. Loose text beside an article has no element and is left out."""
    root = parse(page or "")
    mark_noise(root, _hash("host", host_of(url)), low, names)
    beside: set[int] = set()
    above: dict[int, Node] = {}
    todo = [root]
    while todo:
        node = todo.pop()
        for c in node.children:
            if isinstance(c, Node) and not c.noise:
                above[id(c)] = node
                if not _is_article(c):
                    todo.append(c)
                elif blocks(c):
                    while c is not root and id(above[id(c)]) not in beside:
                        c = above[id(c)]
                        beside.add(id(c))
    return "\n".join(blocks(root, beside))


def importances(pages: DataFrame) -> DataFrame:
    """(node, styles, imp) of nodes whose own importance is below BESIDE, the higher threshold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for u, h in zip(batch.column(0), batch.column(1), strict=True) for r in style_rows(parse(h.as_py() or ""), host_of(u.as_py()))]
            pairs, n = np.unique(np.array(rows, np.int64).reshape(-1, 2), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n)], names=["node", "style", "n"])

    rows = pages.select("url", "html").mapInArrow(count, "node long, style long, n long").groupBy("node", "style").agg(F.sum("n").alias("n"))
    nodes = rows.groupBy("node").agg(F.sum("n").alias("m"), F.count(F.lit(1)).alias("styles"), F.sum(F.col("n") * F.log("n")).alias("s"))
    total = F.col("m") + 1
    nodes = nodes.select("node", "styles", (1 - F.col("s") / (total * F.log(total))).alias("imp"))
    return checkpointed(nodes.where(F.col("imp") < BESIDE))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", told: int = TOLD) -> DataFrame:
    """page_id, url, text of every page."""
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    nodes = importances(source)
    schema = "page_id long, url string, text string"

    def texts(batch, low) -> pa.RecordBatch:
        out = [extract_page(h.as_py(), u.as_py(), low) for u, h in zip(batch.column(1), batch.column(2), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    if nodes.limit(told + 1).count() <= told:
        table = nodes.toPandas()
        shared = pages.sparkSession.sparkContext.broadcast({k: (i, n) for k, i, n in zip(table["node"].tolist(), table["imp"].tolist(), table["styles"].tolist(), strict=True)})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield texts(batch, shared.value.get)

        return source.mapInArrow(run, schema)

    # Too many to tell: each page lists its nodes, their importances are joined by page, and then it is read again.
    rows = source.withColumn("row", F.monotonically_increasing_id())
    rows = checkpointed(rows)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(r.as_py(), k) for u, h, r in zip(batch.column(1), batch.column(2), batch.column(3), strict=True) for k, _ in style_rows(parse(h.as_py() or ""), host_of(u.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["row", "node"])

    own = rows.mapInArrow(keys, "row long, node long").join(nodes, "node")
    own = own.groupBy("row").agg(F.collect_list(F.struct("node", "imp", "styles")).alias("low"))

    def run_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                low = {x["node"]: (x["imp"], x["styles"]) for x in batch.column(3)[k].as_py() or []}
                yield texts(batch.slice(k, 1), low.get)

    return rows.join(own, "row", "left").select("page_id", "url", "html", "low").mapInArrow(run_own, schema)
