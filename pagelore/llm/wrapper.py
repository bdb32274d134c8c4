"""Main text by wrapper induction.

Pages of a host are parsed into trees and aligned with a reference page of the host by simple tree
matching.  For every node of the reference the alignments are summed: a node whose text hardly
changes from page to page is template, one that varies is a slot, and the element that holds most
slot text is the content region.  Extraction aligns each page with the wrapper again, takes the
content region and leaves out template nodes and elements that are no article text by their kind.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm.common import cut, own, table
from pagelore.llm.url_rules import host_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hr html legend li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: Elements that hold no article text.
LEFT_OUT = frozenset("script style noscript template iframe svg canvas object nav footer aside form button select textarea head title dialog menu".split())
#: Words of class, id or role that mark an element as none of the article.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup "
                  "modal overlay newsletter subscribe subscription sidebar widget widgets related recommended share sharing social menu nav navbar navigation "
                  "breadcrumb breadcrumbs header masthead footer comment comments disqus respond login signup search complementary contentinfo".split())
MARK = re.compile(r"[A-Za-z]+")
#: A paragraph ends where one of these begins.
ENDS_P = BLOCKS - {"html", "body"}
#: Scores kept before the nodes are numbered by shape; this changes no result.
MANY_PAIRS = 256
#: A node is template if its text is the same on this share of at least so many differing pages.
SAME_SHARE, LEAST_PAGES = 0.9, 4
MAX_DEPTH = 200


class Node:
    __slots__ = ("tag", "out", "children", "text", "number", "plain")

    def __init__(self, tag: str, out: bool = False, text: str = ""):
        self.tag, self.out, self.text = tag, out, text
        self.children: list[Node] = []
        self.number = -1
        #: Nodes and text of a leaf, or of an element with nothing but one text; else None.
        self.plain: tuple[int, str] | None = None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P and any(n.tag == "p" for n in self.stack):
            self._close("p")
        elif tag in ("li", "td", "th", "tr", "dt", "dd", "option"):
            top = next((n.tag for n in reversed(self.stack) if n.tag in (tag, "ul", "ol", "table", "dl", "select")), "")
            if top == tag:
                self._close(tag)
        values = dict(attrs)
        words = {w.lower() for k in ("class", "id", "role") for w in MARK.findall(values.get(k) or "")}
        hidden = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in (values.get("style") or "").replace(" ", "").lower()
        inside = any(n.tag in ("article", "main") for n in self.stack)
        out = tag in LEFT_OUT or hidden or (tag == "header" and not inside) or (tag not in ("html", "body", "article", "main") and bool(words & MARKS))
        parent = self.stack[-1]
        node = Node(tag, out or parent.out)
        if not parent.out:  # an element left out stays as a leaf; what it holds is never looked at
            parent.children.append(node)
        if tag not in VOID and len(self.stack) < MAX_DEPTH:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack[-1].tag == tag and len(self.stack) > 1:
            self.stack.pop()

    def _close(self, tag):
        at = next((i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].tag == tag), 0)
        if at:
            del self.stack[at:]

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        if data and not self.stack[-1].out:
            self.stack[-1].children.append(Node("#text", text=data))


def parse(html: str | None) -> Node:
    """The tree of a page, its nodes numbered in page order; comments are no nodes."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    n = 0
    order = [builder.root]
    while order:  # preorder without recursion
        node = order.pop()
        node.number, n = n, n + 1
        if not node.children:
            node.plain = (1, node.text)
        elif len(node.children) == 1 and node.children[0].tag == "#text":
            node.plain = (2, node.children[0].text)
        order.extend(reversed(node.children))
    return builder.root


def shapes(a: Node, b: Node) -> dict[int, int]:
    """A number for each node of two trees (by ``id``), equal where the subtrees match all others alike.

    A text counts in a match only by being equal to one of the other tree, so all texts that one tree has alone are alike.
    """
    order: list[list[Node]] = [below(a), below(b)]
    texts = [{n.plain[1] for n in nodes if n.plain is not None} for nodes in order]
    shared, numbers, out = texts[0] & texts[1], {}, {}
    for side, nodes in enumerate(order):
        for node in reversed(nodes):  # children before parents
            plain = None if node.plain is None else (node.plain[0], node.plain[1] if node.plain[1] in shared else side)
            out[id(node)] = numbers.setdefault((node.tag, plain, tuple(out[id(c)] for c in node.children)), len(numbers))
    return out


def match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the largest order-keeping match of two trees, and its node pairs.

    One full recurrence for lists of every length.  Scores are kept by pair of nodes, from ``MANY_PAIRS`` on by pair of shapes
    (the same scores), so rows of one make are matched once; lists that are followed back hold one byte a cell.
    """
    if a.tag != b.tag:
        return 0, []
    shape: dict[int, int] = {}
    known: dict[tuple[int, int], int] = {}

    def table_of(x: Node, y: Node, ways: list[bytearray] | None) -> int:
        columns = [(v.tag, v.plain, v) for v in y.children]
        above = [0] * (len(columns) + 1)
        for u in x.children:
            tag, plain = u.tag, u.plain
            row, way, left = [0], bytearray(len(columns)), 0
            for j, (other, text, v) in enumerate(columns):
                top = above[j + 1]
                if left > top:
                    top, way[j] = left, 1
                if tag == other:
                    if plain is not None and text is not None:
                        found = plain[0] + (plain[1] == text[1]) if plain[0] == text[0] else 1
                    else:
                        found = known.get((shape.get(id(u), id(u)), shape.get(id(v), id(v))))
                        if found is None:
                            found = known[shape.get(id(u), id(u)), shape.get(id(v), id(v))] = table_of(u, v, None)
                            if len(known) > MANY_PAIRS and not shape:
                                shape.update(shapes(a, b))
                    if above[j] + found > top:
                        top, way[j] = above[j] + found, 2
                row.append(top)
                left = top
            above = row
            if ways is not None:
                ways.append(way)
        return above[-1] + 1

    total, pairs, open_ = 0, [], [(a, b)]
    while open_:
        x, y = open_.pop()
        pairs.append((x, y))
        if x is not a and x.plain is not None and y.plain is not None:
            if x.children and y.children:
                pairs.append((x.children[0], y.children[0]))
            continue
        ways: list[bytearray] = []
        score = table_of(x, y, ways)
        total = total or score
        i, j = len(x.children), len(y.children)
        while i and j:
            step = ways[i - 1][j - 1]
            if step == 2:
                open_.append((x.children[i - 1], y.children[j - 1]))
            i, j = i - (step != 1), j - (step != 0)
    return total, pairs


def whole(node: Node) -> str:
    parts, stack = [], [node]
    while stack:
        n = stack.pop()
        parts.append(n.text)
        stack.extend(reversed(n.children))
    return " ".join("".join(parts).split())


def blocks(root: Node, template: frozenset[int] = frozenset()) -> list[str]:
    """Texts of the blocks below a node in page order, without elements left out and template nodes (by ``id``)."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, ended = stack.pop()
        if ended:
            close()
            continue
        if node.out or id(node) in template:
            if node.tag in BLOCKS:
                close()
            elif node.tag in ("br", "td", "th"):
                run.append(" ")
            continue
        if node.tag == "#text":
            run.append(node.text)
        elif node.tag in ("br", "td", "th"):
            run.append(" ")
        if node.tag in BLOCKS:
            close()
            stack.append((node, True))
        stack.extend((c, False) for c in reversed(node.children))
    close()
    return out


def article_roots(root: Node) -> list[Node]:
    """Outermost ``article`` elements, or ``main`` where there is none, outside elements left out."""
    for tag in ("article", "main"):
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.out:
                continue
            if node.tag == tag:
                found.append(node)
            else:
                stack.extend(reversed(node.children))
        if found:
            return found
    return []


def induce(reference: str, aligned: dict[int, int], same: dict[int, int]) -> tuple[frozenset[int], int, bool]:
    """Template nodes of the reference, the deepest element with most of the varying text, and whether an article holds template."""
    root = parse(reference)
    constant = frozenset(n for n, k in aligned.items() if k >= LEAST_PAGES and same.get(n, 0) >= SAME_SHARE * k)
    # what holds no letter or digit is the same on every page and still parts the words around it
    constant -= {n.number for n in below(root) if n.number in constant and not any(c.isalnum() for c in whole(n))}
    mass: dict[int, int] = {}
    order, stack = [], [(root, None)]
    while stack:
        node, parent = stack.pop()
        order.append((node, parent))
        stack.extend((c, node) for c in node.children)
    for node, parent in reversed(order):
        own_mass = 0 if node.out or node.number in constant or node.tag == "a" else mass.get(node.number, 0) + (len(node.text) if node.tag == "#text" else 0)
        mass[node.number] = own_mass
        if parent is not None:
            mass[parent.number] = mass.get(parent.number, 0) + own_mass
    held = [n for r in article_roots(root) for n in below(r)]
    region = root
    while True:
        inner = max((c for c in region.children if c.tag not in ("#text", "p")), key=lambda c: mass[c.number], default=None)
        if inner is None or mass[inner.number] < 0.8 * max(mass[region.number], 1) or not inner.children:
            return constant, region.number, any(n.number in constant for n in held) or not held
        region = inner


def below(node: Node) -> list[Node]:
    out, stack = [], [node]
    while stack:
        out.append(stack.pop())
        stack.extend(out[-1].children)
    return out


def extract(html: str | None, reference: Node | None, constant: frozenset[int], region: int, inside: bool) -> str:
    """The main text of a page by the wrapper of its host; ``inside``: template nodes may lie in the article."""
    page = parse(html)
    roots, template = article_roots(page), frozenset()
    if reference is not None and (inside or not roots):
        pairs = match(reference, page)[1]
        template = frozenset(id(y) for x, y in pairs if x.number in constant and x.tag not in ("#root", "html", "body"))
        if not roots:
            roots = [y for x, y in pairs if x.number == region]
    return "\n\n".join(t for r in roots or [page] for t in blocks(r, template))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page.

    A null or empty html, and one without article text, gives the empty text.  Urls without a host
    form one host.  A host with one page, or with copies of one page only, has no template nodes.
    Repeated rows give repeated rows; an empty table an empty result; other columns are not read.
    """
    base = own(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long")).withColumn("host", host_of(F.col("url")))
    lone = F.min_by("html", F.struct(F.xxhash64("page_id"), "html"))
    references = cut(base.filter(F.length("html") > 0).groupBy("host").agg(lone.alias("reference"), F.count(F.lit(1)).alias("pages")))

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: tuple = (None, None, "")
        for frame in frames:
            sums: Counter = Counter()
            for host, html, reference, pages_ in zip(frame.host, frame.html, frame.reference, frame.pages, strict=True):
                if not html or not pages_ > LEAST_PAGES:
                    continue
                if known[0] != reference:
                    tree = parse(reference)
                    known = (reference, tree, whole(tree))
                page = parse(html)
                if whole(page) == known[2]:
                    continue  # a copy of the reference says nothing about what varies
                for x, y in match(known[1], page)[1]:
                    sums[host, x.number, x.plain == y.plain if x.plain is not None else whole(x) == whole(y)] += 1
            rows = [(h, n, k, k * s) for (h, n, s), k in sums.items()]
            yield pd.DataFrame(rows, columns=["host", "node", "aligned", "same"]).astype({"host": "object", "node": "int64", "aligned": "int64", "same": "int64"})

    # both passes deal out the same columns of the pages by host, so that one exchange serves both
    sums = (
        base.join(references, "host", "left").select("page_id", "url", "host", "html", "reference", "pages")
        .mapInPandas(align, "host string, node long, aligned long, same long").groupBy("host", "node").agg(F.sum("aligned").alias("aligned"), F.sum("same").alias("same"))
    )
    nodes = sums.groupBy("host").agg(F.collect_list(F.struct("node", "aligned", "same")).alias("nodes"))

    def wrappers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for host, reference, found in zip(frame.host, frame.reference, frame.nodes, strict=True):
                found = [] if found is None else found
                constant, region, inside = induce(reference, {n["node"]: n["aligned"] for n in found}, {n["node"]: n["same"] for n in found})
                rows.append((host, reference, sorted(constant), region, inside))
            yield pd.DataFrame(rows, columns=["host", "reference", "constant", "region", "inside"])

    induced = references.join(nodes, "host", "left").select("host", "reference", "nodes").mapInPandas(wrappers, "host string, reference string, constant array<long>, region long, inside boolean")

    def texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: tuple = (None, None)
        for frame in frames:
            out = []
            for html, reference, constant, region, inside in zip(frame.html, frame.reference, frame.constant, frame.region, frame.inside, strict=True):
                has = reference is not None
                if has and known[0] != reference:
                    known = (reference, parse(reference))
                out.append(extract(html, known[1] if has else None, frozenset(constant) if has else frozenset(), int(region) if has else 0, bool(inside) if has else False))
            yield pd.DataFrame({"page_id": frame.page_id, "url": frame.url, "text": out, "n_chars": [len(t) for t in out]})

    joined = base.join(induced, "host", "left").select("page_id", "url", "html", "reference", "constant", "region", "inside")
    return joined.mapInPandas(texts, "page_id long, url string, text string, n_chars long")


def op5_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op5_wrapper_text": op5_wrapper_text}
