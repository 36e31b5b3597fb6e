"""Main text of web pages by wrapper induction over the pages of a host.

1. Every page is parsed to a DOM tree and reduced to a skeleton: labels (tag and class names), with runs of equal
   siblings folded into one repeated node, and a hash of each node's own text.
2. A host's reference is one of its skeletons. Every other skeleton of the host is aligned with it by simple tree
   matching (the largest order-preserving top-down matching of equal labels). Hosts are not gathered: each skeleton
   meets its reference by a join, and what leaves is one small row per aligned node.
3. Aligned nodes are counted by an aggregate over (host, node). A node whose text is the same on all of at least
   ``LEAST_PAGES`` pages with different articles is template, a varying one a slot.
4. Each page is cut again with its host's template: the article's slots are the text. The regions that are no article
   on any site (menus, headers, footers, sidebars, forms, adverts, notices, reader comments) are known by element and
   by class, id and role; constancy adds what a site repeats without naming it.

Pages of a host that are copies of one article count once, so copies never become template.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowarden.llm.urlfilter import host_and_path
from flowarden.session import materialise

LEAST_PAGES = 3
MOST_DEPTH = 60  # skeletons end there; deeper text belongs to the node at this depth
WIDE = 20_000  # child pairs up to which siblings are matched by the full table, beyond by label order
BROADCAST_BYTES = 4_000_000  # tables by host up to this counted size are broadcast

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th "
    "thead tr ul".split()
)
CLOSES_P = BLOCKS - {"br", "button", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "html", "head", "body", "select", "legend"}
CLOSED_BY_SAME = {"li": {"ul", "ol", "menu"}, "option": {"select"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}}
BOILERPLATE = frozenset(
    "head nav header footer aside form script style noscript template button select textarea iframe object embed svg canvas menu dialog title".split()
)
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent notice notices alert "
    "newsletter subscribe signup comment comments commentlist respond disqus sidebar menu navbar navigation nav breadcrumb breadcrumbs share "
    "sharing social related recommended footer header masthead popup modal toolbar pagination pager login search".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


class Node:
    __slots__ = ("tag", "names", "kind", "role", "children", "index")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.names, self.role, self.kind, self.children, self.index = tag, [], "", "", [], -1
        if attributes:
            for name, value in ATTRIBUTE.findall(attributes):
                value = value.strip("\"'").lower()
                if name.lower() == "role":
                    self.role = value
                elif name.lower() == "itemprop":
                    self.kind = value
                elif name.lower() != "hidden":
                    self.names += [re.sub(r"\d+", "", x) for x in value.split()]

    @property
    def label(self) -> str:
        return ".".join([self.tag, *sorted(set(self.names))])

    @property
    def boilerplate(self) -> bool:
        if self.tag in BOILERPLATE or self.role in ROLES:
            return True
        if self.tag in ("html", "body", "article", "main"):
            return self.tag == "article" and any(x.startswith("comment") for x in self.names)
        return any(not HINTS.isdisjoint(re.split(r"[^a-z]+", x)) for x in self.names)


def parse(html: str | None) -> Node:
    """DOM tree of a whole page, with the end tags that HTML lets authors leave out; a null page is an empty tree."""
    root = Node("#root")
    stack, at, html = [root], 0, html or ""

    def close(tags: set, within: set) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in within:
                return

    while at < len(html):
        m = TOKEN.search(html, at)
        if m is None:
            stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at, end, tag = m.end(), m.group(1), (m.group(2) or "").lower()
        if not tag:
            continue
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                    break  # a stray end tag does not leave the article
            continue
        if tag in CLOSES_P:
            close({"p"}, {"article", "main", "div", "section", "td", "li", "blockquote", "body", "button"})
        if tag in CLOSED_BY_SAME:
            close({tag} | ({"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else set()), CLOSED_BY_SAME[tag])
        node = Node(tag, m.group(3))
        stack[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            at = stop.end() if stop else len(html)
        elif tag not in VOID:
            stack.append(node)
    return root


def article_roots(root: Node) -> list[Node]:
    """The page's articles; else its main part; else its body; regions that are boilerplate are not looked into."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "body": []}
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag == "article" or node.kind == "articlebody":
            found["article"].append(node)
            continue
        if node.tag in ("main", "body") or node.role == "main":
            found["body" if node.tag == "body" else "main"].append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.boilerplate)
    return found["article"] or found["main"][:1] or found["body"][:1] or [root]


def blocks(roots: list[Node], template: frozenset[int] = frozenset()) -> list[str]:
    """Text blocks in page order, without boilerplate and the own text of ``template`` nodes."""
    out, line = [], []

    def flush():
        text = " ".join(entities.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    stack: list = list(reversed(roots))
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            line.append(item)
        else:
            block = item.tag in BLOCKS
            if block:
                flush()
                stack.append(None)
            drop = item.index in template
            stack.extend(c for c in reversed(item.children) if not (drop if isinstance(c, str) else c.boilerplate))
    flush()
    return out


# ---- skeletons -----------------------------------------------------------------------------------------
def skeleton(root: Node) -> list[list]:
    """Preorder ``[label, depth, own text hash]``; sets ``index`` of the nodes it holds. Repeated siblings share an entry.

    Boilerplate is left out: it is no text in any case. The hash of a repeated or a childless deep node covers all its text.
    """
    out: list[list] = []
    stack = [([root], 0)]
    while stack:
        nodes, depth = stack.pop()
        index = len(out)
        groups: dict[str, list[Node]] = {}
        own: list[str] = []
        for node in nodes:
            node.index = index
            for child in node.children:
                if isinstance(child, str):
                    own.append(child)
                elif not child.boilerplate:
                    groups.setdefault(child.label, []).append(child)
        text = " ".join(" ".join(own).split())
        out.append([nodes[0].label, depth, zlib.crc32(text.encode("utf-8", "surrogatepass")) if text else 0])
        if depth < MOST_DEPTH:
            stack.extend((g, depth + 1) for g in reversed(groups.values()))
    return out


def _children(nodes: list[list]) -> list[list[int]]:
    kids: list[list[int]] = [[] for _ in nodes]
    path: list[int] = []
    for i, (_, depth, _) in enumerate(nodes):
        del path[depth:]
        if path:
            kids[path[-1]].append(i)
        path.append(i)
    return kids


def align(one: list[list], two: list[list]) -> dict[int, int]:
    """Simple tree matching: nodes of ``two`` to nodes of ``one``, as many as keep labels, parents and order."""
    kids1, kids2 = _children(one), _children(two)
    size: dict[tuple[int, int], int] = {}
    pick: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def match(a: int, b: int) -> int:
        if one[a][0] != two[b][0]:
            return 0
        if (a, b) in size:
            return size[a, b]
        x, y = kids1[a], kids2[b]
        if len(x) * len(y) > WIDE:
            first = {one[i][0]: i for i in reversed(x)}
            pairs = [(first[two[j][0]], j) for j in y if two[j][0] in first]
            total = sum(match(i, j) for i, j in pairs)
        else:
            table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            for i, p in enumerate(x):
                for j, q in enumerate(y):
                    table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + match(p, q))
            total, pairs, i, j = table[-1][-1], [], len(x), len(y)
            while i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((x[i], y[j]))
        size[a, b], pick[a, b] = total + 1, pairs
        return total + 1

    found: dict[int, int] = {}
    if one and two and match(0, 0):
        stack = [(0, 0)]
        while stack:
            a, b = stack.pop()
            found[b] = a
            stack.extend(pick[a, b])
    return found


def extract(html: str | None, wrapper: str | None = None) -> str:
    """Main text of one page; ``wrapper`` is its host's, as ``induce`` makes it."""
    if not html:
        return ""
    root = parse(html)
    template: frozenset[int] = frozenset()
    if wrapper:
        known = json.loads(wrapper)
        constant = dict(known["constant"])
        own = skeleton(root)
        # only text that is indeed the template's: a page may differ where the pages it was learnt from agreed
        template = frozenset(i for i, r in align(known["nodes"], own).items() if r in constant and own[i][2] == constant[r])
    return "\n".join(blocks(article_roots(root), template))


# ---- induction over a table ----------------------------------------------------------------------------
def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, contents, nodes = [], [], []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root = parse(html)
            hosts.append(host)
            nodes.append(json.dumps(skeleton(root)))
            contents.append(zlib.crc32("\n".join(blocks(article_roots(root))).encode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "content": pa.array(contents, pa.int64()), "nodes": pa.array(nodes, pa.string())})


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, reference, nodes in zip(*[c.to_pylist() for c in batch.columns]):
            own = json.loads(nodes)
            rows += [(host, r, own[i][2]) for i, r in align(json.loads(reference), own).items() if own[i][2]]
        columns = list(zip(*rows)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_pydict({"host": pa.array(columns[0], pa.string()), "node": pa.array(columns[1], pa.int32()), "text": pa.array(columns[2], pa.int64())})


def induce(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``(host, wrapper)`` for every host (column host, html) with template text. Null and empty hosts have none."""
    rows = pages.where("host <> '' AND html IS NOT NULL").select("host", "html")
    shapes = materialise(rows.mapInArrow(_skeletons, "host string, content long, nodes string"), "skeletons")
    # one skeleton for each different article of a host; the smallest stands for the host
    distinct = shapes.groupBy("host", "content").agg(F.min("nodes").alias("nodes"))
    distinct = materialise(distinct, "articles")
    reference = distinct.groupBy("host").agg(F.min("nodes").alias("reference"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    known = _small(materialise(reference.select("host", "reference"), "references"), "reference")
    met = distinct.join(known, "host").select("host", "reference", "nodes")
    nodes = met.mapInArrow(_aligned, "host string, node int, text long")
    counted = nodes.groupBy("host", "node").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("low"), F.max("text").alias("high"))
    constant = counted.where((F.col("n") >= least_pages) & (F.col("low") == F.col("high")))
    by_host = constant.groupBy("host").agg(F.array_sort(F.collect_list(F.array(F.col("node").cast("long"), "low"))).alias("constant"))
    return by_host.join(known, "host").select("host", F.concat(F.lit('{"constant":'), F.to_json("constant"), F.lit(',"nodes":'), F.col("reference"), F.lit("}")).alias("wrapper"))


def _small(table: DataFrame, column: str) -> DataFrame:
    """``table`` to be broadcast if its counted size allows it; a larger one is joined by its key."""
    size = table.agg(F.coalesce(F.sum(F.length(column)), F.lit(0))).first()[0]
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def main_texts(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES) -> DataFrame:
    """``pages`` with text and n_chars (columns of these names are replaced).

    A null or empty page, and one without an article's text, has an empty text. Pages with a null url, and hosts with
    too few pages to tell what is constant, are cut without a template. Rows stay, repeated ones too.
    """
    host, _ = host_and_path(F.col(url_col))
    wrappers = materialise(induce(pages.select(host.alias("host"), F.col(html_col).alias("html")), least_pages), "wrappers")
    rows = pages.withColumn("__host", host)

    @F.arrow_udf("string")
    def cut(html: pa.Array, wrapper: pa.Array) -> pa.Array:
        return pa.array([extract(h, w) for h, w in zip(html.to_pylist(), wrapper.to_pylist())], pa.string())

    known = wrappers.select(F.col("host").alias("__h"), F.col("wrapper").alias("__wrapper"))
    rows = rows.join(_small(known, "__wrapper"), F.col("__host") == F.col("__h"), "left")
    rows = rows.withColumn("text", F.coalesce(cut(F.col(html_col), F.col("__wrapper")), F.lit("")))
    return rows.withColumn("n_chars", F.length("text").cast("long")).drop("__host", "__h", "__wrapper")
