"""HTML extraction by wrapper induction.

Pages of one host share a few templates. A page's layout is the set of its containers. All distinct pages of each host and of
each layout, whatever their length, are aligned with the one of most text by simple tree matching (the largest order-preserving
matching of blocks of equal tag and name). How many pages have each of its blocks, how many with the same text, and how much
other text, are sums over pages, and show the container: the deepest one that holds the text that varies. What is constant is
counted over the same pages: a text at a path is constant if at least ``LEAST_PAGES`` pages have it and half of the pages with
text at that path do. The wrapper of a layout (of its host, if fewer than ``LEAST_PAGES`` pages have the layout) is then applied
to all its pages: the text of the container, block by block, without constant texts and without what HTML itself marks as no
content (navigation, headers, footers, asides, adverts, notices, forms, scripts, styles, comments).

Pages are parsed once for their trees and texts, which are stored as numbers; pages of equal html are held equal by 64 bits
of a hash. Trees that the others are aligned with, and wrappers, are broadcast while they are small, joined otherwise.

Defined results: null and empty html give an empty text; a page without the container falls back on its article, main or
body; a null url has no host and no wrapper; hosts of fewer than ``LEAST_PAGES`` distinct pages have no constants, and neither
have pages that differ in nothing; repeated rows are extracted each. White space is what Unicode calls so, after character
references are decoded. A tag ends at the first ``>`` outside of quoted values (a quote counts after ``=`` only); what looks like a tag
behind the page's last ``>`` is text; where honouring a quote would leave a tag without an end, quotes are plain from there on.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegrid.llm.common import batch, materialize

LEAST_PAGES = 4
#: Share of the varying text that the container must hold.
HELD = 0.9
#: Bytes of wrappers, or of trees, that are broadcast.
MOST_BROADCAST = 32_000_000
#: Shapes and alignments that a task remembers, and blocks of trees whose sums it holds.
MOST_SHAPES, MOST_SUMS = 50_000, 1_000_000

# A quote has its meaning after an equals sign only. Repetitions are possessive: no character is read twice for a tag.
_OTHER = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
TAG = re.compile(rf"""{_OTHER}|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""", re.DOTALL)
PLAIN_TAG = re.compile(rf"{_OTHER}|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.DOTALL)
BEGIN = re.compile(r"<[/!?]?[a-zA-Z!?\[-]")
UNCLOSED = re.compile(r"<!(?:--|\[CDATA\[)")
NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg object canvas".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article body center div html main section table tbody td".split())
#: Elements that hold no main text, and words of class, id or role that say so.
NO_TEXT = frozenset("aside button dialog footer form head input label menu nav select".split()) | RAW
NO_TEXT_NAMES = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer header masthead menu nav navbar navigation newsletter notice notices popup promo related share sharing sidebar social sponsored subscribe widget".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES |= {t: ("p",) for t in BLOCK - {"br", "option", "td", "th", "tr", "li", "dt", "dd", "p", "html", "body"}}
KEEPS_IN = {"li": ("ul", "ol"), "tr": ("table",), "td": ("table",), "th": ("table",), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}


@lru_cache(maxsize=1 << 14)
def names_of(attributes: str) -> tuple[str, ...]:
    """The words of class, id and role."""
    if "=" not in attributes:
        return ()
    return tuple(w for x in NAME.findall(attributes) for w in re.split(r"[\s_-]+", "".join(x).lower()) if w)


def events(html: str):
    """("open", tag, name words, "") and ("close", tag, (), "") in document order with implied ends, and ("text", "", (), text)."""
    stack: list[str] = []
    places: defaultdict[str, list[int]] = defaultdict(list)  # of each open tag, so that deep pages cost no more

    def close(tag):
        while True:
            last = stack.pop()
            places[last].pop()
            yield "close", last, (), ""
            if last == tag:
                break

    at, last, pattern = 0, html.rfind(">"), TAG
    while True:
        m, seek = None, at
        while begin := BEGIN.search(html, seek):
            # behind the last > there are no tags, and what a comment there holds is no text
            inside = begin.start() <= last or UNCLOSED.match(html, begin.start())
            m = pattern.match(html, begin.start()) if inside else None
            if m is None and inside and pattern is TAG:
                # a quote that takes the rest of the page: from here on quotes are plain characters
                pattern = PLAIN_TAG
                m = pattern.match(html, begin.start())
            if m or not inside:
                break
            seek = begin.start() + 1
        text = html[at : m.start() if m else len(html)]
        if text:
            yield "text", "", (), text
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if places[tag]:
                yield from close(tag)
            continue
        for other in CLOSES.get(tag, ()):
            if places[other]:
                stop = max((places[t][-1] for t in (CONTAINER if other == "p" else KEEPS_IN.get(tag, ())) if places[t]), default=-1)
                if places[other][-1] > stop:
                    yield from close(other)
        yield "open", tag, names_of(m[3]) if m[3] else (), ""
        if tag in VOID or m[3].endswith("/"):
            yield "close", tag, (), ""
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>", re.IGNORECASE).search(html, at, last + 1)
            at = end.end() if end else len(html)
            yield "close", tag, (), ""
        else:
            places[tag].append(len(stack))
            stack.append(tag)
    for last in reversed(stack):
        yield "close", last, (), ""


@lru_cache(maxsize=1 << 14)
def no_text(tag: str, names: tuple[str, ...], in_article: bool) -> bool:
    if tag in NO_TEXT or (tag == "header" and not in_article):
        return True
    return tag not in ("html", "body", "article", "main") and not NO_TEXT_NAMES.isdisjoint(names)


@lru_cache(maxsize=1 << 14)
def label(tag: str, names: tuple[str, ...]) -> str:
    return ".".join((tag, *names[:2]))


def number(*parts: str | int) -> int:
    return int.from_bytes(blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@lru_cache(maxsize=1 << 16)
def below(path: int, name: str) -> int:
    """The number of the path of an element in an element; 0 is the path of no element."""
    return number(path, name)


class Node:
    """A block element with the text of itself and of the inline elements in it."""

    __slots__ = ("children", "label", "nodes", "own", "path", "shape", "size", "tag")

    def __init__(self, tag: str, name: str, path: int) -> None:
        self.tag, self.label, self.path, self.own, self.size, self.shape = tag, name, path, "", 0, 0
        self.children: list[Node] = []
        self.nodes: list[Node] = []  # of the root: all nodes, parents before children


def tree(html: str, read: list | None = None) -> Node:
    """The blocks of a page that can hold main text. read: its events, if they are known."""
    root = Node("", "", 0)
    root.nodes, texts, articles = [root], [[]], 0
    stack = [(root, 0, False)]  # the nearest block, the path of the element, whether it holds no text
    for kind, tag, names, text in events(html) if read is None else read:
        node, path, skip = stack[-1]
        if kind == "text":
            if not skip:
                texts[-1].append(text)
        elif kind == "open":
            articles += tag == "article"
            skip, path = skip or no_text(tag, names, articles > 0), below(path, label(tag, names))
            if tag in BLOCK and not skip:
                inner = Node(tag, label(tag, names), path)
                node.children.append(inner)
                root.nodes.append(inner)
                texts[-1].append(" ")
                texts.append([])
                node = inner
            stack.append((node, path, skip))
        else:
            articles -= tag == "article"
            stack.pop()
            if stack[-1][0] is not node:
                node.own = " ".join(unescape("".join(texts.pop())).split())
    root.own = " ".join(unescape("".join(texts.pop())).split())
    for x in reversed(root.nodes):
        x.size = len(x.own) + sum(c.size for c in x.children)
    return root


class Matching:
    """Simple tree matching: the largest matching of two trees that keeps order and depth and pairs nodes of equal labels.

    How many nodes two subtrees match depends on their shapes alone, so it is found once for two shapes. Children are aligned
    row by row, in halves, so that memory is that of a row however many children there are; no step recurses with depth.
    """

    def __init__(self, trees: list[Node]) -> None:
        self.kinds: dict[tuple, int] = {}
        self.labels: list = []
        self.kids: list[np.ndarray] = []
        self.found: dict[tuple[int, int], int] = {}
        for t in trees:
            self.add(t)

    def add(self, t: Node) -> None:
        for x in reversed(t.nodes):
            kind = x.label, tuple(c.shape for c in x.children)
            x.shape = self.kinds.setdefault(kind, len(self.kinds))
            if x.shape == len(self.labels):
                self.labels.append(x.label)
                self.kids.append(np.array(kind[1], np.int64))

    def weight(self, a: int, b: int) -> int:
        """Nodes that trees of shapes a and b match."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if (x, y) in self.found:
                todo.pop()
            elif self.labels[x] != self.labels[y]:
                self.found[x, y] = 0
            else:
                p, q, s, t = self.apart(x, y)
                new = [(i, j) for i in set(p.tolist()) for j in set(q.tolist()) if (i, j) not in self.found]
                new += [(i, i) for i in {*s.tolist(), *t.tolist()} if (i, i) not in self.found]
                todo += new
                if not new:
                    equal = sum(self.found[i, i] for i in (*s.tolist(), *t.tolist()))
                    self.found[x, y] = 1 + equal + (int(self.last(p, q)[-1]) if len(p) and len(q) else 0)
        return self.found[a, b]

    def apart(self, x: int, y: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Children of two shapes between those that both begin and both end with, and those: equal shapes at an end are best
        matched with each other, since nothing matches more of a tree than its equal."""
        p, q = self.kids[x], self.kids[y]
        n = min(len(p), len(q))
        begin = int(np.append(p[:n] != q[:n], True).argmax())
        n -= begin
        end = int(np.append(p[len(p) - n :][::-1] != q[len(q) - n :][::-1], True).argmax())
        return p[begin : len(p) - end], q[begin : len(q) - end], p[:begin], p[len(p) - end :]

    def table(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights of the distinct shapes of two lists, and the place of each member among them."""
        (u, i), (v, j) = (np.unique(x, return_inverse=True) for x in (p, q))
        return np.array([[self.found[x, y] for y in v.tolist()] for x in u.tolist()], np.int64).reshape(len(u), len(v)), i, j

    def last(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """For every number of first members of q, how many nodes they match with all of p."""
        w, i, j = self.table(p, q)
        return self.row(w, i, j)

    @staticmethod
    def row(w: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        best = np.zeros(len(j) + 1, np.int64)
        for k in i.tolist():
            new = best.copy()
            np.maximum(new[1:], best[:-1] + w[k, j], out=new[1:])
            best = np.maximum.accumulate(new)
        return best

    def align(self, p: np.ndarray, q: np.ndarray) -> list[tuple[int, int]]:
        """Places of the members of two lists that are matched."""
        w, i, j = self.table(p, q)
        out, todo = [], [(0, len(i), 0, len(j))]
        while todo:
            a, b, c, d = todo.pop()
            if b - a == 1 and c < d:
                k = c + int(w[i[a], j[c:d]].argmax())
                if w[i[a], j[k]]:
                    out.append((a, k))
            elif b > a and c < d:
                half = (a + b) // 2
                left, right = self.row(w, i[a:half], j[c:d]), self.row(w, i[half:b][::-1], j[c:d][::-1])[::-1]
                cut = c + int((left + right).argmax())
                todo += [(a, half, c, cut), (half, b, cut, d)]
        return sorted(out)

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """The nodes of two trees that are matched."""
        if not self.weight(a.shape, b.shape):
            return []
        out = [(a, b)]
        for x, y in out:  # grows
            p, q, s, t = self.apart(x.shape, y.shape)
            out += zip(x.children[: len(s)], y.children[: len(s)], strict=True)
            if len(p) and len(q):
                out += [(x.children[len(s) + i], y.children[len(s) + j]) for i, j in self.align(p, q)]
            if len(t):
                out += zip(x.children[-len(t) :], y.children[-len(t) :], strict=True)
        return out


def match(a: Node, b: Node) -> int:
    """How many nodes two trees match."""
    return Matching([a, b]).weight(a.shape, b.shape)


#: A page's blocks, parents before children: the places of their parents, numbers of their labels, paths and own texts, characters
#: of them and all below, and whether they can be the container.
TREE = ("parents", "labels", "paths", "owns", "sizes", "boxes")


def flat(root: Node) -> tuple[list, ...]:
    """The columns of TREE."""
    at = {id(x): i for i, x in enumerate(root.nodes)}
    parents = [-1] * len(root.nodes)
    for i, x in enumerate(root.nodes):
        for c in x.children:
            parents[at[id(c)]] = i
    return parents, [below(0, x.label) for x in root.nodes], [x.path for x in root.nodes], [number(x.own) for x in root.nodes], [x.size for x in root.nodes], [x.tag in CONTAINER for x in root.nodes]


def shaped(parents: list[int], labels: list[int]) -> Node:
    """The tree of these blocks, each with its place as its path."""
    nodes = [Node("", name, i) for i, name in enumerate(labels)]
    for x, up in zip(nodes[1:], parents[1:], strict=True):
        nodes[up].children.append(x)
    nodes[0].nodes = nodes
    return nodes[0]


class Sums:
    """Sums over pages that are aligned with a template: by block of it how many pages have it, how many of these with its text,
    characters of their texts, and characters below that nothing of the template aligns with."""

    def __init__(self, template: tuple) -> None:
        self.template = template
        self.owns = np.array(template[3], np.int64)
        self.sums = np.zeros((4, len(self.owns)), np.int64)
        self.pages = 0
        self.forget()

    def forget(self) -> None:
        self.root = shaped(*self.template[:2])
        self.matching = Matching([self.root])
        self.known: dict[int, list[np.ndarray]] = {}  # how pages of one shape align

    def aligned(self, parents: list[int], labels: list[int]) -> list[np.ndarray]:
        """Places in the template and in a page of the blocks that are matched, and of blocks of the page below them that are not."""
        key = number(*parents, *labels)
        if key not in self.known:
            other = shaped(parents, labels)
            self.matching.add(other)
            pairs = [(x.path, y) for x, y in self.matching.pairs(self.root, other)]
            met = {y.path for _, y in pairs}
            rest = [(x, c.path) for x, y in pairs for c in y.children if c.path not in met]
            self.known[key] = [np.array(x, np.int64) for x in ([x for x, _ in pairs], [y.path for _, y in pairs], [x for x, _ in rest], [c for _, c in rest])]
        return self.known[key]

    @property
    def shapes(self) -> int:
        return len(self.matching.kinds) + len(self.matching.found) // 4

    def add(self, page: tuple) -> None:
        x, y, at, other = self.aligned(page[0], page[1])
        own, size = np.array(page[3], np.int64), np.array(page[4], np.int64)
        chars = size.copy()
        np.subtract.at(chars, np.array(page[0][1:], np.int64), size[1:])
        self.pages += 1
        self.sums[0, x] += 1
        self.sums[1, x] += own[y] == self.owns[x]
        self.sums[2, x] += chars[y]
        np.add.at(self.sums[3], at, size[other])


def container(template: tuple, sums: np.ndarray, pages: int) -> int:
    """The path of the deepest container that holds HELD of the text that varies; 0 if none does."""
    met, equal, chars, extra = sums
    constant = (met >= max(LEAST_PAGES, pages / 2)) & (equal >= LEAST_PAGES) & (equal * 2 >= met)
    varying = np.where(constant, 0, chars) + extra
    parents, _, paths, _, _, boxes = template
    children: list[list[int]] = [[] for _ in parents]
    for i in range(len(parents) - 1, 0, -1):
        varying[parents[i]] += varying[i]
        children[parents[i]].append(i)
    at = 0
    if not varying[at]:  # pages that differ in nothing show no template
        return 0
    while inner := [i for i in children[at] if boxes[i] and varying[i] >= HELD * varying[0]]:
        at = min(inner)
    return paths[at]


def blocks(html: str, container: int = 0, containers: set[int] | None = None, read: list | None = None):
    """(path, text, within article, within main, within the container) of every block of text; containers gets their paths.
    read: the page's events, if they are known."""
    up, skip, within = 0, False, False  # of the innermost element: its path, no text, within the container
    path: list[tuple[int, bool, bool]] = []  # the same of those around it
    line: list[str] = []
    articles = mains = 0
    for kind, tag, names, text in events(html) if read is None else read:
        if kind == "text":
            if not skip:
                line.append(text)
            continue
        if line and tag in BLOCK:
            found = " ".join(unescape("".join(line)).split())
            line.clear()
            if found:
                yield up, found, articles > 0, mains > 0, within
        if kind == "open":
            path.append((up, skip, within))
            skip = skip or no_text(tag, names, articles > 0)
            up = below(up, label(tag, names))
            within = within or (container != 0 and up == container)
            if containers is not None and not skip and tag in CONTAINER:
                containers.add(up)
            articles += tag == "article"
            mains += tag == "main"
        else:
            articles -= tag == "article"
            mains -= tag == "main"
            up, skip, within = path.pop()
    found = " ".join(unescape("".join(line)).split())
    if found:
        yield up, found, articles > 0, mains > 0, within


def extract(html: str, container: int = 0, constants: frozenset[int] = frozenset()) -> str:
    """The main text of a page: the wrapper's container, or article, main or body where the page has none."""
    found: dict[str, list[str]] = {"wrapper": [], "article": [], "main": [], "body": []}
    for where, text, article, main, within in blocks(html, container):
        if where and constants and number(where, text) in constants:
            continue
        for k, put in (("body", True), ("article", article), ("main", main), ("wrapper", within)):
            if put:
                found[k].append(text)
    return "\n".join(next((found[k] for k in ("wrapper", "article", "main") if found[k]), found["body"]))


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


#: The scope that holds all pages of a host; others are layouts.
HOST = 0


def laid_out(pages: DataFrame) -> DataFrame:
    """pages with their layout, a number of the set of their containers."""
    kinds = T.StructType([*pages.schema.fields, T.StructField("layout", T.LongType())])

    def run(batches):
        for b in batches:
            out = []
            for html in b.column("html").to_pylist():
                seen: set[int] = set()
                for _ in blocks(html or "", "", seen):
                    pass
                out.append(number(*sorted(seen)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "layout"])

    return pages.mapInArrow(run, kinds)


def parsed(pages: DataFrame) -> DataFrame:
    """(host, layout, h, lines, the columns of TREE) of every distinct page of a host: h is a hash of its html, lines have the
    paths that hold text, each beside null and beside the number of each of its texts."""
    many = {"parents": pa.int32(), "sizes": pa.int32(), "boxes": pa.bool_()}
    line = pa.struct([("path", pa.int64()), ("line", pa.int64())])
    arrow = pa.schema([("host", pa.string()), ("layout", pa.int64()), ("h", pa.int64()), ("lines", pa.list_(line)), *((k, pa.list_(many.get(k, pa.int64()))) for k in TREE)])

    def run(batches):
        for b in batches:
            out = []
            for host, html, h in zip(*(b.column(k).to_pylist() for k in ("host", "html", "h")), strict=True):
                read = list(events(html))
                found: set[tuple] = set()
                seen: set[int] = set()
                for where, text, *_ in blocks(html, 0, seen, read):
                    if where:
                        found |= {(where, None), (where, number(where, text))}
                out.append((host, number(*sorted(seen)), h, [{"path": w, "line": x} for w, x in found], *flat(tree(html, read))))
            if out:
                yield batch(arrow, *map(list, zip(*out, strict=True)))

    known = pages.where((F.col("host") != "") & F.col("html").isNotNull()).select("host", "html", F.xxhash64("html").alias("h"))
    kinds = ", ".join(f"{k} array<{'boolean' if k == 'boxes' else 'int' if k in many else 'bigint'}>" for k in TREE)
    return known.mapInArrow(run, f"host string, layout long, h long, lines array<struct<path: bigint, line: bigint>>, {kinds}").dropDuplicates(["host", "h"])


def near(df: DataFrame, size) -> DataFrame:
    """df, marked for a broadcast if these bytes a row are few in all."""
    held = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= MOST_BROADCAST else df


def containers(pages: DataFrame) -> DataFrame:
    """(host, scope, container, pages): the number of the container's path of every host and of every layout, and how many pages
    it was chosen from, which are all; of parsed pages."""
    known = pages.select("host", F.explode(F.array(F.lit(HOST).cast("long"), "layout")).alias("scope"), "h", *TREE)
    # a task sends one page for each scope
    first = known.groupBy("host", "scope").agg(F.max_by(F.struct(*TREE), F.struct(F.element_at("sizes", 1), "h")).alias("template"), F.count("*").alias("_n"))
    # layouts of fewer pages have no wrapper
    first = materialize(first.where((F.col("scope") == HOST) | (F.col("_n") >= LEAST_PAGES)).drop("_n"), "templates")
    joined = known.join(near(first, F.size("template.parents") * 40 + F.length("host")), ["host", "scope"])
    arrow = pa.schema([("host", pa.string()), ("scope", pa.int64()), ("pages", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches):
        held: dict[tuple, Sums] = {}
        size = shapes = 0

        def told():
            return batch(arrow, *map(list, zip(*((*k, s.pages, s.sums.ravel().tolist()) for k, s in held.items()), strict=True)))

        for b in batches:
            host, scope, *page, template = (b.column(k) for k in ("host", "scope", *TREE, "template"))
            for i, (key, *own) in enumerate(zip(zip(host.to_pylist(), scope.to_pylist(), strict=True), *(c.to_pylist() for c in page), strict=True)):
                if key not in held:
                    if size > MOST_SUMS:
                        yield told()
                        held.clear()
                        size = shapes = 0
                    t = template[i].as_py()
                    held[key] = Sums(tuple(t[k] for k in TREE))
                    size += len(t["parents"])
                if shapes > MOST_SHAPES:
                    shapes = 0
                    for x in held.values():
                        x.forget()
                shapes -= held[key].shapes
                held[key].add(own)
                shapes += held[key].shapes
        if held:
            yield told()

    def add(rows: pa.Table) -> pa.Table:
        whole = sum(np.array(x.as_py(), np.int64) for x in rows.column("sums"))
        return pa.table([rows.column("host")[:1], rows.column("scope")[:1], pa.array([sum(rows.column("pages").to_pylist())], pa.int64()), pa.array([whole.tolist()], pa.list_(pa.int64()))], schema=arrow)

    kinds = "host string, scope long, pages long, sums array<bigint>"
    whole = joined.mapInArrow(run, kinds).groupBy("host", "scope").applyInArrow(add, kinds)  # a row or a few of each task

    def choose(batches):
        for b in batches:
            rows = list(zip(*(b.column(k).to_pylist() for k in ("template", "sums", "pages")), strict=True))
            found = [container(tuple(t[k] for k in TREE), np.array(x, np.int64).reshape(4, -1), n) for t, x, n in rows]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("scope"), pa.array(found, pa.int64()), b.column("pages")], names=["host", "scope", "container", "pages"])

    return whole.join(first, ["host", "scope"]).mapInArrow(choose, "host string, scope long, container long, pages long")


def constants(pages: DataFrame) -> DataFrame:
    """(host, scope, constants): numbers of the texts at their paths that are constant, counted over all parsed pages."""
    # a page's lines are dealt out by themselves, so a large host is no large task
    lines = pages.select("host", "layout", F.explode("lines").alias("x")).select("host", "layout", "x.path", "x.line")
    by_layout = materialize(lines.groupBy("host", "layout", "path", "line").agg(F.count("*").alias("n")), "lines")
    counts = by_layout.withColumnRenamed("layout", "scope").unionByName(by_layout.groupBy("host", "path", "line").agg(F.sum("n").alias("n")).withColumn("scope", F.lit(HOST).cast("long")))
    at = counts.where("line is null").select("host", "scope", "path", F.col("n").alias("pages"))
    told = counts.where("line is not null").join(at, ["host", "scope", "path"]).withColumn("constant", (F.col("n") >= LEAST_PAGES) & (F.col("n") * 2 >= F.col("pages")))
    # pages that differ in nothing show no template
    return told.groupBy("host", "scope").agg(F.collect_list(F.when(F.col("constant"), F.col("line"))).alias("constants"), F.bool_and("constant").alias("same")).where("not same and size(constants) > 0").drop("same")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    hosted = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    plain = laid_out(hosted)
    read = materialize(parsed(hosted), "parsed")
    scopes = materialize(containers(read), "containers").join(constants(read), ["host", "scope"], "full")
    known = materialize(scopes.select("host", "scope", F.to_json(F.struct(F.coalesce("container", F.lit(0)).alias("container"), F.coalesce("constants", F.array().cast("array<long>")).alias("constants"))).alias("wrapper"), F.coalesce("pages", F.lit(0)).alias("pages")), "wrappers")
    of_host = known.where(F.col("scope") == HOST).select("host", F.col("wrapper").alias("of_host"))
    of_layout = known.where((F.col("scope") != HOST) & ((F.col("pages") >= LEAST_PAGES) | F.col("wrapper").contains('"constants":[') & ~F.col("wrapper").contains('"constants":[]'))).select("host", F.col("scope").alias("layout"), F.col("wrapper").alias("of_layout"))

    both = plain.join(near(of_host, F.length("of_host") + F.length("host")), "host", "left").join(near(of_layout, F.length("of_layout") + F.length("host")), ["host", "layout"], "left").select("page_id", "url", "html", "of_host", "of_layout")
    kind = dict(pages.dtypes)["page_id"]

    def run(batches):
        wrappers: dict[str, tuple] = {}

        def of(wrapper):
            if wrapper is None:
                return 0, frozenset()
            if wrapper not in wrappers:
                if len(wrappers) > 1000:
                    wrappers.clear()
                x = json.loads(wrapper)
                wrappers[wrapper] = x["container"], frozenset(x["constants"])
            return wrappers[wrapper]

        for b in batches:
            texts = []
            for html, host, layout in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                # what is constant in the host or in the layout goes; the layout's container goes before the host's
                texts.append(extract(html, of(layout or host)[0], of(host)[1] | of(layout)[1]) if html else "")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return both.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
