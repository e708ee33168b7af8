"""Main text of web pages: wrappers induced from all pages of a host, applied to every page of it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleweave.llm.common import drop_tables, flat_map, materialize, read
from ruleweave.llm.url_filter import url_host

#: Pages of a host (picked by a hash of their id) with which every page of the host is aligned. A node is template if its text
#: is the same on at least SAME different pages and on half of those that have the node.
REFERENCES, SAME = 4, 3
#: Pages of a host that one task aligns; a host with more has its references in several tasks.
HOST_PAGES = 500
#: Hosts with more than HOST_PAGES pages that are broadcast at most; of more the pages meet the hosts in a shuffled join.
LARGE_HOSTS = 200_000

#: Fixed values of HTML: elements whose content is raw text, that have no content, that make blocks, that are never article.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
OUTSIDE = {"head", "nav", "aside", "footer", "form", "menu", "dialog", "template", "svg", "select", "button", "audio", "video", "canvas"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PASSAGES = HEADINGS | {"p", "li", "dt", "dd", "tr", "td", "th", "pre", "blockquote", "figcaption", "caption", "summary"}
ENDED_BY_NEXT = {"li", "dt", "dd", "tr", "td", "th"}
#: Words that mark what isn't the article, and words that may stand beside them in a marking name. A name such as
#: `cookie-notice` or `comments-list` marks; `notice-period`, `share-of-market` and `has-sidebar` don't.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner banners breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies copyright disclaimer disqus feedback footer form gdpr header login "
    "masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup "
    "promo promotion related replies reply search share sharing sidebar sidebars signup skip social sponsor sponsored "
    "subscribe subscription toolbar topbar widget widgets".split()
)
BESIDE = set(
    "area articles aside bar block bottom box button buttons col column container content foot global group head icons inner item "
    "items left links list main mobile module outer page panel post posts primary right row secondary section side site slot "
    "stories thread top unit wrap wrapper".split()
)
REPLIES = {"comment", "comments", "reply", "replies", "disqus"}

TAG_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
PLAIN_TAG = re.compile(r"<(/?[a-zA-Z][^\s/>]*)[^>=]*>")
QUOTE_OR_END = re.compile(r""">|=\s*["']""")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
MASK = (1 << 64) - 1


@dataclass(slots=True, eq=False)
class Node:
    """A block element that holds text. key is a hash of the labels from the page's root down to it."""

    label: str
    key: int = 0
    depth: int = 0
    parent: Node | None = None
    text: list[str] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)
    linked: bool = False
    shape: int = -1
    size: int = 0  # characters of text outside of menus and the like
    known: int | None = None  # constant() of a node with text in a tree made from an outline

    def constant(self) -> int:
        """A hash of where the node is and what it says."""
        return xxhash.xxh64_intdigest("\n".join(self.text).encode("utf-8", "surrogatepass"), self.key)


@dataclass(slots=True)
class Block:
    node: Node
    text: str
    outside: bool
    article: bool
    rooted: bool


def signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def child_key(key: int, label: str) -> int:
    return xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), key)


def path_key(path: str) -> int:
    """The key of a path such as /body/div.top."""
    key = 0
    for label in path.split("/")[1:]:
        key = child_key(key, label)
    return key


#: Elements that are whole pages.
TOPS = [signed(path_key(p)) for p in ("", "/html", "/body", "/html/body")]


def marks(words: list[str]) -> set[str]:
    """What marks a name as none of the article's, if the whole name says so."""
    found = set(words)
    hit = found & MARKS
    return hit if hit and all(w in MARKS or w in BESIDE or w.isdigit() for w in found) else set()


def read_attributes(tag: str, attributes: str, inside: bool) -> tuple[str, bool]:
    """The element's name in paths (classes and id, numbers as 0), and whether they or its role mark it.

    Inside the article headings and inline elements are never marked, and an id marks reader comments only; an article or main
    element can only be marked as a comment.
    """
    label, marked = "", False
    for m in ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip()
        if kind != "role":
            label += "." + re.sub(r"\d+", "0", value)
        if tag in ("html", "body") or (inside and (tag in HEADINGS or tag not in BLOCKS)):
            continue
        hit = set().union(*(marks([w.lower() for w in NAME.findall(name)]) for name in value.split()))
        if tag in ("article", "main") or (inside and kind == "id"):
            hit &= REPLIES
        marked = marked or bool(hit)
    return label, marked


def tags(html: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of comments, tags and declarations; name is '' for what is no tag, and begins with / in end tags.

    A quoted attribute value may hold '>'; a quote that is never closed counts for nothing. A tag that the page's end cuts
    off goes on to the end. Every character is looked at a bounded number of times.
    """
    at, last = 0, {q: html.rfind(q) for q in "\"'"}
    while (start := html.find("<", at)) >= 0:
        if (plain := PLAIN_TAG.match(html, start)) and (name := plain[1].lower()) not in RAW:
            at = plain.end()
            yield start, at, name, ""
            continue
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = len(html) if end < 0 else end + 3
            yield start, at, "", ""
            continue
        name = TAG_NAME.match(html, start + 1)
        if name is None:
            at = start + 1
            if html.startswith(("<!", "<?", "</"), start):
                end = html.find(">", at)
                at = len(html) if end < 0 else end + 1
                yield start, at, "", ""
            continue
        at = name.end()
        while True:
            stop = QUOTE_OR_END.search(html, at)
            if stop is None:
                yield start, len(html), "", ""
                return
            if stop[0] == ">":
                at = stop.end()
                break
            quote = html[stop.end() - 1]
            if stop.end() > last[quote]:
                end = html.find(">", stop.end())
                at = len(html) if end < 0 else end + 1
                break
            at = html.index(quote, stop.end()) + 1
        raw = RAW_END.get(name[0].lower())
        yield start, at, name[0].lower(), html[name.end() : at - 1]
        if raw is not None:
            end = raw.search(html, at)
            at = len(html) if end is None else end.start()
            yield at, at, "", ""  # text goes on here


def parse(html: str, root: int | None = None) -> tuple[Node, list[Block]]:
    """The page's blocks of text in page order, and the tree of the block elements that hold them.

    A block is outside if an element that is no part of an article, or is marked so, is open; article if an article or main
    element is; rooted if the element with the key `root` is. Elements may be left open: a block ends an open paragraph, an
    item the item before it, an end tag what is open inside its element.
    """
    top = Node("")
    # Of each open element: tag, node, index of the nearest block element, outside, article, rooted.
    stack: list[tuple[str, Node, int, bool, bool, bool]] = [("", top, 0, False, False, root == 0)]
    opened: Counter[str] = Counter()
    out: list[Block] = []
    parts: list[str] = []

    def close() -> None:
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            _, node, _, outside, article, rooted = stack[-1]
            node.text.append(text)
            out.append(Block(node, text, outside, article, rooted))
            while node.parent is not None and not node.linked:
                node.parent.children.append(node)
                node.linked = True
                node = node.parent

    def leave(at: int) -> None:
        for entry in stack[at:]:
            opened[entry[0]] -= 1
        del stack[at:]

    at, raw = 0, False
    for start, end, tag, attributes in tags(html):
        if start > at and not raw:
            parts.append(html[at:start])
        at, raw = end, tag in RAW
        if not tag or raw:
            continue
        if tag == "br":
            parts.append("\n")
        elif tag[0] == "/":
            tag = tag[1:]
            if opened[tag]:
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                if stack[-1][2] >= i:  # a block element ends
                    close()
                leave(i)
        else:
            block = tag in BLOCKS
            if block:
                close()
                nearest = stack[-1][2]
                if tag not in ("html", "body") and (stack[nearest][0] == "p" or (stack[nearest][0] == tag and tag in ENDED_BY_NEXT)):
                    leave(nearest)
            if tag not in VOID:
                _, node, nearest, outside, article, rooted = stack[-1]
                label, marked = read_attributes(tag, attributes, article or rooted) if "=" in attributes else ("", False)
                outside = outside or tag in OUTSIDE or marked or (tag in ("header", "noscript") and not article)
                article = article or (tag in ("article", "main") and not outside)
                if block:
                    node = Node(tag + label, child_key(node.key, tag + label), node.depth + 1, node)
                    nearest, rooted = len(stack), rooted or node.key == root
                stack.append((tag, node, nearest, outside, article, rooted))
                opened[tag] += 1
    if not raw:
        parts.append(html[at:])
    close()
    return top, out


class Matcher:
    """Simple tree matching: the most nodes that two trees share, level by level and in order.

    Equal subtrees have one shape, and a pair of shapes is scored once. Equal shapes at the start or the end of two lists of
    children always belong together in a best matching; what remains between them goes through the usual table, row by row.
    """

    def __init__(self) -> None:
        self.shapes: dict[tuple | str, int] = {}
        self.labels: list[str] = []
        self.inner: list[list[int]] = []
        self.sizes: list[int] = []
        self.scores: dict[tuple[int, int], int] = {}

    def name(self, root: Node) -> None:
        """Gives each node of a tree the number of its shape, children first."""
        order = [root]
        for node in order:
            order.extend(node.children)
        for node in reversed(order):
            inner = [c.shape for c in node.children]
            key = (node.label, *inner) if inner else node.label
            shape = self.shapes.get(key)
            if shape is None:
                shape = self.shapes[key] = len(self.labels)
                self.labels.append(node.label)
                self.inner.append(inner)
                self.sizes.append(1 + sum(self.sizes[i] for i in inner))
            node.shape = shape

    @staticmethod
    def trim(a: list[int], b: list[int]) -> tuple[int, int]:
        """Lengths of the equal start and of the equal end."""
        n, start, end = min(len(a), len(b)), 0, 0
        while start < n and a[start] == b[start]:
            start += 1
        while end < n - start and a[-1 - end] == b[-1 - end]:
            end += 1
        return start, end

    def weights(self, x: int, bs: list[int]) -> list[int]:
        return [self.sizes[x] if x == y else self.scores[x, y] if self.labels[x] == self.labels[y] else 0 for y in bs]

    def table(self, xs: list[int], ys: list[int]) -> np.ndarray:
        """Best score of all xs with the first j of ys, for each j."""
        best, rows = np.zeros(len(ys) + 1, dtype=np.int64), {}
        for x in xs:
            if x not in rows:
                rows[x] = np.array(self.weights(x, ys), dtype=np.int64)
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + rows[x]))
        return best

    def score(self, a: int, b: int) -> int:
        """Shared nodes of two shapes."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if x == y or (x, y) in self.scores or self.labels[x] != self.labels[y]:
                todo.pop()
                continue
            xs, ys = self.inner[x], self.inner[y]
            start, end = self.trim(xs, ys)
            left, right = xs[start : len(xs) - end], ys[start : len(ys) - end]
            if left and right:
                pairs = ((p, q) for p in set(left) for q in set(right))
                missing = [(p, q) for p, q in pairs if p != q and self.labels[p] == self.labels[q] and (p, q) not in self.scores]
                if missing:
                    todo += missing
                    continue
            equal = sum(self.sizes[s] for s in xs[:start]) + sum(self.sizes[s] for s in xs[len(xs) - end :])
            self.scores[x, y] = 1 + equal + (int(self.table(left, right)[-1]) if left and right else 0)
            todo.pop()
        return self.sizes[a] if a == b else self.scores.get((a, b), 0)

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """The matched nodes of a best matching of two named trees, by halving the first list until one element is left."""
        if not self.score(a.shape, b.shape):
            return []
        out, todo = [], [(a, b)]

        def take(xs: list[Node], ys: list[Node]) -> None:
            for pair in zip(xs, ys, strict=True):
                (todo if pair[0].children and pair[1].children else out).append(pair)

        while todo:
            x, y = todo.pop()
            out.append((x, y))
            spans = [(x.children, y.children)]
            while spans:
                xs, ys = spans.pop()
                p, q = [n.shape for n in xs], [n.shape for n in ys]
                start, end = self.trim(p, q)
                take(xs[:start], ys[:start])
                take(xs[len(xs) - end :], ys[len(ys) - end :])
                xs, p, ys, q = xs[start : len(xs) - end], p[start : len(p) - end], ys[start : len(ys) - end], q[start : len(q) - end]
                if not xs or not ys:
                    continue
                if len(xs) == 1:
                    own = self.weights(p[0], q)
                    if max(own):
                        take(xs, [ys[own.index(max(own))]])
                    continue
                half = len(xs) // 2
                both = self.table(p[:half], q) + self.table(p[half:][::-1], q[::-1])[::-1]
                cut = int(both.argmax())
                spans += [(xs[:half], ys[:cut]), (xs[half:], ys[cut:])]
        return out


Outline = tuple[list[int], list[str], list[int | None], list[int]]


def outline(html: str) -> Outline:
    """(depths, labels, constants, sizes) of the nodes of a page's tree, parents first: all that an alignment needs of it."""
    top, blocks = parse(html)
    for b in blocks:
        if not b.outside:
            b.node.size += len(b.text)
    out: Outline = ([], [], [], [])
    todo = [top]
    while todo:
        node = todo.pop()
        for column, value in zip(out, (node.depth, node.label, signed(node.constant()) if node.text else None, node.size), strict=True):
            column.append(value)
        todo += reversed(node.children)
    return out


def grow(found: Outline) -> tuple[Node, list[Node]]:
    """The tree of an outline: its top and all its nodes, parents first. Only depths between linked nodes count."""
    nodes: list[Node] = []
    chain: list[Node] = []
    for depth, label, constant, size in zip(*found, strict=True):
        del chain[depth:]
        parent = chain[-1] if chain else None
        node = Node(label, child_key(parent.key, label) if parent else 0, depth, parent, size=size, known=constant)
        if parent:
            parent.children.append(node)
        chain.append(node)
        nodes.append(node)
    return nodes[0], nodes


def align(found: Outline, references: list[Node], matcher: Matcher) -> tuple[dict[int, bool], list[tuple[int, int, int]]]:
    """What one page says about the wrapper of its host, aligned with references that the matcher has named.

    (constants, masses): for each node of a reference that the page has too, whether the text is the same; and the length of the
    text of the page's other nodes outside of menus and the like, summed up to every element but passages such as paragraphs, as
    (key, depth, length).
    """
    top, nodes = grow(found)
    matcher.name(top)
    seen: dict[int, bool] = {}
    for reference in references:
        for x, y in matcher.pairs(reference, top):
            if x.known is not None:
                equal = x.known == y.known
                seen[x.known] = seen.get(x.known, False) or equal
                if equal:
                    y.size = 0
    masses: dict[int, list[int]] = {}
    for n in reversed(nodes):
        if n.size:
            if n.label.split(".", 1)[0] not in PASSAGES:
                masses.setdefault(n.key, [n.depth, 0])[1] += n.size
            if n.parent is not None:
                n.parent.size += n.size
    return seen, [(signed(key), depth, size) for key, (depth, size) in masses.items()]


OUTLINE = "depths array<int>, labels array<string>, constants array<long>, sizes array<int>"


def outlines(pages: DataFrame) -> DataFrame:
    """(host, order, copy, depths, labels, constants, sizes) of pages (host, order, html); copy is a hash of the html."""
    kinds = [pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        copies, found = [], ([], [], [], [])
        for html in batch.column(2).to_pylist():
            copies.append(signed(xxhash.xxh64_intdigest(html.encode("utf-8", "surrogatepass"))))
            for column, value in zip(found, outline(html), strict=True):
                column.append(value)
        columns = [batch.column(0), batch.column(1), pa.array(copies, pa.int64()), *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))]
        return pa.RecordBatch.from_arrays(columns, ["host", "order", "copy", "depths", "labels", "constants", "sizes"])

    return flat_map(pages, run, f"host string, order long, copy long, {OUTLINE}")


SEEN = "host string, kind string, key long, n long, m long"


def _observe(rows: DataFrame) -> DataFrame:
    """What all pages say, from rows (host, salt, page, copy, outline) that are sorted, references (page false) first; summed in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, references, matcher, found = None, [], Matcher(), {}

        def flush() -> pa.RecordBatch:
            columns = list(zip(*((group[0], kind, key, n, m) for (kind, key), (n, m) in found.items()), strict=True)) or [()] * 5
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "kind", "key", "n", "m"])

        for batch in batches:
            names = [batch.column(i).to_pylist() for i in range(4)]
            for host, salt, is_page, copy, *page in zip(*names, *batch.columns[4:], strict=True):
                page = [c.as_py() for c in page]
                if (host, salt) != group or len(found) > 200_000 or len(matcher.scores) > 1_000_000:
                    if found:
                        yield flush()
                    if (host, salt) != group:
                        group, references = (host, salt), []
                    matcher = Matcher()
                    for _, reference in references:
                        matcher.name(reference)
                if not is_page:
                    references.append((copy, grow(page)[0]))
                    matcher.name(references[-1][1])
                    continue
                others = [reference for other, reference in references if other != copy]  # copies say nothing
                if not others:
                    continue
                seen, masses = align(page, others, matcher)
                for key, equal in seen.items():
                    cell = found.setdefault(("constant", key), [0, 0])
                    cell[0] += 1
                    cell[1] += equal
                for key, depth, size in masses:
                    cell = found.setdefault(("mass", key), [0, depth])
                    cell[0] += size
        if found:
            yield flush()

    return rows.mapInArrow(run, SEEN).groupBy("host", "kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("same"), F.max("m").alias("depth"))


def judge(seen: DataFrame) -> DataFrame:
    """(host, template, root) from the sums over all pages: the constants, and the deepest element (not the page's top) that holds four
    fifths of what varies."""
    constant = seen.where((F.col("kind") == "constant") & (F.col("same") >= SAME - 1) & (2 * F.col("same") >= F.col("n")))
    template = constant.groupBy("host").agg(F.collect_list("key").alias("template"))  # at most the nodes of the references
    mass = seen.where("kind = 'mass'")
    total = mass.where("depth = 0").select("host", F.col("n").alias("total"))
    large = mass.where(~F.col("key").isin(TOPS)).join(total, "host").where(5 * F.col("n") >= 4 * F.col("total"))
    root = large.groupBy("host").agg(F.max_by("key", F.struct("depth", "key")).alias("root"))
    return template.join(root, "host", "full")


def induce(pages: list[str]) -> tuple[list[int], int | None]:
    """(template constants, content root) of a few pages of one host; what wrappers() does for all hosts."""
    references = [(html, grow(outline(html))[0]) for html in pages[:REFERENCES]]
    seen, masses, depths, matcher = {}, Counter(), {}, Matcher()
    for _, reference in references:
        matcher.name(reference)
    for html in pages:
        others = [reference for other, reference in references if other != html]
        found, sizes = align(outline(html), others, matcher) if others else ({}, [])
        for key, equal in found.items():
            cell = seen.setdefault(key, [0, 0])
            cell[0] += 1
            cell[1] += equal
        for key, depth, size in sizes:
            masses[key] += size
            depths[key] = depth
    template = sorted(k for k, (n, same) in seen.items() if same >= SAME - 1 and 2 * same >= n)
    roots = [k for k, n in masses.items() if k not in TOPS and 5 * n >= 4 * masses[0]]
    return template, max(roots, key=lambda k: (depths[k], k), default=None)


def main_text(html: str | None, template: list[int] | None = None, root: int | None = None) -> str:
    """The page's article: its article or main element if it has one, else all blocks that vary and all inside the content root.

    Menus, forms, marked elements and the like are left out everywhere; a node that the template knows with just this text is left
    out unless it stands inside the article or the root.
    """
    if not html:
        return ""
    fixed = {k & MASK for k in template} if template is not None and len(template) else set()
    _, blocks = parse(html, None if root is None else root & MASK)
    kept = [b for b in blocks if not b.outside]
    if any(b.article for b in kept):
        kept = [b for b in kept if b.article]
    elif fixed:
        kept = [b for b in kept if b.rooted or b.node.constant() not in fixed]
    return "\n\n".join(b.text for b in kept)


def wrappers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, template, root): a wrapper for each host.

    A few pages of a host serve as references; all its pages are aligned with them, and constants and slots are counted over
    all. Pages travel as outlines of their trees. The pages of a large host are dealt over tasks by a salt, its references
    copied to each.
    """
    own = pages.select(url_host(F.col(url_col)).alias("host"), F.xxhash64(F.col(id_col)).alias("order"), F.col(html_col).cast("string").alias("html"))
    own = own.where("html is not null and html <> '' and host <> ''")
    large = own.groupBy("host").agg(F.ceil(F.count("*") / HOST_PAGES).cast("int").alias("salts")).where("salts > 1")
    large = materialize(large, "large-hosts")
    pages = materialize(outlines(own), "outlines")
    found = pages.join(F.broadcast(large) if large.count() <= LARGE_HOSTS else large, "host", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    columns = ["copy", "depths", "labels", "constants", "sizes"]
    # The rank within the host is limited before the shuffle, so a host with a third of all pages sends no more than others.
    rank = F.row_number().over(W.partitionBy("host").orderBy("order", "copy"))
    picked = found.withColumn("rank", rank).where(F.col("rank") <= REFERENCES)
    references = picked.select("host", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("page"), *columns)
    dealt = found.select("host", F.pmod("order", "salts").cast("int").alias("salt"), F.lit(True).alias("page"), *columns)
    rows = references.unionByName(dealt).repartition("host", "salt").sortWithinPartitions("host", "salt", "page")
    seen = materialize(_observe(rows), "page-nodes")
    learned = materialize(judge(seen), "wrappers")
    drop_tables(large, pages, seen)
    return learned


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text): the main text of every page.

    Null html gives an empty text; a page without a host is read without a wrapper, and the wrapper of a host with fewer than SAME
    different pages knows no constants; repeated rows are read each; an empty table gives an empty result; columns other than the three named are ignored.
    """
    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    learned = wrappers(pages, id_col, url_col, html_col)
    joined = picked.withColumn("host", url_host(F.col("url"))).join(learned, "host", "left").select("page_id", "url", "html", "template", "root")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        wanted = zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True)
        texts = [main_text(h.as_py(), t.values.to_pylist() if t.is_valid else None, r) for h, t, r in wanted]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return flat_map(joined, run, "page_id long, url string, text string")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
