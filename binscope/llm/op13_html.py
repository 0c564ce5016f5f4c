"""Operator 13: main text of web pages by wrapper induction.

Pages become DOM trees of block elements. Pages of a host are sorted by a hash
and each is aligned with the different pages before it by simple tree matching.
Nodes whose text stays the same between aligned pages are template, the others
are slots; the votes are summed for each host. A page's content is what its
slots hold in the main container: the article or main element, else the element
reached from the body by following the child with most of the slots' text.
Elements that HTML or their class declare as navigation, advert, notice and so
on are left out, as is what varies there.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binscope.llm.common import BROADCAST_ROWS, record, small_side, stored
from binscope.session import ship_package

#: different pages before it that a page is aligned with
PARTNERS = 2
#: least aligned pairs of a host, and least share of them in which a text is the same, for a template
LEAST_PAIRS, CONSTANT = 4, 0.25
#: share of the slots' text that a child needs to be followed
FOLLOW = 2 / 3
#: deeper elements belong to the one at this depth (their text stays)
DEPTH = 200
#: pages handled at a time
PAGES = 64

# Elements of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title noscript template iframe svg math object canvas audio video select textarea button datalist".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary
    table tbody td tfoot th thead tr ul""".split())
CONTAINER = frozenset("article body center div html main section table tbody td tr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: an open element of these ends when one of its kind begins, up to the nearest of the third part
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
        "tfoot": ({"tbody", "thead", "tfoot"}, {"table"})}
#: elements and words of a class or id that declare what is not the article
DROPPED = frozenset("nav footer aside form dialog menu search".split())
WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo banner menu nav navbar navigation
    breadcrumb breadcrumbs sidebar aside footer cookie cookies consent gdpr notice popup modal overlay newsletter subscribe
    signup login share sharing social related recommended comment comments reply replies discussion disqus respond search
    pagination pager toolbar masthead topbar""".split())
#: those of them that an article or main element can be declared as
OTHER_ARTICLES = frozenset("ad ads advert sponsored promo related recommended comment comments reply replies".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _hash(parent: int, text: str) -> int:
    x = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), parent & 0xFFFFFFFFFFFFFFFF)
    return x - (1 << 64) if x >> 63 else x


class Page:
    """Block elements of a page in document order, and its blocks of text.

    ``label``: tag with class or id, digits as 0; ``path``: hash of the labels
    from the root; ``drop``: declared as something other than the article, by
    itself or an element around it; ``blocks``: (element, text, its hash).
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.label, self.path = ["#root"], [-1], ["#root"], [0]
        self.depth, self.own, self.named, self.header = [0], [False], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(source)
        self._decide()

    def _open(self, node: int, tag: str, attrs: str) -> int:
        if self.depth[node] >= DEPTH:
            return node
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMED.finditer(attrs)} if "=" in attrs else {}
        words = {w.lower() for k in ("class", "id") for w in _PART.findall(found.get(k, ""))}
        name = found.get("class") or found.get("id") or ""
        label = f"{tag}.{re.sub('[0-9]+', '0', ' '.join(sorted(name.split())))}" if name else tag
        self.tag.append(tag)
        self.parent.append(node)
        self.label.append(label)
        self.path.append(_hash(self.path[node], label))
        self.depth.append(self.depth[node] + 1)
        self.own.append(tag in DROPPED)
        known = () if tag in ("html", "body") else OTHER_ARTICLES if tag in ("article", "main") else WORDS
        self.named.append(bool(words.intersection(known)) or
                          tag not in ("html", "body", "article", "main") and found.get("role", "").lower() in ROLES)
        self.header.append(tag not in ("html", "body") and (tag == "header" or "header" in words))
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        node, at, n = 0, 0, len(source)
        open_tags: list[str] = []          # elements flattened at DEPTH
        text: list[str] = []
        skip: tuple[str, int] | None = None     # an inline element that is left out, and its block element

        def flush():
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if joined:
                self.blocks.append((node, joined, _hash(0, joined)))

        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                lt = n
            if skip is None and lt > at:
                text.append(source[at:lt])
            at = lt
            if at >= n:
                break
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                at = n if end < 0 else end + 3
                continue
            if source[at + 1:at + 2] in ("!", "?"):
                end = source.find(">", at)
                at = n if end < 0 else end + 1
                continue
            m = _TAG.match(source, at) or _LOOSE.match(source, at)
            if m is None:
                if source[at + 1:at + 2].isalpha() and source[at + 1:at + 2].isascii() or source.startswith("</", at):
                    end = source.find(">", at)     # an end tag without a name, or a tag cut off at the end
                    at = n if end < 0 else end + 1
                else:
                    if skip is None:
                        text.append("<")
                    at += 1
                continue
            at, closing, tag = m.end(), bool(m[1]), m[2].lower()
            if tag in RAW:
                if not closing and not m[3].endswith("/"):
                    end = re.compile(f"</{tag}\\b[^>]*>?", re.I).search(source, at)
                    if end is not None:
                        at = end.end()
                    elif tag in ("script", "style", "title"):
                        at = n
                continue
            if tag == "br":
                if skip is None:
                    text.append(" ")
                continue
            if tag not in BLOCK:
                if closing:
                    if skip is not None and skip[0] == tag:
                        skip = None
                elif skip is None and tag not in VOID and "=" in m[3]:
                    words = {w.lower() for x in _NAMED.finditer(m[3]) if x[1].lower() != "role"
                             for w in _PART.findall(x[2] or x[3] or x[4] or "")}
                    if words & WORDS:
                        skip = (tag, node)
                continue
            flush()
            if closing:
                if open_tags:
                    if tag in open_tags:
                        while open_tags.pop() != tag:
                            pass
                    continue
                up = node
                while up > 0 and self.tag[up] != tag:
                    up = self.parent[up]
                if up > 0 and tag not in ("body", "html"):
                    node = self.parent[up]
            else:
                if not open_tags:
                    node = self._before(node, tag)
                if tag in VOID:
                    continue
                inner = self._open(node, tag, m[3])
                if inner == node:
                    open_tags.append(tag)
                node = inner
            if skip is not None and (skip[1] != node and not self._inside(node, skip[1])):
                skip = None
        flush()

    def _inside(self, node: int, outer: int) -> bool:
        while node > outer:
            node = self.parent[node]
        return node == outer

    def _before(self, node: int, tag: str) -> int:
        """Close what ``tag`` ends: an open paragraph, or an element of its kind."""
        kinds, stop = ENDS.get(tag, ({"p"}, frozenset(["td", "th", "table", "li", "article", "section", "div", "main", "body"])))
        up = node
        while up > 0 and self.tag[up] not in stop:
            if self.tag[up] in kinds:
                return self.parent[up]
            if self.tag[up] == "p" and tag not in ENDS:
                return self.parent[up]
            up = self.parent[up]
        return self.parent[node] if self.tag[node] == "p" else node

    def _decide(self) -> None:
        n = len(self.tag)
        main = [t in ("article", "main") for t in self.tag]
        for i in range(n - 1, 0, -1):
            main[self.parent[i]] |= main[i]
        self.main = [t in ("article", "main") for t in self.tag]
        self.drop, inside = [False] * n, [False] * n
        for i in range(1, n):
            up = self.parent[i]
            inside[i] = inside[up] or self.tag[up] in ("article", "main")
            # a class of what surrounds the article says nothing about it; an article's own header belongs to it
            named = (self.own[i] or self.named[i] or (self.header[i] and not inside[i])) and (self.main[i] or not main[i])
            self.drop[i] = self.drop[up] or named

    # -- slots for the alignment ------------------------------------------------
    def skeleton(self) -> tuple[list[int], list[int], list[list[int]]]:
        """(parent, path, text hashes) of the tree in which siblings of one label in a row are one node."""
        parent, path, last = [-1], [0], [-1]
        where, label = [0] * len(self.tag), [""]
        for i in range(1, len(self.tag)):
            up = where[self.parent[i]]
            if last[up] >= 0 and label[last[up]] == self.label[i]:
                where[i] = last[up]
                continue
            where[i] = last[up] = len(parent)
            parent.append(up), path.append(self.path[i]), label.append(self.label[i]), last.append(-1)
        texts: list[list[int]] = [[] for _ in parent]
        for node, _, h in self.blocks:
            texts[where[node]].append(h)
        return parent, path, texts

    # -- content ------------------------------------------------------------------
    def content(self, template: set[tuple[int, int]]) -> str:
        """The text of the slots in the main container, blocks in page order."""
        free = [b for b in self.blocks if not self.drop[b[0]]]
        varying = [b for b in free if (self.path[b[0]], b[2]) not in template]
        root = self._root(varying) if varying else 0
        for roots in ({i for i, m in enumerate(self.main) if m and not self.drop[i]}, {root}):
            mine = [False] * len(self.tag)
            for i in range(len(mine)):
                mine[i] = i in roots or (self.parent[i] >= 0 and mine[self.parent[i]])
            every = [t for node, t, _ in free if mine[node]]
            slots = [t for node, t, _ in varying if mine[node]]
            if every:
                # most of a container is no template: such a page is one of many copies
                few = 2 * sum(map(len, slots)) < sum(map(len, every))
                return "\n".join(every if few else slots)
        return ""

    def _root(self, blocks: list[tuple[int, str, int]]) -> int:
        """From the root, follow the container that holds most of the text, until a heading stands beside it."""
        size = [0] * len(self.tag)
        for node, text, _ in blocks:
            size[node] += len(text)
        own = size[:]
        kids: dict[int, list[int]] = {}
        for i in range(len(self.tag) - 1, 0, -1):
            size[self.parent[i]] += size[i]
            if size[i]:
                kids.setdefault(self.parent[i], []).append(i)
        node = 0
        while True:
            inner = kids.get(node, [])
            best = max(inner, key=size.__getitem__, default=None)
            if (best is None or self.tag[best] not in CONTAINER or own[best] or size[best] < FOLLOW * size[node]
                    or self.tag[best] in ("tr", "tbody") and len(inner) > 1 or any(self.tag[i] in HEADING for i in inner)):
                return node
            node = best


# -- simple tree matching -------------------------------------------------------
class Tree:
    """A skeleton with the digest and size of each subtree."""

    def __init__(self, parent: list[int], path: list[int], texts: list[list[int]]):
        self.path, self.texts = path, texts
        n = len(parent)
        self.kids: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            self.kids[parent[i]].append(i)
        self.size, self.shape = [1] * n, [0] * n
        for i in range(n - 1, -1, -1):
            self.size[i] += sum(self.size[k] for k in self.kids[i])
            self.shape[i] = hash((path[i], *[self.shape[k] for k in self.kids[i]]))


def matched(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Pairs of nodes of the greatest top-down, order-keeping match of two trees."""
    known: dict[tuple[int, int], int] = {}

    def weight(x: int, y: int) -> int:
        if a.path[x] != b.path[y]:
            return 0
        if a.shape[x] == b.shape[y]:
            return a.size[x]
        if (x, y) not in known:
            known[x, y] = 1 + table(x, y)[-1][-1]
        return known[x, y]

    def table(x: int, y: int) -> list[list[int]]:
        rows = [[0] * (len(b.kids[y]) + 1)]
        for u in a.kids[x]:
            above, row = rows[-1], [0]
            for j, v in enumerate(b.kids[y]):
                row.append(max(row[j], above[j + 1], above[j] + weight(u, v)))
            rows.append(row)
        return rows

    pairs, todo = [], [(0, 0)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        if a.shape[x] == b.shape[y]:
            todo += zip(a.kids[x], b.kids[y])
            continue
        rows = table(x, y)
        i, j = len(a.kids[x]), len(b.kids[y])
        while i and j:
            w = weight(a.kids[x][i - 1], b.kids[y][j - 1])
            if w and rows[i][j] == rows[i - 1][j - 1] + w:
                todo.append((a.kids[x][i - 1], b.kids[y][j - 1]))
                i, j = i - 1, j - 1
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return pairs


def constant_texts(a: Tree, b: Tree) -> Iterator[tuple[int, int]]:
    """(path, text hash) of each different text that stands in a pair of matched nodes."""
    for x, y in matched(a, b):
        if a.texts[x] and b.texts[y]:
            for h in set(a.texts[x]) & set(b.texts[y]):
                yield a.path[x], h


# -- Spark ------------------------------------------------------------------------
def host_of(url):
    """The host of a URL in lower case; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _mapped(df: DataFrame, fn, schema: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, PAGES):
                yield fn(batch.slice(i, PAGES))
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


_SKELETON = {"host": pa.string(), "place": pa.int64(), "parent": pa.list_(pa.int32()), "path": pa.list_(pa.int64()),
             "texts": pa.list_(pa.list_(pa.int64()))}


def skeletons(pages: DataFrame) -> DataFrame:
    """(host, place, parent, path, texts): each page's slot tree; ``place`` hashes its texts."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {k: [] for k in _SKELETON}
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent, path, texts = Page(source or "").skeleton()
            for k, v in zip(_SKELETON, (host, _hash(1, repr((path, texts))), parent, path, texts)):
                out[k].append(v)
        return record(_SKELETON, out)
    return _mapped(pages.select(host_of(F.col("url")).alias("host"), "html"), run,
                   "host string, place long, parent array<int>, path array<long>, texts array<array<long>>")


def _votes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted skeletons to (host, path, text, n): pairs in which a text is constant; pairs as null text."""
    before: list[tuple[str, int, Tree]] = []
    for batch in batches:
        votes: Counter = Counter()
        for host, place, parent, path, texts in zip(*(c.to_pylist() for c in batch.columns)):
            if before and before[-1][0] != host:
                before = []
            if before and before[-1][1] == place:
                continue                       # a copy of the page before
            tree = Tree(parent, path, texts)
            for _, _, other in before:
                votes[host, None, None] += 1
                votes.update((host, p, h) for p, h in constant_texts(other, tree))
            before = [*before, (host, place, tree)][-PARTNERS:]
        yield record({"host": pa.string(), "path": pa.int64(), "text": pa.int64(), "n": pa.int64()},
                     {"host": [k[0] for k in votes], "path": [k[1] for k in votes], "text": [k[2] for k in votes],
                      "n": list(votes.values())})


def learn(pages: DataFrame, least_pairs: int = LEAST_PAIRS, constant: float = CONSTANT) -> DataFrame:
    """(host, pairs, template): the wrapper of each host of ``pages(url, html)`` that has one.

    ``template`` lists (path, text hash) of the texts that are the same in at
    least ``constant`` of the host's aligned pairs: a text of half of the pages
    is so in a quarter of the pairs. A host needs ``least_pairs`` pairs. Pages
    are dealt by ranges of (host, hash of the page), so that a host of any
    size is spread; pages with equal texts count once.
    """
    # what a page ships is its tree of slots and hashes, not its text
    trees = stored(skeletons(pages), "trees")
    parts = int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    votes = (trees.repartitionByRange(parts, "host", "place").sortWithinPartitions("host", "place")
             .mapInArrow(_votes, "host string, path long, text long, n long")
             .groupBy("host", "path", "text").agg(F.sum("n").alias("n")))
    votes = stored(votes, "votes")
    pairs = votes.where("path is null").select("host", F.col("n").alias("pairs")).where(F.col("pairs") >= least_pairs)
    return (votes.where("path is not null").join(pairs, "host").where(F.col("n") >= constant * F.col("pairs"))
            .groupBy("host", "pairs").agg(F.sort_array(F.collect_list(F.struct("path", "text"))).alias("template")))


def extract(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(page_id, url, host, text): the main text of every row of ``pages(page_id, url, html)``.

    Blocks in page order joined by one line feed, white space inside a block
    as one space, character references decoded. Null and empty pages, and
    pages without such a block, have an empty text. Pages without a URL share
    the empty host. Rows that repeat stay. Other columns are not read.
    """
    wrappers = stored(wrappers, "wrappers")
    wrappers = small_side(wrappers.select("host", "template"), wrappers.select(F.sum(F.size("template"))).first()[0] or 0,
                          BROADCAST_ROWS // 8)
    types = {"page_id": pa.int64(), "url": pa.string(), "host": pa.string(), "text": pa.string()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[str, set] = {}
        out = []
        for host, source, template in zip(*(batch.column(k).to_pylist() for k in ("host", "html", "template"))):
            if host not in known:
                known[host] = {(t["path"], t["text"]) for t in template or ()}
            out.append(Page(source or "").content(known[host]))
        return record(types, {"page_id": batch.column("page_id"), "url": batch.column("url"), "host": batch.column("host"),
                              "text": out})
    joined = (pages.select(F.col("page_id").cast("long"), "url", "html", host_of(F.col("url")).alias("host"))
              .join(wrappers, "host", "left"))
    return _mapped(joined, run, "page_id long, url string, host string, text string")


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): wrappers learnt from all ``pages``, then every page's main text.

    See :func:`extract`; ``n_chars`` counts code points. An empty table gives
    an empty result.
    """
    out = extract(pages, learn(pages))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
