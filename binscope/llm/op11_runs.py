"""Operator 11: maximal periodic runs of words, and texts collapsed to one period.

The suffix trees of a word sequence and of its reversal are built with
Ukkonen's algorithm. An Euler tour of a tree, kept as the string depth where it
turns between two leaves, makes the longest common extension (LCE) of two
positions a range minimum, answered in constant time. The longest Lyndon word
at each position, under both orders of the alphabet, is the candidate root of
every run (the runs theorem); a root is extended to both sides by LCE.

Trees are only built where runs can be. A run of at least ``max(24, 3 q)``
words with period q holds at least 16 consecutive 9-word windows, each of which
occurs again in the run. Pieces of a text without 16 such windows in a row
cannot hold a run, and the test is repeated inside the pieces that remain. It
only uses equality of hashes, so collisions can keep a piece but lose none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binscope.llm.common import record
from binscope.session import ship_package

#: a run has at least this many words, and this many periods
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: words of a window: each window of a run occurs in it again
WINDOW = 9
#: words handled at a time (a longer document is handled alone)
CHUNK_WORDS = 1 << 18
#: fixed value: odd multiplier of the window hash
_STEP = np.uint64(0x9E3779B97F4A7C15)

Words = list[bytes]


# -- suffix tree ------------------------------------------------------------
class SuffixTree:
    """Suffix tree of ``s`` (integers under ``size``; the last one occurs once)."""

    def __init__(self, s: list[int], size: int):
        n = len(s)
        start, stop, link = [0], [0], [0]
        edge: dict[int, int] = {}            # node * size + first symbol -> child
        suffix = [-1]                        # of a leaf: where its suffix starts
        node = at = length = left = leaves = 0
        for i, c in enumerate(s):
            left += 1
            open_node = 0
            while left:
                if not length:
                    at = i
                key = node * size + s[at]
                child = edge.get(key)
                if child is None:
                    edge[key] = len(start)
                    start.append(i), stop.append(n), link.append(0), suffix.append(leaves)
                    leaves += 1
                    if open_node:
                        link[open_node] = node
                        open_node = 0
                else:
                    span = min(stop[child], i + 1) - start[child]
                    if length >= span:
                        at, length, node = at + span, length - span, child
                        continue
                    if s[start[child] + length] == c:
                        length += 1
                        if open_node:
                            link[open_node] = node
                        break
                    inner = len(start)
                    edge[key] = inner
                    start.append(start[child]), stop.append(start[child] + length), link.append(0), suffix.append(-1)
                    edge[inner * size + c] = inner + 1
                    start.append(i), stop.append(n), link.append(0), suffix.append(leaves)
                    leaves += 1
                    start[child] += length
                    edge[inner * size + s[start[child]]] = child
                    if open_node:
                        link[open_node] = inner
                    open_node = inner
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length, at = length - 1, i - left + 1
        self.n, self.size = n, size
        self.start, self.stop, self.suffix, self.edge = start, stop, suffix, edge

    def tour(self, falling: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in the order of the leaves, and the depth where the tour turns before each.

        Children go by symbol, or by falling symbol; the last symbol of the
        text (the greatest) always comes first, so a prefix precedes what it
        begins.
        """
        keys = np.fromiter(self.edge.keys(), np.int64, len(self.edge))
        kids = np.fromiter(self.edge.values(), np.int64, len(self.edge))
        parent, symbol = keys // self.size, keys % self.size
        place = np.where(symbol == self.size - 1, -self.size, -symbol if falling else symbol)
        # the stack gives the last child first
        order = np.lexsort((-place, parent))
        kids, parent = kids[order].tolist(), parent[order]
        first = np.searchsorted(parent, np.arange(len(self.start) + 1)).tolist()
        start, stop, suffix = self.start, self.stop, self.suffix
        leaves, turns, turn = [], [], 0
        stack = [(0, 0, 0)]
        while stack:
            node, above, turned = stack.pop()
            if turned:
                turn = above
            if suffix[node] >= 0:
                leaves.append(suffix[node])
                turns.append(turn)
                continue
            deep = above + stop[node] - start[node]
            a, b = first[node], first[node + 1]
            for kid in kids[a:b - 1]:
                stack.append((kid, deep, 1))
            if b > a:
                stack.append((kids[b - 1], deep, 0))
        return np.array(leaves, np.int32), np.array(turns, np.int32)


class Extension:
    """Longest common extension of two positions: the depth of the lowest common ancestor of two leaves."""

    def __init__(self, leaves: np.ndarray, turns: np.ndarray):
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        self.low = [turns]
        step = 1
        while 2 * step <= len(turns):
            self.low.append(np.minimum(self.low[-1][:-step], self.low[-1][step:]))
            step *= 2
        self.levels = np.zeros(len(turns) + 1, np.int64)
        for k in range(1, len(self.low)):
            self.levels[1 << k:] = k

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For different positions ``a`` and ``b``."""
        ra, rb = self.rank[a], self.rank[b]
        lo, hi = np.minimum(ra, rb) + 1, np.maximum(ra, rb) + 1
        level = self.levels[hi - lo]
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.low[k]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(k))])
        return out


def _next_smaller(rank: list[int]) -> np.ndarray:
    """For each position the next one of smaller rank, or the length."""
    n = len(rank)
    out, stack = [n] * n, []
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while stack and rank[stack[-1]] > r:
            stack.pop()
        if stack:
            out[i] = stack[-1]
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(s: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """(start, length, period) rows of every maximal run of the integer sequence ``s``, sorted."""
    n = len(s)
    if n < max(least, periods):
        return np.empty((0, 3), np.int64)
    symbols, s = np.unique(s, return_inverse=True)
    size = len(symbols) + 1
    ahead = SuffixTree([*s.tolist(), size - 1], size)
    up, up_turns = ahead.tour()
    forward = Extension(up, up_turns)
    backward = Extension(*SuffixTree([*s[::-1].tolist(), size - 1], size).tour())
    found = []
    for leaves in (up, ahead.tour(falling=True)[0]):
        rank = np.empty(n + 1, np.int64)
        rank[leaves] = np.arange(n + 1)
        after = _next_smaller(rank[:n].tolist())
        i = np.arange(n)
        p = after - i
        keep = (p * periods <= n) & (after < n)
        i, p = i[keep], p[keep]
        right = forward(i, i + p)
        left = np.zeros(len(i), np.int64)
        inner = i > 0
        # position x of the text is n - 1 - x of the reversal
        left[inner] = backward(n - i[inner], n - i[inner] - p[inner])
        length = left + p + right
        ok = length >= np.maximum(least, periods * p)
        found.append(np.stack([i[ok] - left[ok], length[ok], p[ok]], 1))
    rows = np.concatenate(found)
    if not len(rows):
        return rows
    rows = np.unique(rows[:, [0, 2, 1]], axis=0)
    return rows[:, [0, 2, 1]]


# -- where runs can be ------------------------------------------------------
def _windows(ids: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Hash of the ``WINDOW`` ids from each position on and their piece."""
    one = (ids.astype(np.uint64) + np.uint64(1)) * _STEP
    one ^= one >> np.uint64(29)
    h, width, power = one, 1, _STEP
    while 2 * width <= WINDOW:
        h = h[:-width] * power + h[width:]
        width, power = 2 * width, np.uint64(int(power) ** 2 % (1 << 64))
    while width < WINDOW:
        h = h[:-1] * _STEP + one[width:]
        width += 1
    h = (h ^ (piece[:len(h)].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))) * _STEP
    return h ^ (h >> np.uint64(32))


def likely_pieces(ids: np.ndarray, piece: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """(start, stop) of the stretches of ``ids``, inside one ``piece`` each, that can hold a run."""
    least_windows = least - WINDOW + 1
    at = np.arange(len(ids))
    while len(ids) >= least:
        h = _windows(ids, piece)
        table = 1 << max(10, int(4 * len(h)).bit_length())
        slot = (h & np.uint64(table - 1)).astype(np.int64)
        again = (np.bincount(slot, minlength=table)[slot] > 1) & (piece[:len(h)] == piece[WINDOW - 1:])
        # stretches of windows that occur again, one position after the other
        edges = np.flatnonzero(np.r_[True, (again[1:] != again[:-1]) | (piece[1:len(h)] != piece[:len(h) - 1]), True])
        a, b = edges[:-1], edges[1:]
        good = again[a] & (b - a >= least_windows)
        a, b = a[good], b[good] + WINDOW - 1
        total = int((b - a).sum())
        pieces = [(int(at[x]), int(at[y - 1]) + 1) for x, y in zip(a, b)]
        if total >= len(ids) or not total:
            return pieces
        take = np.concatenate([np.arange(x, y) for x, y in zip(a, b)])
        piece = np.repeat(np.arange(len(a)), b - a)
        ids, at = ids[take], at[take]
    return []


# -- texts --------------------------------------------------------------------
def _collapsed(words: Words, rows: np.ndarray) -> Words:
    """The words outside every run's part after its first period."""
    if not len(rows):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 0] + rows[:, 1], -1)
    return [w for w, gone in zip(words, np.cumsum(change)) if not gone]


def text_runs(texts: list[Words], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[np.ndarray]:
    """The runs of each word sequence, as :func:`runs_of` gives them."""
    number: dict[bytes, int] = {}
    size = [len(t) for t in texts]
    ids = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, sum(size))
    owner = np.repeat(np.arange(len(texts)), size)
    base = np.r_[0, np.cumsum(size)]
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for a, b in likely_pieces(ids, owner, least):
        rows = runs_of(ids[a:b], least, periods)
        if len(rows):
            k = int(owner[a])
            out[k].append(rows + np.array([a - base[k], 0, 0]))
    none = np.empty((0, 3), np.int64)
    return [np.unique(np.concatenate(x)[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]] if x else none for x in out]


_TYPES = {"doc_id": pa.int64(),
          "runs": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])),
          "best": pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]),
          "collapsed": pa.binary()}
SCHEMA = ("doc_id long, runs array<struct<start: long, length: long, period: long>>, "
          "best struct<start: long, length: long, period: long>, collapsed binary")


def _rows(ids: list, texts: list[Words], least: int, periods: int) -> pa.RecordBatch:
    found = text_runs(texts, least, periods)
    as_dict = lambda r: {"start": int(r[0]), "length": int(r[1]), "period": int(r[2])}
    best = [as_dict(min(rows, key=lambda r: (-Fraction(int(r[1]), int(r[2])), r[0], r[2]))) if len(rows) else None
            for rows in found]
    return record(_TYPES, {"doc_id": ids, "runs": [[as_dict(r) for r in rows] for rows in found], "best": best,
                           "collapsed": [b" ".join(_collapsed(t, rows)) for t, rows in zip(texts, found)]})


def periodic_runs(docs: DataFrame, prepare: Callable[[int | None, Words], Words] | None = None,
                  least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """(doc_id, runs, best, collapsed) for every row of ``docs(doc_id, text)``.

    A word is a run of characters other than space and U+0009 to U+000D. A run
    is a stretch of ``max(least, periods * q)`` words or more with smallest
    period q that no neighbouring word extends; ``runs`` is sorted by start,
    then period. ``best`` has the greatest length / period, then the smallest
    start, then period, and is null without runs. ``collapsed`` joins by one
    space the words that no run contains after its first period.
    ``prepare(doc_id, words)`` may change a document's words first.

    A null or empty text has no words: no runs, empty ``collapsed``. Rows that
    repeat stay, one result each; null ids stay null; other columns are not
    read. An empty table gives an empty result. Documents are handled in
    groups of about ``CHUNK_WORDS`` words, a longer one alone: memory follows
    the longest document.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, words = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = t.as_buffer().to_pybytes().split() if t.is_valid else []
                if prepare is not None:
                    w = prepare(i, w)
                if texts and words + len(w) > CHUNK_WORDS:
                    yield _rows(ids, texts, least, periods)
                    ids, texts, words = [], [], 0
                ids.append(i)
                texts.append(w)
                words += len(w)
            if texts:
                yield _rows(ids, texts, least, periods)
    ship_package(docs.sparkSession)
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, SCHEMA)
            .withColumn("collapsed", F.col("collapsed").cast("string")))
