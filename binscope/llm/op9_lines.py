"""Operator 9: fuzzy line dedup by MinHash.

Distinct lines are represented by the minima of a one-permutation hash of their
character shingles; bands of them bring similar lines together; lines
that collide are verified by exact Jaccard similarity of the shingle sets,
first against a leader, then the lines of a key that are still in different
components against each other in blocks; a distributed union-find forms the
classes, and one line of each stays in the corpus.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binscope.llm.common import (ASCII_SPACE, Forest, components, free_names, key_runs, map_slices, quoted, record, small_side,
                                 stored)

SEED = 42
#: characters of a shingle and the least similarity
SHINGLE, SIMILARITY = 7, 0.8
#: bands x rows minima: 0.99 of the pairs at similarity 0.8 collide, 0.9998 at 0.85
BANDS, BAND_ROWS = 12, 5
#: one-permutation hashes, each of BANDS * BAND_ROWS / HALVES bins; one is enough (recall 0.99 from 50 characters on)
HALVES = 1
#: fixed values: odd multipliers of the hash functions
_STEP = 0x01000193
_MULTIPLIERS = (0x7FEB352D, 0x846CA68B)
_WIDE = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)
#: code points hashed at a time: the arrays stay in the processor's cache
PIECE = 1 << 15
#: most rounds against leaders before the lines left are compared in blocks
ROUNDS = 3
#: lines outside a key's largest component that a block holds, and lines compared with them in one group
BLOCK, PROBES = 2048, 16384
#: bits of a line's shingle map, and lines whose maps are compared with a block's at a time
MAP_BITS, MAPS = 4096, 8
#: lines whose shingles a worker keeps
SETS = 256
#: lines of the groups that are compared together, and pairs of maps compared at a time
SMALL, PAIRS = 1024, 1 << 14
#: leader rounds end once the blocks need at most so many rows for each line of an open key
ENOUGH = 4


def line_id(line: str) -> int:
    """The hash Spark's ``xxhash64`` gives the trimmed line."""
    x = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), SEED)
    return x - (1 << 64) if x >> 63 else x


def _shingle_hashes(points: np.ndarray, shingle: int) -> np.ndarray:
    """32-bit polynomial hash of each run of ``shingle`` code points, by doubling."""
    out, length, at = None, 0, 0
    power, width, step = points, 1, _STEP
    left = shingle
    while left:
        if left & 1:
            n = len(points) - shingle + 1
            part = power[at:at + n]
            out = part.copy() if out is None else out * np.uint32(pow(_STEP, width, 1 << 32)) + part
            at, length = at + width, length + width
        left >>= 1
        if left:
            power = power[:-width] * np.uint32(step) + power[width:]
            width, step = 2 * width, step * step % (1 << 32)
    return out


def _mixed(h: np.ndarray, multiplier: int) -> np.ndarray:
    h = h ^ (h >> np.uint32(16))
    h *= np.uint32(multiplier)
    h ^= h >> np.uint32(15)
    h *= np.uint32(_MULTIPLIERS[1])
    h ^= h >> np.uint32(16)
    return h


def band_keys(lines: list[str], shingle: int = SHINGLE, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """(lines, bands) keys; every line needs at least ``shingle`` characters."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    owner = np.repeat(np.arange(len(lines), dtype=np.int32), size)
    bins = bands * rows // HALVES
    none = np.uint32(0xFFFFFFFF)
    low = [np.full(len(lines) * bins, none, np.uint32) for _ in range(HALVES)]
    for i in range(0, len(points) - shingle + 1, PIECE):
        piece = points[i:i + PIECE + shingle - 1]
        own = owner[i:i + PIECE + shingle - 1]
        inside = own[:len(own) - shingle + 1] == own[shingle - 1:]
        h = _shingle_hashes(piece, shingle)[inside]
        own = own[:len(inside)][inside] * np.int64(bins)
        for half in range(HALVES):
            v = _mixed(h + np.uint32(half), _MULTIPLIERS[half])
            np.minimum.at(low[half], own + (((v >> np.uint32(16)) * np.uint32(bins)) >> np.uint32(16)), v)
    sig = np.concatenate([_filled(x.reshape(len(lines), bins), none) for x in low], 1)
    sig = sig.reshape(len(lines), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * np.uint64(_WIDE[0]), sig.shape[:2]).copy()
    for r in range(rows):
        key ^= sig[:, :, r]
        key *= np.uint64(_WIDE[0])
        key ^= key >> np.uint64(29)
        key *= np.uint64(_WIDE[1])
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _filled(low: np.ndarray, none: np.uint32) -> np.ndarray:
    """Give each empty bin the value of a fixed pseudo-random full one (densification)."""
    given = low.copy()
    rng = np.random.default_rng(SEED)
    rows = np.flatnonzero((low == none).any(1))
    while len(rows):
        other = rng.integers(0, low.shape[1], low.shape[1])
        part = np.where(given[rows] == none, low[rows][:, other], given[rows])
        given[rows] = part
        rows = rows[(part == none).any(1)]
    return given


def trimmed(line: F.Column) -> F.Column:
    """The line without ASCII white space at its ends; only lines that have some there are trimmed."""
    ends = [line.startswith(c) | line.endswith(c) for c in ASCII_SPACE]
    return F.when(functools.reduce(lambda a, b: a | b, ends), F.trim(line, F.lit(ASCII_SPACE))).otherwise(line)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ``name``: 0, or a number of its own for each row without an id.

    Rows that repeat an id are one document listed twice; rows without an id
    are different documents. Those are written first, which fixes the numbers.
    """
    known = docs.where(F.col("doc_id").isNotNull()).withColumn(name, F.lit(0).cast("long"))
    none = docs.where(F.col("doc_id").isNull())
    if none.isEmpty():
        return known
    return known.unionByName(stored(none.withColumn(name, F.monotonically_increasing_id() + 1), "line-documents"))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text_hash, pos, lid) of every line that is not blank; ``lid`` hashes the trimmed line."""
    # the text is hashed before it is split: once, not for each of its lines
    hashed = docs.select("doc_id", "row", F.xxhash64("text").alias("text_hash"), "text")
    return (hashed.select("doc_id", "row", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
            .select("doc_id", "row", "text_hash", "pos", trimmed(F.col("line")).alias("line")).where("line <> ''")
            .select("doc_id", "row", "text_hash", "pos", F.xxhash64("line").alias("lid")))


def banded(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """(key, lid) of every line of at least ``shingle`` characters, repeats within a batch once."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lines: dict[str, None] = {}
        for text in b.column(0).to_pylist():
            for line in (text or "").split("\n"):
                line = line.strip(ASCII_SPACE)
                if len(line) >= shingle:
                    lines[line] = None
        found = list(lines)
        keys = band_keys(found, shingle, bands, rows) if found else np.empty((0, bands), np.int64)
        return record({"key": pa.int64(), "lid": pa.int64()},
                      {"key": keys.ravel(), "lid": np.repeat([line_id(x) for x in found], bands).astype(np.int64)})
    return map_slices(docs.select("text"), run, "key long, lid long")


def _shared(batches):
    """Stream sorted by key to the rows of keys with two different lines or more; a row may come more than once."""
    open_key, first, many = None, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        key, lid = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "lid"))
        if key[0] == open_key and not many:
            # the line that the open key has shown so far
            key, lid = np.r_[open_key, key], np.r_[first, lid]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        other = lid != np.repeat(lid[starts], sizes)
        more = np.logical_or.reduceat(other, starts)
        more[0] |= key[0] == open_key and many
        open_key, first, many = key[-1], lid[starts[-1]], bool(more[-1])
        other[starts] = True
        keep = more.repeat(sizes) & other
        yield record({"key": pa.int64(), "lid": pa.int64()}, {"key": key[keep], "lid": lid[keep]})


def shingles(line: str, shingle: int = SHINGLE) -> set[str]:
    """The shingle set; a shorter line is its own only shingle."""
    return {line[i:i + shingle] for i in range(max(1, len(line) - shingle + 1))}


def _alike(x: str, y: str, nx: int, ny: int, shingle: int, similarity: float) -> bool:
    """Exact Jaccard similarity of two lines with ``nx`` and ``ny`` different shingles.

    Lines that differ in one place need no sets: the shingles outside it are
    shared, and all others can be counted against them.
    """
    lo, hi = 0, min(len(x), len(y))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if x[lo:mid] == y[lo:mid] else (lo, mid - 1)
    front, lo, hi = lo, 0, min(len(x), len(y)) - lo
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if x[len(x) - mid:len(x) - lo] == y[len(y) - mid:len(y) - lo] else (lo, mid - 1)
    shared = max(0, front - shingle + 1) + max(0, lo - shingle + 1)
    least = min(nx - (len(x) - shingle + 1 - shared), ny - (len(y) - shingle + 1 - shared))
    if least > 0 and least >= similarity * (nx + ny - least):
        return True
    a, b = _kept_numbers(x, shingle), _kept_numbers(y, shingle)
    if a is None or b is None:
        both = len(shingles(x, shingle) & shingles(y, shingle))
    else:
        every = np.sort(np.concatenate([a, b]))
        both = int((every[1:] == every[:-1]).sum())
    return both >= similarity * (nx + ny - both)


def shingle_numbers(points: np.ndarray, shingle: int) -> np.ndarray | None:
    """Each run of ``shingle`` code points as one number; None if they are too great to fit."""
    bits = 63 // shingle
    if len(points) < shingle or not bits or int(points.max()) >> bits:
        return None
    wide, n = points.astype(np.uint64), len(points) - shingle + 1
    out = wide[:n].copy()
    for k in range(1, shingle):
        out = (out << np.uint64(bits)) | wide[k:n + k]
    return out


@functools.lru_cache(SETS)
def _kept_numbers(line: str, shingle: int) -> np.ndarray | None:
    """The different shingle numbers of a line that is likely to be compared again soon."""
    found = shingle_numbers(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32), shingle)
    return None if found is None else np.unique(found)


def _words(maps: pa.Array) -> np.ndarray:
    """(lines, words) of binary shingle maps."""
    return np.frombuffer(b"".join(maps.to_pylist()), np.uint64).reshape(len(maps), MAP_BITS // 64)


def _most_common(and_bits: np.ndarray, size: np.ndarray, bits: np.ndarray, other_size: np.ndarray, other_bits: np.ndarray) -> np.ndarray:
    """A bound on shared shingles: shared bits, and shingles that fall on bits taken already."""
    return and_bits + np.minimum(size - bits, other_size - other_bits)


def _sizes(lines: list[str], points: np.ndarray, shingle: int) -> list[int]:
    """The number of different shingles of each line; ``points`` are all their code points."""
    stops = np.cumsum([len(x) for x in lines]).tolist()
    numbers, out = shingle_numbers(points, shingle), []
    for line, stop in zip(lines, stops):
        if numbers is None:
            out.append(len(shingles(line, shingle)))
            continue
        own = np.sort(numbers[stop - len(line):stop - shingle + 1])
        out.append(1 + int((own[1:] != own[:-1]).sum()))
    return out


def line_maps(lines: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(lid, line, size, map) of ``lines(lid, line)``: its number of different shingles and their map of bits.

    A line has at least ``shingle`` characters.
    """
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = b.column(1).to_pylist()
        points = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(found), dtype=np.int64), list(map(len, found)))
        bits = np.zeros(len(found) * MAP_BITS, np.uint8)
        if len(points) >= shingle:
            last = len(points) - shingle + 1
            inside = owner[:last] == owner[shingle - 1:]
            h = _mixed(_shingle_hashes(points, shingle)[inside], _MULTIPLIERS[0])
            bits[owner[:last][inside] * MAP_BITS + h % np.uint32(MAP_BITS)] = 1
        maps = np.packbits(bits.reshape(len(found), MAP_BITS), axis=1)
        return record({"lid": pa.int64(), "line": pa.string(), "size": pa.int32(), "map": pa.binary()},
                      {"lid": b.column(0), "line": b.column(1), "size": _sizes(found, points, shingle),
                       "map": [m.tobytes() for m in maps]})
    return map_slices(lines.select("lid", "line"), run, "lid long, line string, size int, map binary")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b, near) for distinct ``pairs(a, b)`` of line ids, by exact Jaccard similarity.

    The maps rule most unlike pairs out before their lines are compared.
    """
    side = lambda k, n: texts.select(F.col("lid").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("line", "size", "map")])
    joined = pairs.join(side("b", 1), "b").join(side("a", 0), "a").select(
        "a", "b", "line_a", "line_b", "size_a", "size_b", "map_a", "map_b")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        nx, ny = (b.column(c).to_numpy().astype(np.int64) for c in ("size_a", "size_b"))
        x, y = _words(b.column("map_a")), _words(b.column("map_b"))
        count = lambda m: np.bitwise_count(m).sum(1, dtype=np.int64)
        most = _most_common(count(x & y), nx, count(x), ny, count(y))
        near = most >= similarity * (nx + ny - most)
        for i in np.flatnonzero(near):
            near[i] = _alike(b.column("line_a")[i].as_py(), b.column("line_b")[i].as_py(), int(nx[i]), int(ny[i]), shingle, similarity)
        return record({"a": pa.int64(), "b": pa.int64(), "near": pa.bool_()},
                      {"a": b.column(0), "b": b.column(1), "near": near})
    return map_slices(joined, run, "a long, b long, near boolean")


def _blocks(open_keys: DataFrame, block: int, probes: int) -> DataFrame:
    """(key, block, part, held, lid, root): the comparisons that are left, as groups of bounded size.

    Lines of a key's largest component need no comparison with each other. The
    others are dealt into blocks; a group holds the lines of one block and a
    part of the lines to compare with them: the largest component and the
    lines of later blocks.
    """
    of_root = open_keys.groupBy("key", "root").agg(F.count("*").alias("n"))
    sizes = (of_root.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main"))
             .select("key", F.col("main.root").alias("main"),
                     F.ceil((F.col("n") - F.col("main.n")) / block).cast("int").alias("blocks"),
                     F.ceil(F.col("n") / probes).cast("int").alias("parts")))
    placed = (open_keys.join(sizes, "key").withColumn("major", F.col("root") == F.col("main"))
              .withColumn("own", F.when(F.col("major"), F.col("blocks")).otherwise(F.pmod(F.xxhash64("lid", "key"), "blocks")).cast("int"))
              .withColumn("at", F.pmod(F.xxhash64("key", "lid"), "parts").cast("int")))
    held = (placed.where("not major").select("key", F.col("own").alias("block"),
                                             F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                                             F.lit(True).alias("held"), "lid", "root"))
    probing = (placed.where("own > 0").select("key", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("block"),
                                              F.col("at").alias("part"), F.lit(False).alias("held"), "lid", "root"))
    return held.unionByName(probing)


class _Block:
    """The held lines of one large group, compared with lines as they come."""

    def __init__(self, shingle: int, similarity: float):
        self.shingle, self.similarity, self.rows = shingle, similarity, None

    def add(self, rows: "_Lines", forest: Forest, out: list) -> None:
        """Compare ``rows`` of the group with those held before each, and hold them if they are to be held."""
        if rows.held[0] and not rows.held[-1]:
            cut = int(np.flatnonzero(~rows.held)[0])
            self.add(rows.take(slice(0, cut)), forest, out)
            rows = rows.take(slice(cut, None))
        before = 0 if self.rows is None else len(self.rows.lid)
        if rows.held[0]:
            self.rows = rows if self.rows is None else self.rows.plus(rows)
        if self.rows is None or rows.held[0] and rows.part[0]:
            return          # the lines of a block are compared with each other in its first part only
        for i in range(0, len(rows.lid), MAPS):
            j = min(i + MAPS, len(rows.lid))
            shared = np.bitwise_count(rows.maps[i:j, None, :] & self.rows.maps[None]).sum(2, dtype=np.int64)
            most = _most_common(shared, rows.size[i:j, None], rows.bits[i:j, None], self.rows.size[None], self.rows.bits[None])
            some = most >= self.similarity * (rows.size[i:j, None] + self.rows.size[None] - most)
            for k, h in zip(*np.nonzero(some)):
                k = int(k) + i
                if not rows.held[0] or h < before + k:
                    _link(self.rows, int(h), rows, k, self.shingle, self.similarity, forest, out)


class _Lines:
    """Rows (held, part, lid, root, line, size, map) of a batch."""

    def __init__(self, held, part, lid, root, line, size, maps, bits):
        self.held, self.part, self.lid, self.root, self.line, self.size, self.maps, self.bits = held, part, lid, root, line, size, maps, bits

    @classmethod
    def of(cls, b: pa.RecordBatch) -> "_Lines":
        array = lambda c: b.column(c).to_numpy(zero_copy_only=False)
        maps = _words(b.column("map"))
        return cls(array("held").astype(bool), array("part"), array("lid"), array("root"), np.array(b.column("line").to_pylist(), object),
                   array("size").astype(np.int64), maps, np.bitwise_count(maps).sum(1, dtype=np.int64))

    def take(self, s) -> "_Lines":
        return _Lines(*(x[s] for x in vars(self).values()))

    def plus(self, other: "_Lines") -> "_Lines":
        return _Lines(*(np.concatenate([a, b]) for a, b in zip(vars(self).values(), vars(other).values())))


def _link(a: _Lines, i: int, b: _Lines, j: int, shingle: int, similarity: float, forest: Forest, out: list) -> None:
    """Join the components of two lines if they differ and the lines are alike."""
    top = lambda root: forest.find(root) if root in forest.parent else root
    x, y = int(a.root[i]), int(b.root[j])
    if top(x) != top(y) and _alike(a.line[i], b.line[j], int(a.size[i]), int(b.size[j]), shingle, similarity):
        forest.join(x, y)
        out.append((int(a.lid[i]), int(b.lid[j])))


def _small_groups(rows: _Lines, group: np.ndarray, shingle: int, similarity: float, forest: Forest, out: list) -> None:
    """Compare the rows of many whole groups, held ones first in each: all maps at once."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    held = np.add.reduceat(rows.held.astype(np.int64), starts).repeat(sizes)
    first = starts.repeat(sizes)
    # a probing line meets all held ones, a held one those before it, in a block's first part
    partners = np.where(~rows.held, held, np.where(rows.part == 0, np.arange(len(group)) - first, 0))
    upto = np.cumsum(partners)
    at = 0
    while at < len(group):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        n = partners[at:stop]
        j = np.repeat(np.arange(at, stop), n)
        i = first[j] + np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n)
        other = rows.root[i] != rows.root[j]
        i, j = i[other], j[other]
        shared = np.bitwise_count(rows.maps[i] & rows.maps[j]).sum(1, dtype=np.int64)
        most = _most_common(shared, rows.size[i], rows.bits[i], rows.size[j], rows.bits[j])
        some = most >= similarity * (rows.size[i] + rows.size[j] - most)
        for a, b in zip(i[some].tolist(), j[some].tolist()):
            _link(rows, a, rows, b, shingle, similarity, forest, out)
        at = stop


def _compared(shingle: int, similarity: float, small: int = SMALL):
    """Stream of groups, held lines first, to links (a, b) between different components.

    Memory: the held lines of one group. A link that joins nothing new is
    neither looked for nor given. A bit that only one of two maps has is a
    shingle the lines do not share: maps are compared many at a time, and only
    pairs they cannot rule out are compared exactly.
    """
    def run(batches):
        block, open_group = None, None
        for kind, batch in key_runs(batches, "group", small):
            rows, group, out = _Lines.of(batch), batch.column("group").to_numpy(zero_copy_only=False), []
            if kind == "whole":
                _small_groups(rows, group, shingle, similarity, Forest(), out)
            else:
                if open_group != group[0]:
                    block, open_group, forest = _Block(shingle, similarity), group[0], Forest()
                block.add(rows, forest, out)
            yield record({"a": pa.int64(), "b": pa.int64()}, {"a": [a for a, _ in out], "b": [b for _, b in out]})
    return run


def remaining_links(open_keys: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY,
                    block: int = BLOCK, probes: int = PROBES, small: int = SMALL) -> DataFrame:
    """(a, b): links that connect all similar lines of a key of ``open_keys(key, lid, root)``."""
    return (_blocks(open_keys, block, probes).join(texts, "lid")
            .select(F.xxhash64("key", "block", "part").alias("group"), "held", "part", "lid", "root", "line", "size", "map")
            .repartition("group").sortWithinPartitions("group", F.desc("held"))
            .mapInArrow(_compared(shingle, similarity, small), "a long, b long").distinct())


def line_components(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY,
                    rounds: int = ROUNDS, block: int = BLOCK, probes: int = PROBES, small: int = SMALL) -> DataFrame:
    """(node, root): components of different similar lines that share a band key.

    Every similar pair that shares a key is connected. Lines of a key are
    first compared with one leader, which costs as many pairs as it has lines;
    the leader follows a hash of the line and the round, so the keys of a
    group agree on it and repeat no pair. Keys whose lines are then not all
    connected stay open: if their comparisons are many, another leader is
    tried, up to ``rounds`` in all; the rest is compared in blocks.
    """
    # sorted by one long only, which Spark does by radix; the few rows that are left are made distinct
    keyed = stored(banded(docs, shingle).repartition("key").sortWithinPartitions("key")
                   .mapInArrow(_shared, "key long, lid long").distinct(), "line-keys")
    lids = stored(keyed.select("lid").distinct(), "line-ids")
    texts = stored(line_maps(
        docs.select(F.explode(F.split("text", "\n", -1)).alias("line")).select(trimmed(F.col("line")).alias("line"))
        .where("line <> ''").withColumn("lid", F.xxhash64("line"))
        .join(small_side(lids, lids.count()), "lid", "left_semi")
        .groupBy("lid").agg(F.first("line").alias("line")), shingle), "line-texts")
    open_keys, tried, near = keyed.withColumn("root", F.col("lid")), None, None
    for turn in range(rounds):
        rank = lambda c: F.xxhash64(F.col(c), F.lit(turn))  # noqa: B023, E731
        reps = open_keys.groupBy("key", "root").agg(F.min(F.struct(rank("lid").alias("rank"), "lid")).alias("rep"))
        leader = reps.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1")
        pairs = (reps.join(leader, "key").where(F.col("rep.lid") != F.col("leader.lid"))
                 .select(F.col("leader.lid").alias("a"), F.col("rep.lid").alias("b")).distinct())
        if tried is not None:
            known = tried.select("a", "b").unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        checked = stored(verified(pairs, texts, shingle, similarity), "line-pairs")
        tried = checked if tried is None else tried.unionByName(checked)
        near = tried.where("near").select("a", "b")
        if turn:
            roots = components(near).withColumnRenamed("node", "lid")
            now = keyed.join(roots, "lid", "left").select("key", "lid", F.coalesce("root", "lid").alias("root"))
        else:
            # a key's lines that are like its leader are one component; what other keys connect shows at the end
            led = keyed.join(leader.select("key", F.col("leader.lid").alias("a")), "key").withColumnRenamed("lid", "b")
            now = led.join(near.withColumn("like", F.lit(True)), ["a", "b"], "left").select(
                "key", F.col("b").alias("lid"), F.when(F.col("like"), F.col("a")).otherwise(F.col("b")).alias("root"))
        mixed = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        open_keys = stored(now.join(mixed.select("key"), "key"), "line-open")
        if turn + 1 < rounds:
            of_root = open_keys.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(
                F.sum("n").alias("n"), F.max("n").alias("main"))
            work = of_root.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.ceil((F.col("n") - F.col("main")) / block)).alias("rows")).first()
            if (work["rows"] or 0) <= ENOUGH * (work["n"] or 0):
                break
    rest = stored(remaining_links(open_keys, texts, shingle, similarity, block, probes, small), "line-rest")
    return stored(components(near.unionByName(rest)), "line-roots")


def removals(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, row, text_hash, removed): for each document of ``docs(doc_id, row, text)`` with superfluous
    lines, their places and the kept line's.

    The kept line of a class is the first by document id (nulls last), row,
    text hash and position.
    """
    occ = stored(occurrences(docs), "lines")
    roots = line_components(docs, shingle, similarity)
    # a line that stands once and is like no other needs no place
    again = stored(occ.groupBy("lid").agg(F.count("*").alias("n")).where("n > 1").select("lid")
                   .unionByName(roots.select(F.col("node").alias("lid"))).distinct(), "line-again")
    some = stored(occ.join(small_side(again, again.count()), "lid", "left_semi"), "line-places")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "text_hash", "pos")
    member = stored(some.groupBy("lid").agg(F.min(place).alias("first")).join(roots.withColumnRenamed("node", "lid"), "lid", "left")
                    .select("lid", "first", F.coalesce("root", "lid").alias("root")), "line-members")
    classes = member.groupBy("root").agg(F.min("first").alias("kept"))
    kept = stored(member.select("lid", "root").join(classes, "root").select("lid", "kept"), "line-classes")
    gone = some.join(kept, "lid").where(~place.eqNullSafe(F.col("kept")))
    return gone.groupBy("doc_id", "row", "text_hash").agg(F.sort_array(F.collect_set(F.struct(
        "pos", F.col("kept.doc_id").alias("kept_doc"), F.col("kept.pos").alias("kept_pos")))).alias("removed"))


def _without(text: F.Column, places: F.Column) -> F.Column:
    """The text without the lines at these sorted places: the stretches between them, joined.

    Lines and places are bound to a lambda variable, so that they are made
    once and each line is copied once.
    """
    def stretches(s: F.Column) -> F.Column:
        lines, gone = s["lines"], s["gone"]
        start = lambda i: F.coalesce(F.get(gone, i - 1) + 1, F.lit(0))
        stop = lambda i: F.coalesce(F.get(gone, i), F.size(lines))
        parts = F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(lines, start(i) + 1, stop(i) - start(i)))
        return F.array_join(F.flatten(parts), "\n")
    return F.transform(F.array(F.struct(F.split(text, "\n", -1).alias("lines"), places.alias("gone"))), stretches)[0]


def dedup_lines(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, removed: str = "removed") -> DataFrame:
    """All rows and columns of ``docs``, ``text`` without superfluous lines, and ``removed``.

    Blank lines stay; a null text stays null. Rows that repeat id and text are
    one document listed twice and lose the same lines; rows without an id are
    documents of their own. Lines shorter than a shingle are similar only to
    equal lines. Null ids come last in the choice of the kept line. An empty
    table gives an empty result. Other columns may have any name but
    ``removed``.
    """
    row, own_id, own_row, own_hash, gone = free_names(docs, "row", "id", "row_", "hash", "gone")
    docs_n = numbered(docs, row)
    found = (removals(docs_n.select("doc_id", F.col(row).alias("row"), "text"), shingle, similarity)
             .select(F.col("doc_id").alias(own_id), F.col("row").alias(own_row), F.col("text_hash").alias(own_hash),
                     F.col("removed").alias(gone)))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col(f"{gone}.pos")))
    out = docs_n.join(found, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(row) == F.col(own_row)) &
                      (F.xxhash64("text") == F.col(own_hash)), "left")
    return out.select(*[text.alias(c) if c == "text" else quoted(c) for c in docs.columns], F.col(gone).alias(removed))


def line_report(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed, text): one row per row; see :func:`dedup_lines`."""
    n = F.size(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = dedup_lines(docs.select("doc_id", "text", F.coalesce(n, F.lit(0)).cast("long").alias("n_lines")),
                      shingle, similarity)
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
                      "removed", "text")


def keep_lines(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the columns it has and deduplicated texts.

    A document all of whose lines are kept elsewhere is a copy and goes; null
    and blank texts without such lines stay. Columns may have any name; see
    :func:`dedup_lines` for the rest.
    """
    removed = free_names(docs, "removed")[0]
    out = dedup_lines(docs, shingle, similarity, removed)
    blank = F.trim(F.coalesce("text", F.lit("")), F.lit(ASCII_SPACE)) == ""
    return out.where(F.col(removed).isNull() | ~blank).select(*[quoted(c) for c in docs.columns])
