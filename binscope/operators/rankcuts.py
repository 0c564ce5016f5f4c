"""Exact values at given ranks of many columns, whatever the partitioning.

The rank's value is narrowed down by ranges: a range that holds a wanted rank
is cut at approximate quantiles, the rows of the pieces are counted exactly,
and only pieces that still hold several values and a wanted rank are cut again.
When these have few rows, their values are counted and the running count names
the value. All columns share each pass; a pass hands on counts of pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binscope.functions.exprs import as_double, qcol
from binscope.session import ship_package

#: rows of a range whose values are counted one by one
RANGE_ROWS = 1_000_000
#: pieces that a range is cut into, and accuracy of the quantiles it is cut at
PIECES, ACCURACY = 64, 2_000


@dataclass
class Range:
    """Values lo..hi of a column: ``before`` rows are smaller, ``n`` are inside."""
    lo: float
    hi: float
    before: int
    n: int
    ranks: list[int]


def _inside(edges: Sequence[np.ndarray], tops: Sequence[np.ndarray]):
    """For a batch of columns the piece of each value, -1 outside all."""
    def pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for c in range(len(edges)):
            if not len(edges[c]):
                continue
            x = batch.column(c).drop_null().to_numpy(zero_copy_only=False)
            k = np.searchsorted(edges[c], x, "right") - 1
            k[(k >= 0) & (x > tops[c][k])] = -1
            yield c, x[k >= 0], k[k >= 0]
    return pieces


def _counted(edges: Sequence[np.ndarray], tops: Sequence[np.ndarray]):
    """Batches to (c, k, n, lo, hi) of the pieces of column c, once a task."""
    pieces = _inside(edges, tops)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(e), np.int64) for e in edges]
        lo, hi = ([np.full(len(e), v) for e in edges] for v in (np.inf, -np.inf))
        for batch in batches:
            for c, x, k in pieces(batch):
                n[c] += np.bincount(k, minlength=len(n[c]))
                np.minimum.at(lo[c], k, x)
                np.maximum.at(hi[c], k, x)
        for c in range(len(edges)):
            k = np.flatnonzero(n[c])
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), c)), pa.array(k), pa.array(n[c][k]), pa.array(lo[c][k]),
                                                  pa.array(hi[c][k])], names=["c", "k", "n", "lo", "hi"])
    return run


def _valued(edges: Sequence[np.ndarray], tops: Sequence[np.ndarray]):
    """Batches to (c, k, x) of the values inside the pieces."""
    pieces = _inside(edges, tops)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, x, k in pieces(batch):
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c)), pa.array(k), pa.array(x)], names=["c", "k", "x"])
    return run


def rank_values(df: DataFrame, columns: Sequence[str], shares: Sequence[float], range_rows: int = RANGE_ROWS,
                pieces: int = PIECES) -> dict[str, list[float]]:
    """For each numeric view of ``columns`` the values at ranks ceil(share x n) of its n values (nulls left out).

    This is the discrete quantile. A column without values gives an empty
    list. The number of values returned is that of ``shares``: what reaches
    the driver beside them is a row for each piece of a range.
    """
    ship_package(df.sparkSession)
    types = {f.name: f.dataType for f in df.schema.fields}
    # -0.0 counts as 0.0
    wide = df.select(*[(as_double(qcol(c), types[c]) + F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(columns)])
    first = wide.agg(*[F.struct(F.count(x), F.min(x), F.max(x)).alias(x) for x in wide.columns]).first()
    found: list[dict[int, float]] = [{} for _ in columns]
    wanted, open_ = [], []
    for i, x in enumerate(wide.columns):
        n, lo, hi = first[x]
        wanted.append([max(1, math.ceil(p * n)) for p in shares] if n else [])
        open_.append(_settled([Range(lo, hi, 0, n, sorted(set(wanted[i])))] if n else [], found[i]))
    while any(open_):
        if max(r.n for rs in open_ for r in rs) <= range_rows:
            _list_values(wide, open_, found)
            break
        open_ = _cut(wide, open_, found, pieces)
    return {c: [found[i][r] for r in wanted[i]] for i, c in enumerate(columns)}


def _settled(ranges: list[Range], found: dict[int, float]) -> list[Range]:
    """Ranges of several values; the ranks in the others are found."""
    for r in ranges:
        if r.lo == r.hi:
            found.update(dict.fromkeys(r.ranks, r.lo))
    return [r for r in ranges if r.lo < r.hi and r.ranks]


def _edges(ranges: list[list[Range]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [np.array([r.lo for r in rs]) for rs in ranges], [np.array([r.hi for r in rs]) for rs in ranges]


def _cut(wide: DataFrame, open_: list[list[Range]], found: list[dict[int, float]], pieces: int) -> list[list[Range]]:
    """Cut every open range at quantiles of its own and keep the pieces that hold a wanted rank."""
    rows = wide.mapInArrow(_valued(*_edges(open_)), "c long, k long, x double")
    shares = [i / pieces for i in range(1, pieces)]
    cuts = {(r.c, r.k): r.q for r in rows.groupBy("c", "k").agg(F.percentile_approx("x", shares, ACCURACY).alias("q")).collect()}
    edges, tops, owner = [], [], []
    for c, ranges in enumerate(open_):
        own = []
        for k, r in enumerate(ranges):
            # the greatest value alone is a piece: every cut makes progress
            own += [(x, r.hi, k) for x in sorted({r.lo, *cuts.get((c, k), []), r.hi})]
        edges.append(np.array([x for x, _, _ in own]))
        tops.append(np.array([x for _, x, _ in own]))
        owner.append([k for *_, k in own])
    counts = (wide.mapInArrow(_counted(edges, tops), "c long, k long, n long, lo double, hi double")
              .groupBy("c", "k").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect())
    out: list[list[Range]] = [[] for _ in open_]
    before: dict[tuple[int, int], int] = {}
    for row in sorted(counts, key=lambda r: (r.c, r.k)):
        parent = open_[row.c][owner[row.c][row.k]]
        at = before.setdefault((row.c, owner[row.c][row.k]), parent.before)
        out[row.c].append(Range(row.lo, row.hi, at, row.n, [x for x in parent.ranks if at < x <= at + row.n]))
        before[row.c, owner[row.c][row.k]] = at + row.n
    return [_settled(rs, found[c]) for c, rs in enumerate(out)]


def _list_values(wide: DataFrame, open_: list[list[Range]], found: list[dict[int, float]]) -> None:
    """Count the values of the open ranges, each of a bounded number of rows, and read off the wanted ranks."""
    counts = (wide.mapInArrow(_valued(*_edges(open_)), "c long, k long, x double").groupBy("c", "k", "x").agg(F.count("*").alias("n")))
    run = Window.partitionBy("c", "k").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("n").over(run))
    ranks = wide.sparkSession.createDataFrame(
        [(c, k, x, x - r.before) for c, rs in enumerate(open_) for k, r in enumerate(rs) for x in r.ranks],
        "rc long, rk long, rank long, inner long")
    # as many rows as ranks are wanted
    hit = counts.join(F.broadcast(ranks), (F.col("c") == F.col("rc")) & (F.col("k") == F.col("rk")) & (F.col("inner") <= F.col("upto"))
                      & (F.col("inner") > F.col("upto") - F.col("n")))
    for r in hit.select("c", "rank", "x").collect():
        found[r.c][r.rank] = r.x
