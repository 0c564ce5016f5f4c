"""Spearman rho and exact Kendall tau-b for every factor against a target.

Input is the long form ``(factor, x, y)``.  Both statistics start from the
pre-aggregated pairs ``(factor, x, y, w)`` (ties collapse into weights).

Spearman: exact average ranks of x and of y per factor (bucketed running sums,
no whole-column window), then a weighted Pearson correlation of centred ranks
(the mean average rank is exactly (n + 1) / 2, so no cancellation).

Kendall: S = C - D is split by value buckets of x and y (a value that is a
bucket cut forms a bucket alone; pairs with equal x or equal y add 0):

* pairs in the same x-bucket: counted with exact x and y, per (factor, x-bucket);
* pairs in different x-buckets but the same y-bucket: exact y, bucket order for x,
  per (factor, y-bucket);
* pairs in different x- and y-buckets: decided by the buckets alone, i.e. a
  weighted Kendall S over the bucket grid, which is the same problem on at most
  (2B+1)^2 points and is solved by the same function (recursively).

Each local count runs in ``applyInPandas`` on a group of at most
``LOCAL_PAIRS`` distinct pairs with an O(m log^2 m) vectorised divide and
conquer; no group ever holds a whole factor unless that factor is that small.

Where one side has few values (``LOCAL_PAIRS / LEVEL_SHARE``), the rows are
sorted by the other side instead, in ranges: a task walks its range with the
weights by value so far, and what is between ranges follows from each range's
weights by value. One shuffle, O(m log levels), neither pairs nor buckets. A
value may go on in the next ranges, so a frequent one is spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binscope.operators.longform import buckets_for, ranked_values, with_value_buckets
from binscope.session import ship_package

LOCAL_PAIRS = 2_000_000
# a side has few values if they are at most so small a share of a local group
LEVEL_SHARE = 500
# points that a task walks together, and points of a range (more ranges than cores only beyond)
WALKED, RANGE_POINTS = 1 << 18, 1 << 20


# ---------------------------------------------------------------------------
# local weighted Kendall S (numpy)
# ---------------------------------------------------------------------------
def kendall_s_local(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """S = sum over unordered pairs of w_i w_j sign(x_i - x_j) sign(y_i - y_j).

    Bottom-up merge over the distinct x values: at each level every block of x
    groups is compared with its right neighbour through sorted y keys.
    """
    n = len(x)
    if n < 2:
        return 0.0
    xr = np.unique(x, return_inverse=True)[1].astype(np.int64)
    yr = np.unique(y, return_inverse=True)[1].astype(np.int64)
    w = np.asarray(w, dtype=np.float64)
    g = int(xr.max()) + 1
    ny = int(yr.max()) + 1
    s_total = 0.0
    size = 1
    while size < g:
        pair = xr // (2 * size)
        right = ((xr // size) % 2) == 1
        left = ~right
        if right.any() and left.any():
            lk = pair[left] * ny + yr[left]
            order = np.argsort(lk, kind="stable")
            lk = lk[order]
            cw = np.concatenate(([0.0], np.cumsum(w[left][order])))
            rp, ry, rw = pair[right], yr[right], w[right]
            start = np.searchsorted(lk, rp * ny, "left")
            end = np.searchsorted(lk, (rp + 1) * ny, "left")
            lo = np.searchsorted(lk, rp * ny + ry, "left")
            hi = np.searchsorted(lk, rp * ny + ry, "right")
            less = cw[lo] - cw[start]
            greater = cw[end] - cw[hi]
            s_total += float(np.dot(rw, less - greater))
        size *= 2
    return s_total


def _s_schema(keys: list[str]) -> str:
    return ", ".join(f"{k} string" if k == "factor" else f"{k} long" for k in keys) + ", s double"


def _local_s(df: DataFrame, keys: list[str], x: str, y: str, w: str) -> DataFrame:
    """``(keys..., s)``: S of each group (groups bounded by the bucketing)."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        s = kendall_s_local(pdf[x].to_numpy(), pdf[y].to_numpy(), pdf[w].to_numpy())
        out = {k: [pdf[k].iloc[0]] for k in keys}
        out["s"] = [s]
        return pd.DataFrame(out)
    ship_package(df.sparkSession)
    return df.select(*keys, x, y, w).groupBy(*keys).applyInPandas(fn, _s_schema(keys))


def largest_group(pairs: DataFrame) -> int:
    """Most distinct pairs of any factor (one small job; a bound for every bucketing choice)."""
    return int(pairs.groupBy("factor").count().agg(F.max("count")).first()[0] or 0)


def kendall_s(pairs: DataFrame, local_pairs: int = LOCAL_PAIRS, largest: int | None = None,
              depth: int = 0) -> DataFrame:
    """``(factor, s)`` for weighted points ``(factor, x, y, w)`` (x, y double; w long).

    The bucket grid of one level has at most (2B+1)^2 points with
    B ~ 2 * largest / local_pairs, so two levels cover any realistic size; the
    second level's grid is always counted locally (bounded by (2B+1)^2).
    """
    if largest is None:
        largest = largest_group(pairs)
    if largest <= local_pairs or depth >= 2:
        return _local_s(pairs, ["factor"], "x", "y", "w")
    nb = max(2, math.ceil(2 * largest / local_pairs))
    b = with_value_buckets(pairs, "factor", "x", nb, out="xb")
    b = with_value_buckets(b, "factor", "y", nb, out="yb")
    # odd bucket ids hold one value only: their inner pairs add nothing
    within_x = _local_s(b.filter(F.col("xb") % 2 == 0), ["factor", "xb"], "x", "y", "w")
    within_y = _local_s(b.filter(F.col("yb") % 2 == 0).withColumn("xbd", F.col("xb").cast("double")),
                        ["factor", "yb"], "xbd", "y", "w")
    grid = (b.groupBy("factor", "xb", "yb").agg(F.sum("w").alias("w"))
            .select("factor", F.col("xb").cast("double").alias("x"), F.col("yb").cast("double").alias("y"), "w"))
    across = kendall_s(grid, local_pairs, depth=depth + 1)
    parts = (within_x.select("factor", "s").unionByName(within_y.select("factor", "s"))
             .unionByName(across.select("factor", "s")))
    return parts.groupBy("factor").agg(F.sum("s").alias("s"))


# ---------------------------------------------------------------------------
# few values on one side: a walk along the other
# ---------------------------------------------------------------------------
def _below_less_above(weight: np.ndarray) -> np.ndarray:
    """For each level the weight of the smaller levels less that of the greater ones."""
    up = np.cumsum(weight)
    return up - weight - (up[-1] - up)


def _walk(code: np.ndarray, run: np.ndarray, w: np.ndarray, levels: int) -> int:
    """S of points in order of y (``run``: the place of their y) by halving the levels 0..levels-1."""
    total = 0
    for bit in reversed(range((levels - 1).bit_length())):
        # points of one block differ in the bits from ``bit`` down only; inside a block they are in order of y
        block, right = code >> (bit + 1), (code >> bit) & 1
        new_block = np.append(True, block[1:] != block[:-1])
        first = np.flatnonzero(new_block | np.append(True, run[1:] != run[:-1]))
        rw = np.add.reduceat(w * right, first)
        up = np.append(0, np.cumsum(np.add.reduceat(w * (1 - right), first)))
        starts = np.flatnonzero(new_block[first])
        ends = np.append(starts[1:], len(first))
        around = np.repeat(up[starts] + up[ends], ends - starts)
        total += int(np.dot(rw, up[:-1] + up[1:] - around))
        if bit:
            order = np.argsort((code >> bit).astype(np.uint16), kind="stable")
            code, run, w = code[order], run[order], w[order]
    return total


_RANGES = "f int, first double, last double, s double, tied double, weights binary, first_weights binary, last_weights binary"


def _walked(levels: dict[int, int]):
    """(f, code, y, w) sorted by y to a row for each f: the range's first and last y, its S and ties of y, and its
    weights by level, those of the first y and of the last."""
    names = [x.split()[0] for x in _RANGES.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}
        for f, code, y, w in _whole_runs(batches):
            place = np.cumsum(np.append(0, y[1:] != y[:-1]))
            at_y = np.add.reduceat(w, np.flatnonzero(np.append(True, place[1:] != place[:-1])))
            by_level = [np.bincount(code[own], w[own], levels[f]).astype(np.int64) for own in (slice(None), place == 0, place == place[-1])]
            if f not in found:
                found[f] = {"first": y[:1].view(float)[0], "s": 0, "tied": 0, "weights": np.zeros(levels[f], np.int64), "first_weights": by_level[1]}
            own = found[f]
            own["s"] += _walk(code, place, w, levels[f]) + int(np.dot(_below_less_above(own["weights"]), by_level[0]))
            own["tied"] += int(np.dot(at_y, at_y - 1)) // 2
            own["weights"] = own["weights"] + by_level[0]
            own["last"], own["last_weights"] = y[-1:].view(float)[0], by_level[2]
        for f, own in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([f], pa.int32()), *[pa.array([float(own[k])]) for k in names[1:5]],
                 *[pa.array([own[k].tobytes()], pa.binary()) for k in names[5:]]], names=names)
    return run


def _whole_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(f, code, bits of y, w) of one f, from some ``WALKED`` points at a time; points of one y stay together."""
    parts, n = [], 0
    for batch in batches:
        if batch.num_rows:
            f, code, y, w = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            # one zero and one NaN
            parts.append([f, code.astype(np.int64), np.where(np.isnan(y), np.nan, y + 0.0).view(np.int64), w])
            n += batch.num_rows
        if n >= WALKED:
            rows = [np.concatenate(c) for c in zip(*parts)]
            held = int(np.flatnonzero(rows[2] == rows[2][-1])[0])     # the last y may go on: a point for each f and level
            yield from _by_factor(*[c[:held] for c in rows])
            f, code, y, w = (c[held:] for c in rows)
            key, first, place = np.unique(f.astype(np.int64) << 32 | code, return_index=True, return_inverse=True)
            parts, n = [[f[first], code[first], y[first], np.bincount(place, w, len(key)).astype(np.int64)]], 0
    if parts:
        yield from _by_factor(*(np.concatenate(c) for c in zip(*parts)))


def _by_factor(f: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The points of each f, in the order given."""
    if len(f) and (f != f[0]).any():
        order = np.argsort(f, kind="stable")
        f, columns = f[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.append(True, f[1:] != f[:-1])) if len(f) else []
    for a, b in zip(edges, [*edges[1:], len(f)]):
        yield int(f[a]), *[c[a:b] for c in columns]


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """The ranges of one f, in order: their own S and ties, and what is between them."""
    s, tied, seen, last, at_last = float(pdf["s"].sum()), float(pdf["tied"].sum()), None, None, None
    same = lambda a, b: a == b or (a != a and b != b)
    for r in pdf.sort_values(["first", "last"]).itertuples():
        own, at_first, own_last = (np.frombuffer(x, np.int64) for x in (r.weights, r.first_weights, r.last_weights))
        goes_on = seen is not None and same(r.first, last)
        if seen is not None:
            s += float(np.dot(_below_less_above(seen).astype(float), own))
        if goes_on:
            # points of one y in both: no pairs of S, but ties
            s -= float(np.dot(_below_less_above(at_last).astype(float), at_first))
            tied += float(at_last.sum()) * float(at_first.sum())
        seen = own if seen is None else seen + own
        last, at_last = r.last, at_last + own_last if goes_on and same(r.first, r.last) else own_last
    return pd.DataFrame({"f": pdf["f"].iloc[:1], "s": [s], "tied": [tied]})


def _walked_s(points: DataFrame, sizes: dict[str, tuple[int, int]], few: str, many: str, marginal: DataFrame) -> DataFrame:
    """``(factor, s, tied)`` of the factors in ``sizes`` (points, values of ``few``): S, and pairs of points tied in ``many``.

    ``marginal(factor, few, t)`` has the weight of each value of ``few``; what is broadcast of it is at most
    ``LOCAL_PAIRS / LEVEL_SHARE`` values a factor.
    """
    spark = points.sparkSession
    ship_package(spark)
    names = sorted(sizes)
    number = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "factor string, f int")
    codes = marginal.join(F.broadcast(number), "factor").select(
        "factor", "f", few, (F.row_number().over(Window.partitionBy("factor").orderBy(few)) - 1).alias("code"))
    ranges = max(spark.sparkContext.defaultParallelism, math.ceil(sum(sizes[x][0] for x in names) / RANGE_POINTS))
    rows = points.join(F.broadcast(codes), ["factor", few]).select(
        "f", "code", F.col(many).cast("double").alias("y"), F.col("w").cast("long"), F.monotonically_increasing_id().alias("__at"))
    # equal values are dealt out by their place
    by_range = (rows.repartitionByRange(ranges, "f", "y", "__at").select("f", "code", "y", "w").sortWithinPartitions("y")
                .mapInArrow(_walked({i: sizes[x][1] for i, x in enumerate(names)}), _RANGES))
    return by_range.groupBy("f").applyInPandas(_joined, "f int, s double, tied double").join(F.broadcast(number), "f").select("factor", "s", "tied")


# ---------------------------------------------------------------------------
# public operators
# ---------------------------------------------------------------------------
def weighted_pairs(long_df: DataFrame, persist: bool = True) -> DataFrame:
    """``(factor, x, y, w)``: rows with both values present, ties collapsed.

    Persisted (memory, spilling to disk) because every statistic reads it
    several times; lineage is kept, so a lost executor's blocks are recomputed.
    """
    p = (long_df.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
         .groupBy("factor", "x", "y").agg(F.count(F.lit(1)).alias("w")))
    return p.persist(StorageLevel.MEMORY_AND_DISK) if persist else p


def _ties(pairs: DataFrame, value: str, out: str) -> DataFrame:
    t = pairs.groupBy("factor", value).agg(F.sum("w").cast("double").alias("__t"))
    return t.groupBy("factor").agg(F.sum(F.col("__t") * (F.col("__t") - 1) / 2).alias(out))


def _sides(points: DataFrame, most: int) -> tuple[dict[str, str], list[str]]:
    """The side of each factor that seems to have few values (x if both do), and the other factors."""
    rows = points.groupBy("factor").agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in "xy"]).collect()   # one row a factor
    side = {r["factor"]: "x" if r["x"] <= 1.1 * most else "y" if r["y"] <= 1.1 * most else None for r in rows if r["factor"] is not None}
    return {f: c for f, c in side.items() if c}, [f for f, c in side.items() if not c]


def kendall_tau_b(long_df: DataFrame, local_pairs: int = LOCAL_PAIRS, pairs: DataFrame | None = None) -> DataFrame:
    """``(factor, kendall_tau_b)``; null when x or y is constant (denominator 0)."""
    most = local_pairs // LEVEL_SHARE
    present = long_df.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select("factor", "x", "y")
    points = pairs if pairs is not None else present.withColumn("w", F.lit(1).cast("long"))
    side, left = _sides(points, most) if most else ({}, None)
    parts = []
    for few, many in (("x", "y"), ("y", "x")):
        own = [f for f, c in side.items() if c == few]
        if not own:
            continue
        marginal = (points.where(F.col("factor").isin(own)).groupBy("factor", few)
                    .agg(F.sum("w").alias("t"), F.count(F.lit(1)).alias("points")).persist(StorageLevel.MEMORY_AND_DISK))
        t = F.col("t").cast("double")
        by_factor = marginal.groupBy("factor").agg(F.sum(t).alias("n"), F.sum(t * (t - 1) / 2).alias("n1"),
                                                   F.sum("points").alias("points"), F.count(F.lit(1)).alias("values"))
        sizes = {r["factor"]: (r["points"], r["values"]) for r in by_factor.collect()}        # one row a factor
        walk = {f: v for f, v in sizes.items() if v[1] <= most}
        left += [f for f in sizes if f not in walk]
        if walk:
            parts.append(by_factor.join(_walked_s(points, walk, few, many, marginal), "factor")
                         .select("factor", "n", "s", "n1", F.col("tied").alias("n2")))
    if left or not parts:
        pairs = pairs if pairs is not None else weighted_pairs(long_df if left is None else long_df.where(F.col("factor").isin(left)))
        rest = pairs if left is None else pairs.where(F.col("factor").isin(left))
        n = rest.groupBy("factor").agg(F.sum("w").cast("double").alias("n"))
        s = kendall_s(rest, local_pairs, largest_group(rest))
        parts.append(n.join(s, "factor", "left").join(_ties(rest, "x", "n1"), "factor").join(_ties(rest, "y", "n2"), "factor")
                     .select("factor", "n", "s", "n1", "n2"))
    j = parts[0]
    for part in parts[1:]:
        j = j.unionByName(part)
    n0 = F.col("n") * (F.col("n") - 1) / 2
    den = (n0 - F.col("n1")) * (n0 - F.col("n2"))
    return j.select("factor", F.when(den > 0, F.coalesce(F.col("s"), F.lit(0.0)) / F.sqrt(den))
                    .alias("kendall_tau_b"))


def _avg_rank(pairs: DataFrame, value: str, out: str, n_buckets: int | None = None) -> DataFrame:
    counts = pairs.groupBy("factor", value).agg(F.sum("w").alias("cnt"))
    r = ranked_values(counts, "factor", value, "cnt", n_buckets)
    return r.select("factor", value, (F.col("cum_before") + (F.col("cnt") + 1) / 2.0).alias(out))


def spearman(long_df: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``(factor, spearman)`` from exact average ranks; null when x or y is constant."""
    pairs = pairs if pairs is not None else weighted_pairs(long_df)
    nb = buckets_for(largest_group(pairs))  # distinct pairs bound distinct x and distinct y
    rx = _avg_rank(pairs, "x", "rx", nb)
    ry = _avg_rank(pairs, "y", "ry", nb)
    n = pairs.groupBy("factor").agg(F.sum("w").cast("double").alias("n"))
    j = pairs.join(rx, ["factor", "x"]).join(ry, ["factor", "y"]).join(F.broadcast(n), "factor")
    mid = (F.col("n") + 1) / 2
    cx, cy, w = F.col("rx") - mid, F.col("ry") - mid, F.col("w")
    s = j.groupBy("factor").agg(F.sum(w * cx * cy).alias("sxy"), F.sum(w * cx * cx).alias("sxx"),
                                F.sum(w * cy * cy).alias("syy"))
    return s.select("factor", F.when((F.col("sxx") > 0) & (F.col("syy") > 0),
                                     F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy"))).alias("spearman"))


def rank_correlations(long_df: DataFrame, local_pairs: int = LOCAL_PAIRS) -> DataFrame:
    """G4 + G5 from one set of pre-aggregated pairs: ``(factor, kendall_tau_b, spearman)``."""
    pairs = weighted_pairs(long_df)
    return kendall_tau_b(long_df, local_pairs, pairs).join(spearman(long_df, pairs), "factor", "outer")
