"""Helpers the operators share: scratch tables, Arrow mapping, components.

Python code runs in Arrow batches that Spark deals out; a helper sees at most
``ROWS`` documents at a time, so its memory follows the documents, not the
partition. Intermediate tables are Parquet files in the shared folder of
``spark.checkpoint.dir``: a lost executor costs only the tasks it ran.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binscope.session import scratch_dir, ship_package

#: rows of an Arrow batch that one Python call handles
ROWS = 256
#: rows up to which a side is sent to every executor; beyond it Spark shuffles
BROADCAST_ROWS = 2_000_000
#: the characters [\x20\x09-\x0D]
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until ``df`` has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def plain_names(df: DataFrame, *kept: str) -> DataFrame:
    """``df`` with columns c0, c1, ... but for ``kept``: names that Python functions over rows can take."""
    return df.toDF(*[c if c in kept else f"c{i}" for i, c in enumerate(df.columns)])


def quoted(name: str) -> F.Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if its counted ``rows`` are under ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str,
               rows: int = ROWS) -> DataFrame:
    """``mapInArrow`` that hands ``fn`` at most ``rows`` rows at a time."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                yield fn(batch.slice(i, rows))
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def record(types: dict[str, pa.DataType], columns: dict) -> pa.RecordBatch:
    """An Arrow batch with these column types, in this order."""
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in types.items()],
                                      names=list(types))


def sample_share(counts: dict, bound: int) -> dict:
    """Share of each group to take so that about ``bound`` rows of it remain."""
    return {k: min(1.0, bound / n) if n else 0.0 for k, n in counts.items()}


def unit_hash(*cols) -> F.Column:
    """A number in [0, 1) fixed by the values of ``cols``."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))).cast("double")


# -- sorted streams ---------------------------------------------------------
def key_runs(batches: Iterable[pa.RecordBatch], key: str, most: int
             ) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Cut a stream sorted by ``key`` at group borders.

    Yields ``("whole", batch)`` with complete groups of at most ``most`` rows
    and ``("part", batch)`` with pieces of larger groups, in order. Keeps at
    most ``most`` rows of an open group.
    """
    held, open_key = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if open_key is not None:            # rows of a group already known as large
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            n = int(np.searchsorted(keys != open_key, True))
            if n:
                yield "part", batch.slice(0, n)
            if n == batch.num_rows:
                continue
            batch, open_key = batch.slice(n), None
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        last = int(starts[-1])
        whole = np.repeat(sizes <= most, sizes)
        whole[last:] = False
        if whole.any():
            yield "whole", batch.filter(pa.array(whole))
        for s, n in zip(starts[:-1], sizes[:-1]):
            if n > most:
                yield "part", batch.slice(int(s), int(n))
        held = batch.slice(last)
        if held.num_rows > most:
            yield "part", held
            held, open_key = None, keys[last]
    if held is not None:
        yield "whole", held


# -- connected components ---------------------------------------------------
class Forest:
    """Union-find over integers; a root is the smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p, root = self.parent, x
        while (up := p.setdefault(root, root)) != root:
            root = up
        while p[x] != root:
            p[x], x = root, p[x]
        return root

    def join(self, a: int, b: int) -> bool:
        """Link two members; False if they were linked already."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of a batch by (member, root), at most as many."""
    for batch in batches:
        forest = Forest()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
        out = [(x, forest.find(x)) for x in list(forest.parent)]
        out = [(x, r) for x, r in out if x != r]
        yield record({"u": pa.int64(), "v": pa.int64()},
                     {"u": [x for x, _ in out], "v": [r for _, r in out]})


def _stars_only(edges: DataFrame) -> bool:
    """No node of ``edges(u, v)`` with v < u has two parents, or a parent and a child."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                          F.struct(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
                        .alias("e")).select("e.*")
    return (ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
            .where("up > 1 or (up = 1 and down = 1)").isEmpty())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)`` (longs); root is the smallest node.

    Distributed union-find by alternating large-star and small-star steps:
    each step is two grouped minima and two joins, whatever the diameter; the
    number of rounds grows with the logarithm of the longest chain. Links of
    one Arrow batch are contracted first. Nulls and self-links are ignored;
    no links give an empty table.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .where("u <> v").mapInArrow(_contract, "u long, v long").distinct(), "links")
    while not _stars_only(edges):
        # large star: a node's larger neighbours go to its smallest neighbour; only a parent that has a
        # parent itself changes anything
        low = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v")
        large = stored(edges.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        edges = stored(small, "small-star")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(roots.select("node", F.col("node").alias("root"))))
