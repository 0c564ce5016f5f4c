"""D6 opt-in: mergeable quantile sketches with a stated rank error.

Exact quantiles shuffle every distinct value. A KLL sketch (Karnin, Lang,
Liberty 2016; Spark's ``kll_sketch_agg_double``) is one short binary value per
column and group: sketches of days or files are stored as Parquet rows, merged
later without the data, and asked for any quantile.

The rank error is for the whole answer, not for one confidence level: the
published 99 % bound of a sketch of size k is 2.296 / k^0.9021, and k is chosen
so that this is half of the error asked for (about five standard deviations).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binscope.operators.longform import to_long

# fixed values of the published bound, and the sizes a sketch may have
KLL_FACTOR, KLL_POWER = 2.296, 0.9021
KLL_MIN, KLL_MAX = 8, 65535
_OWN = ("factor", "position", "x", "column_name", "n", "min_x", "max_x", "sketch")


def sketch_size(error: float) -> int:
    """Sketch size k whose 99 % rank error is at most half of ``error``."""
    if not 0 < error < 1:
        raise ValueError(f"the rank error must be between 0 and 1, got {error}")
    k = math.ceil((2 * KLL_FACTOR / error) ** (1 / KLL_POWER))
    if k > KLL_MAX:
        raise ValueError(f"a rank error of {error} asks for a sketch of size {k}, more than {KLL_MAX}: take exact quantiles")
    return max(KLL_MIN, k)


def quantile_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), error: float = 0.01) -> DataFrame:
    """``(by..., column_name, position, n, min_x, max_x, sketch)``: one row per group and column.

    Missing and non-finite values are left out; a column without values has
    ``n`` = 0. Partial sketches are built in each task and only these are
    shuffled. ``by`` columns may not be named like the result's own.
    """
    clash = [c for c in by if c.lower() in _OWN]
    if clash:
        raise ValueError(f"group columns named like the result's own: {clash}")
    return (to_long(df, columns, keep=list(by)).withColumnRenamed("factor", "column_name")
            .groupBy(*by, "column_name", "position")
            .agg(F.count("x").alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x"),
                 F.kll_sketch_agg_double("x", F.lit(sketch_size(error))).alias("sketch")))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of finer groups as those of the groups ``by`` (none: one per column)."""
    return (sketches.groupBy(*by, "column_name", "position")
            .agg(F.sum("n").alias("n"), F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"),
                 F.kll_merge_agg_double("sketch").alias("sketch")))


def sketch_quantiles(sketches: DataFrame, probs: Sequence[float]) -> DataFrame:
    """``sketches`` without the binary, one row per probability: ``(..., prob, quantile)``; null where ``n`` is 0."""
    ps = [float(p) for p in probs]
    pairs = F.arrays_zip(F.array(*map(F.lit, ps)).alias("prob"),
                         F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, ps))))
                         .otherwise(F.array(*[F.lit(None).cast("double")] * len(ps))).alias("quantile"))
    keep = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*keep, F.explode(pairs).alias("__q")).select(*keep, "__q.prob", "__q.quantile")


def rank_errors(df: DataFrame, quantiles: DataFrame) -> DataFrame:
    """``(column_name, position, prob, n, rank_error)``: how far each quantile is from its rank in ``df``, counted exactly.

    ``quantiles(column_name, prob, quantile)`` has a row per column and
    probability. The error is the distance of ``prob`` to the shares of values
    below and not above the quantile, 0 between the two.
    """
    columns = [r["column_name"] for r in quantiles.groupBy("column_name").agg(F.min("position").alias("p"))
               .orderBy("p").collect()]
    asked = quantiles.select(F.col("column_name").alias("factor"), "prob", "quantile")
    n = F.count("x")
    return (to_long(df, columns).where(F.col("x").isNotNull())
            .join(F.broadcast(asked), "factor")    # columns x probabilities rows
            .groupBy(F.col("factor").alias("column_name"), "position", "prob")
            .agg(n.alias("n"), (F.count_if(F.col("x") < F.col("quantile")) / n).alias("below"),
                 (F.count_if(F.col("x") <= F.col("quantile")) / n).alias("upto"))
            .select("column_name", "position", "prob", "n",
                    F.greatest(F.lit(0.0), F.col("below") - F.col("prob"), F.col("prob") - F.col("upto")).alias("rank_error")))
