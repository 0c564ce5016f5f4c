"""The data behind the binning charts (no pixels are drawn)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = {"continuous": ("mean", "woe", "iv"), "binary": ("event_rate", "woe", "iv")}


def _kinds(add_special: bool, add_missing: bool) -> list[str]:
    return ["regular", "others"] + (["special"] if add_special else []) + (["missing"] if add_missing else [])


def bin_series(table: DataFrame, metric: str = "mean", add_special: bool = True, add_missing: bool = True,
               show_bin_labels: bool = False, label_length: int = 27) -> DataFrame:
    """``(factor, x, count, metric, kind, label)``: bars at positions 0..k-1 plus a metric line.

    The bin of pooled categories, if there is one, comes after the regular ones with kind ``others``.
    """
    if metric not in ("mean", "woe", "iv", "event_rate"):
        raise ValueError(f"metric must be one of mean, woe, iv, event_rate; got {metric!r}")
    t = table.filter(F.col("kind").isin(*_kinds(add_special, add_missing)))
    w = Window.partitionBy("factor").orderBy("bin_id")   # per factor: a few rows
    label = F.col("bin") if show_bin_labels else F.col("bin_id").cast("string")
    if show_bin_labels:
        label = F.when(F.length(label) > label_length,
                       F.concat(F.substring(label, 1, label_length), F.lit("..."))).otherwise(label)
    return t.select("factor", (F.row_number().over(w) - 1).cast("int").alias("x"),
                    F.col("count"), F.col(metric).alias("metric"), "kind", label.alias("label"))


def actual_scale_series(table: DataFrame, metric: str = "mean", show_bin_labels: bool = False) -> DataFrame:
    """regular bins at their real x: ``(factor, bin_id, left, right, width, mid, count, metric)``.

    Edges are min_x, the splits and max_x; Special and Missing are not drawn.
    A factor of categories has no scale: reading its rows raises.
    """
    if show_bin_labels:
        raise ValueError("bin labels can only be shown with the bin style, not with the actual scale")
    tot = table.filter(F.col("kind") == "totals").select("factor", F.col("min_x").alias("__lo"),
                                                         F.col("max_x").alias("__hi"))
    reg = table.filter(F.col("kind") == "regular").join(tot, "factor")   # one totals row per factor
    no_scale = F.when(F.col("count") > 0, F.raise_error(F.concat(
        F.col("factor"), F.lit(": bins of categories have no actual scale"))).cast("double"))
    left = F.coalesce(F.col("lo"), F.col("__lo"), no_scale)
    right = F.coalesce(F.col("hi"), F.col("__hi"), no_scale)
    return reg.select("factor", "bin_id", left.alias("left"), right.alias("right"),
                      (right - left).alias("width"), ((left + right) / 2).alias("mid"),
                      "count", F.col(metric).alias("metric"))


def multiclass_series(table: DataFrame, add_special: bool = True, add_missing: bool = True) -> DataFrame:
    """stacked class counts per bin (``base`` = counts of earlier classes) and event-rate lines."""
    t = table.filter(F.col("kind").isin(*_kinds(add_special, add_missing)))
    wx = Window.partitionBy("factor").orderBy("bin_id")
    pos = (t.select("factor", "bin_id").distinct()
           .withColumn("x", (F.row_number().over(wx) - 1).cast("int")))
    wc = Window.partitionBy("factor", "bin_id").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    return (t.join(pos, ["factor", "bin_id"])
            .select("factor", "x", "bin_id", "class", F.col("event").alias("count"),
                    F.coalesce(F.sum("event").over(wc), F.lit(0)).cast("long").alias("base"),
                    "event_rate", "kind"))


def chart_series(table: DataFrame, kind: str, **options) -> DataFrame:
    """The series of a table chosen by its kind (multiclass stacks, else bins with a metric line)."""
    if kind == "multiclass":
        return multiclass_series(table, options.get("add_special", True), options.get("add_missing", True))
    metric = options.pop("metric", "mean" if kind == "continuous" else "event_rate")
    if options.pop("style", "bin") == "actual":
        return actual_scale_series(table, metric, options.get("show_bin_labels", False))
    return bin_series(table, metric, **options)
