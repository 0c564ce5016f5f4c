"""Binning tables for given splits, their metrics and summaries.

Plan of a table (all factors at once, one pass over the data):

1. on the wide row, every factor gets its bin index from its own balanced
   comparison tree (``bin_index_expr``: log2(k) comparisons, codegen);
2. one explode to ``(factor, bin_id, y)`` and one ``groupBy(factor, bin_id)``
   with partial aggregation: the shuffle carries at most
   ``#tasks x #factors x #bins`` rows whatever the data size;
3. a skeleton of ``#factors x (#bins + 2)`` rows (from the splits, built on the
   driver) supplies labels and empty bins; totals and metrics are computed on
   that tiny table.

Bins are ``(-inf, s1)``, ``[s1, s2)``, ..., ``[sk, inf)``; then ``Special``
(values listed in ``special_codes``) and ``Missing`` (x null, NaN or infinite).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binscope.functions.exprs import qcol, target_values, as_double, bin_index_expr, bin_label, short_label
from binscope.session import materialize

SPECIAL = "Special"
MISSING = "Missing"
TOTALS = "Totals"


def _dtypes(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def normalise_splits(splits: Mapping[str, Sequence[float]]) -> dict[str, list[float]]:
    return {f: sorted(set(float(s) for s in (v or []))) for f, v in splits.items()}


def bin_skeleton(spark, factors: Sequence[str], splits: Mapping[str, Sequence[float]],
                 label_length: int | None = None) -> DataFrame:
    """``(factor, position, bin_id, bin, lo, hi, kind)``: every bin of every factor (tiny)."""
    rows = []
    for p, f in enumerate(factors):
        cuts = splits.get(f, [])
        edges = [None] + list(cuts) + [None]
        for i in range(len(cuts) + 1):
            rows.append((f, p, i, edges[i], edges[i + 1], "regular"))
        rows.append((f, p, len(cuts) + 1, None, None, "special"))
        rows.append((f, p, len(cuts) + 2, None, None, "missing"))
    sk = spark.createDataFrame(rows, "factor string, position int, bin_id int, lo double, hi double, "
                                     "kind string")
    label = (F.when(F.col("kind") == "special", F.lit(SPECIAL))
             .when(F.col("kind") == "missing", F.lit(MISSING))
             .otherwise(bin_label(F.col("lo"), F.col("hi"))))
    if label_length:
        label = short_label(label, label_length)
    return sk.withColumn("bin", label)


def _regular_bin_id(x: Column, cuts: Sequence[float]) -> Column:
    # bin_index_expr gives 0..k for k cuts; regular bins are numbered from 0
    return bin_index_expr(x, cuts)


# above this many cuts a comparison tree gets too large for Java codegen: use MLlib's
# Bucketizer (binary search in the JVM, one pass over all columns)
TREE_MAX_CUTS = 32


def assign_bins(df: DataFrame, factors: Sequence[str], splits: Mapping[str, Sequence[float]],
                y: str | None = None, y_expr: Column | None = None,
                special_codes: Sequence[float] = ()) -> DataFrame:
    """``(factor, position, bin_id, x[, y])`` for every row and factor.

    Regular bins are ``0..k``; ``k+1`` is Special, ``k+2`` is Missing.
    """
    dt = _dtypes(df)
    splits = normalise_splits(splits)
    xs = {f: as_double(qcol(f), dt[f]) for f in factors}
    has_y = y is not None or y_expr is not None
    base = [xs[f].alias(f"__x{p}") for p, f in enumerate(factors)]
    if has_y:
        base.append((y_expr if y_expr is not None else as_double(qcol(y), dt[y])).alias("y"))
    wide = df.select(*base)
    big = [p for p, f in enumerate(factors) if len(splits.get(f, [])) > TREE_MAX_CUTS]
    if big:
        from pyspark.ml.feature import Bucketizer
        inf = float("inf")
        bk = Bucketizer(splitsArray=[[-inf, *splits[factors[p]], inf] for p in big],
                        inputCols=[f"__x{p}" for p in big], outputCols=[f"__b{p}" for p in big],
                        handleInvalid="keep")
        wide = bk.transform(wide)
    structs = []
    for p, f in enumerate(factors):
        cuts = splits.get(f, [])
        x = F.col(f"__x{p}")
        k = len(cuts)
        b = F.when(x.isNull(), F.lit(k + 2))
        if special_codes:
            b = b.when(x.isin(*[float(s) for s in special_codes]), F.lit(k + 1))
        b = b.otherwise(F.col(f"__b{p}").cast("int") if p in big else _regular_bin_id(x, cuts))
        structs.append(F.struct(F.lit(f).alias("factor"), F.lit(p).alias("position"),
                                b.cast("int").alias("bin_id"), x.alias("x")))
    out = wide.select(F.explode(F.array(*structs)).alias("__s"), *(["y"] if has_y else []))
    return out.select("__s.*", *(["y"] if has_y else []))


# ---------------------------------------------------------------------------
# per-bin statistics (the only pass over the data)
# ---------------------------------------------------------------------------
def continuous_bin_stats(assigned: DataFrame) -> DataFrame:
    """``(factor, bin_id, n, sum_y, m2_y, min_y, max_y, zeros)`` over rows with y present.

    ``m2_y`` is the sum of squared differences from the bin's mean (Spark's
    updating formula: no cancellation for targets far from zero).
    """
    y = F.col("y")
    return (assigned.filter(y.isNotNull()).groupBy("factor", "bin_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("sum_y"), (F.var_pop(y) * F.count(y)).alias("m2_y"),
        F.min(y).alias("min_y"), F.max(y).alias("max_y"), F.count_if(y == 0).alias("zeros"),
        F.min("x").alias("min_x"), F.max("x").alias("max_x")))


def binary_bin_stats(assigned: DataFrame) -> DataFrame:
    """``(factor, bin_id, n, events, min_x, max_x)``; y is 1 for an event, 0 otherwise."""
    y = F.col("y")
    return (assigned.filter(y.isNotNull()).groupBy("factor", "bin_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).cast("long").alias("events"),
        F.min("x").alias("min_x"), F.max("x").alias("max_x")))


def multiclass_bin_stats(assigned: DataFrame) -> DataFrame:
    """``(factor, bin_id, class, n)``; y holds the class label (string)."""
    return (assigned.filter(F.col("y").isNotNull())
            .groupBy("factor", "bin_id", F.col("y").alias("class"))
            .agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------------------
# tables from per-bin statistics (tiny inputs)
# ---------------------------------------------------------------------------
def _with_skeleton(stats: DataFrame, skeleton: DataFrame, fill: Sequence[str]) -> DataFrame:
    j = skeleton.join(stats, ["factor", "bin_id"], "left")
    return j.fillna(0, subset=list(fill))


def continuous_table_from_stats(stats: DataFrame, skeleton: DataFrame) -> DataFrame:
    """Bin, Count, Count %, Sum, Std, Mean, Min, Max, Zeros, WoE, IV + Totals."""
    t = _with_skeleton(stats, skeleton, ["n", "sum_y", "m2_y", "zeros"])
    wf = Window.partitionBy("factor")
    n = F.col("n").cast("double")
    tot_n = F.sum("n").over(wf).cast("double")
    tot_sum = F.sum("sum_y").over(wf)
    mean_all = tot_sum / F.nullif(tot_n, F.lit(0.0))
    mean = F.col("sum_y") / F.nullif(n, F.lit(0.0))
    var = F.col("m2_y") / F.nullif(n, F.lit(0.0))
    around_all = F.coalesce(F.col("m2_y") + n * (mean - mean_all) * (mean - mean_all), F.lit(0.0))
    rows = t.select(
        "factor", "position", "bin_id", "bin", "kind", "lo", "hi",
        F.col("n").cast("long").alias("count"),
        (n / F.nullif(tot_n, F.lit(0.0))).alias("count_pct"),
        F.col("sum_y").alias("sum"),
        F.sqrt(var).alias("std"),
        mean.alias("mean"),
        F.col("min_y").alias("min"), F.col("max_y").alias("max"),
        F.col("zeros").cast("long").alias("zeros"),
        F.coalesce(mean - mean_all, F.lit(0.0)).alias("woe"),
        F.coalesce(F.abs(mean - mean_all) * n / F.nullif(tot_n, F.lit(0.0)), F.lit(0.0)).alias("iv"),
        around_all.alias("__ss"), F.col("min_x"), F.col("max_x"))
    totals = rows.groupBy("factor", "position").agg(
        F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.sum("__ss").alias("__ss"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.sum("zeros").alias("zeros"),
        F.sum(F.abs("woe")).alias("woe"), F.sum("iv").alias("iv"),
        F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"))
    tn = F.col("count").cast("double")
    tmean = F.col("sum") / F.nullif(tn, F.lit(0.0))
    totals = totals.select(
        "factor", "position", F.lit(None).cast("int").alias("bin_id"), F.lit(TOTALS).alias("bin"),
        F.lit("totals").alias("kind"), F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"), F.col("count").cast("long").alias("count"),
        F.when(tn > 0, F.lit(1.0)).alias("count_pct"), "sum",
        F.sqrt(F.col("__ss") / F.nullif(tn, F.lit(0.0))).alias("std"),
        tmean.alias("mean"), "min", "max", F.col("zeros").cast("long").alias("zeros"), "woe", "iv",
        "__ss", "min_x", "max_x")
    return rows.unionByName(totals).drop("__ss")


def _xlogy_ratio(a: Column, b: Column) -> Column:
    """a * ln(a / b) with 0 * ln(0) = 0."""
    return F.when(a > 0, a * F.log(a / b)).otherwise(F.lit(0.0))


def binary_table_from_stats(stats: DataFrame, skeleton: DataFrame) -> DataFrame:
    """Count, Count %, Non-event, Event, Event rate, WoE, IV, JS + Totals."""
    t = _with_skeleton(stats, skeleton, ["n", "events"])
    wf = Window.partitionBy("factor")
    n = F.col("n").cast("double")
    e = F.col("events").cast("double")
    ne = n - e
    tot_n = F.sum("n").over(wf).cast("double")
    tot_e = F.sum("events").over(wf).cast("double")
    tot_ne = tot_n - tot_e
    p = ne / F.nullif(tot_ne, F.lit(0.0))
    q = e / F.nullif(tot_e, F.lit(0.0))
    ok = (e > 0) & (ne > 0)
    woe = F.when(ok, F.log(p / q)).otherwise(F.lit(0.0))
    iv = F.when(ok, (p - q) * F.log(p / q)).otherwise(F.lit(0.0))
    m = (p + q) / 2
    js = F.coalesce(0.5 * (_xlogy_ratio(p, m) + _xlogy_ratio(q, m)), F.lit(0.0))
    rows = t.select(
        "factor", "position", "bin_id", "bin", "kind", "lo", "hi",
        F.col("n").cast("long").alias("count"),
        (n / F.nullif(tot_n, F.lit(0.0))).alias("count_pct"),
        ne.cast("long").alias("non_event"), F.col("events").cast("long").alias("event"),
        (e / F.nullif(n, F.lit(0.0))).alias("event_rate"),
        woe.alias("woe"), iv.alias("iv"), js.alias("js"), "min_x", "max_x")
    totals = rows.groupBy("factor", "position").agg(
        F.sum("count").alias("count"), F.sum("non_event").alias("non_event"),
        F.sum("event").alias("event"), F.sum("iv").alias("iv"), F.sum("js").alias("js"),
        F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"))
    tn = F.col("count").cast("double")
    totals = totals.select(
        "factor", "position", F.lit(None).cast("int").alias("bin_id"), F.lit(TOTALS).alias("bin"),
        F.lit("totals").alias("kind"), F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"), F.col("count").cast("long").alias("count"),
        F.when(tn > 0, F.lit(1.0)).alias("count_pct"), F.col("non_event").cast("long").alias("non_event"),
        F.col("event").cast("long").alias("event"),
        (F.col("event") / F.nullif(tn, F.lit(0.0))).alias("event_rate"),
        F.lit(None).cast("double").alias("woe"), "iv", "js", "min_x", "max_x")
    return rows.unionByName(totals)


def multiclass_table_from_stats(stats: DataFrame, skeleton: DataFrame, classes: DataFrame) -> DataFrame:
    """E14 (long): per bin and class: Count, Count %, Event (class count), Event rate + Totals.

    ``classes`` is ``(factor, class)``: the classes seen for each factor.
    """
    sk = skeleton.join(classes, "factor")
    j = sk.join(stats, ["factor", "bin_id", "class"], "left").fillna(0, subset=["n"])
    wb = Window.partitionBy("factor", "bin_id")
    wf = Window.partitionBy("factor", "class")
    per_bin = F.sum("n").over(wb)
    rows = j.select(
        "factor", "position", "bin_id", "bin", "kind", "lo", "hi", "class",
        per_bin.cast("long").alias("count"),
        F.col("n").cast("long").alias("event"),
        (F.col("n") / F.nullif(per_bin.cast("double"), F.lit(0.0))).alias("event_rate"),
        F.sum("n").over(wf).alias("__class_total"))
    wf2 = Window.partitionBy("factor")
    rows = rows.withColumn("count_pct", F.col("count") / F.nullif(
        F.sum("event").over(wf2).cast("double"), F.lit(0.0)))
    totals = rows.groupBy("factor", "position", "class").agg(
        F.sum("event").alias("event"), F.first("__class_total").alias("__class_total"))
    wt = Window.partitionBy("factor")
    totals = totals.select(
        "factor", "position", F.lit(None).cast("int").alias("bin_id"), F.lit(TOTALS).alias("bin"),
        F.lit("totals").alias("kind"), F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"), "class",
        F.sum("event").over(wt).cast("long").alias("count"), F.col("event").cast("long").alias("event"),
        (F.col("event") / F.nullif(F.sum("event").over(wt).cast("double"), F.lit(0.0))).alias("event_rate"),
        "__class_total",
        F.when(F.sum("event").over(wt) > 0, F.lit(1.0)).alias("count_pct"))
    return rows.unionByName(totals).drop("__class_total")


# ---------------------------------------------------------------------------
# tables straight from data with given splits
# ---------------------------------------------------------------------------
def binning_table_continuous(df: DataFrame, factors: Sequence[str], y: str,
                             splits: Mapping[str, Sequence[float]], special_codes: Sequence[float] = (),
                             label_length: int | None = None) -> DataFrame:
    """E12 for given splits; x-y pairs with y missing are left out (x missing -> Missing bin)."""
    a = assign_bins(df, factors, splits, y=y, special_codes=special_codes)
    sk = bin_skeleton(df.sparkSession, factors, normalise_splits(splits), label_length)
    # per-bin statistics are tiny and read by several branches (rows, totals, windows): one scan
    return continuous_table_from_stats(materialize(continuous_bin_stats(a)), sk)


def binning_table_binary(df: DataFrame, factors: Sequence[str], y: str,
                         splits: Mapping[str, Sequence[float]], event_value=1,
                         special_codes: Sequence[float] = (), label_length: int | None = None) -> DataFrame:
    """E13 for given splits; y == event_value is an event."""
    yv = target_values(y, _dtypes(df)[y])
    yy = F.when(yv.isNull(), F.lit(None)).otherwise((yv == F.lit(event_value)).cast("int"))
    a = assign_bins(df, factors, splits, y_expr=yy, special_codes=special_codes)
    sk = bin_skeleton(df.sparkSession, factors, normalise_splits(splits), label_length)
    return binary_table_from_stats(materialize(binary_bin_stats(a)), sk)


def binning_table_multiclass(df: DataFrame, factors: Sequence[str], y: str,
                             splits: Mapping[str, Sequence[float]], special_codes: Sequence[float] = (),
                             label_length: int | None = None) -> DataFrame:
    """E14 (long form, one row per bin and class) for given splits."""
    yy = target_values(y, _dtypes(df)[y]).cast("string")
    a = assign_bins(df, factors, splits, y_expr=yy, special_codes=special_codes)
    stats = materialize(multiclass_bin_stats(a))
    classes = stats.select("factor", "class").distinct()
    sk = bin_skeleton(df.sparkSession, factors, normalise_splits(splits), label_length)
    return multiclass_table_from_stats(stats, sk, classes)


# ---------------------------------------------------------------------------
# Per-factor summaries of a table
# ---------------------------------------------------------------------------
def monotonic_trend(table: DataFrame, metric: str, group: Sequence[str] = ("factor",)) -> DataFrame:
    """Trend of ``metric`` over the regular bins (Special, Missing, Totals left out).

    ascending (no decrease), descending (no increase), peak (all rises before all
    falls), valley (all falls before all rises), undefined (one bin), else no monotonic.
    """
    g = list(group)
    reg = table.filter(F.col("kind") == "regular")
    w = Window.partitionBy(*g).orderBy("bin_id")
    d = reg.withColumn("__d", F.col(metric) - F.lag(metric).over(w))
    s = d.groupBy(*g).agg(
        F.count(F.lit(1)).alias("__k"),
        F.count_if(F.col("__d") > 0).alias("__np"), F.count_if(F.col("__d") < 0).alias("__nn"),
        F.max(F.when(F.col("__d") > 0, F.col("bin_id"))).alias("__maxp"),
        F.min(F.when(F.col("__d") > 0, F.col("bin_id"))).alias("__minp"),
        F.max(F.when(F.col("__d") < 0, F.col("bin_id"))).alias("__maxn"),
        F.min(F.when(F.col("__d") < 0, F.col("bin_id"))).alias("__minn"))
    trend = (F.when(F.col("__k") <= 1, F.lit("undefined"))
             .when(F.col("__nn") == 0, F.lit("ascending"))
             .when(F.col("__np") == 0, F.lit("descending"))
             .when(F.col("__maxp") < F.col("__minn"), F.lit("peak"))
             .when(F.col("__maxn") < F.col("__minp"), F.lit("valley"))
             .otherwise(F.lit("no monotonic")))
    return s.select(*g, trend.alias("monotonic_trend"))


def trend_shape(table: DataFrame, metric: str) -> DataFrame:
    """``(factor, trend_shape)``: how ``metric`` bends over the middles of the regular bins.

    Slopes between neighbouring bins are taken at the exact middles of their
    values: convex (no slope falls), concave (none rises), linear (neither),
    mixed; undefined with fewer than three bins.
    """
    w = Window.partitionBy("factor").orderBy("bin_id")
    mid = (F.col("min_x") + F.col("max_x")) / 2
    reg = table.filter((F.col("kind") == "regular") & F.col("min_x").isNotNull()).withColumn("__x", mid)
    slope = (F.col(metric) - F.lag(metric).over(w)) / (F.col("__x") - F.lag("__x").over(w))
    bend = reg.withColumn("__s", slope).withColumn("__b", F.col("__s") - F.lag("__s").over(w))
    n = bend.groupBy("factor").agg(F.count_if(F.col("__b") > 0).alias("__up"), F.count_if(F.col("__b") < 0).alias("__down"),
                                   F.count("__b").alias("__n"))
    shape = (F.when(F.col("__n") == 0, "undefined").when((F.col("__up") == 0) & (F.col("__down") == 0), "linear")
             .when(F.col("__down") == 0, "convex").when(F.col("__up") == 0, "concave").otherwise("mixed"))
    return n.select("factor", shape.alias("trend_shape"))


def gini_from_table(table: DataFrame) -> DataFrame:
    """Gini of a binary table: bins by event rate descending, trapezoid AUC, abs(2 AUC - 1)."""
    b = table.filter(F.col("kind") != "totals").filter(F.col("count") > 0)
    wf = Window.partitionBy("factor")
    w = Window.partitionBy("factor").orderBy(F.col("event_rate").desc(), F.col("bin_id"))
    e = F.col("event") / F.nullif(F.sum("event").over(wf).cast("double"), F.lit(0.0))
    ne = F.col("non_event") / F.nullif(F.sum("non_event").over(wf).cast("double"), F.lit(0.0))
    c = b.select("factor", "bin_id", "event_rate", e.alias("__e"), ne.alias("__ne"))
    c = c.withColumn("__ce", F.sum("__e").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    area = F.col("__ne") * (2 * F.col("__ce") - F.col("__e")) / 2
    return c.groupBy("factor").agg(F.abs(2 * F.sum(area) - 1).alias("gini"))


def binary_summary(table: DataFrame) -> DataFrame:
    """E16 for binary tables: n_bins, iv, js, gini, monotonic trend of the event rate."""
    tot = table.filter(F.col("kind") == "totals").select("factor", "position", "iv", "js")
    nb = table.filter(F.col("kind") == "regular").groupBy("factor").agg(F.count(F.lit(1)).alias("n_bins"))
    tr = monotonic_trend(table, "event_rate")
    return (tot.join(nb, "factor").join(gini_from_table(table), "factor", "left").join(tr, "factor")
            .select("factor", "position", F.col("n_bins").cast("int").alias("n_bins"), "iv", "js",
                    F.coalesce(F.col("gini"), F.lit(0.0)).alias("gini"), "monotonic_trend"))


def continuous_summary(table: DataFrame) -> DataFrame:
    """E16 for continuous tables: n_bins, woe (sum of abs), iv, trend of the mean."""
    tot = table.filter(F.col("kind") == "totals").select("factor", "position", "woe", "iv",
                                                         F.col("mean").alias("__mean"))
    nb = table.filter(F.col("kind") == "regular").groupBy("factor").agg(F.count(F.lit(1)).alias("n_bins"))
    tr = monotonic_trend(table, "mean")
    return (tot.join(nb, "factor").join(tr, "factor")
            .select("factor", "position", F.col("n_bins").cast("int").alias("n_bins"), "woe", "iv",
                    "monotonic_trend"))


def multiclass_summary(table: DataFrame) -> DataFrame:
    """E16 for multiclass tables: n_bins, js = H(mean_c P_c) - mean_c H(P_c), trend string."""
    reg = table.filter(F.col("kind") != "totals")
    wc = Window.partitionBy("factor", "class")
    pc = reg.withColumn("__p", F.col("event") / F.nullif(F.sum("event").over(wc).cast("double"), F.lit(0.0)))
    h_each = pc.groupBy("factor", "class").agg(
        F.sum(F.when(F.col("__p") > 0, -F.col("__p") * F.log("__p")).otherwise(0.0)).alias("__h"))
    mean_h = h_each.groupBy("factor").agg(F.avg("__h").alias("__mh"), F.count(F.lit(1)).alias("__nc"))
    mix = (pc.groupBy("factor", "bin_id").agg(F.sum("__p").alias("__sp"))
           .join(mean_h, "factor")
           .withColumn("__m", F.col("__sp") / F.col("__nc"))
           .groupBy("factor").agg(
               F.sum(F.when(F.col("__m") > 0, -F.col("__m") * F.log("__m")).otherwise(0.0)).alias("__hm"),
               F.first("__mh").alias("__mh")))
    js = mix.select("factor", (F.col("__hm") - F.col("__mh")).alias("js"))
    nb = (table.filter(F.col("kind") == "regular").select("factor", "bin_id").distinct()
          .groupBy("factor").agg(F.count(F.lit(1)).alias("n_bins")))
    tr = monotonic_trend(table, "event_rate", ("factor", "class"))
    cls = table.select("factor", "class").distinct()
    wi = Window.partitionBy("factor").orderBy("class")
    tr = tr.join(cls, ["factor", "class"]).withColumn("__i", F.row_number().over(wi) - 1)
    trend = (tr.groupBy("factor").agg(F.array_sort(F.collect_list(F.struct(
        "__i", F.format_string("Class[%d]]:%s=%s", F.col("__i"), F.col("class"),
                               F.col("monotonic_trend")).alias("s")))).alias("__t"))
        .select("factor", F.array_join(F.transform("__t", lambda s: s["s"]), " , ").alias("monotonic_trend")))
    pos = table.select("factor", "position").distinct()
    return (pos.join(nb, "factor").join(js, "factor").join(trend, "factor")
            .select("factor", "position", F.col("n_bins").cast("int").alias("n_bins"), "js", "monotonic_trend"))


def bin_arrays(table: DataFrame, metric: str) -> DataFrame:
    """Per factor, the regular bins' labels and ``metric`` values as arrays (bin order)."""
    reg = table.filter(F.col("kind") == "regular")
    s = reg.groupBy("factor").agg(F.array_sort(F.collect_list(F.struct("bin_id", "bin", metric))).alias("__a"))
    return s.select("factor", F.transform("__a", lambda r: r["bin"]).alias("bins"),
                    F.transform("__a", lambda r: r[metric]).alias(metric + "s"))


def skeleton_from_splits(splits_df: DataFrame, label_length: int | None = None) -> DataFrame:
    """Like :func:`bin_skeleton`, built in Spark from ``(factor, position, splits[, others])`` rows.

    Where ``others`` is true, a bin of that kind follows the regular ones.
    """
    others = F.col("others") if "others" in splits_df.columns else F.lit(False)
    sp = splits_df.select("factor", "position", "splits", others.cast("int").alias("__o"))
    k = F.size("splits")
    reg = sp.select("factor", "position", "splits", F.explode(F.sequence(F.lit(0), k)).alias("bin_id"))
    i = F.col("bin_id")
    reg = reg.select("factor", "position", "bin_id",
                     F.when(i > 0, F.element_at("splits", i)).alias("lo"),
                     F.when(i < F.size("splits"), F.element_at("splits", i + 1)).alias("hi"),
                     F.lit("regular").alias("kind"))
    extra = sp.select("factor", "position", F.explode(F.concat(
        F.when(F.col("__o") > 0, F.array(F.struct((k + 1).alias("bin_id"), F.lit("others").alias("kind"))))
        .otherwise(F.array().cast("array<struct<bin_id:int,kind:string>>")),
        F.array(F.struct((k + F.col("__o") + 1).alias("bin_id"), F.lit("special").alias("kind")),
                F.struct((k + F.col("__o") + 2).alias("bin_id"), F.lit("missing").alias("kind"))))).alias("__e"))
    extra = extra.select("factor", "position", F.col("__e.bin_id").alias("bin_id"),
                         F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
                         F.col("__e.kind").alias("kind"))
    sk = reg.unionByName(extra)
    label = (F.when(F.col("kind") == "special", F.lit(SPECIAL))
             .when(F.col("kind") == "missing", F.lit(MISSING))
             .otherwise(bin_label(F.col("lo"), F.col("hi"))))
    if label_length:
        label = short_label(label, label_length)
    return sk.withColumn("bin", label)
