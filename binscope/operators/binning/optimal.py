"""Optimal binning of many factors at once.

Plan (numeric factors):

1. candidate cuts: all values of a factor that has few, else exact discrete
   quantiles found by narrowing value ranges (``rankcuts``); at most
   ``max_candidates - 1`` values per factor reach the driver;
2. fine-bin statistics: every factor's fine bin from its own comparison tree,
   one explode and one ``groupBy(factor, fine_bin)`` - the only pass over the
   data; the result (at most #factors x (max_candidates + 2) rows) is
   checkpointed;
3. per factor, ``applyInPandas`` runs CART pre-binning and the DP over the fine
   bins (a few hundred rows) and returns the fine-bin -> bin map and splits;
4. the final tables are sums of exact fine-bin statistics per final bin, so
   they are exact for the chosen splits (the splits themselves are restricted
   to the candidate cuts: within 1/max_candidates of the mass).

Categorical factors (E9): fine units are categories ordered by target mean /
event rate (metric-range buckets of categories when a factor has more than
``max_candidates`` of them); the same solver groups consecutive units.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binscope.functions.exprs import qcol, target_values, as_double
from binscope.operators.binning import solve as S
from binscope.operators.binning import tables as B
from binscope.operators.longform import ranked_values
from binscope.session import materialize, ship_package

MAX_CANDIDATES = 256
MAX_CLASSES = 1_000
# stands for the pooled categories among the units; never shown, and no category of a table is named so
OTHERS = "\0others"


@dataclass
class BinningResult:
    kind: str
    splits: DataFrame     # (factor, position, dtype, splits, status, trend, n_bins)
    table: DataFrame      # binning table of the kind (regular bins, Special, Missing, Totals)
    summary: DataFrame    # (factor, position, dtype, n_bins, status, metrics..., monotonic_trend)


def _dtypes(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def target_kind(df: DataFrame, y: str, estimator: str) -> str:
    """Regression -> continuous; Classification -> multiclass iff more than 2 classes."""
    if estimator.lower().startswith("reg"):
        return "continuous"
    n = df.select(F.count_distinct(target_values(y, _dtypes(df)[y]))).first()[0]
    return "multiclass" if n > 2 else "binary"


def choose_binning(df: DataFrame, y: str, estimator: str) -> DataFrame:
    """E2 as a table: ``(target, n_classes, kind)`` - continuous for regression, else binary or
    multiclass by the number of distinct target values (one aggregation)."""
    reg = estimator.lower().startswith("reg")
    n = F.count_distinct(target_values(y, _dtypes(df)[y]))
    return df.agg(n.alias("n_classes")).select(
        F.lit(y).alias("target"), F.col("n_classes").cast("long").alias("n_classes"),
        (F.lit("continuous") if reg else
         F.when(F.col("n_classes") > 2, F.lit("multiclass")).otherwise(F.lit("binary"))).alias("kind"))


def _event_value(df: DataFrame, y: str):
    """Binary: the larger of the two values is the event."""
    return df.select(F.max(target_values(y, _dtypes(df)[y]))).first()[0]


def candidate_cuts(df: DataFrame, factors: Sequence[str], max_candidates: int = MAX_CANDIDATES) -> dict[str, list[float]]:
    """Cuts per factor: every distinct value but the smallest, or ``max_candidates - 1`` exact quantiles.

    Discrete quantiles (existing values, deduplicated) are taken for factors
    with more than ``max_candidates`` distinct values. They follow from the
    rows alone, not from their partitioning.
    """
    if not factors:
        return {}
    from binscope.operators.longform import to_long
    from binscope.operators.rankcuts import rank_values
    dt = _dtypes(df)
    cols = [as_double(qcol(f), dt[f]).alias(f"__x{i}") for i, f in enumerate(factors)]
    row = df.select(*cols).agg(*[F.approx_count_distinct(f"__x{i}").alias(f"__d{i}") for i in range(len(factors))],
                               *[F.min(f"__x{i}").alias(f"__m{i}") for i in range(len(factors))]).first()
    # the estimate only picks the factors whose values are few enough to list exactly
    few = [f for i, f in enumerate(factors) if row[f"__d{i}"] <= 1.5 * max_candidates]
    listed = {}
    if few:
        listed = {r["factor"]: r["vals"] for r in to_long(df, few).filter(F.col("x").isNotNull())
                  .select("factor", "x").distinct().groupBy("factor")
                  .agg(F.sort_array(F.collect_set("x")).alias("vals")).collect()}
        listed = {f: v for f, v in listed.items() if len(v) <= max_candidates}
    many = [f for i, f in enumerate(factors) if f not in listed and row[f"__m{i}"] is not None]
    cuts = rank_values(df, many, [i / max_candidates for i in range(1, max_candidates)]) if many else {}
    # the smallest value opens the first bin anyway: a cut there leaves (-inf, min) empty
    return {f: sorted({float(v) for v in listed.get(f, cuts.get(f, [])) if v > row[f"__m{i}"]}) for i, f in enumerate(factors)}


def _y_expr(df: DataFrame, y: str, kind: str, event_value=None) -> Column:
    dt = _dtypes(df)
    if kind == "continuous":
        return as_double(qcol(y), dt[y])
    if kind == "binary":
        yv = target_values(y, dt[y])
        return F.when(yv.isNull(), F.lit(None)).otherwise((yv == F.lit(event_value)).cast("int"))
    return target_values(y, dt[y]).cast("string")


def _stats_schema(kind: str) -> str:
    return "factor string, fine_id int, bin_id int, splits array<double>, status string, trend string, " \
           "objective double, others boolean"


def _solver(kind: str, cuts: dict[str, list[float]], classes: list[str], monotonic_trend, max_n_prebins,
            min_prebin_size, max_bin_size, min_bin_size, categorical: bool):
    """The per-factor function for ``applyInPandas`` (closure holds only tiny values)."""
    ship_package(SparkSession.getActiveSession())

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        factor = pdf["factor"].iloc[0]
        if categorical:
            k = int(pdf["n_units"].iloc[0])
        else:
            k = len(cuts.get(factor, []))
        if kind == "multiclass":
            wide = pdf.pivot_table(index="fine_id", columns="class", values="n", aggfunc="sum", fill_value=0)
            wide = wide.reindex(columns=classes, fill_value=0)
            fine_ids = wide.index.to_numpy()
            st = np.c_[wide.sum(axis=1).to_numpy(dtype=float), wide.to_numpy(dtype=float)]
        else:
            g = pdf.groupby("fine_id").first().sort_index()
            fine_ids = g.index.to_numpy()
            if kind == "continuous":
                # sums around the factor's mean: squares keep their digits for targets far from zero
                n, s, m2 = g[["n", "sum_y", "m2_y"]].to_numpy(dtype=float).T
                d = s / np.maximum(n, 1) - s.sum() / max(n.sum(), 1)
                st = np.c_[n, n * d, m2 + n * d * d]
            else:
                st = g[["n", "events"]].to_numpy(dtype=float)
        regular = fine_ids <= k
        rids, rst = fine_ids[regular], st[regular]
        if len(rids) == 0:
            starts, sol = [0], S.Solution([0], "INFEASIBLE", "none", 0.0)
            groups = []
        else:
            pre = S.prebin_cart(rst, kind, max_n_prebins, min_prebin_size, max_bin_size)
            if kind == "binary":
                pre = S.merge_pure_prebins(rst, pre)
            bounds = pre + [len(rst)]
            pst = np.array([rst[bounds[i]:bounds[i + 1]].sum(axis=0) for i in range(len(pre))])
            trend = "ascending" if categorical and monotonic_trend == "auto" else monotonic_trend
            sol = S.optimal_groups(pst, kind, trend, max_bin_size, min_bin_size)
            starts = [pre[i] for i in sol.groups]            # start index into regular fine bins
            groups = np.searchsorted(np.array(starts), np.arange(len(rids)), side="right") - 1
        if categorical:
            splits = [float(rids[s]) for s in starts[1:]] if len(rids) else []
        else:
            c = cuts.get(factor, [])
            # fine bin f (>= 1) starts at c[f - 1]
            splits = [float(c[int(rids[s]) - 1]) for s in starts[1:]] if len(rids) else []
        nb = len(splits)
        out_ids = np.empty(len(fine_ids), dtype=np.int64)
        others = int(categorical and (fine_ids == k + 3).any())    # pooled categories: a bin of their own
        out_ids[regular] = groups
        out_ids[fine_ids == k + 3] = nb + 1
        out_ids[fine_ids == k + 1] = nb + others + 1
        out_ids[fine_ids == k + 2] = nb + others + 2
        return pd.DataFrame({"factor": factor, "fine_id": fine_ids.astype(np.int32),
                             "bin_id": out_ids.astype(np.int32), "splits": [splits] * len(fine_ids),
                             "status": sol.status, "trend": sol.trend, "objective": float(sol.objective),
                             "others": bool(others)})

    return fn


def _shifted(stats: DataFrame) -> DataFrame:
    """Add ``__d``: a bin's mean less its factor's mean."""
    w = Window.partitionBy("factor")
    return stats.withColumn("__d", F.coalesce(F.col("sum_y") / F.col("n")
                                              - F.sum("sum_y").over(w) / F.sum("n").over(w), F.lit(0.0)))


def _merged_m2() -> Column:
    """Squared differences around the merged bin's own mean, from ``_shifted`` rows."""
    n, d = F.col("n"), F.col("__d")
    return F.greatest(F.sum("m2_y") + F.sum(n * d * d) - F.sum(n * d) * F.sum(n * d) / F.sum("n"),
                      F.lit(0.0)).alias("m2_y")


def _merge_stats(fine: DataFrame, mapping: DataFrame, kind: str) -> DataFrame:
    j = fine.join(mapping.select("factor", "fine_id", "bin_id"), ["factor", "fine_id"])
    if kind == "continuous":
        return _shifted(j).groupBy("factor", "bin_id").agg(
            F.sum("n").alias("n"), F.sum("sum_y").alias("sum_y"), _merged_m2(),
            F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"), F.sum("zeros").alias("zeros"),
            F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"))
    if kind == "binary":
        return j.groupBy("factor", "bin_id").agg(
            F.sum("n").alias("n"), F.sum("events").alias("events"),
            F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"))
    return j.groupBy("factor", "bin_id", "class").agg(F.sum("n").alias("n"))


def _fine_stats(assigned: DataFrame, kind: str) -> DataFrame:
    if kind == "continuous":
        s = B.continuous_bin_stats(assigned)
    elif kind == "binary":
        s = B.binary_bin_stats(assigned)
    else:
        s = B.multiclass_bin_stats(assigned)
    return s.withColumnRenamed("bin_id", "fine_id")


def _metric_from(per: DataFrame, kind: str) -> DataFrame:
    if kind == "multiclass":
        first_class = per.agg(F.min("class")).first()[0]
        tot = per.groupBy("factor", "position", "category").agg(
            F.sum("n").alias("__n"),
            F.sum(F.when(F.col("class") == first_class, F.col("n")).otherwise(0)).alias("__e"))
        return tot.select("factor", "position", "category", (F.col("__e") / F.col("__n")).alias("metric"),
                          F.col("__n").alias("n"))
    return per.select("factor", "position", "category", (F.col("sum_y") / F.col("n")).alias("metric"), "n")


def _units_by_mass(sized: DataFrame, units: int) -> DataFrame:
    """``sized(factor, ..., metric, n)`` with ``fine_id``: a unit begins at each 1/``units`` of a factor's rows.

    Categories are in metric order and those of one metric stay together, so a
    unit of several metrics holds less than 1/``units`` of the rows besides its
    last metric's. Counted exactly: the units do not depend on the partitioning.
    """
    per_metric = sized.groupBy("factor", "metric").agg(F.sum("n").alias("cnt"))
    total = per_metric.groupBy("factor").agg(F.sum("cnt").alias("__t"))
    begins = (ranked_values(per_metric, "factor", "metric", "cnt").join(F.broadcast(total), "factor")  # one row per factor
              .select("factor", "metric", F.floor(F.col("cum_before") * units / F.col("__t")).cast("int").alias("fine_id")))
    return sized.join(begins, ["factor", "metric"])


def _same_category(left: str, right: str) -> Column:
    """Equal factor and category of two aliases; a missing category equals itself."""
    return (F.col(f"{left}.factor") == F.col(f"{right}.factor")) & \
        F.col(f"{left}.category").eqNullSafe(F.col(f"{right}.category"))


def _categorical_units(df: DataFrame, factors: Sequence[str], y_expr: Column, kind: str,
                       max_candidates: int, first_position: int, cat_cutoff: float | None = None):
    """``(fine stats, unit map)`` for string factors; units are categories in metric order.

    A factor of more than ``max_candidates`` categories has units of about
    equal shares of its rows instead, see :func:`_units_by_mass`.

    With ``cat_cutoff``, categories holding less than that share of a factor's
    rows are pooled into one unit, after the Missing one, that the solver
    leaves alone: it becomes the ``others`` bin.
    """
    parts = [F.struct(F.lit(f).alias("factor"), F.lit(first_position + i).alias("position"),
                      qcol(f).cast("string").alias("category")) for i, f in enumerate(factors)]
    lng = df.select(F.explode(F.array(*parts)).alias("__s"), y_expr.alias("y")).select("__s.*", "y") \
        .filter(F.col("y").isNotNull())
    if kind == "multiclass":
        per = lng.groupBy("factor", "position", "category", F.col("y").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    else:
        yy = F.col("y").cast("double")
        per = lng.groupBy("factor", "position", "category").agg(
            F.count(F.lit(1)).alias("n"), F.sum(yy).alias("sum_y"), (F.var_pop(yy) * F.count(yy)).alias("m2_y"),
            F.min(yy).alias("min_y"), F.max(yy).alias("max_y"), F.count_if(yy == 0).alias("zeros"))
    per = materialize(per)   # one row per (factor, category[, class]): read by every step below
    pooled = None
    if cat_cutoff:
        cat_n = per.groupBy("factor", "category").agg(F.sum("n").alias("__c"))
        tot = cat_n.groupBy("factor").agg(F.sum("__c").alias("__t"))
        pooled = (cat_n.join(F.broadcast(tot), "factor")    # one row per factor
                  .select("factor", "category",
                          F.when(F.col("category").isNotNull() & (F.col("__c") < cat_cutoff * F.col("__t")),
                                 F.lit(OTHERS)).otherwise(F.col("category")).alias("__unit")))
        keys = ["factor", "position", "__unit"] + (["class"] if kind == "multiclass" else [])
        sums = [F.sum("n").alias("n")] if kind == "multiclass" else [
            F.sum("n").alias("n"), F.sum("sum_y").alias("sum_y"), _merged_m2(),
            F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"), F.sum("zeros").alias("zeros")]
        with_unit = per.alias("p").join(pooled.alias("u"), _same_category("p", "u")).select("p.*", "u.__unit")
        per = materialize((with_unit if kind == "multiclass" else _shifted(with_unit)).groupBy(*keys).agg(*sums)
                          .withColumnRenamed("__unit", "category"))
    metric_tbl = _metric_from(per, kind)
    # units: categories in (metric, category) order; null category -> Missing unit
    rest = F.col("category") == OTHERS if pooled is not None else F.lit(False)
    nonnull = metric_tbl.filter(F.col("category").isNotNull() & ~rest)
    counts = nonnull.groupBy("factor").count()
    # decided per factor: one row per factor reaches the driver
    many = [r["factor"] for r in counts.filter(F.col("count") > max_candidates).collect()]
    w = Window.partitionBy("factor").orderBy("metric", "category")
    units = nonnull.filter(~F.col("factor").isin(many)).withColumn("fine_id", F.dense_rank().over(w) - 1)
    if many:
        units = units.unionByName(_units_by_mass(nonnull.filter(F.col("factor").isin(many)), max_candidates))
    nunits = units.groupBy("factor").agg(F.max("fine_id").alias("n_units"))
    unit_map = units.select("factor", "category", F.col("fine_id").cast("int").alias("fine_id"))
    unit_map = unit_map.join(nunits, "factor").unionByName(
        metric_tbl.filter(F.col("category").isNull() | rest).join(nunits, "factor", "left")
        .withColumn("n_units", F.coalesce("n_units", F.lit(0)))
        .select("factor", "category", (F.col("n_units") + F.when(F.col("category").isNull(), 2).otherwise(3))
                .cast("int").alias("fine_id"), "n_units"))
    joined = per.alias("p").join(unit_map.alias("u"), _same_category("p", "u")).select("p.*", "fine_id", "n_units")
    if pooled is not None:
        # labels list the original categories: map each one through its pooled unit
        unit_map = (pooled.join(unit_map.withColumnRenamed("category", "__unit"), ["factor", "__unit"])
                    .select("factor", "category", "fine_id", "n_units"))
    if kind == "multiclass":
        fine = joined.groupBy("factor", "fine_id", "class").agg(F.sum("n").alias("n"), F.first("n_units").alias("n_units"))
    elif kind == "binary":
        fine = joined.groupBy("factor", "fine_id").agg(
            F.sum("n").alias("n"), F.sum("sum_y").cast("long").alias("events"),
            F.lit(None).cast("double").alias("min_x"), F.lit(None).cast("double").alias("max_x"),
            F.first("n_units").alias("n_units"))
    else:
        fine = _shifted(joined).groupBy("factor", "fine_id").agg(
            F.sum("n").alias("n"), F.sum("sum_y").alias("sum_y"), _merged_m2(),
            F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"), F.sum("zeros").alias("zeros"),
            F.lit(None).cast("double").alias("min_x"), F.lit(None).cast("double").alias("max_x"),
            F.first("n_units").alias("n_units"))
    return fine, unit_map


def _category_labels(unit_map: DataFrame, mapping: DataFrame, label_values: int = 10) -> DataFrame:
    """``(factor, bin_id, bin)``: a bin's categories (first ``label_values`` by name, then '...')."""
    from binscope.operators.longform import top_k
    cats = (unit_map.filter(F.col("category").isNotNull())
            .join(mapping.select("factor", "fine_id", "bin_id"), ["factor", "fine_id"]))
    first = top_k(cats, ["factor", "bin_id"], [F.col("category").asc()], label_values, ["category"])
    n = cats.groupBy("factor", "bin_id").agg(F.count(F.lit(1)).alias("__n"))
    lab = first.groupBy("factor", "bin_id").agg(F.array_sort(F.collect_list("category")).alias("__c")).join(
        n, ["factor", "bin_id"])
    return lab.select("factor", "bin_id", F.concat(
        F.lit("["), F.array_join("__c", ", "),
        F.when(F.col("__n") > label_values, F.lit(", ...")).otherwise(F.lit("")), F.lit("]")).alias("__label"))


def optimal_binning(df: DataFrame, factors: Sequence[str], y: str, kind: str = "continuous", *,
                    categorical: Sequence[str] | None = None, numeric: Sequence[str] = (), monotonic_trend: str | None = "auto",
                    max_n_prebins: int = S.MAX_N_PREBINS, min_prebin_size: float = S.MIN_PREBIN_SIZE,
                    max_bin_size: float | None = None, min_bin_size: float | None = None,
                    max_candidates: int = MAX_CANDIDATES, event_value=None, cat_cutoff: float | None = None,
                    drop_missing_x: bool = False, label_length: int | None = None) -> BinningResult:
    """E6-E9 + E18: optimal bins for every factor against ``y``.

    ``kind``: continuous (regression), binary or multiclass.  String factors (or
    those listed in ``categorical``) are binned as categories, but strings
    listed in ``numeric`` as the numbers they hold.  Rows with a
    missing target are left out; ``drop_missing_x`` also drops rows whose factor
    is missing (the binning report), else they form the Missing bin.
    """
    dt = _dtypes(df)
    cat = [f for f in factors if (categorical and f in categorical)
           or (isinstance(dt[f], T.StringType) and f not in numeric)]
    num = [f for f in factors if f not in cat]
    if kind == "binary" and event_value is None:
        event_value = _event_value(df, y)
    yx = _y_expr(df, y, kind, event_value)
    data = df.filter(yx.isNotNull())
    if kind == "continuous":
        data = data.filter(~F.isnan(yx.cast("double")) & ~yx.isin(float("inf"), float("-inf")))
    pos = {f: i for i, f in enumerate(factors)}
    classes = []
    if kind == "multiclass":
        found = data.select(yx.alias("c")).distinct().limit(MAX_CLASSES + 1).collect()
        if len(found) > MAX_CLASSES:
            raise ValueError(f"target {y!r} has more than {MAX_CLASSES} classes: not a classification target")
        classes = sorted(r[0] for r in found)

    fine_parts, maps, cat_maps = [], [], None
    cuts = {}
    if num:
        cuts = candidate_cuts(data, num, max_candidates)
        a = B.assign_bins(data, num, cuts, y_expr=_y_expr(data, y, kind, event_value))
        if drop_missing_x:
            a = a.filter(F.col("x").isNotNull())
        fine_num = materialize(_fine_stats(a, kind))
        fn = _solver(kind, cuts, classes, monotonic_trend, max_n_prebins, min_prebin_size, max_bin_size,
                     min_bin_size, categorical=False)
        m = fine_num.groupBy("factor").applyInPandas(fn, _stats_schema(kind))
        fine_parts.append(fine_num)
        maps.append(materialize(m))
    if cat:
        fine_cat, unit_map = _categorical_units(data, cat, _y_expr(data, y, kind, event_value), kind,
                                                max_candidates, 0, cat_cutoff)
        if drop_missing_x:
            fine_cat = fine_cat.filter(F.col("fine_id") != F.col("n_units") + 2)
        fine_cat = materialize(fine_cat)
        fn = _solver(kind, {}, classes, monotonic_trend, max_n_prebins, min_prebin_size, max_bin_size,
                     min_bin_size, categorical=True)
        m = materialize(fine_cat.groupBy("factor").applyInPandas(fn, _stats_schema(kind)))
        fine_parts.append(fine_cat.drop("n_units"))
        maps.append(m)
        cat_maps = (unit_map, m)
    fine = fine_parts[0] if len(fine_parts) == 1 else fine_parts[0].unionByName(fine_parts[1])
    mapping = maps[0] if len(maps) == 1 else maps[0].unionByName(maps[1])

    posdf = df.sparkSession.createDataFrame([(f, i, "categorical" if f in cat else "numerical")
                                             for f, i in pos.items()], "factor string, position int, dtype string")
    splits = (mapping.groupBy("factor").agg(F.first("splits").alias("splits"), F.first("status").alias("status"),
                                            F.first("trend").alias("trend"), F.first("objective").alias("objective"),
                                            F.bool_or("others").alias("others"))
              .join(F.broadcast(posdf), "factor"))  # one row per factor
    sk = B.skeleton_from_splits(splits, label_length)
    if cat_maps is not None:
        labels = _category_labels(*cat_maps)
        sk = (sk.join(labels, ["factor", "bin_id"], "left")
              .withColumn("bin", F.coalesce(F.col("__label"), F.col("bin"))).drop("__label"))
        sk = sk.join(F.broadcast(posdf.select("factor", "dtype")), "factor").withColumn(
            "lo", F.when(F.col("dtype") == "categorical", F.lit(None)).otherwise(F.col("lo"))).withColumn(
            "hi", F.when(F.col("dtype") == "categorical", F.lit(None)).otherwise(F.col("hi"))).drop("dtype")
    merged = _merge_stats(fine, mapping, kind)
    if kind == "continuous":
        table = B.continuous_table_from_stats(merged, sk)
        summ = B.continuous_summary(table)
    elif kind == "binary":
        table = B.binary_table_from_stats(merged, sk)
        summ = B.binary_summary(table)
    else:
        cls = merged.select("factor", "class").distinct()
        table = B.multiclass_table_from_stats(merged, sk, cls)
        summ = B.multiclass_summary(table)
    info = splits.select("factor", "dtype", "status", "splits", F.col("trend").alias("trend_constraint"))
    summary = summ.join(info, "factor")
    return BinningResult(kind, splits.select("factor", "position", "dtype", "splits", "status", "trend",
                                             F.size("splits").alias("n_splits")), table, summary)
