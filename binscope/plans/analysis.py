"""The factor-analysis and binning-report plans.

Each plan composes the operators: clean (B), types (C), optimal binning (E),
rank correlations and importances (G).  Everything stays a DataFrame; the only
values brought to the driver are the type map (one entry per column), the
candidate cuts (at most 255 per factor) and a few counts used for sizing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binscope.operators import factors as G
from binscope.operators import ranks as R
from binscope.operators import series as FS
from binscope.operators.binning import optimal as O
from binscope.operators.binning import solve as S
from binscope.operators.binning import tables as B
from binscope.operators.binning.quality import quality_score
from binscope.operators.clean import check_roles, fill_null_by_types
from binscope.operators.longform import to_long
from binscope.operators.types import TYPE_NAMES, get_data_types
from binscope.session import materialize


def type_map_of(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, list[str]]:
    """{type: [columns]} in schema order (one small row per column reaches the driver)."""
    rows = get_data_types(df, columns).orderBy("position").collect()
    out: dict[str, list[str]] = {t: [] for t in TYPE_NAMES}
    for r in rows:
        out[r.data_type].append(r.column_name)
    return out


def binning_factors(x_factors: Sequence[str], type_map: Mapping[str, Sequence[str]]) -> list[str]:
    """The factors of X that are Numeric, in X order."""
    num = set(type_map.get("Numeric", []))
    return [x for x in x_factors if x in num]


def binning_factor_table(types_long: DataFrame, x_factors: Sequence[str]) -> DataFrame:
    """E1 as a table: ``(factor, position)`` for the Numeric factors of X, position = place in X."""
    order = types_long.sparkSession.createDataFrame([(x, i) for i, x in enumerate(x_factors)],
                                                    "factor string, position int")
    num = types_long.filter(F.col("data_type") == "Numeric").select(F.col("column_name").alias("factor"))
    return order.join(num, "factor")   # both sides: one row per column


def _string_factors(df: DataFrame, xs: Sequence[str], type_map: Mapping[str, Sequence[str]]) -> list[str]:
    """Factors binned as categories: strings that the type map does not call Numeric."""
    dt = {f.name: f.dataType for f in df.schema.fields}
    return [x for x in xs if isinstance(dt[x], T.StringType) and x not in type_map.get("Numeric", [])]


def _bins_array(table: DataFrame) -> DataFrame:
    return B.bin_arrays(table, "count").select("factor", "bins")


def fit_regression(df: DataFrame, x_factors: Sequence[str], y_factor: str,
                   type_map: Mapping[str, Sequence[str]] | None = None,
                   binning_fit_params: Mapping | None = None, n_trees: int = G.DEFAULT_TREES,
                   importance_type: str = "split") -> DataFrame:
    """One row per factor, ordered by feature importance (then quality score, name)."""
    xs = check_roles(df, x_factors, y_factor)
    if type_map is None:
        type_map = type_map_of(df, [*xs, y_factor])
    # a narrow projection of the input: recomputed from the (pruned) scan, never copied
    filled = fill_null_by_types(df, xs, y_factor, type_map)
    params = dict(binning_fit_params or {})
    numerical = [x for x in xs if x not in _string_factors(filled, xs, type_map)]
    res = O.optimal_binning(filled, xs, y_factor, "continuous", **{"numeric": numerical, **params})
    table = materialize(res.table)
    if numerical:
        lng = to_long(filled, numerical, target=y_factor)
        corr = R.rank_correlations(lng)   # one pre-aggregation of (factor, x, y) for both
    else:
        corr = df.sparkSession.createDataFrame([], "factor string, kendall_tau_b double, spearman double")
    raw = G.factor_stats(df, xs, numerical).select("factor", "missing", "std")
    tot = table.filter(F.col("kind") == "totals").select("factor", F.col("min_x").alias("min_value"),
                                                          F.col("max_x").alias("max_value"))
    summ = B.continuous_summary(table).join(res.splits.select("factor", "dtype"), "factor")
    q = quality_score(table, "continuous")
    imp = G.importance_regression(filled, xs, y_factor, type_map, n_trees, importance_type)
    out = (summ.join(corr, "factor", "left").join(tot, "factor").join(_bins_array(table), "factor")
           .join(raw, "factor").join(q, "factor").join(imp.select("factor", "feature_importance"), "factor", "left"))
    num = F.col("dtype") == "numerical"
    return rank_factors(out.select(
        F.col("factor").alias("name"), "dtype", "n_bins", "monotonic_trend",
        F.when(num, F.coalesce(F.col("kendall_tau_b"), F.lit(0.0))).otherwise(F.lit(0.0))
         .alias("rank_order_correlation(kendalltau)"),
        F.when(num, F.coalesce(F.col("spearman"), F.lit(0.0))).otherwise(F.lit(0.0))
         .alias("rank_order_correlation(spearmanr)"),
        "min_value", "max_value", "bins", "missing",
        F.when(num, F.col("std")).otherwise(F.lit(0.0)).alias("std"),
        "woe", "quality_score", "feature_importance"), ["quality_score"])


def fit_classification(df: DataFrame, x_factors: Sequence[str], y_factor: str,
                       type_map: Mapping[str, Sequence[str]] | None = None,
                       binning_fit_params: Mapping | None = None, n_trees: int = G.DEFAULT_TREES,
                       importance_type: str = "split") -> DataFrame:
    """One row per factor; iv / gini only for a binary target."""
    xs = check_roles(df, x_factors, y_factor)
    if type_map is None:
        type_map = type_map_of(df, [*xs, y_factor])
    # a narrow projection of the input: recomputed from the (pruned) scan, never copied
    filled = fill_null_by_types(df, xs, y_factor, type_map)
    kind = O.target_kind(filled, y_factor, "classification")
    numerical = [x for x in xs if x not in _string_factors(filled, xs, type_map)]
    res = O.optimal_binning(filled, xs, y_factor, kind, **{"numeric": numerical, **dict(binning_fit_params or {})})
    table = materialize(res.table)
    raw = G.factor_stats(df, xs, numerical)
    if kind == "binary":
        summ = B.binary_summary(table)
        arr = B.bin_arrays(table, "event_rate")
        rates = arr.select("factor", "bins", F.col("event_rates"))
        q = quality_score(table, kind)
        metrics = ["iv", "js", "gini"]
    else:
        summ = B.multiclass_summary(table)
        rates = _multiclass_rates(table)
        q = quality_score(table, kind, summ)
        metrics = ["js"]
    imp = G.importance_classification(filled, xs, y_factor, type_map, n_trees, importance_type)
    out = (summ.join(res.splits.select("factor", "dtype"), "factor").join(rates, "factor").join(raw, "factor")
           .join(q, "factor").join(imp.select("factor", "feature_importance"), "factor", "left"))
    return rank_factors(out.select(
        F.col("factor").alias("name"), "dtype", "n_bins", "monotonic_trend", "min_value", "max_value",
        "event_rates", "bins", "missing",
        F.when(F.col("dtype") == "numerical", F.col("std")).otherwise(F.lit(0.0)).alias("std"),
        *metrics, "quality_score", "feature_importance"), ["quality_score", "js"])


def _multiclass_rates(table: DataFrame) -> DataFrame:
    """Per factor: 'Class[i]]:c=[r1, r2, ...]' joined with ' , ', plus the bin labels."""
    reg = table.filter(F.col("kind") == "regular")
    per_class = (reg.groupBy("factor", "class")
                 .agg(F.array_sort(F.collect_list(F.struct("bin_id", "event_rate"))).alias("__r")))
    cls_idx = per_class.select("factor", "class").distinct()
    from pyspark.sql import Window
    cls_idx = cls_idx.withColumn("__i", F.row_number().over(Window.partitionBy("factor").orderBy("class")) - 1)
    s = per_class.join(cls_idx, ["factor", "class"]).select(
        "factor", "__i", F.format_string("Class[%d]]:%s=[%s]", F.col("__i"), F.col("class"),
                                         F.array_join(F.transform("__r", lambda r: F.format_string(
                                             "%.6f", r["event_rate"])), ", ")).alias("__s"))
    rates = s.groupBy("factor").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__s"))),
                                                             lambda r: r["__s"]), " , ").alias("event_rates"))
    labels = (reg.select("factor", "bin_id", "bin").distinct().groupBy("factor")
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("bin_id", "bin"))), lambda r: r["bin"])
                   .alias("bins")))
    return rates.join(labels, "factor")


def rank_factors(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Round numbers to 3 digits, order by importance, then the quality keys, then name."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    out = df.select(*[F.round(F.col(f"`{c}`"), 2 if c == "missing" else 3).alias(c) if c in num
                      else F.col(f"`{c}`") for c in df.columns])
    order = [F.col("feature_importance").desc_nulls_last()] + [F.col(b).desc_nulls_last() for b in by] + \
        [F.col("name")]
    return out.orderBy(*order)


def binning_summary(df: DataFrame, x_factors: Sequence[str], y_factor: str, estimator: str = "regression",
                    **params) -> DataFrame:
    """One row per factor: dtype, status, n_bins and the metrics of its table (+ quality score)."""
    kind = O.target_kind(df, y_factor, estimator)
    res = O.optimal_binning(df, x_factors, y_factor, kind, **params)
    table = materialize(res.table)
    summ = materialize(res.summary)
    q = quality_score(table, kind, summ)
    return summ.join(q, "factor")


def binning_analysis(df: DataFrame, x_factors: Sequence[str], y_factor: str, estimator: str = "regression",
                     type_map: Mapping[str, Sequence[str]] | None = None,
                     binning_fit_params: Mapping | None = None) -> dict[str, DataFrame]:
    """Binning report over the Numeric factors of X: tables, summary and chart series.

    Regression uses the report's settings (60 pre-bins of at least 1 %, bins of at
    most 20 %, trend auto); classification uses the library defaults.  Rows
    with a missing factor or target are dropped per factor.
    """
    xs = check_roles(df, x_factors, y_factor)
    if type_map is None:
        type_map = type_map_of(df, [*xs, y_factor])
    factors = binning_factors(xs, type_map)
    if not factors:
        raise ValueError("no Numeric factor to bin")
    kind = O.target_kind(df, y_factor, estimator)
    params = dict(binning_fit_params or {})
    if kind == "continuous":
        params = {**dict(max_n_prebins=S.REPORT_MAX_N_PREBINS, min_prebin_size=S.REPORT_MIN_PREBIN_SIZE,
                         max_bin_size=S.REPORT_MAX_BIN_SIZE, monotonic_trend="auto"), **params}
    # every factor here is Numeric by the type map: strings are read as the numbers they hold
    res = O.optimal_binning(df, factors, y_factor, kind, drop_missing_x=True, **{"numeric": factors, **params})
    table = materialize(res.table)
    out = {"table": table, "summary": res.summary, "splits": res.splits}
    if kind == "multiclass":
        out["series"] = FS.multiclass_series(table)
    else:
        metric = "mean" if kind == "continuous" else "event_rate"
        out["series"] = FS.bin_series(table, metric)
        out["actual_scale"] = FS.actual_scale_series(table, metric)
        if kind == "binary":
            out["woe_series"] = FS.bin_series(table, "woe")
    return out
