"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Results are rounded (doubles to 6 decimals, large sums to 4) so that the same
numbers computed in a different summation order compare equal with the SQL
oracle in :mod:`binscope.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binscope.operators import profile as P
from binscope.operators import sketches as K
from binscope.operators import types as C
from binscope.plans import fixtures as X
from binscope.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6, overrides: dict[str, int] | None = None) -> DataFrame:
    """Round every double column (per-column digits in ``overrides``)."""
    overrides = overrides or {}
    return df.select(*[
        F.round(F.col(f.name), overrides.get(f.name, digits)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])


# ---------------------------------------------------------------------------
# C: types
# ---------------------------------------------------------------------------
for _t in ("lineitem", "orders", "documents", "part", "events", "conversations", "labels"):
    def _q(spark, d, _t=_t):
        return C.get_data_types(X.table(spark, d, _t))
    register(f"get_data_types_{_t}")(_q)


@register("get_data_types_nulls_orders")
def q_types_nulls(spark, d):
    return C.get_data_types(X.nulls_orders(spark, d))


@register("numeric_columns_documents")
def q_numeric_columns(spark, d):
    return C.numeric_columns(X.table(spark, d, "documents"))


@register("invert_type_map_lineitem")
def q_invert(spark, d):
    return C.invert_type_map(C.get_data_types(X.table(spark, d, "lineitem")))


@register("guess_roles_events")
def q_guess_roles(spark, d):
    return C.guess_roles(C.get_data_types(X.table(spark, d, "events")))


@register("role_candidates_lineitem")
def q_roles(spark, d):
    return C.role_candidates(C.get_data_types(X.table(spark, d, "lineitem")), y="l_extendedprice")


# ---------------------------------------------------------------------------
# D: profile
# ---------------------------------------------------------------------------
@register("profile_table")
def q_profile_table(spark, d):
    return rounded(P.profile_table(X.nulls_orders(spark, d)))


@register("profile_common")
def q_profile_common(spark, d):
    return rounded(P.profile_common(X.nulls_orders(spark, d)))


@register("profile_common_lineitem")
def q_profile_common_li(spark, d):
    return rounded(P.profile_common(X.table(spark, d, "lineitem")))


@register("profile_numeric")
def q_profile_numeric(spark, d):
    return rounded(P.profile_numeric(X.table(spark, d, "lineitem"), X.LINEITEM_NUMERIC),
                   overrides={"sum": 2, "mean": 4, "std": 4, "variance": 2, "cv": 6})


@register("profile_moments")
def q_profile_moments(spark, d):
    return rounded(P.profile_moments(X.table(spark, d, "lineitem"), X.LINEITEM_NUMERIC))


@register("profile_quantiles")
def q_profile_quantiles(spark, d):
    return rounded(P.profile_quantiles(X.table(spark, d, "lineitem"), X.LINEITEM_NUMERIC))


@register("quantile_sketch_error")
def q_quantile_sketch(spark, d):
    """Sketches per month, merged over the months; every quantile's rank within the stated error."""
    li = X.table(spark, d, "lineitem").withColumn("month", F.trunc("l_shipdate", "month"))
    merged = K.merge_sketches(K.quantile_sketches(li, X.LINEITEM_NUMERIC, ["month"], error=0.01))
    errors = K.rank_errors(li, K.sketch_quantiles(materialize(merged), P.QUANTILES))
    return errors.select("column_name", "position", "prob", "n", (F.col("rank_error") <= 0.01).alias("within"))


@register("profile_quantiles_nulls")
def q_profile_quantiles_nulls(spark, d):
    return rounded(P.profile_quantiles(X.nulls_orders(spark, d), ["o_totalprice", "o_custkey"]))


@register("profile_extremes")
def q_profile_extremes(spark, d):
    return rounded(P.profile_extremes(X.table(spark, d, "lineitem"), X.LINEITEM_NUMERIC))


@register("profile_top_values")
def q_profile_top_values(spark, d):
    return rounded(P.profile_top_values(X.nulls_orders(spark, d),
                                        ["o_orderstatus", "o_orderpriority", "o_custkey"]))


@register("profile_histogram")
def q_profile_histogram(spark, d):
    return rounded(P.profile_histogram(X.table(spark, d, "lineitem"), X.LINEITEM_NUMERIC, bins=10))


@register("profile_categorical")
def q_profile_categorical(spark, d):
    return rounded(P.profile_categorical(X.table(spark, d, "lineitem"),
                                         ["l_returnflag", "l_linestatus", "l_linenumber"]))


@register("profile_datetime")
def q_profile_datetime(spark, d):
    return rounded(P.profile_datetime(X.table(spark, d, "lineitem"), ["l_shipdate"]))


@register("profile_boolean")
def q_profile_boolean(spark, d):
    return rounded(P.profile_boolean(X.bool_lineitem(spark, d), ["is_returned", "big_discount"]))


@register("profile_text")
def q_profile_text(spark, d):
    return rounded(P.profile_text(X.table(spark, d, "documents"), ["text", "lang"]))


@register("profile_alerts")
def q_profile_alerts(spark, d):
    return P.profile_alerts(X.nulls_orders(spark, d))


@register("profile_type_counts")
def q_profile_type_counts(spark, d):
    return P.profile_type_counts(X.table(spark, d, "lineitem"))


@register("word_frequencies")
def q_word_frequencies(spark, d):
    return P.word_frequencies(X.table(spark, d, "documents"), ["text"])


@register("word_frequencies_tokens")
def q_word_frequencies_tokens(spark, d):
    return P.word_frequencies(X.table(spark, d, "conversations"), ["text"], tokenizer="tokens")





# ---------------------------------------------------------------------------
# E: binning tables for given splits, summaries, arrays
# ---------------------------------------------------------------------------
from binscope.operators.binning import tables as B  # noqa: E402

_CONT_ROUND = {"sum": 2, "std": 4, "mean": 4, "woe": 4, "iv": 4}


def _reg_table(spark, d, label_length=None):
    li = X.table(spark, d, "lineitem")
    return B.binning_table_continuous(li, list(X.REG_SPLITS), "l_extendedprice", X.REG_SPLITS,
                                      label_length=label_length)


def _bin_table(spark, d):
    return B.binning_table_binary(X.bin_lineitem(spark, d), list(X.BIN_SPLITS), "y", X.BIN_SPLITS)


def _multi_table(spark, d):
    return B.binning_table_multiclass(X.table(spark, d, "lineitem"), list(X.BIN_SPLITS), "l_returnflag",
                                      X.BIN_SPLITS)


@register("assign_bin")
def q_assign_bin(spark, d):
    li = X.table(spark, d, "lineitem")
    return B.assign_bins(li, list(X.BIN_SPLITS), X.BIN_SPLITS, y="l_extendedprice")


@register("bin_labels")
def q_bin_labels(spark, d):
    return _reg_table(spark, d, label_length=9).select("factor", "bin_id", "bin")


@register("binning_table_continuous")
def q_table_cont(spark, d):
    return rounded(_reg_table(spark, d), overrides=_CONT_ROUND)


@register("binning_table_binary")
def q_table_bin(spark, d):
    return rounded(_bin_table(spark, d))


@register("binning_table_multiclass")
def q_table_multi(spark, d):
    return rounded(_multi_table(spark, d))


@register("monotonic_trend")
def q_trend(spark, d):
    return B.monotonic_trend(_reg_table(spark, d), "mean")


@register("iv_js_gini")
def q_iv_js_gini(spark, d):
    return rounded(B.binary_summary(_bin_table(spark, d)))


@register("continuous_summary")
def q_cont_summary(spark, d):
    return rounded(B.continuous_summary(_reg_table(spark, d)), overrides={"woe": 4, "iv": 4})


@register("multiclass_summary")
def q_multi_summary(spark, d):
    return rounded(B.multiclass_summary(_multi_table(spark, d)))


@register("event_rates")
def q_event_rates(spark, d):
    a = B.bin_arrays(_bin_table(spark, d), "event_rate")
    return a.select("factor", F.array_join("bins", "|").alias("bins"),
                    F.array_join(F.transform("event_rates", lambda v: F.format_string("%.6f", v)), "|")
                    .alias("event_rates"))


# ---------------------------------------------------------------------------
# Rank correlations
# ---------------------------------------------------------------------------
from binscope.operators import ranks as R  # noqa: E402
from binscope.operators.longform import to_long  # noqa: E402

RANK_X = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _rank_long(spark, d, factors, y, table="lineitem"):
    return to_long(X.table(spark, d, table), factors, target=y)


@register("spearman")
def q_spearman(spark, d):
    return rounded(R.spearman(_rank_long(spark, d, RANK_X, "l_extendedprice")), 8)


@register("kendall_tau_b")
def q_kendall(spark, d):
    return rounded(R.kendall_tau_b(_rank_long(spark, d, RANK_X, "l_extendedprice")), 8)


@register("kendall_tau_b_supplier")
def q_kendall_supplier(spark, d):
    return rounded(R.kendall_tau_b(_rank_long(spark, d, ["s_nationkey"], "s_acctbal", "supplier")), 8)


@register("kendall_tau_b_ties")
def q_kendall_ties(spark, d):
    return rounded(R.kendall_tau_b(_rank_long(spark, d, ["l_linenumber", "l_quantity"], "l_tax")), 8)


@register("kendall_tau_b_bucketed")
def q_kendall_bucketed(spark, d):
    # small local groups force the bucketed path (within x, within y, bucket grid)
    return rounded(R.kendall_tau_b(_rank_long(spark, d, ["l_linenumber", "l_quantity"], "l_tax"),
                                   local_pairs=40), 8)


# ---------------------------------------------------------------------------
# Optimal binning (no SQL form: rows-only checks + tests)
# ---------------------------------------------------------------------------
from binscope.operators.binning import optimal as O  # noqa: E402
from binscope.operators.binning import solve as S  # noqa: E402
from binscope.operators import series as FS  # noqa: E402
from binscope.plans import analysis as A  # noqa: E402

_REPORT = dict(max_n_prebins=S.REPORT_MAX_N_PREBINS, min_prebin_size=S.REPORT_MIN_PREBIN_SIZE,
               max_bin_size=S.REPORT_MAX_BIN_SIZE)


def _summary_out(res):
    s = res.summary
    return rounded(s.select(*[c for c in s.columns if c not in ("splits", "trend_constraint")],
                            F.array_join(F.transform("splits", lambda v: F.format_string("%.6f", v)), "|")
                            .alias("splits")))


@register("candidate_bins")
def q_candidate_bins(spark, d):
    li = X.table(spark, d, "lineitem")
    cuts = O.candidate_cuts(li, X.BIN_X)
    a = B.assign_bins(li, X.BIN_X, cuts, y="l_extendedprice")
    return rounded(B.continuous_bin_stats(a).withColumnRenamed("bin_id", "fine_id"), 4, {"m2_y": -3})


@register("optimal_binning_continuous")
def q_opt_cont(spark, d):
    li = X.table(spark, d, "lineitem")
    return _summary_out(O.optimal_binning(li, ["l_quantity", "l_discount", "l_tax", "l_linenumber"],
                                          "l_extendedprice", "continuous", **_REPORT))


@register("optimal_binning_binary")
def q_opt_bin(spark, d):
    return _summary_out(O.optimal_binning(X.bin_lineitem(spark, d), X.BIN_X, "y", "binary"))


@register("optimal_binning_multiclass")
def q_opt_multi(spark, d):
    return _summary_out(O.optimal_binning(X.table(spark, d, "lineitem"), X.BIN_X, "l_returnflag", "multiclass"))


@register("optimal_binning_categorical")
def q_opt_cat(spark, d):
    return _summary_out(O.optimal_binning(X.bin_documents(spark, d), ["lang", "source", "n_chars"], "quality",
                                          "binary"))


@register("optimal_binning_table")
def q_opt_table(spark, d):
    res = O.optimal_binning(X.bin_lineitem(spark, d), X.BIN_X, "y", "binary")
    return rounded(res.table)


@register("binning_summary")
def q_binning_summary(spark, d):
    s = A.binning_summary(X.bin_lineitem(spark, d), X.BIN_X, "y", "classification")
    return rounded(s.drop("splits", "trend_constraint"))


@register("quality_score")
def q_quality(spark, d):
    return rounded(A.binning_summary(X.table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"],
                                     "l_extendedprice", "regression", **_REPORT)
                   .select("factor", "quality_score"))


@register("binning_analysis")
def q_binning_analysis(spark, d):
    a = A.binning_analysis(X.table(spark, d, "lineitem"), X.REG_X, "l_extendedprice", "regression")
    return _summary_out(type("R", (), {"summary": a["summary"]}))


@register("binning_analysis_series")
def q_binning_analysis_series(spark, d):
    a = A.binning_analysis(X.table(spark, d, "lineitem"), X.REG_X, "l_extendedprice", "regression")
    return rounded(a["series"], 4)


# ---------------------------------------------------------------------------
# F: chart series over fixed-split tables (SQL-checked)
# ---------------------------------------------------------------------------
@register("bin_series")
def q_bin_series(spark, d):
    return rounded(FS.bin_series(_bin_table(spark, d), "event_rate", show_bin_labels=True, label_length=10))


@register("actual_scale_series")
def q_actual_scale(spark, d):
    return rounded(FS.actual_scale_series(_reg_table(spark, d), "mean"), 4)


@register("multiclass_series")
def q_multiclass_series(spark, d):
    return rounded(FS.multiclass_series(_multi_table(spark, d), add_special=False, add_missing=False))


# ---------------------------------------------------------------------------
# G: factor statistics, encodings, importances, factor analysis
# ---------------------------------------------------------------------------
from binscope.operators import factors as GF  # noqa: E402


@register("factor_stats")
def q_factor_stats(spark, d):
    return rounded(GF.factor_stats(X.nulls_orders(spark, d),
                                   ["o_totalprice", "o_custkey", "o_orderpriority", "o_orderstatus"],
                                   ["o_totalprice", "o_custkey"]), 4)


@register("label_encode")
def q_label_encode(spark, d):
    return GF.label_encode(X.nulls_orders(spark, d), ["o_orderpriority", "o_orderstatus", "o_custkey"])


@register("tfidf")
def q_tfidf(spark, d):
    return rounded(GF.tfidf(X.table(spark, d, "documents"), "doc_id", "text"), 8)


@register("join_tokens")
def q_join_tokens(spark, d):
    return GF.join_tokens(X.table(spark, d, "conversations").select("conv_id", "turn", "text"), ["text"])


@register("importance_regression")
def q_imp_reg(spark, d):
    li = X.table(spark, d, "lineitem")
    tm = A.type_map_of(li, X.REG_X + ["l_extendedprice"])
    return GF.importance_regression(li, X.REG_X, "l_extendedprice", tm)


@register("importance_classification")
def q_imp_cls(spark, d):
    li = X.table(spark, d, "lineitem")
    tm = A.type_map_of(li, X.BIN_X + ["l_returnflag"])
    return GF.importance_classification(li, X.BIN_X, "l_returnflag", tm)


def _fa_out(df):
    arr = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return df.select(*[F.array_join(F.transform(F.col(c), lambda v: v.cast("string")), "|").alias(c)
                       if c in arr else F.col(f"`{c}`") for c in df.columns])


@register("factor_analysis_regression")
def q_fa_reg(spark, d):
    return _fa_out(A.fit_regression(X.table(spark, d, "lineitem"), X.REG_X, "l_extendedprice"))


@register("factor_analysis_classification")
def q_fa_cls(spark, d):
    return _fa_out(A.fit_classification(X.table(spark, d, "lineitem"), X.BIN_X, "l_returnflag"))


@register("factor_analysis_binary")
def q_fa_bin(spark, d):
    return _fa_out(A.fit_classification(X.bin_documents(spark, d), ["n_chars", "lang", "source"], "quality"))
FLAGSHIP = "binning_table_continuous"


# ---------------------------------------------------------------------------
# B: cleaning; H: bands; I: splits; A: sources and sinks
# ---------------------------------------------------------------------------
from binscope.operators import clean as CL  # noqa: E402
from binscope.operators.bands import quartile_bands  # noqa: E402
from binscope.operators.split import split_by_datetime, split_by_samples  # noqa: E402
from binscope.sources import readers as RD  # noqa: E402
from binscope.session import scratch_dir  # noqa: E402

_ORD_TYPES = {"Numeric": ["o_orderkey", "o_custkey", "o_totalprice"], "Categorical": ["o_orderstatus",
              "o_orderpriority"], "DateTime": ["o_orderdate"], "Text": [], "Id": [], "Unsupported": []}


@register("select_factors")
def q_select_factors(spark, d):
    return CL.select_factors(X.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"],
                             "l_extendedprice")


@register("drop_null_pair")
def q_drop_null_pair(spark, d):
    return CL.drop_null_pair(X.nulls_orders(spark, d), "o_totalprice", "o_custkey")


@register("drop_null_rows")
def q_drop_null_rows(spark, d):
    return CL.drop_null_rows(X.nulls_orders(spark, d), ["o_totalprice", "o_orderpriority"], "o_custkey")


@register("fill_null_by_types")
def q_fill_null(spark, d):
    return CL.fill_null_by_types(X.nulls_orders(spark, d), ["o_totalprice", "o_orderpriority", "o_orderdate"],
                                 "o_custkey", _ORD_TYPES)


@register("normalise_non_finite")
def q_non_finite(spark, d):
    k = F.col("o_orderkey")
    o = X.nulls_orders(spark, d).select("o_orderkey", F.when(k % 5 == 0, F.lit(float("inf")))
                                        .when(k % 3 == 0, F.lit(float("nan")))
                                        .when(k % 13 == 0, F.lit(float("-inf")))
                                        .otherwise(F.col("o_totalprice")).alias("ratio"))
    return CL.normalise_non_finite(o)


@register("cast_float")
def q_cast_float(spark, d):
    return CL.cast_float(X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"),
                         ["l_orderkey", "l_linenumber"])


@register("round_report")
def q_round_report(spark, d):
    li = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber",
                                              (F.col("l_extendedprice") / 7).alias("price7"),
                                              (F.col("l_discount") / 3).alias("missing"))
    return CL.round_report(li, 3, {"missing": 2})


@register("quartile_bands")
def q_bands(spark, d):
    o = X.nulls_orders(spark, d).select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("score_value"))
    return quartile_bands(o, ["o_totalprice", "score_value"])


@register("split_by_samples")
def q_split_samples(spark, d):
    return split_by_samples(X.table(spark, d, "orders").select("o_orderkey", "o_custkey"), 0.8, ["o_orderkey"])


@register("split_by_datetime")
def q_split_dt(spark, d):
    return split_by_datetime(X.table(spark, d, "events").select("event_id", "ts"), "ts", "2024-06-01 00:00:00")


@register("replace_literals")
def q_replace(spark, d):
    c = X.table(spark, d, "conversations")
    return c.select("conv_id", "turn", RD.replace_literals(F.col("text"), {"the": "THE", "a": "A", "THE": "the"})
                    .alias("text"))


_LONGS, _DOUBLES = ("l_orderkey", "l_partkey", "l_suppkey"), ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_TIME = "yyyy-MM-dd HH:mm:ss"


def _typed(df):
    """All columns of lineitem as read from text, with the types of the table and the date-time as text."""
    return df.select(*[F.col(c).cast("long").alias(c) for c in _LONGS], F.col("l_linenumber").cast("int").alias("l_linenumber"),
                     *[F.col(c).cast("double").alias(c) for c in _DOUBLES], F.col("l_returnflag").cast("string").alias("l_returnflag"),
                     F.col("l_linestatus").cast("string").alias("l_linestatus"),
                     F.date_format(F.col("l_shipdate").cast("timestamp"), _TIME).alias("l_shipdate"))


def _round_trip(spark, d, fmt):
    """Write lineitem, all columns, with Spark and read it back through read_table."""
    li = X.table(spark, d, "lineitem")
    out = scratch_dir(spark, f"roundtrip-{fmt}")
    if fmt == "tsv":
        li.write.option("header", "true").option("sep", "\t").mode("overwrite").csv(f"{out}/t")
        return _typed(RD.read_table(spark, f"{out}/t", fmt="tsv"))
    RD.write_report_tables({"t": li}, out, fmt)
    return _typed(RD.read_table(spark, f"{out}/t", fmt=fmt))


@register("read_delimited")
def q_read_csv(spark, d):
    return _round_trip(spark, d, "csv")


@register("read_tsv")
def q_read_tsv(spark, d):
    return _round_trip(spark, d, "tsv")


@register("read_parquet_table")
def q_read_parquet(spark, d):
    return _round_trip(spark, d, "parquet")


@register("read_json_table")
def q_read_json(spark, d):
    out = scratch_dir(spark, "json")
    RD.write_report_tables({"t": X.table(spark, d, "lineitem")}, out, "json")
    return _typed(RD.read_json_table(spark, f"{out}/t", multi_line=False))


@register("read_xml_table")
def q_read_xml(spark, d):
    out = scratch_dir(spark, "xml")
    X.table(spark, d, "orders").write.format("xml").option("rowTag", "row").option("rootTag", "rows").mode("overwrite").save(f"{out}/t")
    return RD.read_table(spark, f"{out}/t/*.xml", encodings=["utf8"]).select(
        F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"),
        F.col("o_orderstatus").cast("string").alias("o_orderstatus"), F.col("o_totalprice").cast("double").alias("o_totalprice"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), _TIME).alias("o_orderdate"),
        F.col("o_orderpriority").cast("string").alias("o_orderpriority"))


@register("read_json_lines")
def q_read_json_lines(spark, d):
    """JSON Lines of whole lineitem, all columns, through read_table, which finds the form itself."""
    out = scratch_dir(spark, "jsonl")
    RD.write_report_tables({"t": X.table(spark, d, "lineitem")}, out, "json")
    return _typed(RD.read_table(spark, f"{out}/t"))


def _gb18030(spark, d) -> str:
    docs = X.table(spark, d, "documents").withColumn("text", F.translate("text", "\n\r", "  "))
    RD.ensure_charsets(spark)
    out = scratch_dir(spark, "gb")
    (docs.select("doc_id", "text", "lang", "source").write.option("header", "true").option("encoding", "GB18030")
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").mode("overwrite").csv(f"{out}/t"))
    return f"{out}/t"


@register("read_table_encoded")
def q_read_encoded(spark, d):
    return RD.read_table(spark, _gb18030(spark, d)).select("doc_id", "text", "lang", "source")


@register("detect_encoding")
def q_detect_encoding(spark, d):
    """UTF-8 and GB18030 copies of the documents' texts, and the encoding found for each."""
    out = scratch_dir(spark, "utf")
    X.table(spark, d, "documents").select("text").write.mode("overwrite").text(out)
    return spark.createDataFrame([("gb18030", RD.detect_encoding(spark, _gb18030(spark, d))),
                                  ("utf8", RD.detect_encoding(spark, out))], "written string, found string")


@register("replace_in_text_file")
def q_replace_file(spark, d):
    """All lines of all documents, blank ones included, after ordered replacements in a file."""
    out = scratch_dir(spark, "lines")
    lines = X.table(spark, d, "documents").select(F.explode(F.split("text", "\n", -1)).alias("value"))
    lines.write.mode("overwrite").text(f"{out}/in")
    return RD.replace_in_text_file(spark, f"{out}/in", f"{out}/out", {"the": "THE", "a": "", "THE": "t"})


@register("binning_table_large_offset")
def q_large_offset(spark, d):
    """E12 for a target near 1.7e9 whose differences are small."""
    li = X.table(spark, d, "lineitem").withColumn("y", F.lit(1.7e9) + F.col("l_discount").cast("double"))
    t = B.binning_table_continuous(li, ["l_quantity"], "y", {"l_quantity": [10.0, 20.0, 40.0]})
    return t.select("factor", "bin", "count", F.round("std", 4).alias("std"))


def _nan_target(spark, d):
    """lineitem with a class target that is NaN for a seventh of the orders, and a dotted column."""
    li = X.table(spark, d, "lineitem")
    y = F.when(F.col("l_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise((F.col("l_linenumber") % 2).cast("double"))
    return li.select("l_orderkey", F.col("l_quantity").cast("double").alias("l.quantity"), y.alias("y"))


@register("choose_binning_nan")
def q_choose_nan(spark, d):
    return O.choose_binning(_nan_target(spark, d), "y", "classification")


@register("binning_table_binary_nan")
def q_binary_nan(spark, d):
    t = B.binning_table_binary(_nan_target(spark, d), ["l.quantity"], "y", {"l.quantity": [10.0, 20.0, 40.0]}, 1.0)
    return t.select("factor", "bin", "count", "event")


@register("candidate_bins_distinct")
def q_candidates(spark, d):
    """E4 for factors of few values: every distinct value but the smallest is a cut."""
    cuts = O.candidate_cuts(X.table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_linenumber"])
    return spark.createDataFrame([(f, float(c)) for f, cs in cuts.items() for c in cs], "factor string, cut double")


@register("semantic_types_lineitem")
def q_semantic(spark, d):
    return C.semantic_types(X.table(spark, d, "lineitem"))


@register("prebin_cart")
def q_prebin(spark, d):
    # with no trend and no size limit the DP keeps every pre-bin: the splits are the CART pre-bins
    li = X.table(spark, d, "lineitem")
    return _summary_out(O.optimal_binning(li, ["l_quantity", "l_extendedprice"], "l_tax", "continuous", monotonic_trend=None,
                                          max_n_prebins=S.REPORT_MAX_N_PREBINS,
                                          min_prebin_size=S.REPORT_MIN_PREBIN_SIZE))


# ---------------------------------------------------------------------------
# inventory items that otherwise only run inside other operators
# ---------------------------------------------------------------------------
@register("column_flags_documents")
def q_column_flags(spark, d):
    fl = C.column_flags(C.column_stats(X.table(spark, d, "documents")))
    return fl.select("column_name", "position", "is_numeric", "is_categorical", "is_datetime", "is_text")


@register("choose_binning")
def q_choose_binning(spark, d):
    li = X.table(spark, d, "lineitem")
    return (O.choose_binning(li, "l_returnflag", "classification")
            .unionByName(O.choose_binning(li, "l_linestatus", "classification"))
            .unionByName(O.choose_binning(li, "l_extendedprice", "regression")))


@register("to_long")
def q_to_long(spark, d):
    return to_long(X.table(spark, d, "lineitem"), ["l_quantity", "l_discount"], target="l_extendedprice")


@register("binning_factors")
def q_binning_factors(spark, d):
    li = X.table(spark, d, "lineitem")
    return A.binning_factor_table(C.get_data_types(li), X.REG_X)


@register("assemble_features")
def q_assemble(spark, d):
    docs = X.table(spark, d, "documents")
    tm = {"Numeric": ["n_chars"], "Categorical": ["lang"], "Text": ["text"]}
    out = GF.assemble_features(docs, ["n_chars", "lang", "text"], tm, [F.lit(0.0)], F.col("doc_id")).long()
    return rounded(out.withColumnRenamed("row_id", "doc_id"), 8)


@register("ordered_target_statistics")
def q_target_statistics(spark, d):
    docs = X.bin_documents(spark, d)
    return rounded(GF.ordered_target_statistics(docs, "doc_id", ["lang", "source"], F.col("quality")), 8)


@register("importance_native_categorical")
def q_imp_native(spark, d):
    tm = {"Numeric": ["n_chars"], "Categorical": ["lang", "source"], "Text": ["text"]}
    return GF.importance_native_categorical(X.bin_documents(spark, d), "doc_id", ["n_chars", "lang", "source", "text"],
                                            "quality", tm, "classification")


@register("importance_planted")
def q_imp_planted(spark, d):
    """Factors by importance, strongest first, for a target of known make-up, and whether noise is under a tenth."""
    li = X.planted_lineitem(spark, d)
    imp = GF.importance_regression(li, X.PLANTED_X, "y", {"Numeric": X.PLANTED_X}, importance_type="gain")
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("feature_importance"))      # a row per factor
    return imp.select("factor", F.row_number().over(w).alias("place"), F.max("feature_importance").over(
        Window.partitionBy(F.lit(1))).alias("top"), "feature_importance").select(
            "factor", F.when(F.col("feature_importance") >= 0.1 * F.col("top"), F.col("place")).alias("place"),
            (F.col("feature_importance") < 0.1 * F.col("top")).alias("below_tenth"))


@register("rank_factors")
def q_rank_factors(spark, d):
    table = B.binning_table_binary(X.bin_lineitem(spark, d), X.BIN_X, "y", X.BIN_SPLITS)
    summ = B.binary_summary(table).select(F.col("factor").alias("name"), F.col("iv").alias("feature_importance"), "js", "gini")
    ranked = A.rank_factors(summ, ["js"])
    order = Window.partitionBy(F.lit(1)).orderBy(F.monotonically_increasing_id())     # a row per factor
    return ranked.withColumn("place", F.row_number().over(order))


@register("chart_series_binary")
def q_chart_series(spark, d):
    return rounded(FS.chart_series(_bin_table(spark, d), "binary", show_bin_labels=True, label_length=10))


@register("profile_monotonic")
def q_monotonic(spark, d):
    o = X.nulls_orders(spark, d).withColumn("neg_key", -F.col("o_orderkey"))
    return P.profile_monotonic(o, ["o_orderkey", "o_totalprice", "o_custkey", "neg_key"], "o_orderkey")


@register("profile_monotonic_bucketed")
def q_monotonic_b(spark, d):
    o = X.nulls_orders(spark, d).withColumn("neg_key", -F.col("o_orderkey"))
    return P.profile_monotonic(o, ["o_orderkey", "o_totalprice", "o_custkey", "neg_key"], "o_orderkey",
                               partitions=200)


@register("optimal_binning_cat_cutoff")
def q_opt_cat_cutoff(spark, d):
    return _summary_out(O.optimal_binning(X.bin_documents(spark, d), ["source", "lang"], "quality", "binary",
                                          cat_cutoff=0.06))


@register("bin_series_others")
def q_bin_series_others(spark, d):
    """The bar of the pooled categories after all regular ones."""
    o = O.optimal_binning(X.bin_documents(spark, d), ["source", "lang"], "quality", "binary", cat_cutoff=0.2)
    s = FS.bin_series(o.table, "event_rate", add_special=False, add_missing=False)
    last = s.groupBy("factor").agg(F.max("x").alias("last"))
    return rounded(s.where("kind = 'others'").join(last, "factor")    # a row per factor
                   .select("factor", "count", "metric", "kind", (F.col("x") == F.col("last")).alias("after_regular")))


@register("rank_correlations")
def q_rank_corr(spark, d):
    return rounded(R.rank_correlations(_rank_long(spark, d, ["l_linenumber", "l_quantity"], "l_tax")), 8)


@register("semantic_types_documents")
def q_semantic_docs(spark, d):
    return C.semantic_types(X.table(spark, d, "documents"))


@register("profile_alerts_lineitem")
def q_alerts_li(spark, d):
    return P.profile_alerts(X.table(spark, d, "lineitem"))


# ---------------------------------------------------------------------------
# C5 on date strings; E4, E6, E7, E15, E19 checked over all partitions
# ---------------------------------------------------------------------------
@register("get_data_types_date_strings")
def q_types_dates(spark, d):
    return C.get_data_types(X.date_strings(spark, d))


@register("candidate_cuts")
def q_candidate_cuts(spark, d):
    """E4 for factors of many values: exact discrete quantiles."""
    cuts = O.candidate_cuts(X.table(spark, d, "lineitem"), ["l_extendedprice", "l_orderkey", "l_partkey"])
    return spark.createDataFrame([(f, float(c)) for f, cs in cuts.items() for c in cs], "factor string, cut double")


def _best_partition(res, objective):
    total = res.table.where("kind = 'regular'").groupBy("factor").agg(F.sum(objective).alias("objective"), F.count("*").cast("int").alias("n_bins"))
    splits = F.array_join(F.transform("splits", lambda v: F.format_string("%.6f", v)), "|").alias("splits")
    return rounded(res.splits.select("factor", splits).join(total, "factor"))


@register("optimal_binning_all_partitions")
def q_all_partitions(spark, d):
    res = O.optimal_binning(X.table(spark, d, "lineitem"), ["l_linenumber"], "l_extendedprice", "continuous", min_prebin_size=0.0)
    return _best_partition(res, F.abs("woe"))


@register("optimal_binning_all_partitions_binary")
def q_all_partitions_binary(spark, d):
    res = O.optimal_binning(X.bin_lineitem(spark, d), ["l_linenumber"], "y", "binary", min_prebin_size=0.0)
    return _best_partition(res, F.col("iv"))


@register("trend_shape")
def q_trend_shape(spark, d):
    return B.trend_shape(_reg_table(spark, d), "mean")


@register("binning_analysis_binary")
def q_binning_analysis_binary(spark, d):
    a = A.binning_analysis(X.bin_lineitem(spark, d), X.BIN_X, "y", "classification")
    return _summary_out(type("R", (), {"summary": a["summary"]}))


@register("binning_analysis_multiclass")
def q_binning_analysis_multiclass(spark, d):
    a = A.binning_analysis(X.table(spark, d, "lineitem"), X.BIN_X, "l_returnflag", "classification")
    return _summary_out(type("R", (), {"summary": a["summary"]}))
