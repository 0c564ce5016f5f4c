"""D: data profile as report tables (the content of a minimal profiling report).

Every table is computed for all requested columns at once from the long form
``(column_name, position, value)``; the only shuffles are group-bys keyed by
column (and by value where exact distinct counts or ranks need it).  Exact
quantiles use the bucketed ranks of :mod:`binscope.operators.longform`, so no
column is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binscope.functions.exprs import (qcol, FLOAT_TYPES, NTZ_EPOCH, NUMERIC_TYPES, TEMPORAL_TYPES, TOKEN_RE,
                                      WORD_RE, ntz_micros)
from pyspark import StorageLevel

from binscope.operators.longform import (buckets_for, exact_quantiles, quantiles_from_counts, string_long,
                                         top_k, typed_value_counts, value_counts)
from binscope.operators.types import semantic_types
from binscope.session import materialize, ship_package

# ---------------------------------------------------------------------------
# Alert thresholds and default quantiles of the profile
# ---------------------------------------------------------------------------
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
SKEWNESS_ALERT = 20.0
HIGH_CARDINALITY_ALERT = 50
IMBALANCE_ALERT = 0.5
ZEROS_ALERT = 0.05
TOP_VALUES = 10
EXTREME_VALUES = 5


def _dtypes(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def _numeric_cols(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    dt = _dtypes(df)
    cols = list(columns or df.columns)
    return [c for c in cols if isinstance(dt[c], NUMERIC_TYPES) or isinstance(dt[c], T.BooleanType)]


def _missing(c: str, dt: T.DataType) -> Column:
    col = qcol(c)
    if isinstance(dt, FLOAT_TYPES):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def _safe_div(a: Column, b: Column) -> Column:
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def numeric_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, position, raw)``: numeric columns as double, NaN as null, inf kept."""
    dt = _dtypes(df)

    def raw(c: str) -> Column:
        col = qcol(c)
        if isinstance(dt[c], T.BooleanType):
            return col.cast("int").cast("double")
        v = col.cast("double")
        return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)

    stacked = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"), raw(c).alias("raw"))
        for i, c in enumerate(columns)]))
    return df.select(stacked.alias("__s")).select("__s.*")


def finite_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, position, x)`` with only finite values."""
    inf = (float("inf"), float("-inf"))
    return (numeric_long(df, columns)
            .filter(F.col("raw").isNotNull() & ~F.col("raw").isin(*inf))
            .withColumnRenamed("raw", "x"))


# ---------------------------------------------------------------------------
# D1  table overview
# ---------------------------------------------------------------------------
def profile_table(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and share, columns with missing / all missing."""
    dt = _dtypes(df)
    cols = df.columns
    counts = df.agg(F.count(F.lit(1)).alias("__n"),
                    *[F.count_if(_missing(c, dt[c])).alias(f"__m{i}") for i, c in enumerate(cols)])
    n = F.col("__n")
    miss = [F.col(f"__m{i}") for i in range(len(cols))]
    total = sum(miss[1:], miss[0]) if miss else F.lit(0)
    with_missing = sum([(m > 0).cast("long") for m in miss[1:]], (miss[0] > 0).cast("long")) if miss else F.lit(0)
    all_missing = sum([((m == n) & (n > 0)).cast("long") for m in miss[1:]],
                      ((miss[0] == n) & (n > 0)).cast("long")) if miss else F.lit(0)
    return counts.select(
        n.alias("n_rows"),
        F.lit(len(cols)).cast("long").alias("n_columns"),
        total.cast("long").alias("n_cells_missing"),
        _safe_div(total, n * len(cols)).alias("p_cells_missing"),
        with_missing.cast("long").alias("n_columns_with_missing"),
        all_missing.cast("long").alias("n_columns_all_missing"))


# ---------------------------------------------------------------------------
# D2  number of variables per semantic type
# ---------------------------------------------------------------------------
def profile_type_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(data_type, n_columns)`` over the profile typeset."""
    return (semantic_types(df, columns).groupBy("data_type")
            .agg(F.count(F.lit(1)).alias("n_columns")))


# ---------------------------------------------------------------------------
# D3  common statistics (every column)
# ---------------------------------------------------------------------------
def profile_common(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """D3: n, missing, distinct and unique counts per column, from exact value counts."""
    cols = list(columns or df.columns)
    v = F.col("value")
    per_kind = [vt.groupBy("column_name", "position").agg(
        F.sum(F.when(v.isNotNull(), F.col("cnt")).otherwise(0)).alias("n"),
        F.sum(F.when(v.isNull(), F.col("cnt")).otherwise(0)).alias("n_missing"),
        F.count(v).alias("n_distinct"),
        F.count_if(v.isNotNull() & (F.col("cnt") == 1)).alias("n_unique"))
        for vt in typed_value_counts(df, cols)]
    s = per_kind[0]
    for other in per_kind[1:]:
        s = s.unionByName(other)
    total = F.col("n") + F.col("n_missing")
    return s.select(
        "column_name", "position",
        F.col("n").cast("long").alias("n"),
        F.col("n_missing").cast("long").alias("n_missing"),
        _safe_div(F.col("n_missing"), total).alias("p_missing"),
        F.col("n_distinct").cast("long").alias("n_distinct"),
        _safe_div(F.col("n_distinct"), F.col("n")).alias("p_distinct"),
        F.col("n_unique").cast("long").alias("n_unique"),
        _safe_div(F.col("n_unique"), F.col("n")).alias("p_unique"),
        ((F.col("n_unique") == F.col("n")) & (F.col("n") > 0)).alias("is_unique"))


# ---------------------------------------------------------------------------
# D4 / D5  numeric statistics and bias-corrected moments
# ---------------------------------------------------------------------------
def _moment_cols(n: Column, g1: Column, g2: Column) -> tuple[Column, Column]:
    """Population skewness/excess kurtosis -> the bias-corrected sample versions."""
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * g1)
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    return skew, kurt


def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """D4 (+D5): moments, extremes, sums, zero / negative / infinite counts per numeric column."""
    cols = _numeric_cols(df, columns)
    lng = numeric_long(df, cols)
    r = F.col("raw")
    is_inf = r.isin(float("inf"), float("-inf"))
    x = F.when(~is_inf, r)
    s = lng.groupBy("column_name", "position").agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.var_samp(x).alias("variance"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.sum(x).alias("sum"),
        F.count_if(x == 0).alias("n_zeros"),
        F.count_if(x < 0).alias("n_negative"),
        F.count_if(is_inf).alias("n_infinite"),
        F.skewness(x).alias("__g1"),
        F.kurtosis(x).alias("__g2"))
    n = F.col("n").cast("double")
    skew, kurt = _moment_cols(n, F.col("__g1"), F.col("__g2"))
    return s.select(
        "column_name", "position", F.col("n").cast("long").alias("n"),
        "mean", "std", "variance", "min", "max", "sum",
        (F.col("max") - F.col("min")).alias("range"),
        _safe_div(F.col("std"), F.col("mean")).alias("cv"),
        F.col("n_zeros").cast("long").alias("n_zeros"), _safe_div(F.col("n_zeros"), n).alias("p_zeros"),
        F.col("n_negative").cast("long").alias("n_negative"),
        _safe_div(F.col("n_negative"), n).alias("p_negative"),
        F.col("n_infinite").cast("long").alias("n_infinite"),
        _safe_div(F.col("n_infinite"), n + F.col("n_infinite")).alias("p_infinite"),
        skew.alias("skewness"), kurt.alias("kurtosis"))


def profile_moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis per numeric column."""
    cols = _numeric_cols(df, columns)
    s = finite_long(df, cols).groupBy("column_name", "position").agg(
        F.count("x").alias("n"), F.skewness("x").alias("__g1"), F.kurtosis("x").alias("__g2"))
    skew, kurt = _moment_cols(F.col("n").cast("double"), F.col("__g1"), F.col("__g2"))
    return s.select("column_name", "position", skew.alias("skewness"), kurt.alias("kurtosis"))


# ---------------------------------------------------------------------------
# D6  quantiles, IQR and median absolute deviation
# ---------------------------------------------------------------------------
def _q_name(q: float) -> str:
    return f"p{round(q * 100):02d}"


def profile_quantiles(df: DataFrame, columns: Sequence[str] | None = None,
                      probs: Sequence[float] = QUANTILES) -> DataFrame:
    """Exact quantiles (linear interpolation), IQR and MAD per numeric column."""
    cols = _numeric_cols(df, columns)
    probs = sorted(set(list(probs) + [0.25, 0.5, 0.75]))
    lng = finite_long(df, cols).select(F.col("column_name").alias("factor"), "position", "x")
    # per-value counts: the only pass over the data; every later step reads them
    counts = value_counts(lng, "factor", "x").persist(StorageLevel.MEMORY_AND_DISK)
    nb = buckets_for(counts.groupBy("factor").count().agg(F.max("count")).first()[0] or 0)
    q = materialize(quantiles_from_counts(counts, probs, "factor", "x", nb))   # #columns x #probs rows
    wide = q.groupBy("factor").pivot("prob", probs).agg(F.first("quantile"))
    for p in probs:
        wide = wide.withColumnRenamed(str(p), _q_name(p))
    # MAD = median(|x - median|): exact median of the deviations, from the same counts
    med = q.filter(F.col("prob") == 0.5).select("factor", F.col("quantile").alias("__med"))
    dev = (counts.join(F.broadcast(med), "factor")  # one row per column
           .groupBy("factor", F.abs(F.col("x") - F.col("__med")).alias("x"))
           .agg(F.sum("cnt").alias("cnt"))).persist(StorageLevel.MEMORY_AND_DISK)
    mad = quantiles_from_counts(dev, [0.5], "factor", "x", nb).select(
        "factor", F.col("quantile").alias("mad"))
    pos = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(cols)], "factor string, position int")
    out = pos.join(wide, "factor").join(mad, "factor", "left")
    return out.select(F.col("factor").alias("column_name"), "position",
                      *[_q_name(p) for p in probs],
                      (F.col("p75") - F.col("p25")).alias("iqr"), "mad")


# ---------------------------------------------------------------------------
# D7 / D8  extreme values and most frequent values
# ---------------------------------------------------------------------------
def profile_extremes(df: DataFrame, columns: Sequence[str] | None = None,
                     k: int = EXTREME_VALUES) -> DataFrame:
    """The ``k`` smallest and largest distinct finite values with their counts."""
    cols = _numeric_cols(df, columns)
    counts = value_counts(finite_long(df, cols), group="column_name", value="x")
    lo = top_k(counts, ["column_name"], [F.col("x").asc()], k, ["x"]).withColumn("side", F.lit("min"))
    hi = top_k(counts, ["column_name"], [F.col("x").desc()], k, ["x"]).withColumn("side", F.lit("max"))
    return lo.unionByName(hi).select("column_name", "side", "rank", F.col("x").alias("value"),
                                     F.col("cnt").cast("long").alias("cnt"))


def profile_top_values(df: DataFrame, columns: Sequence[str] | None = None,
                       k: int = TOP_VALUES) -> DataFrame:
    """The ``k`` most frequent values per column (ties by value), share, and an 'other' row."""
    cols = list(columns or df.columns)
    vt = (string_long(df, cols).filter(F.col("value").isNotNull())
          .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt")))
    tot = vt.groupBy("column_name").agg(F.sum("cnt").alias("__n"), F.count(F.lit(1)).alias("__d"))
    top = top_k(vt, ["column_name"], [F.col("cnt").desc(), F.col("value").asc()], k, ["value"])
    top = top.join(F.broadcast(tot), "column_name")  # one row per column
    shown = top.groupBy("column_name").agg(F.sum("cnt").alias("__shown"), F.count(F.lit(1)).alias("__k"))
    other = (tot.join(shown, "column_name")
             .filter(F.col("__d") > F.col("__k"))
             .select("column_name", (F.col("__k") + 1).cast("int").alias("rank"),
                     F.lit("(other)").alias("value"), (F.col("__n") - F.col("__shown")).alias("cnt"),
                     F.col("__n")))
    rows = top.select("column_name", F.col("rank").cast("int").alias("rank"), "value", "cnt", "__n") \
        .unionByName(other)
    return rows.select("column_name", "rank", "value", F.col("cnt").cast("long").alias("cnt"),
                       _safe_div(F.col("cnt"), F.col("__n")).alias("share"))


# ---------------------------------------------------------------------------
# D9  equal-width histogram
# ---------------------------------------------------------------------------
def profile_histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """``bins`` equal-width bins between min and max; the last edge is inclusive."""
    cols = _numeric_cols(df, columns)
    lng = finite_long(df, cols)
    rng = lng.groupBy("column_name").agg(F.min("x").alias("__lo"), F.max("x").alias("__hi"))
    w = (F.col("__hi") - F.col("__lo")) / bins
    b = F.when(F.col("__hi") == F.col("__lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("x") - F.col("__lo")) / w), F.lit(bins - 1))).cast("int")
    counts = (lng.join(F.broadcast(rng), "column_name")  # one row per column
              .groupBy("column_name", b.alias("bin"), "__lo", "__hi")
              .agg(F.count(F.lit(1)).alias("cnt")))
    return counts.select("column_name", "bin",
                         (F.col("__lo") + F.col("bin") * w).alias("lo"),
                         (F.col("__lo") + (F.col("bin") + 1) * w).alias("hi"),
                         F.col("cnt").cast("long").alias("cnt"))


# ---------------------------------------------------------------------------
# D10 - D13  per kind
# ---------------------------------------------------------------------------
def profile_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct count, top value (ties by value), its frequency, imbalance 1 - H/log2(k)."""
    vt = (string_long(df, list(columns)).filter(F.col("value").isNotNull())
          .groupBy("column_name", "position", "value").agg(F.count(F.lit(1)).alias("cnt")))
    tot = vt.groupBy("column_name").agg(F.sum("cnt").alias("__n"))
    j = vt.join(F.broadcast(tot), "column_name")  # one row per column
    p = F.col("cnt") / F.col("__n")
    s = j.groupBy("column_name", "position").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.min(F.struct((-F.col("cnt")).alias("neg"), F.col("value").alias("v"))).alias("__top"),
        F.sum(-p * F.log2(p)).alias("entropy"))
    k = F.col("n_distinct").cast("double")
    return s.select(
        "column_name", "position", F.col("n_distinct").cast("long").alias("n_distinct"),
        F.col("__top.v").alias("top"), (-F.col("__top.neg")).cast("long").alias("freq"),
        "entropy",
        F.when(k > 1, 1 - F.col("entropy") / F.log2(k)).otherwise(F.lit(0.0)).alias("imbalance"))


def profile_datetime(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Min, max (as 'yyyy-MM-dd HH:mm:ss'), range in seconds and distinct count."""
    dt = _dtypes(df)
    parts = []
    for i, c in enumerate(columns):
        col = qcol(c)
        ntz = isinstance(dt[c], T.TimestampNTZType)
        if not isinstance(dt[c], TEMPORAL_TYPES):
            col = F.to_timestamp(col)
        # wall-clock columns: zone-free micros; instants: epoch micros
        us = ntz_micros(col) if ntz else F.unix_micros(col.cast("timestamp"))
        parts.append(F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"),
                              F.lit(ntz).alias("ntz"), us.alias("us")))
    lng = df.select(F.explode(F.array(*parts)).alias("__s")).select("__s.*")
    s = (lng.filter(F.col("us").isNotNull()).select("column_name", "position", "ntz", "us").distinct()
         .groupBy("column_name", "position", "ntz")
         .agg(F.min("us").alias("__lo"), F.max("us").alias("__hi"), F.count(F.lit(1)).alias("n_distinct")))
    fmt = "yyyy-MM-dd HH:mm:ss"
    epoch = F.lit(NTZ_EPOCH).cast("timestamp_ntz")

    def show(us: Column) -> Column:
        return F.when(F.col("ntz"), F.date_format(F.timestamp_add("MICROSECOND", us, epoch), fmt)) \
            .otherwise(F.date_format(F.timestamp_micros(us), fmt))

    return s.select("column_name", "position",
                    show(F.col("__lo")).alias("min"),
                    show(F.col("__hi")).alias("max"),
                    ((F.col("__hi") - F.col("__lo")) / 1e6).alias("range_seconds"),
                    F.col("n_distinct").cast("long").alias("n_distinct"))


def profile_boolean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """True / false counts and shares (of non-null values)."""
    parts = [F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"),
                      qcol(c).cast("boolean").alias("b")) for i, c in enumerate(columns)]
    lng = df.select(F.explode(F.array(*parts)).alias("__s")).select("__s.*")
    s = lng.groupBy("column_name", "position").agg(
        F.count_if(F.col("b")).alias("n_true"), F.count_if(~F.col("b")).alias("n_false"),
        F.count("b").alias("__n"))
    return s.select("column_name", "position",
                    F.col("n_true").cast("long").alias("n_true"),
                    F.col("n_false").cast("long").alias("n_false"),
                    _safe_div(F.col("n_true"), F.col("__n")).alias("p_true"),
                    _safe_div(F.col("n_false"), F.col("__n")).alias("p_false"))


def profile_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct count and min / mean / max length (characters) per text column."""
    parts = [F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"),
                      qcol(c).cast("string").alias("v")) for i, c in enumerate(columns)]
    lng = df.select(F.explode(F.array(*parts)).alias("__s")).select("__s.*").filter(F.col("v").isNotNull())
    per_value = lng.groupBy("column_name", "position", "v").agg(F.count(F.lit(1)).alias("cnt"))
    ln = F.length("v")
    s = per_value.groupBy("column_name", "position").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.min(ln).alias("min_length"), F.max(ln).alias("max_length"),
        (F.sum(ln * F.col("cnt")) / F.sum("cnt")).alias("mean_length"))
    return s.select("column_name", "position", F.col("n_distinct").cast("long").alias("n_distinct"),
                    F.col("min_length").cast("long").alias("min_length"),
                    "mean_length", F.col("max_length").cast("long").alias("max_length"))


# ---------------------------------------------------------------------------
# D14  alerts
# ---------------------------------------------------------------------------
def profile_alerts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, alert)`` from the common, numeric and categorical tables."""
    cols = list(columns or df.columns)
    st = semantic_types(df, cols).select("column_name", "data_type")
    common = profile_common(df, cols).join(st, "column_name")
    num_cols = _numeric_cols(df, cols)
    if num_cols:
        num = profile_numeric(df, num_cols).select("column_name", "p_zeros", "n_infinite", "skewness")
        common = common.join(num, "column_name", "left")
    else:
        common = common.select("*", F.lit(None).cast("double").alias("p_zeros"),
                               F.lit(None).cast("long").alias("n_infinite"),
                               F.lit(None).cast("double").alias("skewness"))
    cat_names = [c for c in cols if c not in set(num_cols)]
    if cat_names:
        cat = profile_categorical(df, cat_names).select("column_name", F.col("imbalance"))
        common = common.join(cat, "column_name", "left")
    else:
        common = common.withColumn("imbalance", F.lit(None).cast("double"))
    c = F.col
    is_cat = c("data_type") == "Categorical"
    checks = [
        ("CONSTANT", c("n_distinct") == 1),
        ("UNIQUE", c("is_unique") & (c("n_distinct") > 1)),
        ("MISSING", c("n_missing") > 0),
        ("ZEROS", c("p_zeros") > ZEROS_ALERT),
        ("INFINITE", c("n_infinite") > 0),
        ("SKEWED", F.abs(c("skewness")) > SKEWNESS_ALERT),
        ("HIGH_CARDINALITY", is_cat & (c("n_distinct") > HIGH_CARDINALITY_ALERT)),
        ("IMBALANCE", is_cat & (c("imbalance") > IMBALANCE_ALERT)),
        ("UNSUPPORTED", c("data_type") == "Unsupported"),
    ]
    arr = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in checks])
    return (common.select("column_name", "position", F.explode(arr).alias("alert"))
            .filter(F.col("alert").isNotNull()))


# ---------------------------------------------------------------------------
# D15  token frequencies
# ---------------------------------------------------------------------------
def word_frequencies(df: DataFrame, columns: Sequence[str], tokenizer: str = "words") -> DataFrame:
    """``(column_name, token, cnt)``; ``words`` = lower-cased words of 2+ letters/digits,
    ``tokens`` = the tokens of the text rule (latin words, every other character alone)."""
    pattern = WORD_RE if tokenizer == "words" else TOKEN_RE
    parts = [F.struct(F.lit(c).alias("column_name"),
                      (F.lower(qcol(c).cast("string")) if tokenizer == "words"
                       else qcol(c).cast("string")).alias("v")) for c in columns]
    lng = df.select(F.explode(F.array(*parts)).alias("__s")).select("__s.*")
    toks = lng.select("column_name", F.explode(F.regexp_extract_all("v", F.lit(pattern), 0)).alias("token"))
    return toks.groupBy("column_name", "token").agg(F.count(F.lit(1)).alias("cnt"))


# ---------------------------------------------------------------------------
# D4 (part): monotonic flags along a caller-given order column
# ---------------------------------------------------------------------------
def _steps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream sorted by (position, order) to one row for each column of a partition: its steps and both ends."""
    state: dict[int, list] = {}
    for batch in batches:
        at, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("position", "v"))
        for p in np.unique(at).tolist():
            x = v[at == p]
            down, up, first, last = state.get(p, (0, 0, x[0], x[0]))
            d = np.diff(np.r_[last, x])
            state[p] = [down + int((d < 0).sum()), up + int((d > 0).sum()), first, x[-1]]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(state), pa.int32()), *[pa.array([s[k] for s in state.values()], t)
                                              for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))]],
        names=["position", "down", "up", "first", "last"])


def profile_monotonic(df: DataFrame, columns: Sequence[str], order_by: str, partitions: int | None = None) -> DataFrame:
    """``(column_name, position, monotonic_increasing, monotonic_decreasing)`` (non-strict, nulls
    skipped) with rows ordered by ``order_by`` (which should be unique: ties have no order).

    Rows are dealt out by ranges of (column, order value) and sorted inside
    their partition, where the steps are counted; the ends of the partitions
    that follow each other, one row a partition and column, give the steps in
    between. Nothing of the data's size is broadcast or sorted in one task.
    """
    from pyspark.sql import Window
    cols = _numeric_cols(df, columns)
    parts = [F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"),
                      qcol(c).cast("double").alias("v")) for i, c in enumerate(cols)]
    lng = (df.select(qcol(order_by).alias("__o"), F.explode(F.array(*parts)).alias("__s"))
           .select("__o", "__s.*").filter(F.col("v").isNotNull() & ~F.isnan("v") & F.col("__o").isNotNull()))
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ship_package(df.sparkSession)
    ends = (lng.repartitionByRange(n, "position", "__o").sortWithinPartitions("position", "__o").select("position", "v")
            .mapInArrow(_steps, "position int, down long, up long, first double, last double")
            .withColumn("part", F.spark_partition_id()))
    w = Window.partitionBy("position").orderBy("part")   # a row for each partition
    step = F.col("first") - F.lag("last").over(w)
    names = F.array(*[F.lit(c) for c in cols])
    s = ends.withColumn("step", step).groupBy("position").agg(
        (F.sum("down") + F.count_if(F.col("step") < 0)).alias("nd"), (F.sum("up") + F.count_if(F.col("step") > 0)).alias("nu"))
    return s.select(F.get(names, F.col("position")).alias("column_name"), "position", (F.col("nd") == 0).alias("monotonic_increasing"),
                    (F.col("nu") == 0).alias("monotonic_decreasing"))
