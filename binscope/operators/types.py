"""C: semantic column types (DateTime, Numeric, Text, Categorical, Id, Unsupported).

Each column is read once:

1. every value in long form becomes a short row. A number, date or flag is its
   column's position and 64 bits. A text is its position, two 64-bit hashes,
   what it looks like as bits (number, blank, boolean word, more tokens than
   the text rule asks for) and, only if it is short and begins like a date,
   the text itself;
2. ``groupBy`` over that row counts distinct values (partial aggregation
   first, so a constant column costs one row per task); no long text is ever
   a shuffle key, and date formats are tried on distinct values only;
3. per column: rows, nulls, distinct count, bad numbers, the date format that
   parses all values, the number of blanks;
4. the ordered rule as a ``CASE`` over those statistics (one row per column).

The text rule wants some token more than three times. A blank is a token of
its own, so a column with more than three blanks has one; tokens are counted
only for the columns that this leaves open, in a second scan of just those.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binscope.functions.exprs import (DATETIME_FORMATS, DATETIME_MAX, FLOAT_TYPES, INTEGER_TYPES, NESTED_TYPES,
                                      NUMERIC_STRING_RE, NUMERIC_TYPES, TEMPORAL_TYPES, TOKEN_RE, qcol, tokens)
from binscope.operators.longform import string_long

# ---------------------------------------------------------------------------
# Fixed values of the type rules
# ---------------------------------------------------------------------------
TYPE_NAMES = ("DateTime", "Numeric", "Text", "Categorical", "Id", "Unsupported")
MAX_CATEGORIES_TEXT = 20          # non-numeric column: at most 20 distinct values
MAX_CATEGORIES_NUMERIC = 8        # integer column: at most 8 distinct values
MAX_CATEGORY_SHARE = 0.2          # distinct / non-null at most 0.2
MIN_TOKENS_FOR_TEXT = 5           # text needs some value with more than 5 tokens
MIN_TOKEN_FREQUENCY_FOR_TEXT = 3  # and some token seen more than 3 times
# semantic (profile) types, our definition of the profiling typeset
SEMANTIC_MAX_NUMERIC_CATEGORIES = 5
SEMANTIC_MAX_CATEGORIES = 50
SEMANTIC_MAX_CATEGORY_SHARE = 0.5
BOOLEAN_STRINGS = ("true", "false", "yes", "no", "t", "f", "y", "n", "on", "off")

# how a value of any of the date formats begins (only such texts are kept and parsed)
DATE_START_RE = r"^(?:[+-]?\d+[-/. ]|[A-Za-z]+\.? \d)"
# more tokens than MIN_TOKENS_FOR_TEXT: each token as the tokeniser takes it, never a shorter one
MANY_TOKENS_RE = rf"^(?>{TOKEN_RE}){{{MIN_TOKENS_FOR_TEXT + 1}}}"
# bits of a text
BAD_NUMBER, NONBLANK, BOOLEAN_WORD, MANY_TOKENS = 1, 2, 4, 8


def _kind(dt: T.DataType) -> str:
    if isinstance(dt, NESTED_TYPES):
        return "nested"
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, INTEGER_TYPES):
        return "int"
    if isinstance(dt, FLOAT_TYPES) or isinstance(dt, T.DecimalType):
        return "float"
    if isinstance(dt, TEMPORAL_TYPES):
        return "temporal"
    if isinstance(dt, T.StringType):
        return "string"
    return "other"


def _text_row(name: str, position: int, dtype: T.DataType) -> Column:
    """What the type rules need of a text: place, two hashes, bits, date-like text, number of blanks."""
    v = qcol(name).cast("string")    # char(n) and collated texts as plain ones
    bits, date_text, blanks = F.lit(0), F.lit(None).cast("string"), F.lit(0)
    if isinstance(dtype, T.StringType):
        trimmed = F.trim(v)
        nonblank = trimmed != ""
        word = (F.length(trimmed) <= max(map(len, BOOLEAN_STRINGS))) & F.lower(trimmed).isin(*BOOLEAN_STRINGS)
        bits = (F.when(nonblank & ~v.rlike(NUMERIC_STRING_RE), BAD_NUMBER).otherwise(0)
                + F.when(nonblank, NONBLANK).otherwise(0) + F.when(word, BOOLEAN_WORD).otherwise(0)
                + F.when(v.rlike(MANY_TOKENS_RE), MANY_TOKENS).otherwise(0))
        date_text = F.when((F.length(v) <= DATETIME_MAX) & v.rlike(DATE_START_RE), v)
        blanks = F.coalesce(F.length(v) - F.length(F.replace(v, F.lit(" "), F.lit(""))), F.lit(0))
    return F.struct(F.lit(position).alias("position"), F.when(v.isNotNull(), F.xxhash64(v)).alias("h1"),
                    F.when(v.isNotNull(), F.xxhash64(F.lit(1), v)).alias("h2"), bits.alias("bits"),
                    date_text.alias("date_text"), blanks.cast("long").alias("blanks"))


def _number_row(name: str, position: int, dtype: T.DataType) -> Column:
    """Place and value of a number, date or flag as 64 bits (hashing eight bytes into eight loses nothing)."""
    v = qcol(name)
    if isinstance(dtype, FLOAT_TYPES):
        v = v.cast("double")
        v = F.when(F.isnan(v), F.lit(None)).when(v == 0, F.lit(0.0)).otherwise(v)
    key = v.cast("long") if isinstance(dtype, (*INTEGER_TYPES, T.BooleanType)) else F.xxhash64(v)
    return F.struct(F.lit(position).alias("position"), F.when(v.isNotNull(), key).alias("h1"))


def _exploded(df: DataFrame, rows: list[Column]) -> DataFrame:
    return df.select(F.explode(F.array(*rows)).alias("__s")).select("__s.*")


def distinct_values(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """One row per distinct value of a column, nulls as one: of the eight-byte columns, and of the others.

    The first is ``(position, h1, cnt)``, the second ``(position, h1, h2,
    bits, date_text, cnt, blanks)``, where two 64-bit hashes stand for a value;
    None if there is no such column. ``position`` counts in ``columns``. Each
    column is read by one of the two.
    """
    dts = {f.name: f.dataType for f in df.schema.fields}
    short = [i for i, c in enumerate(columns) if _kind(dts[c]) in ("int", "bool", "temporal") or isinstance(dts[c], FLOAT_TYPES)]
    rest = [i for i in range(len(columns)) if i not in set(short)]
    n = F.count(F.lit(1)).alias("cnt")
    numbers = texts = None
    if short:
        numbers = _exploded(df, [_number_row(columns[i], i, dts[columns[i]]) for i in short]).groupBy("position", "h1").agg(n)
    if rest:
        texts = (_exploded(df, [_text_row(columns[i], i, dts[columns[i]]) for i in rest])
                 .groupBy("position", "h1", "h2", "bits", "date_text").agg(n, F.sum("blanks").alias("blanks")))
    return numbers, texts


def _frequent_token(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """Those of ``columns`` with a token seen more than MIN_TOKEN_FREQUENCY_FOR_TEXT times (their names only)."""
    if not columns:
        return set()
    counts = (string_long(df, columns).select("column_name", F.explode(tokens(F.col("value"))).alias("token"))
              .groupBy("column_name", "token").agg(F.count(F.lit(1)).alias("n")))
    found = counts.where(F.col("n") > MIN_TOKEN_FREQUENCY_FOR_TEXT).select("column_name").distinct()
    return {r["column_name"] for r in found.collect()}


STATS_SCHEMA = ("column_name string, position int, kind string, declared boolean, n_rows long, n_null long, "
                "n_distinct long, n_bad_numeric long, n_boolean_like long, datetime_format string, "
                "many_tokens boolean, frequent_token boolean")


def column_stats(df: DataFrame, columns: Sequence[str] | None = None,
                 declared_categorical: Sequence[str] = (), all_texts: bool = True) -> DataFrame:
    """Per column statistics that drive every type rule: a row per column (a null ``n_rows`` on an empty table).

    The scan runs at once. With ``all_texts`` off, ``frequent_token`` is only
    settled for columns that no earlier rule decides.
    """
    spark = df.sparkSession
    cols = list(columns or df.columns)
    dts = {f.name: f.dataType for f in df.schema.fields}
    flat = [c for c in cols if not isinstance(dts[c], NESTED_TYPES)]
    found = {}
    if flat:
        numbers, texts = distinct_values(df, flat)
        has = lambda bit: F.col("bits").bitwiseAND(bit) != 0
        basic = [F.sum("cnt").alias("n_rows"), F.sum(F.when(F.col("h1").isNull(), F.col("cnt")).otherwise(0)).alias("n_null"),
                 F.count("h1").alias("n_distinct")]
        of_text = {"n_bad_numeric": F.count_if(has(BAD_NUMBER)), "n_nonblank": F.count_if(has(NONBLANK)),
                   "n_boolean_like": F.sum(F.when(has(BOOLEAN_WORD), F.col("cnt")).otherwise(0)),
                   "many_tokens": F.bool_or(has(MANY_TOKENS)), "blanks": F.sum("blanks")}
        bad = {f"d{i}": F.count_if(has(NONBLANK) & F.try_to_timestamp("date_text", F.lit(fmt)).isNull())
               for i, fmt in enumerate(DATETIME_FORMATS)}
        parts = []
        if numbers is not None:
            parts.append(numbers.groupBy("position").agg(*basic))
        if texts is not None:
            parts.append(texts.groupBy("position").agg(*basic, *[c.alias(k) for k, c in (of_text | bad).items()]))
        per_column = parts[0] if len(parts) == 1 else parts[1].unionByName(parts[0], allowMissingColumns=True)
        found = {flat[r["position"]]: r.asDict() for r in per_column.collect()}    # a row per column
    rows = []
    for i, c in enumerate(cols):
        r = found.get(c)
        head = (c, i, _kind(dts[c]), c in set(declared_categorical))
        if r is None:
            rows.append((*head, None, None, None, None, None, None, False, False))
            continue
        fmt = next((f for j, f in enumerate(DATETIME_FORMATS) if r.get("n_nonblank") and not r[f"d{j}"]), None)
        rows.append((*head, r["n_rows"], r["n_null"], r["n_distinct"], r.get("n_bad_numeric") or 0,
                     r.get("n_boolean_like") or 0, fmt, bool(r.get("many_tokens")),
                     (r.get("blanks") or 0) > MIN_TOKEN_FREQUENCY_FOR_TEXT))
    stats = spark.createDataFrame(rows, STATS_SCHEMA)
    maybe = {r[0] for r in rows if r[-2] and not r[-1]}
    if maybe and not all_texts:
        decided = F.col("is_categorical") | F.col("is_numeric") | F.col("is_datetime") | F.col("declared")
        maybe &= {r["column_name"] for r in column_flags(stats).where(~decided).collect()}
    frequent = _frequent_token(df, [c for c in cols if c in maybe])
    if frequent:
        stats = spark.createDataFrame([(*r[:-1], r[-1] or r[0] in frequent) for r in rows], STATS_SCHEMA)
    return stats


def _flags(int_parity: bool = True) -> dict[str, Column]:
    kind = F.col("kind")
    nd = F.coalesce(F.col("n_distinct"), F.lit(0))
    n_nonnull = F.col("n_rows") - F.col("n_null")
    is_numeric = kind.isin("int", "float", "bool", "temporal") | \
        ((kind == "string") & (F.col("n_bad_numeric") == 0))
    is_integer = (kind == "int") & ((F.col("n_null") == 0) if int_parity else F.lit(True))
    share_ok = (nd / F.nullif(n_nonnull, F.lit(0))) <= F.lit(MAX_CATEGORY_SHARE)
    is_categorical = (nd >= 1) & F.when(
        is_numeric, (nd <= MAX_CATEGORIES_NUMERIC) & is_integer
    ).otherwise(nd <= MAX_CATEGORIES_TEXT) & F.coalesce(share_ok, F.lit(False))
    is_datetime = (kind == "temporal") | ((kind == "string") & F.col("datetime_format").isNotNull())
    is_text = (kind == "string") & F.col("many_tokens") & F.col("frequent_token")
    unsupported = (kind == "nested") | (kind == "other") | (nd < 1)
    return dict(is_numeric=F.coalesce(is_numeric, F.lit(False)),
                is_integer=is_integer,
                is_categorical=F.coalesce(is_categorical, F.lit(False)),
                is_datetime=F.coalesce(is_datetime, F.lit(False)),
                is_text=F.coalesce(is_text, F.lit(False)),
                unsupported=unsupported)


def column_flags(stats: DataFrame, int_parity: bool = True) -> DataFrame:
    """C1, C2, C3, C5 flags per column."""
    fl = _flags(int_parity)
    return stats.select("column_name", "position", "kind", "declared", "n_rows", "n_null", "n_distinct",
                        *[c.alias(k) for k, c in fl.items()])


def types_from_stats(stats: DataFrame, int_parity: bool = True) -> DataFrame:
    """C4: the ordered rule; long result ``(column_name, position, data_type)``."""
    f = column_flags(stats, int_parity)
    c = F.col
    kind = c("kind")
    arr = (F.when(c("unsupported"), F.array(F.lit("Unsupported")))
           .when(c("declared"), F.array(F.lit("Categorical"),
                                        F.when(c("is_numeric"), F.lit("Numeric")).otherwise(F.lit("Text"))))
           .when(c("is_categorical"), F.array(F.lit("Categorical")))
           .when(kind == "temporal", F.array(F.lit("DateTime")))
           .when(kind.isin("int", "float", "bool"), F.array(F.lit("Numeric")))
           .when(c("is_numeric"), F.array(F.lit("Numeric")))
           .when(c("is_datetime"), F.array(F.lit("DateTime")))
           .when(c("is_text"), F.array(F.lit("Text")))
           .otherwise(F.array(F.lit("Id"))))
    return f.select("column_name", "position", F.explode(arr).alias("data_type"))


def get_data_types(df: DataFrame, variables: Sequence[str] | None = None,
                   declared_categorical: Sequence[str] = (), int_parity: bool = True) -> DataFrame:
    """C4 on a table: ``(column_name, position, data_type)``; a column may appear twice."""
    return types_from_stats(column_stats(df, variables, declared_categorical, all_texts=False), int_parity)


def semantic_types(df: DataFrame, variables: Sequence[str] | None = None) -> DataFrame:
    """Profile typeset (Boolean, Numeric, DateTime, Categorical, Text, Unsupported)."""
    s = column_stats(df, variables, all_texts=False)
    c = F.col
    nd = F.coalesce(c("n_distinct"), F.lit(0))
    kind = c("kind")
    n_nonnull = c("n_rows") - c("n_null")
    fl = _flags()
    t = (F.when((kind == "nested") | (kind == "other") | (nd < 1), F.lit("Unsupported"))
         .when(kind == "bool", F.lit("Boolean"))
         .when((kind == "string") & (c("n_boolean_like") == n_nonnull) & (nd <= 2), F.lit("Boolean"))
         .when(kind == "temporal", F.lit("DateTime"))
         .when(kind.isin("int", "float"),
               F.when(nd <= SEMANTIC_MAX_NUMERIC_CATEGORIES, F.lit("Categorical")).otherwise(F.lit("Numeric")))
         .when(fl["is_numeric"], F.lit("Numeric"))
         .when(fl["is_datetime"], F.lit("DateTime"))
         .when((nd <= SEMANTIC_MAX_CATEGORIES) &
               (nd / F.nullif(c("n_rows"), F.lit(0)) < SEMANTIC_MAX_CATEGORY_SHARE), F.lit("Categorical"))
         .otherwise(F.lit("Text")))
    return s.select("column_name", "position", t.alias("data_type"))


def invert_type_map(types_long: DataFrame) -> DataFrame:
    """``(data_type, columns)`` with columns in schema order joined by ','."""
    return (types_long.groupBy("data_type")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "column_name"))),
                                          lambda s: s["column_name"]), ",").alias("columns")))


def numeric_columns(df: DataFrame, variables: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, position, is_numeric)``."""
    return column_flags(column_stats(df, variables, all_texts=False)).select("column_name", "position", "is_numeric")


def guess_roles(types_long: DataFrame) -> DataFrame:
    """Candidate columns (Numeric, Categorical or Text), schema order, no repeats."""
    return (types_long.filter(F.col("data_type").isin("Numeric", "Categorical", "Text"))
            .groupBy("column_name").agg(F.min("position").alias("position")))


def role_candidates(types_long: DataFrame, y: str | None = None) -> DataFrame:
    """Y candidates (Numeric then Categorical) and x candidates (Numeric, Text, Categorical minus y).

    Result ``(role, column_name, rank)``; a column listed under two types keeps its first place.
    """
    ty = F.col("data_type")
    y_order = F.when(ty == "Numeric", 0).when(ty == "Categorical", 1)
    x_order = F.when(ty == "Numeric", 0).when(ty == "Text", 1).when(ty == "Categorical", 2)
    ys = (types_long.withColumn("__o", y_order).filter(F.col("__o").isNotNull())
          .groupBy("column_name").agg(F.min(F.struct("__o", "position")).alias("__k"))
          .select(F.lit("y").alias("role"), "column_name", "__k"))
    xs = types_long.withColumn("__o", x_order).filter(F.col("__o").isNotNull())
    if y is not None:
        xs = xs.filter(F.col("column_name") != y)
    xs = (xs.groupBy("column_name").agg(F.min(F.struct("__o", "position")).alias("__k"))
          .select(F.lit("x").alias("role"), "column_name", "__k"))
    both = ys.unionByName(xs)
    # a handful of rows per role (bounded by the number of columns)
    from pyspark.sql import Window
    w = Window.partitionBy("role").orderBy(F.col("__k.__o"), F.col("__k.position"))
    return both.select("role", "column_name", F.row_number().over(w).alias("rank"))
