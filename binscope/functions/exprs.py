"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must stay as stated for results to match the reference rules)
# ---------------------------------------------------------------------------
# numeric string accepted by a pandas-style ``to_numeric`` (case-insensitive)
NUMERIC_STRING_RE = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity)\s*$"
# token of the text rule: a latin word/number (optionally decimal, optionally %), else one character
TOKEN_RE = r"[A-Za-z0-9]+(?:\.\d+)?%?|[\s\S]"
# word of two or more letters/digits (tf-idf tokens, word frequencies)
WORD_RE = r"[\p{L}\p{M}\p{N}_]{2,}"
# longest bin label before it is cut and given "..."
BIN_LABEL_MAX = 27
# date-time formats tried, one at a time, on string columns
DATETIME_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "yyyy/MM/dd",
    "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy",
    "MM/dd/yyyy HH:mm:ss",
    "dd.MM.yyyy",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd HH:mm:ss.SSSSSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSS",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSSXXX",
    "yyyy-MM-dd HH:mm:ssXXX",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
)
# no value of these formats is longer: a longer text is not parsed
DATETIME_MAX = 40

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
TEMPORAL_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def qcol(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def target_values(y: str, dtype: T.DataType) -> Column:
    """A class target with NaN and infinities as null."""
    return finite(qcol(y), dtype)


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES) or isinstance(dt, T.BooleanType)


def finite(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """NaN, +inf and -inf become null (floating columns only)."""
    col = qcol(c) if isinstance(c, str) else c
    if dtype is not None and not isinstance(dtype, FLOAT_TYPES):
        return col
    return F.when(F.isnan(col) | col.isin(float("inf"), float("-inf")), F.lit(None)).otherwise(col)


NTZ_EPOCH = "1970-01-01 00:00:00"


def ntz_micros(col: Column) -> Column:
    """Microseconds of a wall-clock timestamp since 1970-01-01 00:00, free of the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit(NTZ_EPOCH).cast("timestamp_ntz"), col)


def as_double(c: Column | str, dtype: T.DataType) -> Column:
    """Numeric view of a column: bool -> 0/1, temporal -> epoch seconds, strings parsed."""
    col = qcol(c) if isinstance(c, str) else c
    if isinstance(dtype, T.BooleanType):
        return col.cast("int").cast("double")
    if isinstance(dtype, T.TimestampNTZType):
        return ntz_micros(col).cast("double") / 1e6
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col).cast("double") / 1e6
    if isinstance(dtype, T.DateType):
        return F.unix_date(col).cast("double") * 86400.0
    if isinstance(dtype, T.StringType):
        return finite(parse_numeric_string(col))
    return finite(col.cast("double"))


def parse_numeric_string(col: Column) -> Column:
    """Parse a string the way the numeric rule accepts it; '' and invalid give null."""
    s = F.lower(F.trim(col))
    unsigned = F.regexp_replace(s, r"^[+-]", "")
    neg = s.startswith("-")
    is_inf = unsigned.isin("inf", "infinity")
    return F.when(is_inf & neg, F.lit(float("-inf"))) \
        .when(is_inf, F.lit(float("inf"))) \
        .when(col.rlike(NUMERIC_STRING_RE), s.try_cast("double")) \
        .otherwise(F.lit(None).cast("double"))


def bin_index_expr(x: Column, cuts: Sequence[float]) -> Column:
    """Index of the bin holding ``x`` for bins (-inf,c1), [c1,c2), ..., [ck,inf).

    Equal to ``#{c in cuts : c <= x}``, written as a balanced comparison tree so
    it costs log2(k) comparisons per row and stays inside whole-stage codegen.
    """
    cuts = sorted(set(float(c) for c in cuts))

    def build(lo: int, hi: int) -> Column:
        # answer is in [lo, hi]; cuts[lo..hi-1] decide
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        # x < cuts[mid] -> index <= mid, else index >= mid+1
        return F.when(x < F.lit(cuts[mid]), build(lo, mid)).otherwise(build(mid + 1, hi))

    return F.when(x.isNull(), F.lit(None).cast("int")).otherwise(build(0, len(cuts)))


def bin_label(lo: Column, hi: Column) -> Column:
    """'(-inf, a)', '[a, b)', '[b, inf)' with two decimals; '(-inf, inf)' for a single bin."""
    return F.when(lo.isNull() & hi.isNull(), F.lit("(-inf, inf)")) \
        .when(lo.isNull(), F.format_string("(-inf, %.2f)", hi)) \
        .when(hi.isNull(), F.format_string("[%.2f, inf)", lo)) \
        .otherwise(F.format_string("[%.2f, %.2f)", lo, hi))


def short_label(label: Column, max_length: int = BIN_LABEL_MAX) -> Column:
    """Cut labels longer than ``max_length`` characters and append '...'."""
    return F.when(F.length(label) > max_length,
                  F.concat(F.substring(label, 1, max_length), F.lit("..."))).otherwise(label)


def tokens(col: Column) -> Column:
    """Tokens of the text rule (latin words / numbers, every other character alone)."""
    return F.regexp_extract_all(col, F.lit(TOKEN_RE), 0)


def words(col: Column) -> Column:
    """Lower-cased words of two or more letters/digits."""
    return F.regexp_extract_all(F.lower(col), F.lit(WORD_RE), 0)
