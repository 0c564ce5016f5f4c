"""B: projection, null / non-finite handling, casts and report rounding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binscope.functions.exprs import qcol, FLOAT_TYPES, finite


def _dtypes(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def check_roles(df: DataFrame, x_factors: Sequence[str], y_factor: str | None) -> list[str]:
    """X non-empty, y given and present, y removed from X."""
    cols = set(df.columns)
    if y_factor is not None:
        if not str(y_factor).strip():
            raise ValueError("the target column name is blank")
        if y_factor not in cols:
            raise ValueError(f"target column {y_factor!r} is not in the table")
    xs = [x for x in x_factors if x != y_factor]
    if not xs:
        raise ValueError("no factor columns left after removing the target")
    missing = [x for x in xs if x not in cols]
    if missing:
        raise ValueError(f"factor columns not in the table: {missing}")
    return xs


def select_factors(df: DataFrame, x_factors: Sequence[str], y_factor: str) -> DataFrame:
    """B1: project X and y (y excluded from X)."""
    xs = check_roles(df, x_factors, y_factor)
    return df.select(*xs, y_factor)


def normalise_non_finite(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN, +inf and -inf become null in floating columns."""
    dt = _dtypes(df)
    cols = set(columns or df.columns)
    return df.select(*[
        finite(qcol(c), dt[c]).alias(c) if c in cols and isinstance(dt[c], FLOAT_TYPES) else qcol(c)
        for c in df.columns])


def drop_null_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """B2: (x, y) with rows dropped where either is null, NaN or infinite."""
    dt = _dtypes(df)
    return (df.select(finite(qcol(x), dt[x]).alias(x), finite(qcol(y), dt[y]).alias(y))
              .na.drop(subset=[x, y]))


def drop_null_rows(df: DataFrame, x_factors: Sequence[str], y: str) -> DataFrame:
    """Drop a row if any factor or the target is null, NaN or infinite."""
    cols = list(x_factors) + [y]
    return normalise_non_finite(df.select(*cols), cols).na.drop(subset=cols)


def type_lookup(type_map: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """C13 on the driver side: {type: [columns]} -> {column: [types]} (order kept)."""
    out: dict[str, list[str]] = {}
    for t, cols in type_map.items():
        for c in cols:
            out.setdefault(str(c), []).append(t)
    return out


def fill_value(types: Sequence[str], dtype: T.DataType):
    """Fill literal for a factor: Numeric -> 0, Text -> '', DateTime -> 1970-01-01, else 0."""
    if "Numeric" in types:
        return F.lit(0).cast(dtype) if not isinstance(dtype, T.StringType) else F.lit("0")
    if "Text" in types:
        return F.lit("")
    if "DateTime" in types:
        if isinstance(dtype, T.StringType):
            return F.lit("1970-01-01")
        return F.lit("1970-01-01 00:00:00").cast(dtype)
    if isinstance(dtype, T.StringType):
        return F.lit("0")
    return F.lit(0).cast(dtype)


def fill_null_by_types(df: DataFrame, x_factors: Sequence[str], y: str,
                       type_map: Mapping[str, Sequence[str]]) -> DataFrame:
    """Drop rows with a missing target, then fill each factor by its first type.

    A factor absent from the type map raises ``KeyError`` (as the rule requires a type).
    """
    dt = _dtypes(df)
    lookup = type_lookup(type_map)
    out = df.filter(finite(qcol(y), dt[y]).isNotNull())
    cols = []
    for x in x_factors:
        if x not in lookup:
            raise KeyError(x)
        cols.append(F.coalesce(finite(qcol(x), dt[x]), fill_value(lookup[x], dt[x])).alias(x))
    return out.select(*cols, qcol(y))


def cast_float(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The given columns as double."""
    cs = set(columns)
    return df.select(*[qcol(c).cast("double").alias(c) if c in cs else qcol(c) for c in df.columns])


def round_report(df: DataFrame, digits: int = 3, special: Mapping[str, int] | None = None) -> DataFrame:
    """Round every floating column (``special`` gives per-column digits, e.g. missing: 2)."""
    special = dict(special or {})
    dt = _dtypes(df)
    return df.select(*[
        F.round(qcol(c), special.get(c, digits)).alias(c)
        if isinstance(dt[c], (T.FloatType, T.DoubleType, T.DecimalType)) else qcol(c)
        for c in df.columns])
