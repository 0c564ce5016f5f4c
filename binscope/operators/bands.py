"""H1: quartile bands of numeric columns (and the palette rule P7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binscope.functions.exprs import NUMERIC_STRING_RE, NUMERIC_TYPES, as_double, qcol
from binscope.operators.longform import exact_quantiles
from binscope.operators.profile import finite_long

# Name parts that select the dark palette, and the colours of bands 1..4
DARK_NAME_PARTS = ("score", "scores", "value", "values", "打分", "分值", "分数", "评分")
LIGHT_PALETTE = ("00ffd4", "98f5ff", "fed8b1", "ff7f7d")
DARK_PALETTE = ("40E0D0", "6495ED", "FF7F50", "FC3468")


def palette(column: str) -> tuple[str, ...]:
    """Dark palette when the lower-cased name holds one of DARK_NAME_PARTS."""
    low = column.lower()
    return DARK_PALETTE if any(p in low for p in DARK_NAME_PARTS) else LIGHT_PALETTE


def numeric_strings(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The string columns whose values that are not blank are all numbers (C1), one at least; one pass."""
    if not columns:
        return []
    full = [F.trim(qcol(c)) != "" for c in columns]
    row = df.agg(*[F.struct(F.count_if(f), F.count_if(f & ~qcol(c).rlike(NUMERIC_STRING_RE))).alias(f"s{i}")
                   for i, (c, f) in enumerate(zip(columns, full))]).first()
    return [c for i, c in enumerate(columns) if row[f"s{i}"][0] and not row[f"s{i}"][1]]


def quartile_bands(df: DataFrame, columns: Sequence[str] | None = None, suffix: str = "_band") -> DataFrame:
    """H1: adds ``<column>_band`` (1..4) and ``<column>_colour`` for every numeric column, also of numeric strings.

    band = first i with value <= q(i/4) (exact quartiles, linear interpolation);
    null values get no band.  Quartiles are three numbers per column: they are
    computed by Spark and inlined as literals.
    """
    dt = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in (columns or df.columns) if isinstance(dt[c], NUMERIC_TYPES)]
    cols += numeric_strings(df, [c for c in (columns or df.columns) if isinstance(dt[c], T.StringType)])
    if not cols:
        return df
    cols = [c for c in (columns or df.columns) if c in cols]
    numbers = df.select(*[as_double(qcol(c), dt[c]).alias(c) for c in cols])
    lng = finite_long(numbers, cols).select(F.col("column_name").alias("factor"), "position", "x")
    q = {(r.factor, round(r.prob, 2)): r.quantile
         for r in exact_quantiles(lng, [0.25, 0.5, 0.75]).collect()}   # 3 rows per column
    out = df
    for c in cols:
        x = as_double(qcol(c), dt[c]) if isinstance(dt[c], T.StringType) else qcol(c).cast("double")
        q1, q2, q3 = (q.get((c, p)) for p in (0.25, 0.5, 0.75))
        band = (F.when(x.isNull() | F.isnan(x), F.lit(None).cast("int"))
                .when(x <= F.lit(q1), 1).when(x <= F.lit(q2), 2).when(x <= F.lit(q3), 3).otherwise(4))
        pal = palette(c)
        colour = F.when(band.isNull(), F.lit(None).cast("string")).otherwise(
            F.element_at(F.array(*[F.lit(p) for p in pal]), band))
        out = out.withColumn(c + suffix, band.cast("int")).withColumn(c + "_colour", colour)
    return out
