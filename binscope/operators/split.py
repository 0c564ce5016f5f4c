"""Train / test splits (deterministic, no driver work)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binscope.functions.exprs import qcol

SPLIT_BUCKETS = 1000


def split_by_samples(df: DataFrame, train_share: float = 0.8, key_columns: Sequence[str] | None = None,
                     seed: int = 42) -> DataFrame:
    """Adds ``split`` = train / test from an MD5 of the key columns' texts.

    Stable across runs, retries and engines: a recomputed partition gives every
    row the same side. Each text is led by its length, a null is ``n``, so
    different keys never read alike.
    """
    text = lambda c: qcol(c).cast("string")
    keys = [F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("n"))
            for c in (key_columns or df.columns)]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *keys))
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % SPLIT_BUCKETS
    return df.withColumn("split", F.when(h < int(round(train_share * SPLIT_BUCKETS)), F.lit("train"))
                         .otherwise(F.lit("test")))


def split_by_datetime(df: DataFrame, column: str, point: str) -> DataFrame:
    """Adds ``split`` = train (before ``point``) / test (at or after it); nulls go to test."""
    ts = qcol(column).cast("timestamp")
    return df.withColumn("split", F.when(ts < F.to_timestamp(F.lit(point)), F.lit("train"))
                         .otherwise(F.lit("test")))
