"""Fitted bins on a stream.

The reference has no streaming.  Its row-level operators are stateless, though,
so once splits are fitted on a batch table they apply unchanged to a streaming
DataFrame: bin assignment (E10) and the non-finite / null handling (B2-B5) are
narrow projections, and the bin labels come from a small static table
(stream-static join).  No state, watermark or window is involved.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binscope.operators.binning.tables import assign_bins, bin_skeleton, normalise_splits


def bin_stream(stream: DataFrame, factors: Sequence[str], splits: Mapping[str, Sequence[float]],
               keep: Sequence[str] = (), special_codes: Sequence[float] = ()) -> DataFrame:
    """``(keep..., factor, bin_id, bin, x)`` for every incoming row and factor."""
    spl = normalise_splits(splits)
    if keep:
        # the key columns ride through the explode as one struct
        a = assign_bins(stream, factors, spl, special_codes=special_codes, y_expr=F.struct(*keep))
        a = a.select(*[F.col(f"y.{k}").alias(k) for k in keep], "factor", "position", "bin_id", "x")
    else:
        a = assign_bins(stream, factors, spl, special_codes=special_codes)
    labels = bin_skeleton(stream.sparkSession, factors, spl).select("factor", "bin_id", "bin")
    return a.join(F.broadcast(labels), ["factor", "bin_id"], "left")   # a few rows per factor
