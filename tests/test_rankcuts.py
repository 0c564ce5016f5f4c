import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from binscope.operators.binning.optimal import candidate_cuts
from binscope.operators.rankcuts import rank_values

SHARES = [0.0, 1 / 256, 0.1, 0.25, 0.5, 0.75, 0.9, 255 / 256, 1.0]


def by_sorting(values, shares=SHARES):
    v = sorted(x for x in values if x is not None and math.isfinite(x))
    return [v[max(1, math.ceil(p * len(v))) - 1] for p in shares] if v else []


@pytest.mark.parametrize("range_rows,pieces", [(1_000_000, 64), (60, 16)])
def test_ranks_of_odd_columns(spark, range_rows, pieces):
    """Ties, outliers, nulls and infinities; ranges down to a few rows."""
    rng = np.random.default_rng(4)
    n = 3000
    cols = {"normal": rng.normal(size=n), "steep": np.exp(rng.normal(size=n) * 40), "tie": np.where(rng.random(n) < 0.4, 7.0, rng.random(n) * 9),
            "few": rng.integers(0, 3, n).astype(float), "one": np.full(n, 2.5), "zero": np.where(rng.random(n) < 0.5, -0.0, 0.0),
            "odd": np.where(rng.random(n) < 0.1, np.inf, rng.normal(size=n))}
    rows = [(None if i % 17 == 0 else float(cols["normal"][i]), *[float(cols[c][i]) for c in list(cols)[1:]], None) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in [*cols, "none"]))
    got = rank_values(df, [*cols, "none"], SHARES, range_rows, pieces)
    for k, c in enumerate([*cols, "none"]):
        assert got[c] == by_sorting([r[k] for r in rows]), c


def test_cuts_do_not_follow_the_partitioning(spark, sf001):
    li = spark.read.parquet(f"{sf001}/lineitem.parquet").select("l_extendedprice", "l_quantity", F.col("l_partkey").cast("string").alias("p"))
    every = [candidate_cuts(li.repartition(n), li.columns) for n in (1, 7, 64)]
    assert every[0] == every[1] == every[2]
    values = [r[0] for r in li.select("l_extendedprice").collect()]
    want = by_sorting(values, [i / 256 for i in range(1, 256)])
    assert every[0]["l_extendedprice"] == sorted(set(want) - {min(values)})
    assert every[0]["l_quantity"] == [float(x) for x in range(2, 51)]
