import numpy as np
import pytest
from pyspark.sql import functions as F

from binscope.operators.sketches import (KLL_FACTOR, KLL_POWER, merge_sketches, quantile_sketches, rank_errors,
                                         sketch_quantiles, sketch_size)

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def test_stored_and_merged_sketches_keep_the_error(spark, tmp_path):
    rng = np.random.default_rng(3)
    # skewed, tied (a third of the rows hold one value), with nulls and non-finite values
    x = np.where(rng.random(20_000) < 1 / 3, 5.0, rng.lognormal(size=20_000) * 10)
    rows = [(i % 7, float(v) if i % 50 else None, float("nan") if i % 11 == 0 else float(i)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "day int, `x.y` double, z double").repartition(13)
    quantile_sketches(df, ["x.y", "z"], ["day"], error=0.02).write.parquet(str(tmp_path / "s"))
    merged = merge_sketches(spark.read.parquet(str(tmp_path / "s")))
    q = spark.createDataFrame(sketch_quantiles(merged, PROBS).collect())
    errors = rank_errors(df, q).collect()
    assert len(errors) == 2 * len(PROBS)
    assert max(r.rank_error for r in errors) <= 0.02
    n = {r.column_name: r.n for r in errors}
    assert n == {"x.y": sum(r[1] is not None for r in rows), "z": sum(i % 11 != 0 for i in range(20_000))}
    ends = {(r.column_name, r.prob): r.quantile for r in q.collect()}
    m = {r.column_name: (r.min_x, r.max_x) for r in merged.collect()}
    assert all((ends[c, 0.0], ends[c, 1.0]) == m[c] for c in m)


def test_few_values_are_exact_and_empty_columns_null(spark):
    df = spark.createDataFrame([(float(v), None) for v in range(1, 100)], "x double, e double")
    got = {(r.column_name, r.prob): r.quantile for r in sketch_quantiles(quantile_sketches(df, ["x", "e"]), [0.25, 0.5]).collect()}
    assert got == {("x", 0.25): 25.0, ("x", 0.5): 50.0, ("e", 0.25): None, ("e", 0.5): None}
    assert quantile_sketches(df.limit(0), ["x"]).collect() == []


def test_size_follows_the_bound(spark):
    for error in (0.1, 0.01, 0.001):
        assert KLL_FACTOR / sketch_size(error) ** KLL_POWER <= error / 2
    with pytest.raises(ValueError):
        sketch_size(1e-6)
    df = spark.createDataFrame([(1.0, 2)], "x double, n int")
    with pytest.raises(ValueError):
        quantile_sketches(df, ["x"], by=["n"])


def test_units_of_many_categories(spark):
    """Against a plain loop: units begin at shares of the rows, whatever the partitions; like metrics stay together."""
    from binscope.operators.binning.optimal import _units_by_mass
    rng = np.random.default_rng(5)
    rows = [("f", f"c{i}", float(rng.integers(0, 400)) / 400, int(rng.integers(1, 30))) for i in range(3000)]
    rows.append(("f", "hot", 0.31, sum(r[3] for r in rows) // 2))       # a third of all rows
    total, cum, want = sum(r[3] for r in rows), 0, {}
    for m in sorted({r[2] for r in rows}):
        want[m] = cum * 64 // total
        cum += sum(r[3] for r in rows if r[2] == m)
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "factor string, category string, metric double, n long").repartition(parts)
        got = {r.category: r.fine_id for r in _units_by_mass(df, 64).collect()}
        assert got == {r[1]: want[r[2]] for r in rows}


def test_binning_of_many_categories_covers_all_rows(spark):
    from binscope.operators.binning.optimal import optimal_binning
    rng = np.random.default_rng(6)
    c = rng.integers(0, 600, size=6000)
    df = spark.createDataFrame([(f"c{i}", float(i // 200 * 10 + rng.normal())) for i in c.tolist()], "c string, y double")
    res = optimal_binning(df, ["c"], "y", "continuous")
    regular = res.table.filter("kind = 'regular'").orderBy("bin_id").collect()
    assert sum(r["count"] for r in regular) == 6000
    means = [r["mean"] for r in regular]
    assert means == sorted(means) or means == sorted(means, reverse=True)
    # three planted levels of about 2,000 rows each are told apart
    assert min(means) < 1 and max(means) > 19


def test_split_keys_do_not_run_together(spark):
    from binscope.operators.split import split_by_samples
    df = spark.range(4000).select(F.col("id").cast("string").alias("a.b"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("k"))
    a = split_by_samples(df, 0.8)
    assert a.columns == ["a.b", "k", "split"] and a.where("split is null").isEmpty()
    share = a.where("split = 'train'").count() / 4000
    assert abs(share - 0.8) < 0.03
    b = {r["a.b"]: r["split"] for r in split_by_samples(df.repartition(5), 0.8).collect()}
    assert b == {r["a.b"]: r["split"] for r in a.collect()}
