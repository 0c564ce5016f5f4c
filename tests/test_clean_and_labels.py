from pyspark.sql import functions as F

from binscope.functions.exprs import short_label
from binscope.operators.bands import DARK_PALETTE, quartile_bands
from binscope.operators.clean import drop_null_pair, fill_null_by_types
from binscope.operators.split import split_by_samples


def test_non_finite_pair_dropped(spark):
    rows = [(1.0, 1.0), (float("inf"), 2.0), (float("-inf"), 3.0), (float("nan"), 4.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    assert drop_null_pair(df, "x", "y").count() == 1


def test_fill_drops_missing_target_and_fills_by_type(spark):
    df = spark.createDataFrame([(None, None, 1.0), (2.0, "a", None), (3.0, None, 2.0)],
                               "n double, t string, y double")
    out = fill_null_by_types(df, ["n", "t"], "y", {"Numeric": ["n"], "Text": ["t"]}).orderBy("y").collect()
    assert [(r.n, r.t, r.y) for r in out] == [(0.0, "", 1.0), (3.0, "", 2.0)]


def test_long_label_cut(spark):
    df = spark.createDataFrame([("x" * 30,), ("short",)], "s string")
    out = [r[0] for r in df.select(short_label(F.col("s"))).collect()]
    assert out == ["x" * 27 + "...", "short"]


def test_quartile_bands(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 9)] + [(None,)], "score double")
    rows = quartile_bands(df).orderBy("score").collect()
    bands = [r.score_band for r in rows]
    assert bands == [None, 1, 1, 2, 2, 3, 3, 4, 4]
    assert rows[1].score_colour == DARK_PALETTE[0]


def test_split_disjoint_and_complete(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "k")
    s = split_by_samples(df, 0.7, ["k"])
    n_train = s.filter("split = 'train'").count()
    assert s.count() == 5000
    assert 3200 < n_train < 3800
    again = split_by_samples(df, 0.7, ["k"])
    assert s.join(again, ["k", "split"]).count() == 5000


def test_monotonic_drop_anywhere_is_found(spark):
    from binscope.operators.profile import profile_monotonic
    n = 2000
    drops = list(range(1, n, 41))
    cols = [f"c{j}" for j in range(len(drops))]
    rows = [tuple([i] + [float(i - (5 if i >= p else 0)) for p in drops] + [float(i)]) for i in range(n)]
    df = spark.createDataFrame(rows, "o long, " + ", ".join(f"{c} double" for c in cols) + ", up double")
    out = {r.column_name: r for r in profile_monotonic(df, cols + ["up"], "o", partitions=40).collect()}
    assert out["up"].monotonic_increasing and not out["up"].monotonic_decreasing
    assert not any(out[c].monotonic_increasing for c in cols)


def test_wall_clock_ranges_ignore_session_zone(spark):
    from binscope.operators.profile import profile_datetime
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 01:00:00' AS t UNION ALL "
                       "SELECT TIMESTAMP_NTZ'2024-03-10 04:00:00'")
        r = profile_datetime(df, ["t"]).first()
        assert r.range_seconds == 3 * 3600
        assert (r["min"], r["max"]) == ("2024-03-10 01:00:00", "2024-03-10 04:00:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_common_counts_normalise_floats(spark):
    from binscope.operators.profile import profile_common
    df = spark.createDataFrame([(0.0, 1), (-0.0, 1), (float("nan"), 2), (1.0, None), (None, 3)], "x double, k int")
    r = {x.column_name: x for x in profile_common(df).collect()}
    assert (r["x"].n, r["x"].n_missing, r["x"].n_distinct, r["x"].n_unique) == (3, 2, 2, 1)
    assert (r["k"].n, r["k"].n_missing, r["k"].n_distinct, r["k"].n_unique) == (4, 1, 3, 2)


def test_bands_of_numeric_strings(spark):
    from binscope.operators.bands import quartile_bands
    df = spark.createDataFrame([(str(i) if i % 9 else " ", f"t{i}", float(i)) for i in range(1, 81)], "n string, t string, x double")
    out = quartile_bands(df)
    assert out.columns == ["n", "t", "x", "n_band", "n_colour", "x_band", "x_colour"]
    rows = out.collect()
    assert all((r.n_band is None) == (r.n == " ") for r in rows) and {r.n_band for r in rows} == {None, 1, 2, 3, 4}
    assert all(r.n_band == 1 for r in rows if r.n != " " and int(r.n) <= 18)
