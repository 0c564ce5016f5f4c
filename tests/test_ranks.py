import numpy as np
from pyspark.sql import functions as F

from binscope.operators.longform import to_long
from binscope.operators.ranks import kendall_s_local, kendall_tau_b, spearman


def _brute_s(x, y, w):
    s = 0.0
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            s += w[i] * w[j] * np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
    return s


def _brute_tau(x, y):
    n = len(x)
    s = _brute_s(x, y, np.ones(n))
    n0 = n * (n - 1) / 2
    _, cx = np.unique(x, return_counts=True)
    _, cy = np.unique(y, return_counts=True)
    n1 = (cx * (cx - 1) / 2).sum()
    n2 = (cy * (cy - 1) / 2).sum()
    return s / np.sqrt((n0 - n1) * (n0 - n2))


def test_local_s_matches_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(2, 60))
        x = rng.integers(0, 8, size=n).astype(float)
        y = rng.integers(0, 5, size=n).astype(float)
        w = rng.integers(1, 4, size=n).astype(float)
        assert abs(kendall_s_local(x, y, w) - _brute_s(x, y, w)) < 1e-9


def test_tau_b_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, size=500).astype(float)
    y = (x * 0.3 + rng.integers(0, 6, size=500)).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    lng = to_long(df, ["x"], target="y")
    got = kendall_tau_b(lng).first().kendall_tau_b
    assert abs(got - _brute_tau(x, y)) < 1e-12
    got_b = kendall_tau_b(lng, local_pairs=10).first().kendall_tau_b
    assert abs(got_b - _brute_tau(x, y)) < 1e-12


def test_few_values_are_walked_along_the_other_side(spark, monkeypatch):
    """Ties on both sides, either side with few values, without a local group of pairs."""
    from binscope.operators import ranks as R
    monkeypatch.setattr(R, "_local_s", None)
    rng = np.random.default_rng(6)
    n = 3000
    few, many = rng.integers(0, 11, n) / 4.0, np.round(rng.normal(size=n) * 300)
    y = np.round(many / 7 + few * 20 + rng.normal(size=n) * 30, 1)
    df = spark.createDataFrame([(float(a), float(b), 2.0, None if i % 5 == 0 else float(a), float(c), float(d)) for i, (a, b, c, d) in
                                enumerate(zip(few, many, y, rng.integers(-2, 3, n) * 0.5))],
                               "few double, many double, one double, gaps double, y double, few_y double")
    got = {r.factor: r.kendall_tau_b for r in kendall_tau_b(to_long(df, ["few", "one", "gaps"], target="y"), local_pairs=10_000).collect()}
    some = np.arange(n) % 5 != 0
    assert set(got) == {"few", "one", "gaps"} and got["one"] is None
    assert abs(got["few"] - _brute_tau_fast(few, y)) < 1e-12 and abs(got["gaps"] - _brute_tau_fast(few[some], y[some])) < 1e-12
    few_y = np.array([r.few_y for r in df.select("few_y").collect()])
    got = kendall_tau_b(to_long(df, ["many"], target="few_y"), local_pairs=10_000).first().kendall_tau_b
    assert abs(got - _brute_tau_fast(many, few_y)) < 1e-12


def _brute_tau_fast(x, y):
    dx, dy = (np.sign(v[:, None] - v[None, :]) for v in (x, y))
    return (dx * dy).sum() / np.sqrt((dx != 0).sum() * (dy != 0).sum())


def test_walk_in_steps(monkeypatch):
    """S by steps and ranges is S of all points, whatever y the ranges part."""
    import pyarrow as pa
    from binscope.operators import ranks as R
    monkeypatch.setattr(R, "WALKED", 50)
    rng = np.random.default_rng(2)
    for levels in (1, 2, 7, 33):
        code, y, w = rng.integers(0, levels, 900), np.sort(rng.integers(0, 150, 900) / 2.0), rng.integers(1, 4, 900)
        y[800:] = np.nan                               # goes on, as y[300] does below
        f = rng.choice([0, 3], 900)
        rows = pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(code, pa.int32()), pa.array(y, pa.float64()), pa.array(w)],
                                          names=["f", "code", "y", "w"])
        y[300:700] = y[300]
        cuts = [0, 120, 310, 400, 500, 640, 740, 820, 900]
        ranges = [b for a, c in zip(cuts, cuts[1:])
                  for b in R._walked({0: levels, 3: levels})([rows.slice(i, min(13, c - i)) for i in range(a, c, 13)])]
        pdf = pa.Table.from_batches(ranges).to_pandas()
        place = np.unique(y, return_inverse=True)[1]
        for k in (0, 3):
            own = f == k
            got = R._joined(pdf[pdf["f"] == k])
            assert got["s"].iloc[0] == kendall_s_local(code[own], place[own], w[own])
            t = np.bincount(place[own], w[own])
            assert got["tied"].iloc[0] == (t * (t - 1) / 2).sum()


def test_spearman_and_constant(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=300)
    y = x + rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b), 1.0) for a, b in zip(x, y)], "x double, y double, c double")
    lng = to_long(df, ["x", "c"], target="y")
    got = {r.factor: r.spearman for r in spearman(lng).collect()}
    rx = np.argsort(np.argsort(x)) + 1.0
    ry = np.argsort(np.argsort(y)) + 1.0
    assert abs(got["x"] - np.corrcoef(rx, ry)[0, 1]) < 1e-12
    assert got["c"] is None
    assert {r.factor: r.kendall_tau_b for r in kendall_tau_b(lng).collect()}["c"] is None


def test_bucketed_ranks_equal_single_window(spark):
    from pyspark.sql import functions as F
    from binscope.operators.longform import ranked_values, quantiles_from_counts
    rng = np.random.default_rng(11)
    rows = [("a" if i % 3 else "b", float(v)) for i, v in enumerate(rng.integers(0, 400, size=3000))]
    df = spark.createDataFrame(rows, "factor string, x double")
    counts = df.groupBy("factor", "x").agg(F.count(F.lit(1)).alias("cnt"))
    one = {(r.factor, r.x): (r.cum_before, r.distinct_before) for r in ranked_values(counts, n_buckets=1).collect()}
    many = {(r.factor, r.x): (r.cum_before, r.distinct_before) for r in ranked_values(counts, n_buckets=7).collect()}
    assert one == many
    q1 = sorted(tuple(r) for r in quantiles_from_counts(counts, [0.1, 0.5, 0.9], n_buckets=1).collect())
    q7 = sorted(tuple(r) for r in quantiles_from_counts(counts, [0.1, 0.5, 0.9], n_buckets=7).collect())
    assert q1 == q7
    xa = np.sort(np.array([v for f, v in rows if f == "a"]))
    assert abs(dict(((f, p), q) for f, p, q in q1)[("a", 0.5)] - np.quantile(xa, 0.5)) < 1e-12


def test_small_buckets_without_a_cap(spark, monkeypatch):
    """50,000 values in buckets of about ten: far more buckets than one search step holds."""
    from binscope.operators import longform as L
    from binscope.operators.factors import label_encode
    monkeypatch.setattr(L, "RANK_BUCKET_ROWS", 10)
    rng = np.random.default_rng(8)
    v = rng.permutation(50_000)
    df = spark.createDataFrame([(int(x), f"k{x:05d}") for x in v[:20_000]], "x int, s string")
    counts = L.value_counts(L.to_long(df, ["x"]))
    b = L.with_value_buckets(counts, "factor", "x", L.buckets_for(20_000))
    sizes = b.groupBy("bucket").count()
    assert sizes.count() > 2000 and sizes.agg(F.max("count")).first()[0] < 100
    assert b.groupBy("bucket").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).select(
        F.count_if(F.col("lo") > F.col("hi"))).first()[0] == 0
    ranked = {r.x: r.cum_before for r in L.ranked_values(counts).collect()}
    assert ranked == {float(x): i for i, x in enumerate(sorted(int(x) for x in v[:20_000]))}
    codes = {r.value: r.code for r in label_encode(df, ["s"]).collect()}
    assert codes == {s: i for i, s in enumerate(sorted(f"k{x:05d}" for x in v[:20_000]))}


def test_values_find_their_bucket_by_binary_search(spark):
    """Bucket ids follow the cuts (a cut value has an odd one of its own), without a scan of the cuts per row."""
    from binscope.operators.longform import with_value_buckets
    rng = np.random.default_rng(4)
    values = [*(float(v) for v in rng.integers(0, 400, 3000)), None, float("nan"), -1.0, 1e9]
    df = spark.createDataFrame([("abc"[i % 3], v) for i, v in enumerate(values)], "factor string, x double")
    for n in (2, 3, 17, 300):
        out = with_value_buckets(df, "factor", "x", n)
        assert "lambda" not in out._jdf.queryExecution().executedPlan().toString()
        rows = out.collect()
        for f in "abc":
            mine = [(r.x, r.bucket) for r in rows if r.factor == f and r.x is not None]
            order = sorted(mine, key=lambda r: (r[0] != r[0], r[0]))
            assert [b for _, b in order] == sorted(b for _, b in order)
            assert 1 < len({b for _, b in order if b % 2}) + 1 <= n
            odd = {}
            for v, b in order:
                if b % 2:
                    assert odd.setdefault(b, v) == v
            cuts = sorted(odd.values())
            assert all(b == 2 * int(np.searchsorted(cuts, v)) + (v in cuts) for v, b in order if v == v)
        assert [r.bucket for r in rows if r.x is None] == [None]
