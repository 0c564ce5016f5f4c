import numpy as np
from pyspark.sql import functions as F

from binscope.operators.binning import solve as S
from binscope.operators.binning.optimal import optimal_binning


def test_dp_equals_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(60):
        m = int(rng.integers(2, 9))
        n = rng.integers(5, 60, size=m).astype(float)
        e = np.minimum(n, rng.integers(0, 40, size=m)).astype(float)
        st = np.c_[n, e]
        for trend in ("ascending", "descending", "peak", "valley", "none"):
            for mx in (None, 0.4):
                r = S.solve_dp(st, "binary", trend, mx, None)
                b = S.brute_force(st, "binary", trend if trend != "none" else "x", mx, None)
                assert (r is None) == (b is None)
                if r is not None:
                    assert abs(r[0] - b[0]) < 1e-9


def test_step_target_found(spark):
    rows = [(float(x), float(x // 10)) for x in range(0, 40) for _ in range(25)]
    df = spark.createDataFrame(rows, "x double, y double")
    res = optimal_binning(df, ["x"], "y", "continuous", max_n_prebins=20, min_prebin_size=0.05)
    splits = res.splits.first().splits
    for s in (10.0, 20.0, 30.0):
        assert s in splits
    t = res.table.filter("kind = 'regular'").orderBy("bin_id").collect()
    assert all(a.mean <= b.mean for a, b in zip(t, t[1:]))


def test_heavy_tie_infeasible(spark):
    rows = [(0.0, 1.0)] * 400 + [(float(i), float(i % 7)) for i in range(1, 601)]
    df = spark.createDataFrame(rows, "x double, y double")
    res = optimal_binning(df, ["x"], "y", "continuous", max_bin_size=0.2)
    s = res.splits.first()
    assert s.status == "INFEASIBLE" and s.n_splits == 0


def test_constant_factor_one_bin(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(200)], "x double, y double")
    res = optimal_binning(df, ["x"], "y", "continuous")
    summ = res.summary.first()
    assert summ.n_bins == 1 and summ.monotonic_trend == "undefined"


def test_table_counts_partition_the_rows(spark, sf001):
    li = spark.read.parquet(f"{sf001}/lineitem.parquet").withColumn(
        "y", (F.col("l_returnflag") == "R").cast("int"))
    res = optimal_binning(li, ["l_quantity", "l_extendedprice"], "y", "binary")
    n = li.count()
    for r in res.table.filter("kind = 'totals'").collect():
        assert r["count"] == n
    reg = res.table.filter("kind != 'totals'").groupBy("factor").agg(F.sum("count").alias("c")).collect()
    assert all(r.c == n for r in reg)


def _turns(rates):
    """The trends a sequence has: of those a class can be asked for."""
    d = np.sign(np.where(np.abs(np.diff(rates)) <= 1e-12, 0, np.diff(rates)))
    d = [x for x in d if x]
    first = sum(1 for x, y in zip(d, d[1:]) if x != y)
    out = {"none"}
    if all(x > 0 for x in d):
        out |= {"ascending", "auto", "peak", "valley", "one turn"}
    if all(x < 0 for x in d):
        out |= {"descending", "auto", "peak", "valley", "one turn"}
    if first == 1:
        out |= {"peak" if d[0] > 0 else "valley", "one turn"}
    return out


def test_class_trends_equal_brute_force():
    """Nine pre-bins, three classes: every partition, each class with its own trend."""
    import itertools
    rng = np.random.default_rng(11)
    kinds = ["ascending", "descending", "auto", "peak", "valley", "one turn", "none"]
    for turn in range(14):
        m = 9 if turn < 4 else 6
        counts = rng.integers(1, 40, size=(m, 3)).astype(float)
        if turn % 2:
            counts[:, 0] += np.arange(m) * 15
        st = np.c_[counts.sum(axis=1), counts]
        total = st.sum(axis=0)
        parts = []
        for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, m), r) for r in range(m)):
            bounds = [0, *cuts, m]
            g = np.array([st[a:b].sum(axis=0) for a, b in zip(bounds, bounds[1:])])
            parts.append((S.bin_objective(g, total, "multiclass").sum(), bounds[:-1], g[:, 0].max() / total[0],
                          [_turns(g[:, c + 1] / g[:, 0]) for c in range(3)]))
        for trends in [["auto"] * 3, ["one turn"] * 3, ["none"] * 3, *[list(rng.choice(kinds, 3)) for _ in range(6)]]:
            for most in (None, 0.5):
                ok = [p for p in parts if (most is None or p[2] <= most + 1e-9) and all(t in h for t, h in zip(trends, p[3]))]
                got = S.solve_classes(st, trends, most, None)
                assert (got is None) == (not ok)
                if ok:
                    assert abs(got[0] - max(p[0] for p in ok)) < 1e-9


def test_auto_gives_each_class_a_trend(spark):
    rows = [(float(x), "a" if x < 10 + i % 20 else "b" if (x + i) % 3 else "c") for x in range(40) for i in range(40)]
    res = optimal_binning(spark.createDataFrame(rows, "x double, y string"), ["x"], "y", "multiclass")
    s = res.splits.first()
    assert s.status == "OPTIMAL" and s.trend.split(",")[0] == "descending" and "none" not in s.trend
    rates = {}
    for r in res.table.filter("kind = 'regular'").orderBy("bin_id").collect():
        rates.setdefault(r["class"], []).append(r.event_rate)
    assert all({"auto", "one turn"} & _turns(v) for v in rates.values())


def test_prebins_keep_both_limits():
    rng = np.random.default_rng(2)
    for _ in range(80):
        m = int(rng.integers(3, 60))
        n = rng.integers(1, 30, size=m).astype(float)
        y = rng.normal(size=m) * n
        st = np.c_[n, y, y * y / n + n]
        most, size, least = int(rng.integers(2, 12)), float(rng.uniform(0.1, 0.6)), float(rng.choice([0.0, 0.02, 0.05]))
        starts = S.prebin_cart(st, "continuous", most, least, size)
        bounds = [*starts, m]
        sizes = np.array([n[a:b].sum() for a, b in zip(bounds, bounds[1:])]) / n.sum()
        assert len(starts) <= most and (sizes >= min(least, 1.0) - 1e-9).all()
        # the fewest pieces within the size that whole fine bins allow
        fewest, room = 1, size * n.sum() + 1e-9
        used = 0.0
        for x in n:
            if used and used + x > room:
                fewest, used = fewest + 1, 0.0
            used += x
        if least == 0.0 and fewest <= most and n.max() <= room:
            assert sizes.max() <= size + 1e-9
    even = np.c_[np.full(100, 10.0), np.zeros(100), np.full(100, 10.0)]
    starts = S.prebin_cart(even, "continuous", 5, 0.05, 0.2)
    assert len(starts) == 5
