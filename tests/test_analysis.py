import numpy as np
import pytest
from pyspark.sql import functions as F

from binscope.operators.binning.optimal import optimal_binning
from binscope.plans.analysis import fit_classification, fit_regression


def test_planted_factor_ranks_first(spark):
    rng = np.random.default_rng(42)
    n = 3000
    x1 = rng.normal(size=n)
    x2 = rng.normal(size=n)
    x3 = rng.normal(size=n)
    y = 3 * x1 + 0.3 * rng.normal(size=n)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x1, x2, x3, y)], "x1 double, x2 double, x3 double, y double")
    fa = fit_regression(df, ["x1", "x2", "x3"], "y", n_trees=10).collect()
    assert fa[0]["name"] == "x1"
    top = {r["name"]: r for r in fa}
    assert top["x1"]["rank_order_correlation(spearmanr)"] > 0.9
    assert abs(top["x2"]["rank_order_correlation(kendalltau)"]) < 0.1
    assert top["x1"]["monotonic_trend"] == "ascending"


def test_classification_columns(spark, sf001):
    li = spark.read.parquet(f"{sf001}/lineitem.parquet")
    fa = fit_classification(li, ["l_quantity", "l_discount"], "l_returnflag", n_trees=5)
    assert fa.columns == ["name", "dtype", "n_bins", "monotonic_trend", "min_value", "max_value", "event_rates",
                          "bins", "missing", "std", "js", "quality_score", "feature_importance"]
    rows = fa.collect()
    assert len(rows) == 2 and all(r.event_rates.startswith("Class[0]]:A=") for r in rows)


def test_categorical_bins_cover_all_categories(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    lab = spark.read.parquet(f"{sf001}/labels.parquet").select("doc_id", "quality")
    df = docs.join(lab, "doc_id", "left")
    res = optimal_binning(df, ["lang", "source"], "quality", "binary")
    n = df.filter(F.col("quality").isNotNull()).count()
    tot = {r.factor: r["count"] for r in res.table.filter("kind = 'totals'").collect()}
    assert tot == {"lang": n, "source": n}
    labels = [r.bin for r in res.table.filter("kind = 'regular' AND factor = 'lang'").collect()]
    assert all(b.startswith("[") for b in labels)


def test_multiclass_rates_sum_to_one(spark, sf001):
    li = spark.read.parquet(f"{sf001}/lineitem.parquet")
    res = optimal_binning(li, ["l_quantity"], "l_returnflag", "multiclass")
    sums = (res.table.filter("kind = 'regular'").groupBy("bin_id").agg(F.sum("event_rate").alias("s"))
            .collect())
    assert all(abs(r.s - 1.0) < 1e-9 for r in sums)


def test_cat_cutoff_pools_rare_categories(spark):
    rows = [("a", float(i % 2)) for i in range(500)] + [("b", float(i % 3 == 0)) for i in range(480)] + \
           [(f"r{i}", 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "c string, y double")
    res = optimal_binning(df, ["c"], "y", "binary", cat_cutoff=0.05, min_prebin_size=0.0)
    t = res.table.filter("kind IN ('regular', 'others')").orderBy("bin_id").collect()
    assert sum(r["count"] for r in t) == 1000
    # the pooled categories are listed in a bin of their own, after the regular ones
    assert [r.kind for r in t].count("others") == 1 and t[-1].kind == "others"
    assert "r0" in t[-1].bin and t[-1]["count"] == 20 and not any("r0" in r.bin for r in t[:-1])
    assert [r.kind for r in res.table.orderBy("bin_id").collect() if r.kind != "totals"][-3:] == ["others", "special", "missing"]
    full = optimal_binning(df, ["c"], "y", "binary", min_prebin_size=0.0).table
    assert full.filter("kind = 'totals'").first()["count"] == 1000


def test_split_counts_are_the_inner_nodes(spark):
    """Every split has its two halves of rows; a node's parent is split too; counts add up to all splits."""
    from binscope.operators.factors import _importance_table, assemble_features, factor_splits
    rng = np.random.default_rng(7)
    rows = [(float(a), float(b), float(3 * a + b * b)) for a, b in rng.normal(size=(1500, 2))]
    df = spark.createDataFrame(rows, "label double, features double, y double")     # names the rows use too
    names = ["label", "features"]
    features = assemble_features(df, names, {"Numeric": names}, [F.col("y") / 3])
    splits = factor_splits(features, 150, 1)
    found = splits.collect()
    nodes = {(r.tree, r.node) for r in found}
    assert len(nodes) == len(found) and all(n == 0 or (t, (n - 1) // 2) in nodes for t, n in nodes)
    assert {r.factor for r in found} == set(names) and all(r.gain > 0 for r in found)
    counts = [r.feature_importance for r in _importance_table(splits, names, names, "split").collect()]
    assert sum(counts) == len(found)
    features.drop()


def test_boosting_fits_and_follows_its_bags(spark):
    """Residuals shrink block by block; a forest leaves them alone; sparse features are found."""
    from binscope.operators import boosting as B
    rng = np.random.default_rng(1)
    n = 4000
    x, w = rng.normal(size=(n, 2)), rng.random((n, 6)) < 0.3
    y = x[:, 0] + 4 * w[:, 3]
    y = (y - y.mean()) / y.std()
    rows = [([float(a) for a in x[i]], [2 + int(j) for j in np.flatnonzero(w[i])], [0.5] * int(w[i].sum()), [float(y[i])])
            for i in range(n)]
    df = spark.createDataFrame(rows, "dense array<double>, slots array<long>, weights array<double>, residual array<double>")
    cuts = [np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1]).tolist() for j in range(2)]
    out = B.boosted_splits(df, cuts, 6, 60, block_trees=20, feature_share=0.5).toPandas()
    assert set(out.slot) == {0, 5}
    gain = out.assign(block=out.tree // 20).groupby("block").gain.sum()
    assert gain[0] > 2 * gain[2]
    forest = B.boosted_splits(df, cuts, 6, 60, block_trees=20, feature_share=0.5, rate=0.0).toPandas()
    gain = forest.assign(block=forest.tree // 20).groupby("block").gain.sum()
    assert gain[2] > 0.7 * gain[0]
    # the best split of the root, counted again by hand
    root = out[(out.node == 0) & (out.slot == 5) & (out.tree < 20)].iloc[0]
    bag = n * 0.67
    hit = w[:, 3]
    expect = bag * (hit.mean() * y[hit].mean() ** 2 + (1 - hit.mean()) * y[~hit].mean() ** 2)
    assert root.gain == pytest.approx(expect, rel=0.1)


def test_target_statistics_by_hand(spark, monkeypatch):
    import hashlib

    from binscope.operators import factors as GF
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 11 == 0 else "hot" if i % 3 else f"c{i % 7}", None if i % 13 == 0 else float(rng.normal())) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, c string, y double")
    got = {r.id: r.code for r in GF.ordered_target_statistics(df, "id", ["c"], F.col("y"), orders=2).collect()}
    known = [(i, c, y) for i, c, y in rows if y is not None]
    mean = sum(y for *_, y in known) / len(known)
    for i, c, _ in known:
        code = 0
        for o in range(2):
            h = lambda k: hashlib.md5(f"{k}:{o}".encode()).hexdigest()  # noqa: B023, E731
            before = [y for j, d, y in known if d == c and h(j) < h(i)]
            code += (sum(before) + mean) / (len(before) + 1) / 2
        assert got[i] == pytest.approx(code)
    assert len(got) == len(known)


def test_large_vocabularies_join_alike(spark, sf001, monkeypatch):
    from binscope.operators import factors as GF
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    want = {(r.doc_id, r.token): r.tfidf for r in GF.tfidf(docs, "doc_id", "text").collect()}
    monkeypatch.setattr(GF, "VOCABULARY_ROWS", 10)
    monkeypatch.setattr(GF, "FREQUENT", 0.1)
    got = {(r.doc_id, r.token): r.tfidf for r in GF.tfidf(docs, "doc_id", "text").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    vocab = GF.vocabulary(GF.term_counts(docs, "doc_id", F.col("text"))).orderBy("code").collect()
    assert [r.code for r in vocab] == list(range(len(vocab)))
    assert [r.token.encode() for r in vocab] == sorted(r.token.encode() for r in vocab)


def test_native_categories_rank_above_noise(spark):
    from binscope.operators.factors import importance_native_categorical
    rng = np.random.default_rng(2)
    rows = [(i, "abcdefgh"[i % 8], float(rng.normal()), "plain words" + (" special" if i % 5 == 0 else ""),
             float((i % 8 in (1, 4, 6)) + 0.5 * (i % 5 == 0) + 0.1 * rng.normal())) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, c string, n double, t string, y double")
    tm = {"Numeric": ["n"], "Categorical": ["c"], "Text": ["t"]}
    v = {r.factor: r.feature_importance for r in importance_native_categorical(df, "id", ["c", "n", "t"], "y", tm, n_trees=200).collect()}
    assert v["c"] > v["t"] > 10 * v["n"] and sum(v.values()) == pytest.approx(100, abs=0.1)


def test_noise_factors_score_far_below_the_signal(spark):
    from binscope.operators.factors import importance_classification, importance_regression
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 3))
    df = spark.createDataFrame([(*map(float, r), float(10 * r[0]), "abc"[int(np.digitize(r[0], [-0.5, 0.5]))]) for r in x],
                               "s double, n1 double, n2 double, y double, c string")
    tm = {"Numeric": ["s", "n1", "n2"]}
    for table in (importance_regression(df, ["s", "n1", "n2"], "y", tm, n_trees=15),
                  importance_classification(df, ["s", "n1", "n2"], "c", tm, n_trees=6)):
        v = {r.factor: r.feature_importance for r in table.collect()}
        assert max(v["n1"], v["n2"]) < 0.1 * v["s"]


def test_nan_targets_and_numeric_strings(spark):
    from binscope.operators.binning.optimal import target_kind
    from binscope.plans.analysis import binning_analysis
    rows = [(str(i % 50), float(i % 2) if i % 3 else float("nan")) for i in range(600)]
    df = spark.createDataFrame(rows, "`a.b` string, y double")
    assert target_kind(df, "y", "classification") == "binary"
    out = binning_analysis(df, ["a.b"], "y", "classification", {"Numeric": ["a.b"], "Categorical": ["y"]})
    bins = out["table"].filter("kind = 'regular'").collect()
    assert sum(r["count"] for r in bins) == 400 and bins[0]["bin"].startswith("(-inf")
    assert out["woe_series"].count() == out["series"].count()


@pytest.mark.parametrize("name, targets", [("importance_regression", 1), ("importance_classification", 3),
                                           ("factor_analysis_regression", 1), ("factor_analysis_classification", 3),
                                           ("factor_analysis_binary", 1)])
def test_registered_importances_fit_all_trees(spark, sf001, monkeypatch, name, targets):
    from binscope.operators import factors as GF
    from binscope.plans.queries import QUERIES
    asked, fitted = [], GF.boosted_splits

    def few(rows, cuts, sparse, n_trees, n_targets, *args, **kw):
        asked.append((n_trees, n_targets))
        return fitted(rows, cuts, sparse, 1, n_targets, *args, **kw)
    monkeypatch.setattr(GF, "boosted_splits", few)
    assert QUERIES[name](spark, sf001).count() > 0
    assert asked == [(GF.DEFAULT_TREES, targets)] and GF.DEFAULT_TREES == 2000


@pytest.mark.parametrize("kind", ["continuous", "binary", "multiclass"])
def test_others_bin_of_every_kind(spark, kind):
    """Only rare categories, nulls, and a factor without values: each has its bin and no row is lost."""
    rows = [(f"r{i}", "a" if i % 3 else None, None, float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "rare string, c string, empty string, y double")
    t = optimal_binning(df, ["rare", "c", "empty"], "y", kind, cat_cutoff=0.1, min_prebin_size=0.0).table
    count = F.sum("event") if kind == "multiclass" else F.sum("count")
    got = {(r.factor, r.kind): r.n for r in t.where("kind <> 'totals'").groupBy("factor", "kind").agg(count.alias("n")).collect()}
    assert {k: n for k, n in got.items() if n} == {("rare", "others"): 60, ("c", "regular"): 40, ("c", "missing"): 20,
                                                   ("empty", "missing"): 60}


def test_categories_have_no_actual_scale(spark):
    from binscope.operators.series import actual_scale_series
    df = spark.createDataFrame([("ab"[i % 2], float(i), float(i % 2)) for i in range(40)], "c string, x double, y double")
    t = optimal_binning(df, ["c"], "y", "binary").table
    with pytest.raises(Exception, match="no actual scale"):
        actual_scale_series(t, "event_rate").collect()
    assert actual_scale_series(optimal_binning(df, ["x"], "y", "binary").table, "event_rate").count() >= 1


def test_one_pass_a_block_grows_the_same_trees(spark, monkeypatch):
    """Trees grown on sums by combination of bins are those grown level by level, and take one job's pass a block."""
    from binscope.operators import boosting as B
    rng = np.random.default_rng(1)
    n = 3000
    x = np.column_stack([rng.normal(size=(n, 2)), rng.integers(0, 5, n)])
    y = np.stack([x[:, 0] + x[:, 1] ** 2 + 0.3 * x[:, 2] * x[:, 0], np.sign(x[:, 1])], 1)
    y = (y - y.mean(0)) / y.std(0)
    df = spark.createDataFrame([(x[i].tolist(), [], [], y[i].tolist()) for i in range(n)],
                               "dense array<double>, slots array<long>, weights array<double>, residual array<double>")
    cuts = [np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1]).tolist() for j in range(2)] + [[1.0, 2.0, 3.0, 4.0]]
    passes, grown = [], B._grow_crossed
    monkeypatch.setattr(B, "_grow_crossed", lambda *a: passes.append(1) or grown(*a))

    def fitted():
        return B.boosted_splits(df, cuts, 0, 24, 2, block_trees=8).toPandas().sort_values(["tree", "target", "node"]).reset_index(drop=True)
    once = fitted()
    assert len(passes) == 3
    monkeypatch.setattr(B, "CROSSED_CELLS", 0)
    levels = fitted()
    assert len(passes) == 3 and len(once) > 100
    key = ["tree", "target", "node", "slot"]
    assert once[key].equals(levels[key]) and np.allclose(once.gain, levels.gain)
    monkeypatch.setattr(B, "CROSSED_CELLS", 1 << 13)
    monkeypatch.setattr(B, "HISTOGRAM_BYTES", 1 << 18)      # little room: two passes a block, for some of its trees each
    passes_ = B._summed
    monkeypatch.setattr(B, "_summed", lambda *a: passes.append(2) or passes_(*a))
    parted = fitted()
    assert passes.count(2) == 6 and parted[key].equals(once[key]) and np.allclose(parted.gain, once.gain)


def test_terms_are_counted_where_their_texts_are(spark):
    """Texts are shuffled once by their key, their words never are; rows of one key count together."""
    import math

    from binscope.operators.factors import term_counts, tfidf
    df = spark.createDataFrame([(1, "aa bb aa"), (1, "bb cc"), (2, "AA"), (None, "cc cc"), (3, None)], "k int, t string")
    terms = term_counts(df, "k", F.col("t"))
    plan = terms._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "token" not in next(x for x in plan.splitlines() if "Exchange" in x)
    assert {(r.k, r.token): r.tf for r in terms.collect()} == {(1, "aa"): 2, (1, "bb"): 2, (1, "cc"): 1, (2, "aa"): 1, (None, "cc"): 2}
    got = {(r.k, r.token): r.tfidf for r in tfidf(df, "k", "t").collect()}
    idf = {"aa": math.log(5 / 3) + 1, "bb": math.log(5 / 2) + 1, "cc": math.log(5 / 3) + 1}
    norm = math.sqrt((2 * idf["aa"]) ** 2 + (2 * idf["bb"]) ** 2 + idf["cc"] ** 2)
    assert got[2, "aa"] == got[None, "cc"] == pytest.approx(1) and got[1, "bb"] == pytest.approx(2 * idf["bb"] / norm)
    assert len(got) == 5


def test_words_are_counted_by_tree_and_split_like_by_hand(monkeypatch):
    """A task sends one array a tree and chunk, however many words it has; splits are those of a count by hand."""
    import pyarrow as pa

    from binscope.operators import boosting as B
    rng = np.random.default_rng(4)
    n, dense, n_words, levels, leaf, seed = 900, 2, 80, 3, 20, 42
    level = rng.integers(1, levels + 1, (n, n_words)) * (rng.random((n, n_words)) < rng.random(n_words) * 0.6)
    code, rid = rng.integers(0, 8, (n, dense)), rng.integers(0, 1 << 62, n)
    y = (level[:, 5] > 1) * 1.0 - (level[:, 9] > 0) + 0.2 * (code[:, 0] > 3) + 0.3 * rng.normal(size=n)
    lists = lambda v, t: pa.array([list(map(t, x)) for x in v])
    held = [np.flatnonzero(x)[::-1] for x in level]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(rid), lists(code, int).cast(pa.list_(pa.int16())), lists([h + dense for h in held], int),
         lists([x[h] for x, h in zip(level, held)], int).cast(pa.list_(pa.int16())), lists(y[:, None], float)],
        names=["rid", "bins", "slots", "levels", "residual"])
    trees = B.Trees(np.arange(6), np.zeros(6, np.int64), np.tile([0, 1], (6, 1)))
    # tree 5 stays a root; the others have split it on a word, a word that no row has, or a dense feature
    for t, (slot, cut) in enumerate([(5 + dense, 2), (9 + dense, 1), (9 + dense, 3), (n_words + dense, 1), (0, 4)]):
        trees.split[t, 0], trees.slot[t, 0], trees.cut[t, 0] = True, slot, cut

    def by_hand(t, depth):
        slot, cut = trees.slot[t, 0], trees.cut[t, 0]
        node = np.zeros(n, int)
        if depth:
            of = code[:, slot] if slot < dense else level[:, slot - dense] if slot < n_words + dense else np.zeros(n)
            node = (of >= cut).astype(int)
        bag = B._share(rid.astype(np.uint64), t, seed, 0.67)
        words = B._share(np.arange(n_words) + dense, t, seed + 1, 0.5)
        for k in range(1 << depth):
            r, best = y[bag & (node == k)], (0.0,)
            for f in [*range(dense), *np.flatnonzero(words) + dense]:
                x = (code[:, f] if f < dense else level[:, f - dense])[bag & (node == k)]
                for c in range(1, 8 if f < dense else levels + 1):
                    right = x >= c
                    if min(right.sum(), (~right).sum()) >= leaf:
                        gain = r[right].sum() ** 2 / right.sum() + r[~right].sum() ** 2 / (~right).sum() - r.sum() ** 2 / len(r)
                        if gain > best[0] + 1e-9:
                            best = (gain, f, c, right.sum())
            if len(r):
                yield k, len(r), best

    for depth in (0, 1):
        for entries in (1 << 22, 300):
            monkeypatch.setattr(B, "ENTRIES", entries)
            count = B._counted(trees, depth, dense, levels, 1, 8, 0.67, 0.5, seed)
            parts = list(count([batch.slice(i, 90) for i in range(0, n, 90)]))
            sent = sum(p.num_rows for p in parts)
            grown = range(5) if depth else range(6)
            assert sent == 2 * len(grown) if entries > 300 else sent > 4 * len(grown)
            stream = pa.Table.from_batches(parts).sort_by("tree").to_batches()
            got = pa.Table.from_batches(B._best(trees, depth, 8, levels, leaf)(stream)).to_pylist()
            want = [(t, *x) for t in grown for x in by_hand(t, depth)]
            assert [(g["tree"], g["node"], g["n"]) for g in got] == [w[:3] for w in want]
            for g, (*_, best) in zip(got, want):
                assert g["gain"] == pytest.approx(best[0])
                assert (g["slot"], g["cut"], g["right_n"]) == best[1:] if len(best) > 1 else g["slot"] == -1


def test_bags_are_summed_by_combination_in_blocks():
    """Sums of bags by combination, of blocks whose combinations have many rows (common lines) and of such that have few."""
    import pyarrow as pa
    from binscope.operators import boosting as B
    rng = np.random.default_rng(4)
    for sizes, n in (([3, 4, 2], 6000), ([40, 30, 20], 1500)):
        codes = np.stack([rng.integers(0, s, n) for s in sizes], 1).astype(np.int16)
        codes = codes[np.lexsort(codes.T[::-1])]
        ids, target = rng.integers(-2**62, 2**62, n), rng.normal(size=(n, 2))
        flat = lambda v, t: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(v.shape[1])), pa.array(v.ravel(), t))  # noqa: B023, E731
        rows = pa.RecordBatch.from_arrays([pa.array(ids), flat(codes, pa.int16()), flat(target, pa.float64())], names=["rid", "bins", "residual"])
        cells = list(B._cells(sizes)([rows.slice(i, min(700, n - i)) for i in range(0, n, 700)]))
        assert (np.diff(np.concatenate([c.column("cell").to_numpy() for c in cells])) >= 0).all()
        blocks = list(B._packed(2 * 3 + 8 * 2)([c.select(["rid", "row"]) for c in cells]))
        assert sum(b.num_rows for b in blocks) == 1
        trees = B.Trees(np.arange(12), np.tile([0, 1], 6), np.array([[0, 1], [2, 1], [2, 0]] * 4))
        before = {(0, 2): rng.normal(size=(2, sizes[0] * sizes[2]))}
        got = {t: np.frombuffer(x).reshape(3, -1) for b in B._crossed(trees, sizes, 2, 0.67, 42, before)(blocks)
               for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
        left = target - before[0, 2][:, codes[:, 0].astype(int) * sizes[2] + codes[:, 2]].T
        for t in range(12):
            a, b = sorted(trees.draw[t])
            cell = codes[:, a].astype(int) * sizes[b] + codes[:, b]
            bag = B._share(ids.astype(np.uint64), t, 42, 0.67)
            r = left[:, trees.target[t]]
            expect = np.stack([np.bincount(cell, w * bag, sizes[a] * sizes[b]) for w in (np.ones(n), r, r * r)])
            assert np.allclose(got[t], expect)


def test_texts_are_neither_copied_nor_joined(spark, monkeypatch):
    """Rows that have an id are not copied, a table of nominal rows is not copied again, and words are named by a broadcast."""
    from binscope.operators import factors as GF
    rng = np.random.default_rng(3)
    rows = [(i % 90 if i % 40 else None, float(i % 7), "ab"[i % 2] if i % 11 else None,
             " ".join(f"w{j}" for j in rng.integers(0, 30, 8)) if i % 13 else None, float(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, n double, c string, t string, y double")
    copies, real = [], GF.written
    monkeypatch.setattr(GF, "written", lambda table, name: copies.append((name, [
        f.name for f in table.schema.fields if f.dataType.simpleString() == "string"])) or real(table, name))
    tm = {"Numeric": ["n"], "Categorical": ["c"], "Text": ["t"]}

    def values(row_id):
        f = GF.assemble_features(df, ["n", "c", "t"], tm, [F.lit(0.0)], row_id)
        long = f.long()
        assert "SortMergeJoin" not in long._jdf.queryExecution().executedPlan().toString()
        return sorted(((r.row_id, r.factor, r.token, round(r.value, 9)) for r in long.collect()), key=str)
    got = values(F.col("id"))
    assert [c for c in copies if "__t0" in c[1]] == []
    monkeypatch.setattr(GF, "VOCABULARY_ROWS", 5)
    assert values(F.col("id")) == got
    dense = [(r[0], "n", None, r[1]) for r in rows] + [(r[0], "c", None, float("ab".index(r[2])) if r[2] else 0.0) for r in rows]
    assert sorted((r for r in got if r[1] != "t"), key=str) == sorted(dense, key=str)
    words = {}
    for i, *_, t, _ in rows:
        words.setdefault(i, set()).update((t or "").split())
    # every row of an id has the words of all its rows; rows without one have none
    assert sorted((r[0], r[2]) for r in got if r[1] == "t") == sorted((r[0], w) for r in rows if r[0] is not None for w in words[r[0]])
    copies.clear()
    out = GF.importance_native_categorical(df, "id", ["n", "c", "t"], "y", tm, n_trees=3)
    assert out.count() == 3 and [name for name, texts in copies if {"t", "__t0"} & set(texts)] == ["nominal"]


def test_levels_leave_no_shuffle_files(spark, monkeypatch):
    """The histograms of a level or block are dropped when it is grown, and what a scratch table was dealt out by when it is written."""
    import time

    from binscope.operators import boosting as B
    from binscope.session import drop_table, written
    rng = np.random.default_rng(5)
    rows = [([float(a)], sorted({1 + int(j) for j in rng.integers(0, 9, 4)}), [float(a + rng.normal())]) for a in rng.normal(size=800)]
    df = spark.createDataFrame(rows, "dense array<double>, slots array<long>, residual array<double>").withColumn(
        "weights", F.transform("slots", lambda s: F.lit(1.0)))
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    calls = []

    def files():
        return sum("shuffle_" in x for x in disk.getAllFiles().mkString(" ").split())

    def leaves_none(f):
        def run(*a):
            before = files()
            out = f(*a)
            for _ in range(20):
                if files() <= before:
                    break
                time.sleep(0.1)
            calls.append(files() - before)
            return out
        return run
    for name in ("_grow", "_grow_crossed", "written"):
        monkeypatch.setattr(B, name, leaves_none(getattr(B, name)))
    for sparse in (9, 0):
        source = df if sparse else df.withColumn("slots", F.array().cast("array<long>")).withColumn("weights", F.array().cast("array<double>"))
        assert B.boosted_splits(source, [[0.0, 0.5]], sparse, 8, block_trees=4).count() > 0
    drop_table(leaves_none(written)(df.repartition(3, "dense"), "test"))
    assert len(calls) > 6 and max(calls) <= 0
