"""Operator 7: quality rules as a learned decision list.

Sequential covering in the manner of RIPPER: grow a conjunction of threshold
tests on two thirds of the labelled statistics, prune it on the rest, remove
what it covers, repeat. The list becomes one ordered Spark conditional
expression, so applying it stays inside code generation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binscope.llm.common import map_slices, record, sample_share, unit_hash
from binscope.llm.textstats import COUNTS as STATS
from binscope.llm.textstats import stats

#: rates that rules may test, as SQL over the counts
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_upper + n_lower, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
}
#: labelled rows per class that the learner sees, about (chosen by a hash of the id)
FIT_ROWS = 10_000
Test = tuple[str, str, float]        # feature, "<=" or ">", threshold


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts of :mod:`textstats`): one row per row, a null text as empty."""
    kind = docs.schema[id_col].dataType.simpleString()
    types = {"doc_id": pa.int64() if kind == "bigint" else pa.string()} | {k: pa.int64() for k in STATS}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [stats(t) for t in b.column(1).to_pylist()]
        return record(types, {"doc_id": b.column(0).to_pylist()} | {k: [r[k] for r in rows] for k in STATS})
    ident = F.col(id_col) if kind == "bigint" else F.col(id_col).cast("string")
    return map_slices(docs.select(ident.alias("doc_id"), F.col(text_col).alias("text")), run,
                      f"doc_id {kind if kind == 'bigint' else 'string'}, " + ", ".join(f"{k} long" for k in STATS))


# -- the learner: a bounded table of numbers ---------------------------------
def _covers(rule: list[Test], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for f, op, t in rule:
        hit &= x[f] > t if op == ">" else x[f] <= t
    return hit


def _best_test(x: dict[str, np.ndarray], y: np.ndarray, least: int) -> tuple[float, Test] | None:
    """The threshold test with the most FOIL gain for y = 1."""
    pos, n = y.sum(), len(y)
    base, best = np.log2(max(pos, 1e-9) / n), None
    for f, v in x.items():
        order = np.argsort(v, kind="stable")
        sv, sy = v[order], y[order]
        cut = np.flatnonzero(sv[1:] != sv[:-1])
        if not len(cut):
            continue
        left_p, left_n = np.cumsum(sy)[cut], cut + 1.0
        for op, p, m in (("<=", left_p, left_n), (">", pos - left_p, n - left_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((p > 0) & (m >= least), p * (np.log2(p / m) - base), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                best = gain[k], (f, op, float((sv[cut[k]] + sv[cut[k] + 1]) / 2))
    return best


def learn_rules(x: dict[str, np.ndarray], y: np.ndarray, split: np.ndarray, max_rules: int = 16,
                max_tests: int = 4, min_cover: int = 5, min_precision: float = 0.9) -> list[list[Test]]:
    """Ordered rules for y = 1 (the class to drop). ``split``: True grows, False prunes.

    A rule stays if it is right for ``min_precision`` of the growing and of
    the pruning rows it covers; the first that fails ends the list. No rows or
    one class give no rules.
    """
    rules: list[list[Test]] = []
    left = np.ones(len(y), bool)
    while len(rules) < max_rules:
        g, p = left & split, left & ~split
        if not y[g].sum():
            break
        rule: list[Test] = []
        inside = g.copy()
        while len(rule) < max_tests and y[inside].sum() < inside.sum():
            found = _best_test({f: v[inside] for f, v in x.items()}, y[inside], min_cover)
            if found is None:
                break
            rule.append(found[1])
            inside &= _covers([found[1]], x, len(y))
        if not rule:
            break

        def worth(r: list[Test]) -> float:
            hit = _covers(r, x, len(y)) & p
            return (2 * y[hit].sum() - hit.sum()) / max(hit.sum(), 1)
        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))
        hit = _covers(rule, x, len(y))
        right = [y[hit & s].sum() >= min_precision * (hit & s).sum() for s in (g, p)]
        if (hit & g).sum() < min_cover or not all(right):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def rules_sql(rules: list[list[Test]]) -> str:
    """The list as one ordered conditional: the number of the first rule that fires, else 0."""
    if not rules:
        return "0"
    whens = (f"when {' and '.join(f'({FEATURES[f]}) {op} {t!r}D' for f, op, t in r)} then {i}"
             for i, r in enumerate(rules, 1))
    return f"case {' '.join(whens)} else 0 end"


def labelled_sample(labels: DataFrame, fit_rows: int) -> DataFrame:
    """(doc_id, q): labels of about ``fit_rows`` ids a class, by a hash of the id; nulls ignored."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("q")).where("doc_id is not null and q in (0, 1)")
    share = sample_share({r[0]: r[1] for r in known.groupBy("q").count().collect()}, fit_rows)
    return known.where(unit_hash("doc_id") < F.when(F.col("q") == 0, share.get(0, 0.0)).otherwise(share.get(1, 0.0)))


def fit_rules(statistics: DataFrame, labels: DataFrame) -> list[list[Test]]:
    """Learn from ``statistics`` joined to ``labels(doc_id, q)``; q = 0 is what to drop.

    The joined rows reach the driver: pass a bounded sample. Repeated rows
    count repeatedly; one class alone gives no rules.
    """
    rows = (statistics.join(labels, "doc_id")
            .select("doc_id", "q", *[F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()],
                    (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) < 2).alias("grow"))
            .orderBy("doc_id", *FEATURES).collect())
    if len({r["q"] for r in rows}) < 2:
        return []
    x = {f: np.array([r[f] for r in rows]) for f in FEATURES}
    return learn_rules(x, np.array([1 - r["q"] for r in rows]), np.array([r["grow"] for r in rows]))


def quality_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: counts, ``base_failed``, ``rule`` (first that fires, 0 none), ``kept``.

    The texts of the sampled labelled rows are read first, then all texts once.
    A null or empty text has no words, so it fails the base test. Null ids
    keep their row; repeated rows are judged alike; an empty table gives an
    empty result; no labels give an empty rule list. Extra columns are ignored.
    """
    sample = labelled_sample(labels, fit_rows)
    ids = F.broadcast(sample.select("doc_id").distinct())        # bounded by fit_rows
    rules = fit_rules(text_statistics(docs.join(ids, "doc_id", "left_semi")), sample)
    failed = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"
    return (text_statistics(docs)
            .withColumn("base_failed", F.expr(failed))
            .withColumn("rule", F.expr(rules_sql(rules)).cast("int"))
            .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)))
