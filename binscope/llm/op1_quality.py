"""Operator 1: weak-label quality classifier.

Heuristic labelers vote good, bad or nothing on every document from its text
statistics. Expectation-maximisation over the counts of vote patterns of the
whole corpus estimates their accuracies; the posterior labels of a bounded
sample train a linear scorer on hashed character n-grams, which scores all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binscope.llm.common import map_slices, record, sample_share, stored, unit_hash
from binscope.llm.op10_pii import em, logistic
from binscope.llm.textstats import COUNTS as STATS
from binscope.llm.textstats import stats

#: hashed features, and documents per posterior class that fit the scorer, about
FEATURES, FIT_DOCS = 2048, 1500
#: labeler: SQL over the counts giving 1 (good), 0 (bad), -1 (nothing); fixed values
LABELERS = {
    "symbols": "case when n_words < 3 then -1 when n_symbols > 0.1 * n_words then 0 else 1 end",
    "symbol_share": "case when word_chars < 20 then -1 when n_symbols > 0.03 * word_chars then 0 else 1 end",
    "capitals": "case when n_upper + n_lower < 20 then -1 when n_upper > 0.4 * (n_upper + n_lower) then 0 else 1 end",
    "marks": "case when n_words < 3 then -1 when n_marks > 0.2 * n_words then 0 else 1 end",
    "word_length": "case when n_words < 3 then -1 when word_chars > 15 * n_words or word_chars < 2 * n_words then 0 else 1 end",
    "repetition": "case when n_words < 20 then -1 when n_repeat_words > 0.4 * n_words then 0 else 1 end",
    "variety": "case when n_words < 20 then -1 when n_distinct < 2 * sqrt(n_words) then 0 else 1 end",
    "lines": "case when n_lines < 4 then -1 when n_dup_lines > 0.3 * n_lines then 0 else 1 end",
}


def hashed(text: str | None, size: int = FEATURES) -> np.ndarray:
    """Unit vector of the byte 4-gram counts (square root) hashed to ``size`` places."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(b) < 4:
        return np.zeros(size, np.float32)
    with np.errstate(over="ignore"):
        h = (b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24) * np.uint32(2654435761)
    x = np.sqrt(np.bincount(h >> np.uint32(32 - size.bit_length() + 1), minlength=size)).astype(np.float32)
    return x / np.linalg.norm(x)


def _counted(texts: DataFrame, kind: str, weights: np.ndarray | None = None) -> DataFrame:
    """(doc_id, text_hash, votes[, raw]): packed votes and, with ``weights``, the scorer's sum per document."""
    types = {"doc_id": pa.int64() if kind == "long" else pa.string(), "text_hash": pa.int64()} | {
        k: pa.int64() for k in STATS} | {"raw": pa.float64()}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts_ = b.column(2).to_pylist()
        rows = [stats(t) for t in texts_]
        raw = [None if weights is None else float(hashed(t) @ weights[:-1] + weights[-1]) for t in texts_]
        return record(types, {"doc_id": b.column(0), "text_hash": b.column(1), "raw": raw}
                      | {k: [r[k] for r in rows] for k in STATS})
    packed = " + ".join(f"({sql} + 1) * {3 ** i}" for i, sql in enumerate(LABELERS.values()))
    return map_slices(texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), run,
                      f"doc_id {kind}, text_hash long, " + ", ".join(f"{k} long" for k in STATS) + ", raw double"
                      ).select("doc_id", "text_hash", F.expr(packed).cast("long").alias("votes"), "raw")


def posteriors(votes: DataFrame) -> dict[int, float]:
    """P(good) per vote pattern by EM over the pattern counts of the whole corpus (at most 3^8 rows)."""
    seen = votes.groupBy("votes").count().orderBy("votes").collect()
    if not seen:
        return {}
    m = len(LABELERS)
    patterns = np.array([[r["votes"] // 3 ** i % 3 - 1 for i in range(m)] for r in seen])
    # junk comes in kinds, each known to few labelers: a bad vote is rare on good documents,
    # a good vote common on bad ones
    post = em(patterns, np.array([float(r["count"]) for r in seen]), right=(0.4, 0.98))
    return {r["votes"]: float(p) for r, p in zip(seen, post)}


def train(texts: DataFrame, votes: DataFrame, post: dict[int, float], fit_docs: int) -> np.ndarray | None:
    """Scorer weights and intercept from the posteriors of about ``fit_docs`` documents a side; None without both sides."""
    sides: dict[bool, int] = {}
    for r in votes.groupBy("votes").count().collect():
        side = post[r["votes"]] >= 0.5
        sides[side] = sides.get(side, 0) + r["count"]
    if len(sides) < 2:
        return None
    share = sample_share(sides, fit_docs)
    good = F.col("votes").isin([v for v, p in post.items() if p >= 0.5])
    picked = (votes.where(unit_hash("doc_id", "text_hash") < F.when(good, share[True]).otherwise(share[False]))
              .select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"), "votes").distinct())
    rows_in = texts.join(F.broadcast(picked), F.col("doc_id").eqNullSafe(F.col("i")) & (F.xxhash64("text") == F.col("h")))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return record({"votes": pa.int64(), "x": pa.binary()},
                      {"votes": b.column(0), "x": [hashed(t).tobytes() for t in b.column(1).to_pylist()]})
    rows = map_slices(rows_in.select("votes", "text"), run, "votes long, x binary").orderBy("votes", "x").collect()
    x = np.ones((len(rows), FEATURES + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, :-1] = np.frombuffer(r["x"], np.float32)
    y = np.array([post[r["votes"]] for r in rows], np.float32)
    return logistic(x, y, rounds=400, rate=4.0, l2=1e-4).astype(np.float32)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5,
            fit_docs: int = FIT_DOCS) -> DataFrame:
    """(doc_id, votes, posterior, score, kept): one row per row.

    ``posterior`` is the label model's P(good), ``score`` the linear scorer's,
    and ``kept`` says that their mean is at least ``threshold``: a text too
    short for the scorer stays unless a labeler objects. A null text is empty:
    no features, so the scorer's intercept is its score. Null ids and repeated rows keep their
    rows. If all posteriors fall on one side, the posterior is the score. An
    empty table gives an empty result. Extra columns are ignored.
    """
    kind = "long" if docs.schema[id_col].dataType.simpleString() == "bigint" else "string"
    texts = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col).alias("text"))
    votes = stored(_counted(texts, kind).drop("raw"), "votes")
    post = posteriors(votes)
    weights = train(texts, votes, post, fit_docs) if post else None
    scored = _counted(texts, kind, weights)
    table = texts.sparkSession.createDataFrame(sorted(post.items()), "v long, posterior double")
    score = F.col("posterior") if weights is None else 1 / (1 + F.exp(-F.col("raw")))
    # one row per vote pattern: at most 3^8
    return (scored.join(F.broadcast(table), F.col("votes") == F.col("v"))
            .select("doc_id", "votes", "posterior", score.alias("score"),
                    ((score + F.col("posterior")) / 2 >= threshold).alias("kept")))
