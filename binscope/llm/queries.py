"""Registered queries of the thirteen operators and the pipeline: thin, whole tables, full results."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binscope.llm import (op1_quality, op2_secrets, op3_langid, op4_mixing, op5_decontam, op6_chat, op7_rules,
                          op8_simhash, op9_lines, op10_pii, op11_runs, op12_search, op13_html)
from binscope.llm.common import table

WEIGHTS = [3.0, 1.0, 2.0]


def op1(spark: SparkSession, d: str) -> DataFrame:
    return op1_quality.quality(table(spark, d, "documents"))


def op2(spark: SparkSession, d: str) -> DataFrame:
    _, found = op2_secrets.scan_history(table(spark, d, "documents"))
    return op2_secrets.digest(found, op2_secrets.BASE, lambda f: f["kind"].isin(*op2_secrets.BASE))


def op3(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return (op3_langid.predict(docs, op3_langid.learn(docs))
            .select("doc_id", op3_langid.held_out().alias("held_out"), "lang_pred", "score"))


def op4(spark: SparkSession, d: str) -> DataFrame:
    return op4_mixing.mix(table(spark, d, "documents"), WEIGHTS)


def op5(spark: SparkSession, d: str) -> DataFrame:
    found = op5_decontam.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6(spark: SparkSession, d: str) -> DataFrame:
    return op6_chat.canonical_turns(table(spark, d, "conversations"))


def op7(spark: SparkSession, d: str) -> DataFrame:
    out = op7_rules.quality_rules(table(spark, d, "documents"), table(spark, d, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "rule", "kept")


def op8(spark: SparkSession, d: str) -> DataFrame:
    return op8_simhash.near_duplicates(table(spark, d, "documents"))


def op9(spark: SparkSession, d: str) -> DataFrame:
    return op9_lines.line_report(table(spark, d, "documents"))


def op10(spark: SparkSession, d: str) -> DataFrame:
    found = op10_pii.personal_data(table(spark, d, "documents"))
    return op2_secrets.digest(found, op10_pii.KINDS, lambda f: f["base"])


def op11(spark: SparkSession, d: str) -> DataFrame:
    found = op11_runs.periodic_runs(table(spark, d, "documents"), planted_runs)
    start, length, period = (F.col(f"best.{c}") for c in ("start", "length", "period"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"),
        period.alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def planted_runs(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's input: the tail of every tenth document (by a hash) repeats with a period."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a, g = h // 10 % n, h // 10
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]


def op12(spark: SparkSession, d: str) -> DataFrame:
    return op12_search.search(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op13(spark: SparkSession, d: str) -> DataFrame:
    return op13_html.main_texts(table(spark, d, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1, "op2_secret_scan": op2, "op3_language_id": op3, "op4_source_mixing": op4,
    "op5_decontamination": op5, "op6_chat_format": op6, "op7_quality_rules": op7, "op8_simhash_dedup": op8,
    "op9_line_dedup": op9, "op10_personal_data": op10,
    "op11_periodic_runs": op11, "op12_lexical_search": op12, "op13_html_extraction": op13,
}
SQL: dict[str, str] = {"op12_lexical_search": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
size AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
tf AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
       FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d)
       WHERE term IN (SELECT term FROM i) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT n FROM size) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf GROUP BY term),
s AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * tf.n * size.n) // size.l)))) AS BIGINT) AS score
  FROM tf JOIN i USING (term) JOIN w USING (term), size GROUP BY item_id, r),
k AS (SELECT item_id, doc_id, score,
             row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
"""}


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, d)


QUERIES["pipeline"] = pipeline
