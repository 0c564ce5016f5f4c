"""Corpus pipeline over ``documents``: five stages, each written as Parquet and read again.

Language ID drops documents without a language; line dedup removes repeated
lines; SimHash near-dedup keeps one document of each group; decontamination
drops documents that hold benchmark windows; mixing takes each source to its
target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from binscope.llm import op3_langid, op4_mixing, op5_decontam, op8_simhash, op9_lines
from binscope.llm.common import stored, table

WEIGHTS = [3.0, 1.0, 2.0]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_langid.keep_known(docs, op3_langid.learn(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_lines.keep_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_mixing.mixed_documents(docs, WEIGHTS)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("mixing", mixing)]
#: n-gram profiles, MinHash and SimHash have no SQL form: tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
