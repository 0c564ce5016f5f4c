"""Operator 3: language identification by rank-order n-gram profiles.

A profile is the ranked list of a language's most frequent character n-grams
(one to three characters, words set off by blanks). A document is given the
language whose profile is nearest by the out-of-place distance between ranks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binscope.llm.common import map_slices, plain_names, record, sample_share, stored, unit_hash

#: n-grams in a profile, and of a document that are compared
PROFILE = 400
#: training documents per language whose n-grams are counted, about (by a hash of the id)
FIT_DOCS = 2_000
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point to a small number; 0 for what is no letter."""
    ids = np.zeros(0x110000, np.int64)
    points = [c for c in range(0x110000) if chr(c).isalpha()]
    ids[points] = np.arange(1, len(points) + 1)
    return ids


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of the n-grams of the lower-cased text and their counts.

    A code holds up to three letter numbers of 18 bits under the length; a
    blank stands for any run's border. No letters give empty arrays.
    """
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    a = np.zeros(len(points) + 2, np.int64)
    a[1:-1] = _letters()[points]
    one = a[a > 0]
    x, y = a[:-1], a[1:]
    two = (x << 18 | y)[(x | y) > 0]
    x, y, z = a[:-2], a[1:-1], a[2:]
    three = (x << 36 | y << 18 | z)[(y > 0) & ((x | z) > 0)]
    codes = np.sort(np.concatenate([one | 1 << 54, two | 2 << 54, three | 3 << 54]))
    if not len(codes):
        return codes, codes
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[starts], np.diff(np.r_[starts, len(codes)])


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """Codes by falling count, ties by code, at most ``most``."""
    n = len(codes)
    key = (counts.max(initial=0) - counts) * n + np.arange(n)
    if n > most:
        key = np.partition(key, most)[:most]
    return codes[np.sort(key) % max(n, 1)]


class Profiles:
    """Ranks of every profile's n-grams, ready for lookup."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.codes = np.unique(np.concatenate([np.array(p, np.int64) for p in profiles.values()])) \
            if profiles else np.empty(0, np.int64)
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), size, np.int64)   # last row: absent
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the nearest profile (ties by name), one minus its share of the largest distance."""
        codes = ranked(*ngrams(text), self.size)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, codes)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == codes[known]
        at[~known] = len(self.codes)
        ranks, own = self.ranks[at], np.arange(len(codes))[:, None]
        far = np.where(ranks == self.size, self.size, np.abs(ranks - own)).sum(0)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (self.size * len(codes)))


def fit_profiles(train: DataFrame, size: int = PROFILE, fit_docs: int = FIT_DOCS) -> dict[str, list[int]]:
    """Profiles from ``train(doc_id, text, lang)``; null languages and texts are ignored.

    N-grams of about ``fit_docs`` whole documents a language are counted.
    The top ones are taken first per (language, slice of n-grams), so no task
    holds a language; ``16 * size`` rows a language reach the driver.
    """
    train = train.where("lang is not null and text is not null")
    share = sample_share({r[0]: r[1] for r in train.groupBy("lang").count().collect()}, fit_docs)
    if not share:
        return {}
    keep = F.lit(0.0)
    for lang, s in share.items():
        keep = F.when(F.col("lang") == lang, s).otherwise(keep)
    types = {"lang": pa.string(), "code": pa.int64(), "n": pa.int64()}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        parts: dict[str, list] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            parts.setdefault(lang, []).append(ngrams(text))
        out = {"lang": [], "code": [], "n": []}
        for lang, got in parts.items():
            codes, at = np.unique(np.concatenate([c for c, _ in got]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([n for _, n in got]), len(codes)).astype(np.int64)
            out["lang"] += [lang] * len(codes)
            out["code"] += codes.tolist()
            out["n"] += counts.tolist()
        return record(types, out)
    counted = (map_slices(train.where(unit_hash("doc_id") < keep).select("lang", "text"), run,
                          "lang string, code long, n long")
               .groupBy("lang", "code").agg(F.sum("n").alias("n")))
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("code"), F.lit(16))).orderBy(F.desc("n"), "code")
    top = counted.withColumn("r", F.row_number().over(part)).where(F.col("r") <= size).collect()
    out: dict[str, list[tuple[int, int]]] = {}
    for r in top:
        out.setdefault(r["lang"], []).append((-r["n"], r["code"]))
    return {lang: [c for _, c in sorted(rows)[:size]] for lang, rows in out.items()}


def predict(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row, from the whole text alone.

    A text that is null or has no letters is ``und`` with score 0, as is any
    text without profiles; ties go to the first language by name. Null ids
    and repeated rows keep their rows. Extra columns are ignored.
    """
    kind = "long" if docs.schema[id_col].dataType.simpleString() == "bigint" else "string"
    model = Profiles(profiles, size)
    types = {"doc_id": pa.int64() if kind == "long" else pa.string(), "lang_pred": pa.string(), "score": pa.float64()}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [model.predict(t) for t in b.column(1).to_pylist()]
        return record(types, {"doc_id": b.column(0).to_pylist(), "lang_pred": [x for x, _ in got],
                              "score": [s for _, s in got]})
    return map_slices(docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col).alias("text")), run,
                      f"doc_id {kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> F.Column:
    """True for the third of the documents that is never learnt from (a null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame) -> dict[str, list[int]]:
    """Profiles from the documents that are not held out; null ids are not learnt from."""
    return fit_profiles(docs.select("doc_id", "text", "lang").where(~held_out() & F.col("doc_id").isNotNull()))


def keep_known(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """The rows of ``docs``, all columns, whose text gets a language (not ``und``).

    Texts that are null, empty or without a letter go. Without profiles (no
    row to learn from) nothing else is known about a text: all with a letter
    stay. Rows that repeat stay; columns may have any name; an empty table
    gives an empty result.
    """
    model = Profiles(profiles)

    def known(text: str | None) -> bool:
        return model.predict(text)[0] != UNKNOWN if profiles else any(map(str.isalpha, text or ""))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(b.schema.get_field_index("text")).to_pylist()
        return b.filter(pa.array([known(t) for t in texts], pa.bool_()))
    plain = plain_names(docs, "text")
    return map_slices(plain, run, plain.schema).toDF(*docs.columns)
