"""Operator 12: the best documents for each item by weighted term counts.

Documents are searched where they lie: each task walks its documents in
blocks. In a block every query term has a bitmap of the documents that hold
it; the bitmaps of an item's terms, put side by side, group the documents by
the mask of matched terms. A mask's score is bounded by its terms' greatest
contributions in the block. The distinct masks are evaluated by descending
bound, exactly, until the bound falls below the item's last place so far. A
task hands on at most ``k`` documents an item, so no posting is shuffled and a
frequent term is no hot key.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binscope.llm.common import record, stored
from binscope.session import ship_package

#: documents an item gets
TOP = 10
#: bytes of item texts that are searched in one pass over the documents
ITEM_BYTES = 1 << 22
#: cells of a block's matrix of terms x documents, and the fewest and most documents of a block
CELLS, LEAST_BLOCK, MOST_BLOCK = 1 << 22, 16, 1024
#: documents evaluated at a time
STEP = 64
#: tasks whose candidates are ranked together first
TASKS = 256

# An ASCII character that is not a letter or digit separates terms; only A-Z are lower-cased
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(raw: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return raw.translate(_TABLE).split() if raw else []


def _texts(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, list[bytes]]]:
    for batch in batches:
        for i, t in enumerate(batch.column(column)):
            yield batch, i, terms_of(t.as_buffer().to_pybytes()) if t.is_valid else []


def corpus_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and for each of ``vocabulary`` the documents that hold it."""
    size = len(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        held = np.zeros(size, np.int64)
        for _, _, words in _texts(batches, 0):
            n += bool(words)
            total += len(words)
            held[[vocabulary[w] for w in set(words) if w in vocabulary]] += 1
        some = np.flatnonzero(held)
        yield record({"term": pa.int32(), "n": pa.int64()},
                     {"term": np.r_[-2, -1, some], "n": np.r_[n, total, held[some]]})
    ship_package(docs.sparkSession)
    rows = (docs.select(F.col("text").cast("binary")).mapInArrow(run, "term int, n long")
            .groupBy("term").agg(F.sum("n").alias("n")).collect())
    df = np.zeros(size, np.int64)
    n = total = 0
    for r in rows:
        if r["term"] == -2:
            n = r["n"]
        elif r["term"] == -1:
            total = r["n"]
        else:
            df[r["term"]] = r["n"]
    return n, total, df


def term_weights(n: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 n + 2) / (2 df + 1))), in doubles."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Ranking:
    """The best documents of one item so far: score falling, then id rising, ids that are null last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id, self.none = (np.empty(0, t) for t in (np.int64, np.int64, bool))

    @property
    def least(self) -> int:
        """A score below this cannot enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        good = score >= self.least
        score = np.r_[self.score, score[good]]
        ids, none = np.r_[self.id, ids[good]], np.r_[self.none, none[good]]
        order = np.lexsort((ids, none, -score))[:self.k]
        self.score, self.id, self.none = score[order], ids[order], none[order]


def mask_groups(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group the columns of a boolean (terms, documents) matrix by their mask.

    Gives one document of each distinct mask, and each document's mask number.
    """
    bits = np.packbits(present, axis=0)
    words = np.zeros((present.shape[1], -(-bits.shape[0] // 8) * 8), np.uint8)
    words[:, :bits.shape[0]] = bits.T
    words = words.view(np.uint64)
    if words.shape[1] == 1:
        _, first, group = np.unique(words[:, 0], return_index=True, return_inverse=True)
    else:
        _, first, group = np.unique(words, axis=0, return_index=True, return_inverse=True)
    return first, group.ravel()


def search_block(count: np.ndarray, m: np.ndarray, ids: np.ndarray, none: np.ndarray, items: list[np.ndarray],
                 weight: np.ndarray, ranking: list[Ranking]) -> int:
    """Bring ``ranking`` up to date with a block: ``count`` is (terms, documents). Gives the documents evaluated."""
    most = count.max(axis=1)
    bound = weight * ((1_000_000_000 * most) // (1000 * most + 8 * int(m.min())))
    evaluated = 0
    for terms, best in zip(items, ranking):
        terms = terms[most[terms] > 0]
        if not len(terms):
            continue
        tf = count[terms]
        present = tf > 0
        some = np.flatnonzero(present.any(axis=0))
        first, group = mask_groups(present[:, some])
        # whole numbers below 2 ** 53
        top = bound[terms].astype(float) @ present[:, some[first]]
        falling = np.argsort(-top, kind="stable")
        place = np.empty(len(falling), np.int64)
        place[falling] = np.arange(len(falling))
        by_mask = some[np.argsort(place[group], kind="stable")]
        stops = np.cumsum(np.bincount(place[group], minlength=len(falling)))
        at = mask = 0
        while mask < len(falling) and top[falling[mask]] >= best.least:
            # whole masks, at least STEP documents of them if there are
            mask = int(np.searchsorted(stops, at + STEP)) + 1
            stop = int(stops[min(mask, len(stops)) - 1])
            these = by_mask[at:stop]
            t = tf[:, these]
            score = weight[terms] @ ((1_000_000_000 * t) // (1000 * t + 8 * m[these]))
            best.add(score, ids[these], none[these])
            evaluated += len(these)
            at = stop
    return evaluated


def _searched(docs: DataFrame, items: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    """(item, doc_id, score, task): what each task hands on."""
    vocabulary: dict[bytes, int] = {}
    queries = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64) for _, words in items]
    numbers = [number for number, _ in items]
    n, total, df = corpus_counts(docs, vocabulary)
    weight = term_weights(n, df)
    size = max(1, len(vocabulary))
    block = max(LEAST_BLOCK, min(MOST_BLOCK, CELLS // size))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking = [Ranking(k) for _ in queries]
        find, cells, ids, lengths = vocabulary.get, [], [], []

        def flush():
            key = np.concatenate([np.array(c, np.int64) * len(ids) + d for d, c in enumerate(cells)])
            count = np.bincount(key, minlength=size * len(ids)).reshape(size, len(ids))
            words = np.array(lengths, np.int64)
            search_block(count, 10 + 90 * words * n // max(total, 1),
                         np.array([0 if x is None else x for x in ids], np.int64), np.array([x is None for x in ids]),
                         queries, weight, ranking)
            cells.clear(), ids.clear(), lengths.clear()

        for batch, i, words in _texts(batches, 1):
            hits = [x for x in map(find, words) if x is not None]
            if hits:
                cells.append(hits)
                ids.append(batch.column(0)[i].as_py())
                lengths.append(len(words))
                if len(ids) == block:
                    flush()
        if ids:
            flush()
        for number, best in zip(numbers, ranking):
            if len(best.score):
                yield record({"item": pa.int64(), "doc_id": pa.int64(), "score": pa.int64()},
                             {"item": [number] * len(best.score), "score": best.score,
                              "doc_id": [None if none else x for x, none in zip(best.id.tolist(), best.none)]})
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        run, "item long, doc_id long, score long")
    return found.withColumn("task", F.spark_partition_id())


def search(docs: DataFrame, items: DataFrame, k: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best rows of ``docs(doc_id, text)`` for each item.

    An item is an ``item_id`` of ``items(item_id, text)`` (null is one too)
    with the terms of all its rows, once each. Each row of ``docs`` is a
    document; equal scores rank by rising id, nulls last. Null and empty texts
    have no terms. Items without a match have no row; empty tables give an
    empty result. Other columns are not read. Items are searched in passes
    over the documents, each for about ``item_bytes`` of their text: that
    bounds what reaches the driver and the tasks.
    """
    spark = docs.sparkSession
    id_type = items.schema["item_id"].dataType
    items = stored(items.select("item_id", F.col("text").cast("binary").alias("text")), "items")
    passes = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // item_bytes)
    out, ids = None, []
    for turn in range(passes):
        words: dict[object, dict[bytes, None]] = {}
        for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == turn).collect():
            words.setdefault(r["item_id"], {}).update(dict.fromkeys(terms_of(bytes(r["text"] or b""))))
        queries = [(len(ids) + n, list(w)) for n, w in enumerate(words.values())]
        ids += [(len(ids) + n, i) for n, i in enumerate(words)]
        found = stored(_searched(docs, [(n, w) for n, w in queries if w], k), "found")
        out = found if out is None else out.unionByName(found)
    numbered = spark.createDataFrame(ids, T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", id_type)]))
    if out is None:
        out = spark.createDataFrame([], "item long, doc_id long, score long, task int")
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    few = (out.withColumn("group", F.floor(F.col("task") / TASKS))
           .withColumn("n", F.row_number().over(Window.partitionBy("item", "group").orderBy(*best))).where(F.col("n") <= k))
    ranked = (few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best)))
              .where(F.col("rank") <= k).select("item", "rank", "doc_id", "score"))
    return ranked.join(numbered, "item").select("item_id", "rank", "doc_id", "score")
