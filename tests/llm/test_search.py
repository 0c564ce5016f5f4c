"""Operator 12 against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from binscope.llm import op12_search as S
from binscope.llm import queries as Q
from tests.llm import naive
from tests.llm.test_contracts import docs_of, edge_dir, same  # noqa: F401

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=10):
    """docs, items: (id, text) rows."""
    terms = [(i, TERM.findall((t or "").translate(naive.LOWER))) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    n, total = len(terms), sum(len(t) for _, t in terms)
    df = Counter(w for _, t in terms for w in set(t))
    counts = [(i, len(t), Counter(t)) for i, t in terms]
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(naive.LOWER)))
    out = []
    for item, words in asked.items():
        scored = []
        for i, size, tf in counts:
            m = 10 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m))
                    for w in words if w in tf)
            if s > 0:
                scored.append((-s, i is None, i, s))
        scored.sort(key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))
        out += [(item, r + 1, x[2], x[3]) for r, x in enumerate(scored[:k])]
    return out


def items_of(spark, d):
    return [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]


def test_search(spark, sf001, edge_dir):  # noqa: F811
    for d in (sf001, edge_dir):
        want = ranked([(i, t) for i, t, *_ in docs_of(spark, d)], items_of(spark, d))
        same([tuple(r) for r in Q.op12(spark, d).collect()], want)


def test_passes_give_the_same(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    items = spark.read.parquet(f"{sf001}/benchmark.parquet")
    same(S.search(docs, items, item_bytes=2000).collect(), S.search(docs, items).collect())


@pytest.mark.parametrize("seed", range(4))
def test_blocks_of_ties(seed):
    """Random counts with many ties and more than 64 terms: the best of every item, without scoring all."""
    rng = np.random.default_rng(seed)
    size, n = 150, 400
    count = np.where(rng.random((size, n)) < 0.15, rng.integers(1, 4, (size, n)), 0)
    m = rng.integers(10, 40, n)
    weight = rng.integers(0, 5000, size)
    items = [rng.choice(size, 80, replace=False), rng.choice(size, 2, replace=False), rng.choice(size, 5, replace=False)]
    ids, none = rng.permutation(n), rng.random(n) < 0.02
    ranking = [S.Ranking(10) for _ in items]
    halves = [np.arange(n // 2), np.arange(n // 2, n)]
    evaluated = sum(S.search_block(count[:, h], m[h], ids[h], none[h], items, weight, ranking) for h in halves)
    for terms, best in zip(items, ranking):
        t = count[terms]
        score = weight[terms] @ (10**9 * t // (1000 * t + 8 * m))
        order = np.lexsort((ids, none, -score))[:10]
        order = order[score[order] > 0]
        assert best.score.tolist() == score[order].tolist() and best.id.tolist() == ids[order].tolist()
    assert evaluated < len(items) * n


def test_masks():
    rng = random.Random(2)
    present = np.array([[rng.random() < 0.5 for _ in range(300)] for _ in range(3)])
    first, group = S.mask_groups(present)
    assert len(first) == 8
    assert (present[:, first[group]] == present).all()


def test_odd_rows(spark):
    docs = [(1, "Alpha beta", "x"), (1, "alpha BETA", "y"), (None, "alpha", "z"), (5, "alpha beta", "z"), (2, None, "z"), (3, "--- !!", "z")]
    items = [("q", "ALPHA?", 1), ("q", "beta beta", 2), (None, "alpha", 3), ("none", "gamma", 4), ("nil", None, 5)]
    got = S.search(spark.createDataFrame(docs, "doc_id int, text string, score string"),
                   spark.createDataFrame(items, "item_id string, text string, rank int")).collect()
    same([tuple(r) for r in got], ranked([d[:2] for d in docs], [i[:2] for i in items]))
