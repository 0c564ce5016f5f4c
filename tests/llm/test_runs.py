"""Operator 11 against every period tried on every position."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from binscope.llm import op11_runs as R
from binscope.llm import queries as Q
from tests.llm import naive
from tests.llm.test_contracts import docs_of, edge_dir, same  # noqa: F401


def all_runs(s, least=24, periods=3):
    """Maximal stretches in which words q apart are equal, kept if q is their smallest period."""
    out = set()
    for q in range(1, len(s) // periods + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            n = j - i + q
            if n >= max(least, periods * q) and not any(s[i:j + q - d] == s[i + d:j + q] for d in range(1, q)):
                out.add((i, n, q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def wanted(doc_id, text):
    s = planted(doc_id, naive.SPACE_WORD.findall(text or ""))
    runs = all_runs(s)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1] * 10**9 // r[2], r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(w for i, w in enumerate(s) if i not in gone)))


@pytest.mark.parametrize("least,periods", [(2, 2), (3, 3), (24, 3)])
def test_runs_of_small_sequences(least, periods):
    rng = random.Random(least)
    for _ in range(400):
        n, k = rng.randint(0, 70), rng.randint(1, 4)
        s = [rng.randint(0, k) for _ in range(n)]
        if n > 6 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 9)
            s = [s[a + (i - a) % p] if i >= a and a + p <= n else s[i] for i in range(n)]
        assert [tuple(r) for r in R.runs_of(np.array(s, np.int64), least, periods).tolist()] == all_runs(s, least, periods)


def test_pieces_lose_no_run():
    """Random sequences with runs put in at random, several texts at a time."""
    rng = random.Random(5)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 5)):
            s = [rng.randint(0, 30) for _ in range(rng.randint(0, 120))]
            for _ in range(rng.randint(0, 3)):
                p = rng.randint(1, 12)
                root = [rng.randint(0, 30) for _ in range(p)]
                at = rng.randint(0, len(s))
                s[at:at] = (root * 40)[:rng.randint(20, 60)]
            texts.append([b"%d" % x for x in s])
        assert [[tuple(r) for r in x.tolist()] for x in R.text_runs(texts)] == [all_runs(t) for t in texts]


def test_extension_equals_comparison():
    s = [0, 1, 0, 1, 1, 0, 1, 0, 1, 1, 0, 0, 1, 2]
    ext = R.Extension(*R.SuffixTree(s, 3).tour())
    for a in range(13):
        for b in range(13):
            if a != b:
                want = next(k for k in range(20) if max(a, b) + k == 14 or s[a + k] != s[b + k])
                assert ext(np.array([a]), np.array([b]))[0] == want
    assert R.SuffixTree(s, 3).tour()[0].tolist()[1:] == sorted(range(13), key=lambda i: s[i:-1])


def test_documents(spark, sf001, edge_dir):  # noqa: F811
    for d in (edge_dir, sf001):
        got = [tuple(r) for r in Q.op11(spark, d).select(
            "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
        docs = docs_of(spark, d)
        if d == sf001:
            # the plain definition takes seconds on the longest texts: they are compared in the test above
            short = {i for i, t, *_ in docs if len(t) < 4000}
            assert len(short) > 100
            got = [r for r in got if r[0] in short]
            docs = [r for r in docs if r[0] in short]
        same(got, [wanted(i, t) for i, t, *_ in docs if len(t or "") < 50_000] + [r for r in got if r[0] in
             {i for i, t, *_ in docs if len(t or "") >= 50_000}])


def test_long_texts():
    one = [b"long"] * 200_000
    began = time.time()
    assert R.text_runs([one])[0].tolist() == [[0, 200_000, 1]]
    assert time.time() - began < 30
    rng = random.Random(1)
    words = [b"%d" % rng.randrange(5000) for _ in range(30_000)]
    words[7000:] = (words[7000:7900] * 40)[:23_000]
    assert R.text_runs([words])[0].tolist() == [[7000, 23_000, 900]]


def test_null_and_repeated_rows(spark):
    rows = [(None, "a b " * 20, 1), (None, "a b " * 20, 2), (7, None, 3), (8, "", 4), (8, "", 5)]
    got = R.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int")).collect()
    assert sorted((str(r.doc_id), len(r.runs), r.collapsed) for r in got) == [
        ("7", 0, ""), ("8", 0, ""), ("8", 0, ""), ("None", 1, "a b"), ("None", 1, "a b")]
    assert all(r.best is None or tuple(r.best) == (0, 40, 2) for r in got)
