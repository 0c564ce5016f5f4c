"""Operator 10: personal data by aggregated weak supervision.

Wide patterns propose spans; regex checks, gazetteers and context words vote
on each (yes, no, abstain). Expectation-maximisation over the counts of vote
patterns, taken from every candidate of the corpus, estimates the labelers'
reliabilities; the posteriors train a logistic span classifier that decides
on the spans the base patterns do not already fix.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binscope.llm.common import map_slices, record, sample_share, stored, unit_hash

KINDS = ("email", "ip", "card", "phone")
#: fixed values: gazetteers and context words
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io de fr es it uk eu ch at nl be us ca co br jp cn in ru".split())
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login", "adresse"),
    "card": ("card", "visa", "credit", "pay", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "llame", "appel"),
}
AGAINST = ("version", "isbn", "chapter", "section", "page", "order", "price")
ISSUERS = ("4", "5", "34", "37", "6011", "65", "35", "36", "38", "2")
LABELERS = ("shape", "checksum", "gazetteer", "context", "border")
#: candidates a kind from which the span classifier is fitted, about (by a hash of the span)
FIT_SPANS = 5_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,63}){1,4}"),
    "phone": re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])"),
}


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        d = d * 2 - 9 * (d > 4) if i % 2 else d
        total += d
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches of local part, @, dotted domain; linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _LOCAL:
            left -= 1
        m = _DOMAIN.match(text, at) if left < at else None
        if m:
            yield left, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """The fixed patterns: (kind, start, end), leftmost non-overlapping per kind."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str | None) -> list[tuple[str, int, int, bool]]:
    """Base spans plus looser proposals that overlap none of them."""
    base = base_spans(text)
    if not text:
        return []
    out = [(*s, True) for s in base]
    loose = []
    if "@" not in text or "at" in text:
        if "(at)" in text or "[at]" in text:
            loose += [("email", *m.span()) for m in _LOOSE["email"].finditer(text)]
    loose += [("phone", *m.span()) for m in _LOOSE["phone"].finditer(text)]
    for m in _CARD.finditer(text):          # card-like runs that fail the checksum
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and not luhn(d):
            loose.append(("card", *m.span()))
    starts, ends = [s[1] for s in base], [s[2] for s in base]
    reach = np.maximum.accumulate(ends).tolist() if ends else []
    for kind, a, b in loose:
        i = bisect_left(starts, b)           # base spans that start before b
        if not i or reach[i - 1] <= a:
            out.append((kind, a, b, False))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def votes(text: str, kind: str, start: int, end: int, base: bool) -> list[int]:
    """One of 1, 0, -1 (abstain) per labeler."""
    span, digits = text[start:end], _digits(text[start:end])
    before = text[max(0, start - 40):start].lower()
    shape = int(base)
    checksum = -1
    if kind == "card":
        checksum = int(luhn(digits))
    elif kind == "ip":
        checksum = int(all(p == "0" or not p.startswith("0") for p in span.split(".")))
    elif kind == "phone":
        checksum = int(len(set(digits)) > 2)
    gazetteer = -1
    if kind == "email":
        gazetteer = int(re.split(r"[.\s\])]+", span.lower())[-1] in TOP_DOMAINS) or -1
    elif kind == "card":
        gazetteer = int(digits.startswith(ISSUERS))
    elif kind == "ip":
        gazetteer = 0 if span.startswith(("0.", "255.")) else -1
    elif kind == "phone":
        gazetteer = 1 if span.startswith(("+1", "+33", "+34", "+49", "+44", "(")) else -1
    context = 1 if any(w in before for w in CONTEXT[kind]) else 0 if any(w in before for w in AGAINST) else -1
    left, right = text[start - 1:start], text[end:end + 1]
    border = 0 if (left.isalnum() and kind != "email") or right.isalnum() else 1
    return [shape, checksum, gazetteer, context, border]


def features(kind: str, text: str, start: int, end: int, vote: list[int]) -> list[float]:
    """Numbers the span classifier sees: votes, length, digit share, separators, kind."""
    span = text[start:end]
    n = max(len(span), 1)
    return [1.0, *[float(v > 0) - float(v == 0) for v in vote], min(n, 40) / 40,
            sum(c.isdigit() for c in span) / n, sum(c in " -.()" for c in span) / n,
            *[float(kind == k) for k in KINDS]]


def propose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its candidate spans, votes and features (no text)."""
    kind = "long" if docs.schema[id_col].dataType.simpleString() == "bigint" else "string"
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()),
                      ("votes", pa.int64()), ("x", pa.list_(pa.float64()))])
    types = {"doc_id": pa.int64() if kind == "long" else pa.string(), "spans": pa.list_(span)}

    def row(text):
        out = []
        for k, a, b, base in candidates(text):
            v = votes(text, k, a, b, base)
            out.append({"kind": k, "start": a, "end": b, "base": base, "x": features(k, text, a, b, v),
                        "votes": sum((x + 1) * 3 ** i for i, x in enumerate(v))})
        return out

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return record(types, {"doc_id": b.column(0).to_pylist(), "spans": [row(t) for t in b.column(1).to_pylist()]})
    return map_slices(docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col).alias("text")), run,
                      f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,base:boolean,"
                      "votes:long,x:array<double>>>")


def em(patterns: np.ndarray, counts: np.ndarray, right: tuple[float, float] = (0.9, 0.9), anchor: float = 0.1,
       rounds: int = 200) -> np.ndarray:
    """Posterior of class 1 per vote pattern, by expectation-maximisation.

    ``patterns``: rows of votes in {-1, 0, 1}, where -1 says nothing;
    ``counts``: how often each was seen. ``right``: what one expects of a
    labeler, the share of its votes on class 0 that are 0 and on class 1 that
    are 1; it weighs like ``anchor`` of the counts, so the classes keep their
    meaning when few votes disagree.
    """
    m, n = patterns.shape[1], counts.sum()
    yes = np.repeat([[1 - right[0], right[1]]], m, 0)        # P(vote 1 | class)
    share, post = 0.8, np.full(len(counts), 0.5)
    for _ in range(rounds):
        odds = np.full(len(counts), np.log(share / (1 - share)))
        for j in range(m):
            one, zero = (np.log(f(yes[j, 1]) / f(yes[j, 0])) for f in (lambda p: p, lambda p: 1 - p))
            odds += np.where(patterns[:, j] == 1, one, np.where(patterns[:, j] == 0, zero, 0.0))
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        weight = np.stack([counts * (1 - new), counts * new])
        for j in range(m):
            for c, expected in ((0, 1 - right[0]), (1, right[1])):
                ones, votes = (weight[c][k].sum() for k in (patterns[:, j] == 1, patterns[:, j] >= 0))
                yes[j, c] = (ones + anchor * n * expected + 0.01) / (votes + anchor * n + 0.02)
        share = (weight[1].sum() + 1) / (n + 2)
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return new


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 1.0, l2: float = 1e-3) -> np.ndarray:
    """Weights of a logistic model for soft labels, by full-batch descent."""
    w = np.zeros(x.shape[1], x.dtype)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        w -= (rate * ((p - y) @ x / max(len(y), 1) + l2 * w)).astype(w.dtype)
    return w


def unpack(code: int) -> list[int]:
    return [code // 3 ** i % 3 - 1 for i in range(len(LABELERS))]


def fit(proposed: DataFrame, fit_spans: int = FIT_SPANS) -> list[float]:
    """Span-classifier weights from every candidate's votes; none without candidates.

    Vote patterns are counted over the whole corpus (at most 3^5 a kind); EM
    runs per kind. The classifier sees about ``fit_spans`` candidates a kind.
    """
    spans = proposed.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    seen = spans.groupBy("kind", "votes").count().orderBy("kind", "votes").collect()
    if not seen:
        return []
    post: dict[tuple[str, int], float] = {}
    for kind in {r["kind"] for r in seen}:
        own = [r for r in seen if r["kind"] == kind]
        p = em(np.array([unpack(r["votes"]) for r in own]), np.array([float(r["count"]) for r in own]))
        post |= {(kind, r["votes"]): float(v) for r, v in zip(own, p)}
    totals: dict[str, int] = {}
    for r in seen:
        totals[r["kind"]] = totals.get(r["kind"], 0) + r["count"]
    share = sample_share(totals, fit_spans)
    keep = F.lit(0.0)
    for kind, s in share.items():
        keep = F.when(F.col("kind") == kind, s).otherwise(keep)
    rows = (spans.where(unit_hash("doc_id", "kind", "start") < keep)
            .groupBy("kind", "votes", "x").count().orderBy("kind", "votes", "x").collect())
    if not rows:
        return []
    x = np.array([r["x"] for r in rows]).repeat([r["count"] for r in rows], 0)
    y = np.array([post[r["kind"], r["votes"]] for r in rows]).repeat([r["count"] for r in rows])
    return logistic(x, y).tolist()


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = 0.5, fit_spans: int = FIT_SPANS) -> DataFrame:
    """(doc_id, findings): base spans, and other candidates the classifier accepts, with scores.

    One row per input row. A null or empty text has no findings; null ids and
    repeated rows keep their rows; an empty table gives an empty result. Equal
    starts are ordered by kind. Extra columns are ignored.
    """
    proposed = stored(propose(docs, id_col, text_col), "pii")
    weights = fit(proposed, fit_spans)
    # a linear score in code generation: no second Python pass
    score = F.lit(0.0)
    dot = lambda s: F.aggregate(
        F.zip_with(s["x"], F.array(*[F.lit(w) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    scored = F.transform("spans", lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"),
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-dot(s))) if weights else score).alias("score")))
    return proposed.select(F.col("doc_id").alias("path"), F.filter(
        scored, lambda s: s["base"] | (s["score"] >= threshold)).alias("findings"))


def base_sha256(text: str | None) -> str:
    """The digest by its definition, for tests."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text)).encode()).hexdigest()
