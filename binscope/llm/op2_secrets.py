"""Operator 2: secret scan with an incremental blob ledger.

Every version of a path is content-addressed (SHA-256 of its bytes). A blob is
scanned once per rule version: pairs that the ledger holds are skipped, new
pairs are scanned and appended, and findings are joined back to every path
that ever held the blob.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binscope.llm.common import map_slices, record, stored

RULE_VERSION = "2026.1"
#: kind, pattern, group to measure, least length, literals of which a hit has one; fixed values
RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8,
     ("password", "passwd", "secret", "token", "apikey", "api_key")),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, ("akia",)),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32, ()),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("private key",)),
    ("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, ("xox",)),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30, ("eyj",)),
]
BASE = ("assign", "access", "hex")
LEDGER = "blob_id string, rule_version string, findings array<struct<kind:string,start:long,end:long>>"
_COMPILED = [(k, re.compile(p, re.ASCII | (re.IGNORECASE if k == "assign" else 0)), g, n, lits)
             for k, p, g, n, lits in RULES]


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: leftmost non-overlapping matches per kind."""
    if not text:
        return []
    low, out = text.lower(), []
    for kind, rx, group, least, literals in _COMPILED:
        if literals and not any(x in low for x in literals):
            continue
        out += [(kind, *m.span()) for m in rx.finditer(text) if len(m.group(group)) >= least]
    rank = {k: i for i, (k, *_) in enumerate(RULES)}
    return sorted(out, key=lambda f: (f[1], rank[f[0]]))


def content_address(versions: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``blob_id``: SHA-256 of the text's UTF-8 bytes, a null text as empty."""
    return versions.withColumn("blob_id", F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def scan_unseen(blobs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows for blobs of ``blobs(blob_id, text)`` that ``ledger`` lacks under this version.

    Each unseen content is scanned once, however many versions hold it:
    equal blobs meet as partial aggregates, so a task sends a text once.
    """
    rows = blobs.select("blob_id", "text")
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob_id").distinct()
        rows = rows.join(seen, "blob_id", "left_anti")
    rows = rows.groupBy("blob_id").agg(F.first("text").alias("text"))
    types = {"blob_id": pa.string(), "rule_version": pa.string(), "findings": pa.list_(pa.struct(
        [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [[dict(zip(("kind", "start", "end"), f)) for f in scan(t)] for t in b.column(1).to_pylist()]
        return record(types, {"blob_id": b.column(0).to_pylist(), "rule_version": [rule_version] * b.num_rows,
                              "findings": found})
    return map_slices(rows, run, LEDGER)


def scan_history(versions: DataFrame, path_col: str = "doc_id", text_col: str = "text",
                 ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(new ledger rows, findings by path): scan what the ledger lacks, join back to all paths.

    Findings have one row per version row: (path, blob_id, findings). A null
    or empty text is the empty blob without findings; null paths and repeated
    rows keep their rows; an empty table gives empty results. Extra columns
    are ignored. Append the first result to the ledger to make the next scan
    incremental.
    """
    blobs = content_address(versions.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")))
    new = stored(scan_unseen(blobs, ledger, rule_version), "ledger")
    known = new if ledger is None else new.unionByName(
        ledger.where(F.col("rule_version") == rule_version).select(new.columns))
    # a blob without findings needs no partner: hot empty results do not travel
    hits = known.where("size(findings) > 0").select("blob_id", "findings")
    found = (blobs.select("path", "blob_id").join(hits, "blob_id", "left")
             .select("path", "blob_id", F.coalesce("findings", F.lit([]).cast(hits.schema["findings"].dataType))
                     .alias("findings")))
    return new, found


def spans_string(findings: F.Column) -> F.Column:
    """kind:start:end of the findings, comma-joined in their order."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def digest(findings: DataFrame, kinds: tuple[str, ...], base: Callable[[F.Column], F.Column]) -> DataFrame:
    """Counts per base kind, hash of the base spans and all spans as text; ``base`` tells base findings."""
    own = F.filter("findings", base)

    def count(kind: str) -> F.Column:
        return F.size(F.filter(own, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return findings.select(F.col("path").alias("doc_id"), *map(count, kinds),
                           F.sha2(spans_string(own), 256).alias("base_sha256"),
                           spans_string(F.col("findings")).alias("spans"))
