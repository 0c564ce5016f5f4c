"""Operator 8: SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within an even distance 2r meet at a value within r bits of
both, so each emits all its variants within r bits and equal variants bring
the pair together. For an odd distance 2r + 1 the 64 bits are cut into three
blocks: leaving out the block with most differing bits leaves at most 2r, so
each fingerprint emits the r-balls of its three 2-block remainders (129
variants for distance 3 instead of the 2,081 of a full half-radius ball of 2).
Every colliding pair is verified on all 64 bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binscope.llm.common import Forest, components, key_runs, map_slices, plain_names, record, stored

SEED = 42
#: fingerprints that may share a variant and be verified pair by pair; larger groups go to :func:`_stars`
PAIRWISE = 128


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles of ``text``, 0 without words."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()    # A-Z only; on the six ASCII spaces
    n = max(1, len(words) - shingle + 1)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]][:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1:][:n] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        bits = np.unpackbits(h[i:i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 3, name: str = "fp") -> DataFrame:
    """All columns of ``docs`` and ``name``: the fingerprint as a signed long."""
    from pyspark.sql import types as T
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
        fps = pa.array([signed(fingerprint(t, shingle)) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([*b.columns, fps], names=[*b.schema.names, name])
    return map_slices(docs, run, schema)


def _ball(mask: int, radius: int) -> list[int]:
    """All flips of up to ``radius`` bits of ``mask``."""
    bits = [1 << i for i in range(64) if mask >> i & 1]
    return [sum(c) for r in range(radius + 1) for c in combinations(bits, r)]


def variants(distance: int) -> list[tuple[int, int]]:
    """(mask, flip and tag): a key is (fingerprint & mask) ^ flip. The tag sits in the block left out."""
    full = (1 << 64) - 1
    if distance % 2 == 0:
        return [(full, f) for f in _ball(full, distance // 2)]
    blocks = [((1 << 21) - 1) << 43, ((1 << 21) - 1) << 22, (1 << 22) - 1]
    out = []
    for i, b in enumerate(blocks):
        tag = (i << (b.bit_length() - 2)) & b
        out += [(full ^ b, f | tag) for f in _ball(full ^ b, distance // 2)]
    return out


def _verified(distance: int):
    """Stream sorted by (key, fp) to links; pieces of large groups as (fp, null)."""
    types = {"a": pa.int64(), "b": pa.int64()}

    def run(batches):
        for how, batch in key_runs(batches, "key", PAIRWISE):
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            if how == "part":
                yield record(types, {"a": fp, "b": pa.nulls(len(fp), pa.int64())})
                continue
            key = batch.column("key").to_numpy(zero_copy_only=False)
            forest, out = Forest(), []
            for d in range(1, PAIRWISE):
                at = np.flatnonzero(key[d:] == key[:-d])
                if not len(at):
                    break
                x, y = fp[at], fp[at + d]
                near = (x != y) & (np.bitwise_count((x ^ y).view(np.uint64)) <= distance)
                out += [p for p in zip(x[near].tolist(), y[near].tolist()) if forest.join(*p)]
            yield record(types, {"a": [a for a, _ in out], "b": [b for _, b in out]})
    return run


def _stars(fps: DataFrame, distance: int) -> DataFrame:
    """Exact links among ``fps`` for groups of any size, without pairs.

    Full balls: values within r = distance // 2 bits (core) and, for an odd
    distance, r + 1 bits (rim). A core member lies within the distance of
    every other member of its value, so one core member linked to all others
    keeps every connection; a stream sorted core first needs no memory.
    """
    r = distance // 2
    flips = np.array([signed(f) for f in _ball((1 << 64) - 1, r + distance % 2)], np.int64)
    rim = np.array([int(x).bit_count() > r for x in flips.view(np.uint64)])
    types = {"key": pa.int64(), "rim": pa.bool_(), "fp": pa.int64()}

    def emit(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        return record(types, {"key": (fp[:, None] ^ flips).ravel(), "rim": np.tile(rim, len(fp)),
                              "fp": fp.repeat(len(flips))})

    def star(batches):
        open_key, centre = None, None
        for b in batches:
            key, out_rim, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "rim", "fp"))
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            centres = fp[starts].copy()
            has = ~out_rim[starts].astype(bool)
            if len(key) and key[0] == open_key:
                centres[0], has[0] = (centre, True) if centre is not None else (0, False)
            sizes = np.diff(np.r_[starts, len(key)])
            c, keep = centres.repeat(sizes), has.repeat(sizes)
            keep &= c != fp
            if len(key):
                open_key, centre = key[-1], centres[-1] if has[-1] else None
            yield record({"a": pa.int64(), "b": pa.int64()}, {"a": c[keep], "b": fp[keep]})
    return (map_slices(fps, emit, "key long, rim boolean, fp long", 64)
            .repartition("key").sortWithinPartitions("key", "rim", "fp")
            .mapInArrow(star, "a long, b long").distinct())


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b): links that connect all fingerprints of distinct ``fps(fp)`` within ``distance`` bits.

    Links within one value that join nothing new are left out.
    """
    pairs = F.array(*[F.struct(F.lit(signed(m)).alias("m"), F.lit(signed(f)).alias("f")) for m, f in variants(distance)])
    keyed = (fps.select("fp", F.explode(pairs).alias("v"))
             .select(F.col("fp").bitwiseAND(F.col("v.m")).bitwiseXOR(F.col("v.f")).alias("key"), "fp"))
    found = stored(keyed.repartition("key").sortWithinPartitions("key", "fp")
                   .mapInArrow(_verified(distance), "a long, b long"), "simhash-links")
    crowded = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    direct = found.where("b is not null")
    if crowded.isEmpty():
        return direct
    return direct.unionByName(_stars(crowded, distance))


def groups(marked: DataFrame, rank_col: str, distance: int = 3) -> DataFrame:
    """(fp, first): for each fingerprint of ``marked(fp, rank_col)`` the smallest rank reachable (nulls last)."""
    firsts = stored(marked.groupBy("fp").agg(F.min(rank_col).alias("own")), "fingerprints")
    roots = components(links(firsts.select("fp"), distance))
    member = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "own", F.coalesce("root", "fp").alias("root"))
    low = member.groupBy("root").agg(F.min("own").alias("first"))
    return stored(member.join(low, "root").select("fp", "first"), "simhash-groups")


def near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per document row.

    ``component_id`` is the smallest id reachable by links of at most
    ``distance`` bits (null if all ids there are null). Texts without words,
    null included, have fingerprint zero and link like any other; repeated
    rows link with themselves; an empty table gives an empty result. Extra
    columns are ignored.
    """
    marked = stored(with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")),
                                     "text", shingle).drop("text"), "simhash")
    first = groups(marked, "doc_id", distance)
    return marked.join(first, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                           F.col("first").alias("component_id"))


def keep_one(docs: DataFrame, distance: int = 3, shingle: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns: of each group the one with the smallest id (null last, ties: the first stored).

    Texts without words, null included, are one group. Columns may have any
    name; an empty table gives an empty result.
    """
    row, fp = "row", "fp"
    plain = plain_names(docs, "doc_id", "text").withColumn(row, F.monotonically_increasing_id())
    marked = stored(with_fingerprint(plain, "text", shingle, fp), "simhash-documents")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row"))
    first = groups(marked.select(F.col(fp).alias("fp"), rank.alias("rank")), "rank", distance)
    kept = first.select(F.col("first.row").alias(row)).distinct()
    return marked.join(kept, row, "left_semi").drop(row, fp).toDF(*docs.columns)
