"""Operator 4: mix sources to target weights by hash-threshold histograms.

A document's hash fixes its place in its source; a source's budget becomes a
threshold on that hash. Tokens are summed by (source, hash bucket); the bucket
in which the running sum passes the budget is split again by the next bits
until it holds one hash, so the threshold is exact. Documents under it are
taken by a plain filter: nothing is sorted and thresholds of growing budgets
are nested. Rows that repeat id, source and text share a hash; where the
threshold meets such rows, as many of them are taken as the budget needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binscope.llm.common import free_names, quoted, small_side, stored

#: bits of the hash per histogram level
BITS = 12
#: what separates words; splitting is linear in the text, extracting each match is not
BETWEEN = r"[\x20\x09-\x0D]+"


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, h): words of the text and a 63-bit hash of id, source and text."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), BETWEEN), "")).cast("long").alias("size"),
        F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col)), 1).alias("h"))


def ranked_sources(sources: DataFrame) -> DataFrame:
    """Add ``pos``, the place by code point, nulls last, without one task for all.

    Sorted partitions are numbered by their own offsets; the offsets are one
    row a partition.
    """
    # UTF-8 bytes order like code points
    sorted_ = stored(sources.orderBy(F.col("source").asc_nulls_last())
                     .withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    counts = sorted_.groupBy(part.alias("p")).count()
    offsets = counts.withColumn("before", F.coalesce(F.sum("count").over(
        Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return (sorted_.withColumn("p", part).join(F.broadcast(offsets), "p")
            .select("source", "source_size", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("pos")))


def targets(sources: DataFrame, weights: list[float], budget_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): a weighted budget, each target at most ``most`` times its source.

    The excess of full sources is shared again by weight; every round is one
    sum over the sources table, and only its scalars reach the driver.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("pos") % len(weights) + 1).cast("int"))
    s = stored(ranked_sources(sources).select("source", "source_size", weight.alias("w"),
                                              (F.lit(float(most)) * F.col("source_size")).alias("top")), "weights")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    rate, full = 0.0, -1
    while True:
        is_full = F.col("top") < F.col("w") * F.lit(rate) if full >= 0 else F.lit(False)
        n, used, open_w = s.agg(F.count_if(is_full), F.sum(F.when(is_full, F.col("top")).otherwise(0.0)),
                                F.sum(F.when(~is_full, F.col("w")).otherwise(0.0))).first()
        if n == full or not open_w:
            break
        full, rate = n, (budget_share * total - used) / open_w
    return s.select("source", "source_size", F.least(F.col("top"), F.col("w") * F.lit(rate)).alias("target"))


def thresholds(docs: DataFrame, budgets: DataFrame, bits: int = BITS) -> DataFrame:
    """(source, below, extra): documents of ``docs(source, size, h)`` with h < below, and ``extra`` rows
    with h = below, sum to about ``budget``.

    ``budgets(source, budget)``. A level sums sizes by (source, bucket) and
    finds the bucket where the running sum passes the budget; only that
    bucket's documents go on to the next level. It ends when each such bucket
    holds one hash, of which as many rows are taken as leave the smallest error.
    """
    # lo: lower end of the open bucket; spent: words under it
    state = budgets.select("source", F.col("budget").cast("double").alias("budget"), F.lit(0).cast("long").alias("lo"),
                           F.lit(0.0).alias("spent"))
    done, level, shift = None, docs.withColumn("lo", F.lit(0).cast("long")), 63
    while True:
        step = min(bits, shift)
        shift -= step
        bucket = F.shiftright(F.col("h") - F.col("lo"), shift)
        hist = (level.groupBy("source", bucket.alias("b"))
                .agg(F.sum("size").alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.count("*").alias("c")))
        run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # at most 2^bits rows a source
        hist = hist.withColumn("upto", F.sum("n").over(run))
        found = stored(state.join(hist, state["source"].eqNullSafe(hist["source"])).select(
            state["source"], "budget", "lo", "spent", "b", "n", "h0", "h1", "c", (F.col("spent") + F.col("upto")).alias("upto"))
            .where("upto > budget")
            .groupBy("source", "budget", "lo", "spent")
            .agg(F.min(F.struct("b", "n", "h0", "h1", "c", "upto")).alias("x")), "mix")
        # closed: one hash in the bucket; of its c equal rows the number nearest to the budget is taken
        rows = F.ceil((F.col("budget") - (F.col("x.upto") - F.col("x.n"))) * F.col("x.c") / F.col("x.n") - 0.5)
        rows = F.greatest(F.lit(0), F.least(F.col("x.c"), rows)).cast("long")
        closed = found.where("x.h0 = x.h1").select(
            "source", F.when(rows == F.col("x.c"), F.col("x.h0") + 1).otherwise(F.col("x.h0")).alias("below"),
            F.when(rows < F.col("x.c"), rows).otherwise(0).alias("extra"))
        done = closed if done is None else done.unionByName(closed)
        open_ = found.where("x.h0 < x.h1").select(
            "source", "budget", (F.col("lo") + F.shiftleft(F.col("x.b"), shift)).alias("lo"),
            (F.col("x.upto") - F.col("x.n")).alias("spent"))
        n_open = open_.count()
        if not n_open or not shift:
            return done
        state = stored(open_, "mix-open")
        side = small_side(state.select(F.col("source").alias("s"), "lo"), n_open)
        level = docs.join(side, docs["source"].eqNullSafe(F.col("s")) & (
            F.shiftright(F.col("h"), shift) == F.shiftright(F.col("lo"), shift))).select("source", "size", "h", "lo")


def plan_mix(docs: DataFrame, weights: list[float], budget_share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, int, bool]:
    """(source, source_size, target, copies, below, extra), its row count, and whether any ``extra`` is not 0.

    A document is taken ``copies`` times, and once more if h < below or it is
    one of the ``extra`` rows with h = below.
    """
    per = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = stored(targets(per, weights, budget_share, most)
                  .withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                              .otherwise(0).cast("long"))
                  .withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size")), "plan")
    below = thresholds(docs.select("source", "size", "h"), plan.where("budget > 0"))
    plan = stored(plan.alias("p").join(below.withColumnRenamed("source", "s"), F.col("p.source").eqNullSafe(F.col("s")), "left")
                  .select("p.source", "source_size", "target", "copies", F.coalesce("below", F.lit(0)).alias("below"),
                          F.coalesce("extra", F.lit(0)).alias("extra")), "mix-plan")
    n, shared = plan.agg(F.count("*"), F.coalesce(F.max("extra"), F.lit(0))).first()
    return plan, n, shared > 0


def chosen_repeats(docs: DataFrame, side: DataFrame) -> DataFrame:
    """(row): of the rows of ``docs(source, h, row)`` on a source's threshold, the first ``extra``.

    ``row`` holds a partition number above 33 bits. Rows are numbered inside
    their partition and by the counts of the partitions before: no source's
    repeats meet in one task.
    """
    on = docs.join(side, docs["source"].eqNullSafe(F.col("s")) & (F.col("h") == F.col("below")) & (F.col("extra") > 0)).select(
        "source", "row", "extra", F.shiftright("row", 33).alias("part"))
    counts = on.groupBy("source", "part").agg(F.count("*").alias("n"))
    # a row for each partition of a source
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("cs"), F.col("part").alias("cp"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = on.withColumn("at", F.row_number().over(Window.partitionBy("source", "part").orderBy("row")))
    return (inside.join(counts, F.col("source").eqNullSafe(F.col("cs")) & (F.col("part") == F.col("cp")))
            .where(F.col("before") + F.col("at") <= F.col("extra")).select("row"))


def mix(docs: DataFrame, weights: list[float], budget_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, size, source_size, target, taken): one row per document.

    A null text has size 0; a null source is a source of its own, last. Of
    rows that repeat id, source and text, those needed for the target are
    taken once more than the others. An empty table gives an empty result;
    sources without words have target 0. Extra columns are ignored. Reruns
    agree: everything follows from the rows (which of several equal rows is
    taken cannot be told apart).
    """
    m = stored(measured(docs).withColumn("row", F.monotonically_increasing_id()), "measured")
    plan, n, shared = plan_mix(m, weights, budget_share, most)
    side = small_side(plan.withColumnRenamed("source", "s"), n)
    more = F.col("h") < F.col("below")
    out = m.join(side, m["source"].eqNullSafe(F.col("s")))
    if shared:
        out = out.join(chosen_repeats(m, side).select("row", F.lit(True).alias("chosen")), "row", "left")
        more = more | F.coalesce("chosen", F.lit(False))
    times = F.col("copies") + more.cast("long")
    return out.select("doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: list[float], budget_share: float = 1.5, most: float = 2.0,
                    times: str = "mix_times") -> DataFrame:
    """The documents the mix takes, all columns, and how often each is to be repeated.

    That is ``times``, lengthened until the documents have no such column.
    Null texts have size 0 and are taken with their source; null sources and
    repeated rows as in :func:`mix`; an empty table gives an empty result.
    """
    own, copies, below, extra, row, hash_, chosen, source_size, target, times = free_names(
        docs, "s", "copies", "below", "extra", "row", "h", "chosen", "source_size", "target", times)
    plan, n, shared = plan_mix(stored(measured(docs), "measured"), weights, budget_share, most)
    side = small_side(plan.select(F.col("source").alias(own), F.col("copies").alias(copies), F.col("below").alias(below)), n)
    h = F.shiftrightunsigned(F.xxhash64("doc_id", "source", "text"), 1)
    more, first = h < F.col(below), docs
    if shared:
        # the rows need a name of their own to be told apart
        first = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mix-documents")
        repeats = chosen_repeats(first.select(F.col("source").cast("string").alias("source"), h.alias("h"), F.col(row).alias("row")),
                                 small_side(plan.withColumnRenamed("source", "s"), n))
        first = first.join(repeats.select(F.col("row").alias(row), F.lit(True).alias(chosen)), row, "left")
        more = more | F.coalesce(chosen, F.lit(False))
    return (first.join(side, F.col("source").cast("string").eqNullSafe(F.col(own)))
            .withColumn(times, F.col(copies) + more.cast("long")).where(F.col(times) > 0)
            .select(*[quoted(c) for c in docs.columns], times))
