"""Operator 5: benchmark decontamination by a prefix-filtered set join.

A window of an item is the set of its one-word shingles with their places. A
text that holds the window holds all of them, so by the prefix filter the
rarest alone is a necessary token. Words are ordered by their count in the
whole corpus; a document position that has some window's token gives one
candidate, whose start the token's place fixes and whose end must lie in the
text (the positional and the length bound); the words there are then compared
with the window's. DataFrame functions only.

The words of a document stay one array: exploding a plain column, joining a
broadcast table and comparing slices are one generated loop, in which the
array is never copied per word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binscope.llm.common import free_names, stored

#: what separates words once A-Z are lower-cased; splitting is linear in the text, extracting each match is not
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: windows up to which they are sent to every executor; beyond it tokens are shuffled
BROADCAST_WINDOWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text) -> F.Column:
    """Words of a text with A-Z lower-cased; an empty array for null."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN)
    return F.array_remove(parts, "")


def windows(items: DataFrame, length: int = 10) -> DataFrame:
    """(item_id, window, n): each item's windows of ``length`` words, all words of a shorter item as one.

    Items without words have none.
    """
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
    return (w.withColumn("n", F.least(F.size("w"), F.lit(length))).where("n > 0")
            .select("item_id", "n", F.explode(F.transform(
                F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.slice("w", i, F.col("n")))).alias("w"))
            .select("item_id", F.array_join("w", " ").alias("window"), "n").distinct())


def read_words(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, w): two columns tell documents with the same id apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))


def necessary_tokens(docs: DataFrame, wins: DataFrame, n_windows: int) -> DataFrame:
    """(window, n, token, place, nth): the word of each window that is rarest in the whole corpus.

    ``nth`` numbers the windows of a token from 0.
    """
    by_place = wins.select("window", "n").distinct().select(
        "window", "n", F.posexplode(F.split("window", " ")).alias("place", "token"))
    own = by_place.select("token").distinct()
    own = F.broadcast(own) if n_windows <= BROADCAST_WINDOWS else own
    seen = (read_words(docs).select(F.explode("w").alias("token"))
            .join(own, "token").groupBy("token").agg(F.count("*").alias("count")))
    least = (by_place.join(seen, "token", "left").groupBy("window", "n")
             .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "token", "place")).alias("x"))
             .select("window", "n", "x.token", "x.place"))
    return least.withColumn("nth", F.row_number().over(Window.partitionBy("token").orderBy("window")) - 1)


def matches(docs: DataFrame, tokens: DataFrame, n_windows: int) -> DataFrame:
    """(doc_id, text_hash, window, start, n, n_words): verified occurrences (n_words null), and for each
    document row one row with its number of words (window null)."""
    read = read_words(docs)
    key = ["doc_id", "text_hash"]
    start = F.col("pos") - F.col("place")
    fits = (start >= 0) & (start + F.col("n") <= F.size("w"))
    same = F.array_join(F.slice("w", start + 1, F.col("n")), " ") == F.col("window")
    if n_windows <= BROADCAST_WINDOWS:
        side = F.broadcast(tokens.withColumnRenamed("token", "t"))
        at = (read.select(*key, "w", F.posexplode_outer("w").alias("pos", "word"))
              .join(side, F.col("word") == F.col("t"), "left"))
        hit = F.coalesce(fits & same, F.lit(False))
        first = (F.coalesce("pos", F.lit(0)) == 0) & (F.coalesce("nth", F.lit(0)) == 0)
        # a document's first word also carries its size
        at = (at.select(*key, hit.alias("hit"), first.alias("first"), "window", start.alias("start"), "n",
                        F.size("w").alias("size")).where("hit or first"))
        return at.select(*key, F.when(F.col("hit"), F.col("window")).alias("window"), "start", "n",
                         F.when(F.col("first"), F.col("size")).alias("n_words"))
    # many windows: candidates by a shuffle on the token, then back to the words by document
    cand = (read.select(*key, F.posexplode("w").alias("pos", "token"))
            .join(tokens, "token").where(start >= 0).select(*key, "window", "pos", "place", "n").distinct())
    c = cand.alias("c")
    found = (read.dropDuplicates(key).alias("r").join(c, F.col("r.doc_id").eqNullSafe(F.col("c.doc_id"))
                                & (F.col("r.text_hash") == F.col("c.text_hash")))
             .where(fits & same).select("c.doc_id", "c.text_hash", "window", start.alias("start"), "n",
                                        F.lit(None).cast("int").alias("n_words")))
    return found.unionByName(read.select(*key, F.lit(None).cast("string").alias("window"), F.lit(0).alias("start"),
                                         F.lit(0).alias("n"), F.size("w").alias("n_words")))


def contamination(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, items, contaminated): one row per document row.

    ``n_hit``: words inside an occurrence of any window; ``items``: ids of
    items with an occurring window, sorted as strings. Null and empty texts
    and items have no words. Null document ids keep their rows; rows that
    repeat id and text get the same result each; a null item id counts as no
    id; empty tables give no hits or no rows. Extra columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    wins = stored(windows(items, length), "windows")
    n_windows = wins.count()
    tokens = stored(necessary_tokens(docs, wins, n_windows), "tokens")
    found = stored(matches(docs, tokens, n_windows), "matches")
    key = ["doc_id", "text_hash"]
    hits = found.where("window is not null")
    spans = hits.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("stop")))).alias("spans"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("upto"), F.lit(0).alias("hit")), lambda a, x: F.struct(
        F.greatest(a["upto"], x["stop"]).alias("upto"),
        (a["hit"] + F.greatest(F.lit(0), x["stop"] - F.greatest(a["upto"], x["start"]))).alias("hit")))["hit"]
    owners = wins.where("item_id is not null").select("window", "item_id").distinct()
    in_items = (hits.select(*key, "window").distinct().join(owners, "window").groupBy(*key)
                .agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    total = found.where("n_words is not null").select(*key, F.col("n_words").cast("long").alias("n_words"))
    a, b, c = total.alias("a"), spans.alias("b"), in_items.alias("c")
    on = lambda x: F.col("a.doc_id").eqNullSafe(F.col(f"{x}.doc_id")) & (F.col("a.text_hash") == F.col(f"{x}.text_hash"))
    return (a.join(b, on("b"), "left").join(c, on("c"), "left").select(
        "a.doc_id", "a.text_hash", "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
        .withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", F.col("n_hit") > 0))


def drop_contaminated(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of an item.

    Null and empty texts hold none and stay, null ids too; rows that repeat id
    and text go or stay together. Columns may have any name; an empty table
    gives an empty result, empty items leave all rows.
    """
    own_id, own_hash = free_names(docs, "id", "hash")
    bad = (contamination(docs, items, length).where("contaminated")
           .select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).distinct())
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_hash)), "left_anti")
