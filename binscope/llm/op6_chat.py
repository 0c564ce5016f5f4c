"""Operator 6: chat transcripts to canonical turns by a hidden Markov model.

A transcript is a sequence of lines. Hidden states are the speakers; a line's
speaker marker, length, question mark and place in its block are what one
sees. Transition and emission probabilities are counted from turns with a
known role; Viterbi recovers the roles of every transcript, which is then
rendered turn by turn.

Long conversations are cut into segments by turn number; where turns repeat,
or have no number, further by a hash of the text and by rows, so a segment is
never more than a few hundred rows. A segment's best path from each entry
state to each exit state is a small table (max-plus product), the tables of a
conversation give the states at the cuts, first over sorted parts and then
inside them, and each segment then finds its own path, so no task holds a long
conversation.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binscope.llm.common import small_side, stored

#: fixed values: speaker words and the role they name
MARKERS = {"system": "system", "context": "system", "user": "user", "human": "user", "question": "user", "q": "user",
           "customer": "user", "prompter": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant",
           "gpt": "assistant", "model": "assistant", "answer": "assistant", "a": "assistant"}
MARKER = re.compile(r"^\s*(?:#+\s*|\*\*|<\|?|\[)?([A-Za-z]+)(?:\*\*|\|?>|\])?\s*[:>\]]\s*")
#: turns in a segment; a segment with more than ``CROWD`` rows a turn is cut further, into this many rows
SEGMENT = 256
CROWD = 4
#: segments in a sorted part of the segment tables
PART = 50_000
#: segment of the turns without a number, after all others
NO_TURN = 1 << 62
#: what names a segment: turn range, then turn, place of the text's hash and place among equal rows
KEY = ["conv_id", "seg", "sub", "bucket", "piece"]
ROLES = ["system", "user", "assistant"]
#: observations: marker (none or a role) x first turn or later x length class x question mark
SIZES = (40, 120, 300, 700)
N_OBS = (len(ROLES) + 1) * 2 * (len(SIZES) + 1) * 2


def marker(line: str) -> tuple[int, str]:
    """(1 + role number or 0, text after the marker) of a line."""
    m = MARKER.match(line)
    role = MARKERS.get(m.group(1).lower()) if m else None
    return (ROLES.index(role) + 1, line[m.end():]) if role else (0, line)


def observation(first: bool, text: str | None) -> int:
    """What one sees of a turn, as a number under ``N_OBS``."""
    mark, body = marker(text or "")
    size = int(np.searchsorted(SIZES, len(body), side="right"))
    return ((mark * 2 + int(first)) * (len(SIZES) + 1) + size) * 2 + int(body.rstrip().endswith(("?", "？")))


def observed(turns: DataFrame) -> DataFrame:
    """Add ``seg``, ``first`` and ``obs`` to ``turns(conv_id, turn, role, text)``."""
    @F.pandas_udf("int")
    def see(first: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([observation(bool(a), t) for a, t in zip(first, text)], dtype="int32")
    first = F.coalesce(F.col("turn") == 0, F.lit(False))
    return (turns.withColumn("seg", F.coalesce(F.floor(F.col("turn") / SEGMENT).cast("long"), F.lit(NO_TURN)))
            .withColumn("obs", see(first, F.col("text"))))


def fit(turns: DataFrame) -> dict[str, np.ndarray]:
    """Start, transition and emission log-probabilities, counted over all turns with a known role.

    Emissions are learnt from the bodies, since given turns rarely carry
    markers; a marker that names a role is taken to be right 19 times in 20.
    Successors are found by a join on (conversation, turn + 1), which splits
    however long a conversation is; each row of a turn counts with each of the
    next one, by multiplied counts.
    """
    known = turns.where(F.lower("role").isin(ROLES)).select("conv_id", "turn", F.lower("role").alias("role"), "obs")
    start, trans = np.ones(len(ROLES)), np.ones((len(ROLES), len(ROLES)))
    emit = np.full((len(ROLES), N_OBS // (len(ROLES) + 1)), 0.5)
    plain = emit.shape[1]
    for r in known.groupBy("role", (F.col("obs") % plain).alias("o")).count().collect():
        emit[ROLES.index(r["role"]), r["o"]] += r["count"]
    for r in known.where("turn = 0").groupBy("role").count().collect():
        start[ROLES.index(r["role"])] += r["count"]
    of_turn = known.where("turn is not null").groupBy("conv_id", "turn", "role").agg(F.count("*").cast("double").alias("n"))
    nxt = of_turn.select(F.col("conv_id").alias("c"), (F.col("turn") - 1).alias("t"), F.col("role").alias("to"),
                         F.col("n").alias("m"))
    for r in (of_turn.join(nxt, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")))
              .groupBy("role", "to").agg(F.sum(F.col("n") * F.col("m")).alias("pairs")).collect()):
        trans[ROLES.index(r["role"]), ROLES.index(r["to"])] += r["pairs"]
    emit /= emit.sum(1, keepdims=True)
    marks = np.full((len(ROLES), len(ROLES) + 1), 0.025)
    marks[:, 0] = 1.0
    marks[np.arange(len(ROLES)), np.arange(len(ROLES)) + 1] = 0.95
    full = (marks[:, :, None] * emit[:, None, :]).reshape(len(ROLES), N_OBS)
    return {"start": np.log(start / start.sum()), "trans": np.log(trans / trans.sum(1, keepdims=True)),
            "emit": np.log(full)}


def segment_table(obs: np.ndarray, model: dict) -> np.ndarray:
    """Best log-probability from the start (row 0) or the state before a segment (1 + state) to its last state."""
    best = np.vstack([model["start"], model["trans"]]) + model["emit"][:, obs[0]]
    for o in obs[1:]:
        best = (best[:, :, None] + model["trans"][None]).max(1) + model["emit"][:, o]
    return best


def chained(tables: list[np.ndarray]) -> np.ndarray:
    """The table of consecutive segments."""
    best = tables[0]
    for t in tables[1:]:
        best = (best[:, :, None] + t[None, 1:]).max(1)
    return best


def viterbi(obs: np.ndarray, model: dict, before: int | None = None, last: int | None = None) -> list[int]:
    """The best states; ``before``: the state ahead (None: the start), ``last``: the fixed final state."""
    score = (model["start"] if before is None else model["trans"][before]) + model["emit"][:, obs[0]]
    back = []
    for o in obs[1:]:
        step = score[:, None] + model["trans"]
        back.append(step.argmax(0))
        score = step.max(0) + model["emit"][:, o]
    path = [int(score.argmax()) if last is None else last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _order(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["turn", "tie"], kind="stable", na_position="last")


def _same(left: str, right: str, columns: list[str]) -> F.Column:
    """Equality of these columns of two aliases, nulls included."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def segments(seen: DataFrame, crowded: DataFrame) -> DataFrame:
    """Rows of ``seen`` under their segment (``KEY``); ``w`` equal rows are one row where they crowd.

    ``crowded(conv_id, seg, turn, n)`` are the turns of the segments with too
    many rows. A turn of n rows is dealt by the order of its texts' hashes to
    buckets of SEGMENT / 2 rows on average, equal rows are counted, and running
    counts cut a bucket into pieces of at most SEGMENT rows.
    """
    marked = seen.alias("s").join(small_side(crowded, crowded.count()).alias("c"), _same("s", "c", ["conv_id", "seg", "turn"]),
                                  "left").select("s.*", "n")
    turn = seen.schema["turn"].dataType
    plain = marked.where("n is null").select("conv_id", "seg", F.lit(0).cast(turn).alias("sub"),
                                             F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("piece"),
                                             "turn", "tie", "text", "obs", F.lit(1).cast("long").alias("w"))
    bucket = F.floor((F.col("tie").cast("double") / float(1 << 64) + 0.5) * F.ceil(F.col("n") / (SEGMENT / 2)))
    runs = (marked.where("n is not null").withColumn("bucket", bucket.cast("long"))
            .groupBy("conv_id", "seg", "turn", "bucket", "tie", "text", "obs").agg(F.count("*").alias("c")))
    # a bucket has about SEGMENT / 2 distinct texts at most
    window = Window.partitionBy("conv_id", "seg", "turn", "bucket").orderBy("tie", "text").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    end, c = F.col("end"), F.col("c")
    cut = lambda x: F.floor(x / SEGMENT).cast("long")
    packed = (runs.withColumn("end", F.sum("c").over(window))
              .withColumn("piece", F.explode(F.sequence(cut(end - c), cut(end - 1))))
              .withColumn("w", F.least(end, (F.col("piece") + 1) * SEGMENT) - F.greatest(end - c, F.col("piece") * SEGMENT)))
    return plain.unionByName(packed.select("conv_id", "seg", F.coalesce("turn", F.lit(0).cast(turn)).alias("sub"), "bucket", "piece", "turn", "tie", "text", "obs", "w"))


def recover_roles(turns: DataFrame, model: dict) -> DataFrame:
    """Add ``role_pred`` to ``observed`` turns, by segment."""
    seen = turns.select("conv_id", "seg", "turn", F.xxhash64("text").alias("tie"), "text", "obs")
    types = {f.name: f.dataType.simpleString() for f in seen.schema}
    key = f"conv_id {types['conv_id']}, seg long, sub {types['turn']}, bucket long, piece long"
    most = CROWD * SEGMENT
    n_seg = seen.groupBy("conv_id", "seg").agg(F.count("*").alias("n"))
    long = stored(n_seg.groupBy("conv_id").agg(F.min("seg").alias("seg0"), F.max("seg").alias("seg1"), F.max("n").alias("n"))
                  .where(f"seg0 <> seg1 or n > {most}"), "long-conversations")
    of_turn = seen.groupBy("conv_id", "seg", "turn").agg(F.count("*").alias("n"))
    if long.where(f"n > {most}").isEmpty():
        crowded = of_turn.limit(0)
    else:
        crowded = stored(of_turn.alias("t").join(n_seg.where(f"n > {most}").alias("f"), _same("t", "f", ["conv_id", "seg"]),
                                                 "leftsemi"), "crowded-turns")
    rows = segments(seen, crowded)

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _order(pdf)
        m = segment_table(np.repeat(pdf["obs"].to_numpy(), pdf["w"]), model)
        return pdf[KEY].head(1).assign(m=[m.ravel().tolist()])
    n_long = long.count()
    of_long = (rows.drop("text").alias("r").join(small_side(long, n_long).alias("l"), _same("r", "l", ["conv_id"]), "leftsemi")
               .groupBy(*KEY).applyInPandas(table, f"{key}, m array<double>"))
    ends = _cuts(stored(of_long, "segment-tables"), key) if n_long else None
    if ends is None:
        joined = rows.withColumn("before", F.lit(0)).withColumn("last", F.lit(None).cast("int"))
    else:
        joined = rows.alias("s").join(ends.alias("e"), _same("s", "e", KEY), "left").select(
            "s.*", F.coalesce("before", F.lit(0)).alias("before"), "last")

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _order(pdf)
        before, last = int(pdf["before"].iloc[0]), pdf["last"].iloc[0]
        pdf = pdf.loc[np.repeat(pdf.index.to_numpy(), pdf["w"])]
        path = viterbi(pdf["obs"].to_numpy(), model, before - 1 if before else None, None if pd.isna(last) else int(last))
        return pd.DataFrame({"conv_id": pdf["conv_id"], "turn": pdf["turn"], "text": pdf["text"],
                             "role_pred": [ROLES[s] for s in path]})
    return joined.groupBy(*KEY).applyInPandas(
        decode, f"conv_id {types['conv_id']}, turn {types['turn']}, text string, role_pred string")


def _cuts(tables: DataFrame, key: str) -> DataFrame:
    """(``KEY``, before, last) of ``tables(KEY, m)``: the row of a segment's table that the best path enters, and its last state.

    The tables are sorted into parts of about PART segments. A conversation's
    parts, at most as many as there are, give the states between them; the
    cuts inside a part follow from those.
    """
    k = len(ROLES)
    n = max(1, -(-tables.count() // PART))
    parts = stored(tables.repartitionByRange(n, *KEY).withColumn("part", F.spark_partition_id()), "sorted-tables")
    as_tables = lambda ms: [np.array(m).reshape(k + 1, k) for m in ms]

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        m = chained(as_tables(pdf.sort_values(KEY[1:])["m"]))
        return pdf[["conv_id", "part"]].head(1).assign(m=[m.ravel().tolist()])

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        ends = _ends(as_tables(pdf["m"]))
        return pdf[["conv_id", "part"]].assign(first=[0, *(e + 1 for e in ends[:-1])], final=ends)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(KEY[1:])
        first = int(pdf["first"].iloc[0])
        ends = _ends(as_tables(pdf["m"]), first, int(pdf["final"].iloc[0]))
        return pdf[KEY].assign(before=[first, *(e + 1 for e in ends[:-1])], last=ends)
    conv = key.split(",")[0]
    outer = (parts.groupBy("conv_id", "part").applyInPandas(whole, f"{conv}, part int, m array<double>")
             .groupBy("conv_id").applyInPandas(between, f"{conv}, part int, first int, final int"))
    return stored(parts.alias("p").join(outer.alias("o"), _same("p", "o", ["conv_id", "part"])).select("p.*", "first", "final")
                  .groupBy("conv_id", "part").applyInPandas(inside, f"{key}, before int, last int"), "cuts")


def _ends(ms: list[np.ndarray], first: int = 0, final: int | None = None) -> list[int]:
    """Last state of each segment on the best path that enters by row ``first`` and, if given, ends in ``final``."""
    score, back = ms[0][first], []
    for m in ms[1:]:
        step = score[:, None] + m[1:]
        back.append(step.argmax(0))
        score = step.max(0)
    path = [int(score.argmax()) if final is None else final]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def render(role, text) -> F.Column:
    """A canonical turn: role tag, body without its speaker marker, end tag."""
    words = "|".join(MARKERS)
    body = F.regexp_replace(F.coalesce(text, F.lit("")),
                            rf"(?i)^\s*(?:#+\s*|\*\*|<\|?|\[)?(?:{words})(?:\*\*|\|?>|\])?\s*[:>\]]\s*", "")
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.trim(body), F.lit("\n<|end|>"))


def canonical_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role_pred, rendered): one row per row of ``turns(conv_id, turn, role, text)``.

    Given roles only serve to learn the model. Turns are taken in order,
    nulls last, equal ones by a hash of their text; a null text is empty; null
    conversation ids form one conversation, cut into segments like any other;
    repeated rows stay, each with its own place on the path. No known role gives uniform probabilities, which the
    markers then decide. An empty table gives an empty result. Extra columns
    are ignored.
    """
    seen = observed(turns.select("conv_id", "turn", "role", "text"))
    model = fit(seen)
    out = recover_roles(seen, model)
    return out.select("conv_id", "turn", "role_pred", render(F.col("role_pred"), F.col("text")).alias("rendered"))


def split_transcripts(transcripts: DataFrame, id_col: str = "conv_id", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) of raw transcripts: a line with a marker, or after a blank line, begins a turn.

    The result goes to :func:`canonical_turns`; roles are null. A null or
    empty transcript has no turns.
    """
    words = "|".join(MARKERS)
    begins = rf"(?im)(?=^[ \t]*(?:#+[ \t]*|\*\*|<\|?|\[)?(?:{words})(?:\*\*|\|?>|\])?[ \t]*[:>\]])|\n[ \t]*\n"
    return (transcripts.select(F.col(id_col).alias("conv_id"), F.split(F.col(text_col), begins, -1).alias("t"))
            .select("conv_id", F.posexplode(F.filter("t", lambda x: F.trim(x, F.lit(" \t\n\r")) != "")).alias("turn", "text"))
            .select("conv_id", F.col("turn").cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), "text"))
