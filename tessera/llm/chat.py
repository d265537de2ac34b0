"""Chat transcripts: a hidden Markov model over speaker markers and line features, decoded by Viterbi.

States are the roles, each as first line of a turn or as a later line. A line shows the class of its
speaker marker (none, anonymous, or one of a role) and a feature class (length, question, list or
code). The model is counted from labelled conversations (add-one smoothed), by native aggregation.

Lines are sorted over all tasks and numbered there; each ``BLOCK`` consecutive numbers are a block, so a
block holds a bounded number of lines, whatever their conversations and turns. Conversations within one
block are decoded as they are. Of one that crosses blocks, each piece first becomes a max-plus matrix
(best score from each state before it to each state at its end); ``FAN`` neighbouring matrices are
multiplied into one until a conversation has at most FAN, and on the way back down each level fixes the
states at the ends of the pieces below, between which they are decoded apart: the same path as decoding
the conversation whole.

Every line gets a canonical rendering: a first line opens its turn with the role's tag and loses its
marker, so the renderings of a conversation, in order, are its canonical transcript.

Defined cases: a null text is one empty line; very long texts and lines are taken whole; rows that
repeat conversation, turn and text count once; null conversation ids form one conversation, null turns
come first; equal turns are ordered by the hash of their text; a conversation starts with its least turn;
with no labelled rows the smoothed counts are uniform; empty tables give an empty result; columns other
than the named ones are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # 2 * role: first line of a turn, + 1: later line
#: Words that name a speaker, by role.
SPEAKERS = {"system": "system|note|context", "user": "user|human|customer|question|q|instruction|prompt", "assistant": "assistant|ai|bot|agent|answer|a|response|model"}
#: Marker classes: none, anonymous, then the roles.
MARKERS = 2 + len(ROLES)
FEATURES = 4 * 2 * 2
BLOCK = 512
FAN = 512
TAG = {r: f"<|{r}|>" for r in ROLES}
STYLES = {
    "user": ["User: ", "Human: ", "### Instruction:\n", "<|user|>", "- ", "Q: "],
    "assistant": ["Assistant: ", "AI: ", "### Response:\n", "<|assistant|>", "- ", "A: "],
    "system": ["System: ", "[system] ", "### System:\n", "<|system|>", "- ", "Note: "],
}


def marker_pattern(words: str) -> str:
    """A named marker: "Name:", "[name]", "### Name:" or "<|name|>"."""
    return rf"(?i)^\s*(?:(?:#+\s*)?(?:{words})\s*:|\[(?:{words})\]|<\|(?:{words})\|>)\s*"


ANONYMOUS = r"^\s*(?:[-–—>]\s+)"


def observations(lines: DataFrame) -> DataFrame:
    """``lines`` with ``obs`` (marker class * FEATURES + feature class) and ``body`` (the line without its marker)."""
    line = F.col("line")
    marker = F.when(line.rlike(ANONYMOUS), 1).otherwise(0)
    body = F.when(line.rlike(ANONYMOUS), F.regexp_replace(line, ANONYMOUS, "")).otherwise(line)
    for k, role in enumerate(ROLES):
        pattern = marker_pattern(SPEAKERS[role])
        marker = F.when(line.rlike(pattern), k + 2).otherwise(marker)
        body = F.when(line.rlike(pattern), F.regexp_replace(line, pattern, "")).otherwise(body)
    n = F.length(line)
    size = F.when(n < 20, 0).when(n < 80, 1).when(n < 240, 2).otherwise(3)
    question = line.rlike(r"\?\s*$").cast("int")
    listed = line.rlike(r"^\s*(?:\d+[.)]|[*•]|```|    )").cast("int")
    return lines.withColumns({"obs": (marker * FEATURES + size * 4 + question * 2 + listed).cast("int"), "body": body})


def split_lines(rows: DataFrame, conv_col: str, turn_col: str, raw: Column, *more: Column) -> DataFrame:
    """(conv, turn, tie, line_no, line) of transcript pieces; ``tie`` orders rows of equal turns."""
    pieces = rows.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(raw, F.lit("")).alias("raw"), *more)
    pieces = pieces.withColumn("tie", F.sha2("raw", 256)).dropDuplicates(["conv", "turn", "tie"])
    return pieces.select("conv", "turn", "tie", *[c for c in pieces.columns if c not in ("conv", "turn", "tie", "raw")], F.posexplode(F.split("raw", "\n")).alias("line_no", "line"))


def raw_form(role: Column, text: Column, conv: Column) -> Column:
    """A labelled turn as transcript text, in the style that its conversation's number picks."""
    n = len(STYLES["user"])
    style = F.pmod(F.xxhash64(conv), F.lit(n))
    out = F.lit("- ")
    for name, forms in STYLES.items():
        for k, form in enumerate(forms):
            out = F.when((role == name) & (style == k), form).otherwise(out)
    return F.concat(out, F.coalesce(text, F.lit("")))


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit  # logarithms

    def transfer(self, obs: np.ndarray) -> np.ndarray:
        """Best score from each state before the lines to each state at their last."""
        out = self.move + self.emit[:, obs[0]]
        for o in obs[1:]:
            out = (out[:, :, None] + self.move[None]).max(axis=1) + self.emit[:, o]
        return out

    def path(self, obs: np.ndarray, before: int = -1, last: int = -1) -> np.ndarray:
        """Best states of the lines after state ``before`` (-1: the start), ending in ``last`` (-1: any)."""
        score = (self.start if before < 0 else self.move[before]) + self.emit[:, obs[0]]
        back = np.zeros((len(obs), STATES), np.int8)
        for t in range(1, len(obs)):
            each = score[:, None] + self.move
            back[t] = each.argmax(axis=0)
            score = each.max(axis=0) + self.emit[:, obs[t]]
        out = np.empty(len(obs), np.int8)
        out[-1] = score.argmax() if last < 0 else last
        for t in range(len(obs) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out


def train(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Model:
    """Counts over all labelled rows: turn order, turn lengths, markers and features by state."""
    role = F.lower(F.col(role_col).cast("string"))
    known = rows.where(role.isin(*ROLES))
    own = known.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), role.alias("r"), F.col(text_col).cast("string").alias("x")).dropDuplicates()
    index = F.when(F.col("r") == "system", 0).when(F.col("r") == "user", 1).otherwise(2)
    lines = split_lines(own, "c", "t", raw_form(F.col("r"), F.col("x"), F.col("c")), index.alias("role"))
    seen = observations(lines).groupBy((F.col("role") * 2 + (F.col("line_no") > 0).cast("int")).alias("state"), "obs").agg(F.count(F.lit(1)).alias("n")).collect()
    # the roles of each turn number, each once: at most three rows
    after = own.select("c", F.col("t").cast("long").alias("t"), index.alias("r")).distinct()
    nexts = after.select("c", (F.col("t") - 1).alias("t"), F.col("r").alias("s"))
    moves = after.join(nexts, ["c", "t"]).groupBy("r", "s").agg(F.count(F.lit(1)).alias("n")).collect()
    firsts = after.groupBy("c").agg(F.min(F.struct("t", "r")).alias("least")).groupBy("least.r").agg(F.count(F.lit(1)).alias("n")).collect()
    emit = np.zeros((STATES, MARKERS * FEATURES))
    for r in seen:
        emit[r["state"], r["obs"]] += r["n"]
    first, later = emit[0::2].sum(axis=1), emit[1::2].sum(axis=1)
    by_marker = emit.reshape(STATES, MARKERS, FEATURES)
    p_marker = (by_marker.sum(axis=2) + 1) / (by_marker.sum(axis=(1, 2)) + MARKERS)[:, None]
    p_feature = (by_marker.sum(axis=1) + 1) / (by_marker.sum(axis=(1, 2)) + FEATURES)[:, None]
    turn = np.ones((len(ROLES), len(ROLES)))
    for r in moves:
        turn[r["r"], r["s"]] += r["n"]
    turn /= turn.sum(axis=1, keepdims=True)
    more = (later + 1) / (first + later + 2)  # how often another line of the same turn follows
    move = np.zeros((STATES, STATES))
    for a in range(len(ROLES)):
        for state in (2 * a, 2 * a + 1):
            move[state, 2 * a + 1] = more[a]
            move[state, 0::2] += (1 - more[a]) * turn[a]
    begin = np.ones(len(ROLES))
    for r in firsts:
        begin[r["r"]] += r["n"]
    start = np.full(STATES, 1e-9)
    start[0::2] = begin / begin.sum()
    return Model(np.log(start), np.log(np.maximum(move, 1e-12)), np.log((p_marker[:, :, None] * p_feature[:, None, :]).reshape(STATES, -1)))


ORDER = ["turn", "tie", "line_no"]


def run_starts(conv: pa.ChunkedArray) -> np.ndarray:
    """Where the value changes in a sorted column, which may hold nulls; the end last."""
    known = conv.is_valid().to_numpy()
    value = conv.fill_null(0).to_numpy()
    new = (value[1:] != value[:-1]) | (known[1:] != known[:-1])
    return np.flatnonzero(np.r_[True, new, True])


MATRIX = "conv bigint, block bigint, head boolean, m array<double>"


def one_matrix(t: pa.Table, m: np.ndarray, block: int) -> pa.Table:
    """A row of MATRIX with the group's conversation, its first piece's ``head`` and m."""
    return pa.table({"conv": t.column("conv").slice(0, 1).combine_chunks(), "block": pa.array([block], pa.int64()), "head": t.column("head").slice(0, 1).combine_chunks(), "m": pa.array([m.ravel().tolist()], pa.list_(pa.float64()))})


def matrices(t: pa.Table) -> np.ndarray:
    return np.array(t.column("m").to_pylist()).reshape(-1, STATES, STATES)


def product(t: pa.Table) -> pa.Table:
    t = t.sort_by("block")
    out, *more = matrices(t)
    for m in more:
        out = (out[:, :, None] + m[None]).max(axis=1)
    return one_matrix(t, out, t.column("above")[0].as_py())


def bounds(t: pa.Table) -> pa.Table:
    """The states before and at the end of each of the pieces, between those of all of them if these are given."""
    t = t.sort_by("block")
    given = "before" in t.column_names
    before, last = (t.column(c)[0].as_py() if given else -1 for c in ("before", "last"))
    first, *more = matrices(t)
    score = first[max(before, 0)]  # the rows of a conversation's first matrix are equal
    back = []
    for m in more:
        each = score[:, None] + m
        back.append(each.argmax(axis=0))
        score = each.max(axis=0)
    ends = [int(score.argmax()) if last < 0 else last]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    ends = ends[::-1]
    return pa.table({"conv": t.column("conv"), "block": t.column("block"), "before": pa.array([before, *ends[:-1]], pa.int32()), "last": pa.array(ends, pa.int32())})


def piece_ends(pieces: DataFrame) -> DataFrame:
    """(conv, block, before, last) of rows of MATRIX: the states at the ends of each piece on the best path."""
    schema = "conv bigint, block bigint, before int, last int"
    if pieces.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FAN).isEmpty():
        return pieces.groupBy("conv").applyInArrow(bounds, schema)
    pieces = pieces.withColumn("above", F.expr(f"block div {FAN}"))
    upper = durable(pieces.groupBy("conv", "above").applyInArrow(product, MATRIX))
    given = piece_ends(upper).select(F.col("conv").alias("hc"), F.col("block").alias("hb"), "before", "last")
    told = pieces.join(given, F.col("conv").eqNullSafe(F.col("hc")) & (F.col("above") == F.col("hb")))
    return told.select("conv", "block", "m", "above", "before", "last").groupBy("conv", "above").applyInArrow(bounds, schema)


def parse(lines: DataFrame, model: Model) -> DataFrame:
    """conv, turn, tie, line_no, role, begins and rendered of transcript lines (of ``split_lines``)."""
    seen = observations(lines).select("conv", *ORDER, "obs", "body")
    seen = seen.repartitionByRange("conv", *ORDER).sortWithinPartitions("conv", *ORDER).withColumn("at", F.monotonically_increasing_id())
    seen = durable(seen.withColumn("block", F.expr(f"at div {BLOCK}")))
    blocks = durable(seen.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n")))
    spans = blocks.groupBy("conv").agg(F.min("block").alias("first"), F.max("block").alias("final")).where("first < final").select(F.col("conv").alias("c"), "first")
    pieces = blocks.join(spans, F.col("conv").eqNullSafe(F.col("c"))).select(F.col("conv").alias("hc"), F.col("block").alias("hb"), (F.col("block") == F.col("first")).alias("head"))
    at_piece = F.col("conv").eqNullSafe(F.col("hc")) & (F.col("block") == F.col("hb"))

    def matrix(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        obs = t.column("obs").to_numpy()
        m = model.transfer(obs)
        if t.column("head")[0].as_py():
            score = model.start + model.emit[:, obs[0]]
            for o in obs[1:]:
                score = (score[:, None] + model.move).max(axis=0) + model.emit[:, o]
            m = np.tile(score, (STATES, 1))
        return one_matrix(t, m, t.column("block")[0].as_py())

    crossing = seen.join(pieces, at_piece).select("conv", "block", "at", "obs", "head")
    fixed = piece_ends(durable(crossing.groupBy("conv", "block").applyInArrow(matrix, MATRIX)))
    fixed = fixed.select(F.col("conv").alias("hc"), F.col("block").alias("hb"), "before", "last")

    def decoded(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        at, obs = run_starts(t.column("conv")), t.column("obs").to_numpy()
        before, last = (t.column(c).to_numpy() for c in ("before", "last"))
        states = [model.path(obs[s:e], int(before[s]), int(last[s])) for s, e in zip(at, at[1:])]
        return t.select(["conv", *ORDER]).append_column("state", pa.array(np.concatenate(states).astype(np.int32))).append_column("body", t.column("body"))

    none = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    told = seen.join(fixed, at_piece, "left").select("conv", *ORDER, "at", "block", "obs", "body", none("before"), none("last"))
    states = told.groupBy("block").applyInArrow(decoded, "conv bigint, turn bigint, tie string, line_no int, state int, body string")
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.col("state") / 2).cast("int") + 1)
    begins = F.col("state") % 2 == 0
    return states.select("conv", *ORDER, role.alias("role"), begins.alias("begins"), F.when(begins, F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("body"))).otherwise(F.col("body")).alias("rendered"))
