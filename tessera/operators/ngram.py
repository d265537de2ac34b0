"""Sequence models of token streams: counts of contexts, pruning, longest-suffix lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ORDER, MAX_STATES, MAX_NEXT = 6, 200_000, 64


def streams(rows: DataFrame, stream_col: str, order_cols: list[str], token_col: str, order: int) -> DataFrame:
    """(stream, token, back): each token with the array of up to order - 1 tokens before it, oldest first."""
    if not 1 <= order <= MAX_ORDER:
        raise ValueError(f"order must be 1 .. {MAX_ORDER}")
    by = Window.partitionBy(stream_col).orderBy(*order_cols)
    before = F.array(*[F.lag(token_col, k).over(by) for k in range(order - 1, 0, -1)]) if order > 1 else F.array().cast("array<string>")
    return rows.select(F.col(stream_col).alias("stream"), F.col(token_col).alias("token"), F.filter(before, lambda t: t.isNotNull()).alias("back"))


def context_text(context: Column) -> Column:
    return F.array_join(context, " ")


def state_id(context: Column) -> Column:
    """The id of a model's state, by its context."""
    return F.sha2(F.concat(F.lit("state "), context), 256)


def counts(history: DataFrame) -> DataFrame:
    """(context, ctx_len, next, cnt) over all context lengths; the context is its tokens joined by blanks."""
    n = F.size("back")
    contexts = F.transform(F.sequence(F.lit(0), n), lambda k: F.slice("back", n - k + 1, k))
    each = history.select("token", F.explode(contexts).alias("context"))
    return each.groupBy(context_text(F.col("context")).alias("context"), F.size("context").cast("bigint").alias("ctx_len"), F.col("token").alias("next")).agg(F.count(F.lit(1)).alias("cnt"))


def pruned(model: DataFrame, max_next: int = MAX_NEXT, max_states: int = MAX_STATES) -> DataFrame:
    """The ``max_next`` commonest tokens of each context, of the ``max_states`` contexts with most kept counts."""
    at = ["context", "ctx_len"]
    kept = model.withColumn("place", F.row_number().over(Window.partitionBy(*at).orderBy(F.col("cnt").desc(), "next")).cast("bigint")).where(F.col("place") <= max_next)
    best = kept.groupBy(*at).agg(F.sum("cnt").alias("state_cnt")).orderBy(F.col("state_cnt").desc(), F.col("ctx_len").desc(), "context").limit(max_states)
    return kept.join(best, at)


def next_choices(model: DataFrame, histories: DataFrame) -> DataFrame:
    """(stream, ctx_len, next, cnt): for each stream's last tokens (array ``back``) the choices of the
    longest suffix that is a state; no mixing of shorter ones."""
    n = F.size("back")
    asked = histories.select("stream", F.explode(F.transform(F.sequence(F.lit(0), n), lambda k: F.slice("back", n - k + 1, k))).alias("c")).select("stream", context_text(F.col("c")).alias("context"), F.size("c").cast("bigint").alias("ctx_len"))
    found = asked.join(model.select("context", "ctx_len", "next", "cnt"), ["context", "ctx_len"])
    longest = F.max("ctx_len").over(Window.partitionBy("stream"))
    return found.withColumn("_most", longest).where("ctx_len = _most").select("stream", "ctx_len", "next", "cnt")


def allowed(choices: DataFrame, allow: DataFrame) -> DataFrame:
    """Choices that an allow-list (site, tone, next) admits."""
    return choices.join(allow, ["site", "tone", "next"], "left_semi")


def traces(plans: DataFrame) -> DataFrame:
    """(id, trace): plan item kinds of an answer, in order, between its opening and closing tokens."""
    item = F.struct("item_ix", F.concat(F.lit("item:"), "kind").alias("token"))
    body = plans.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["token"]).alias("body"))
    return body.select("id", F.concat(F.array(F.lit("open")), "body", F.array(F.lit("close"))).alias("trace"))


def corpus_hash(history: DataFrame) -> str:
    """Hash of all streams' tokens and what stands before them, for a model's record of its training data."""
    from tessera.sources.store import content_id

    return content_id(history.select("stream", "token", context_text(F.col("back")).alias("back")))
