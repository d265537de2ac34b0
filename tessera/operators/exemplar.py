"""Exemplars: which kinds of answers conversations ask for, how often, and the best match for a message."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.conversation import last_user_turns
from tessera.operators.pragmatics import FLAGS, directives, features

REFS = 16
#: What a match of mode, style, tone and each of four flags is worth.
WORTH = {"mode": 100, "style": 50, "tone": 20}
MATCHED_FLAGS = ["compare", "recommend", "summarize", "explain"]
FLAG_WORTH = 10


def described(messages: DataFrame) -> DataFrame:
    """Each conversation's last user message with mode, style, tone and the flags that exemplars keep."""
    last = messages.join(last_user_turns(messages), "conv_id").where((F.col("role") == "user") & (F.col("turn") == F.col("query_turn")))
    return keyed(directives(features(last)))


def keyed(told: DataFrame) -> DataFrame:
    """What exemplars are matched by, of rows of ``pragmatics.directives``."""
    bits = sum(1 << FLAGS.index(f) for f in MATCHED_FLAGS)
    return told.select("conv_id", "turn", "mode", "style", "tone", F.col("flags").bitwiseAND(F.lit(bits)).alias("flags"))


def mined(messages: DataFrame) -> DataFrame:
    """(mode, style, tone, flags, support, refs): up to REFS conversations of least id as references."""
    rows = described(messages).select("conv_id", "mode", "style", "tone", "flags").distinct()
    keys = ["mode", "style", "tone", "flags"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("conv_id"))
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("support"))
    refs = rows.withColumn("_n", place).where(F.col("_n") <= REFS).groupBy(*keys).agg(F.array_sort(F.collect_list("conv_id")).alias("refs"))
    return counted.join(refs, keys)


def best_match(asked: DataFrame, exemplars: DataFrame) -> DataFrame:
    """The exemplar of greatest worth for each described message; then more support, then least key.

    Exemplars have at most modes x styles x tones x 16 rows (under 2000), so they are broadcast.
    """
    e = exemplars.select(*[F.col(c).alias(f"e_{c}") for c in ("mode", "style", "tone", "flags")], "support")
    worth = F.lit(0)
    for c, n in WORTH.items():
        worth = worth + F.when(F.col(c) == F.col(f"e_{c}"), n).otherwise(0)
    for f in MATCHED_FLAGS:
        bit = F.lit(1 << FLAGS.index(f))
        worth = worth + F.when(F.col("flags").bitwiseAND(bit) == F.col("e_flags").bitwiseAND(bit), FLAG_WORTH).otherwise(0)
    met = asked.crossJoin(F.broadcast(e)).withColumn("worth", worth.cast("bigint"))
    order = Window.partitionBy("conv_id", "turn").orderBy(F.col("worth").desc(), F.col("support").desc(), "e_mode", "e_style", "e_tone", "e_flags")
    return met.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("conv_id", "turn", "e_mode", "e_style", "e_tone", "e_flags", "worth", "support")


def applied(plan: DataFrame, match: DataFrame) -> DataFrame:
    """Plan items told the way the matching exemplar's style asks: steps for procedures, else bullets."""
    style = F.col("e_style")
    kind = F.when((F.col("kind") == "bullet") & style.isin("StepByStep", "Checklist"), "step").when((F.col("kind") == "step") & (style == "Default"), "bullet").otherwise(F.col("kind"))
    out = plan.join(match.select(F.col("conv_id").alias("id"), "e_style"), "id", "left")
    return out.withColumn("kind", F.when(style.isNull(), F.col("kind")).otherwise(kind)).drop("e_style")
